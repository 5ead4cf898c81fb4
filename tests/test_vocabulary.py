from threadloom.operators import vocabulary as V


def test_create_add_lookup_and_store(spark, tmp_path):
    vocab = V.create(spark)
    more = V.add(vocab, spark.createDataFrame([("b",), ("a",), ("[PAD]",), (None,), ("a",)], "token string"))
    assert [(r["id"], r["token"]) for r in more.orderBy("id").collect()][6:] == [(6, "[CLS]"), (7, "a"), (8, "b")]
    assert V.lookup(more, "a") == 7 and V.lookup(more, "zz") == 0 and V.lookup(more, 8) == "b" and V.lookup(more, 99) is None
    V.save(more, f"{tmp_path}/v")
    assert sorted(map(str, V.load(spark, f"{tmp_path}/v").collect())) == sorted(map(str, more.collect()))
    again = V.add(more, spark.createDataFrame([("a",)], "token string"))
    assert again.count() == more.count()


def test_encode_decode(spark):
    vocab = V.create(spark, {"unk_token": "?", "x": "x"})
    rows = V.encode(spark.createDataFrame([("x",), ("y",), (None,)], "token string"), vocab)
    assert sorted((str(r["token"]), r["id"]) for r in rows.collect()) == [("None", 0), ("x", 1), ("y", 0)]
    back = V.decode(spark.createDataFrame([(1,), (7,)], "id int"), vocab)
    assert {(r["id"], r["token"]) for r in back.collect()} == {(1, "x"), (7, None)}


def test_decode_arrays(spark):
    known = ["[UNK]", "a", None, "b"]
    df = spark.createDataFrame([(0, [1, 3, 1]), (1, []), (2, None), (3, [None, 9, -1, 2])], "k int, ids array<int>")
    got = [r[0] for r in df.orderBy("k").select(V.decode_arrays(df["ids"], known)).collect()]
    assert got == [["a", "b", "a"], [], None, [None] * 4]
    deep = spark.createDataFrame([(0, [[1], [], None, [3, 0]]), (1, None)], "k int, ids array<array<int>>")
    got = [r[0] for r in deep.orderBy("k").select(V.decode_arrays(deep["ids"], known, nested=True)).collect()]
    assert got == [[["a"], [], None, ["b", "[UNK]"]], None]
    assert V.token_list(spark.createDataFrame([(2, "x"), (0, "y")], "id int, token string")) == ["y", None, "x"]
    assert V.token_list(spark.createDataFrame([], "id int, token string")) == []
