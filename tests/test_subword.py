import heapq
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.functions import places, text
from threadloom.plans.pipeline import TokenizationPipeline
from threadloom.subword import models, training, words


def plain_merges(counts, budget, kind):
    """Recount everything for every merge."""
    corpus = [([*w, "</s>"] if kind == "bpe" else ["</b>", *w], n) for w, n in counts.items()]
    out = []
    while len(out) < budget:
        pairs, single = {}, {}
        for s, n in corpus:
            for c in s:
                single[c] = single.get(c, 0) + n
            for p in zip(s, s[1:], strict=False):
                pairs[p] = pairs.get(p, 0) + n
        if not pairs:
            break
        score = (lambda p: pairs[p]) if kind == "bpe" else (lambda p: pairs[p] / (single[p[0]] * single[p[1]]))
        best = min(pairs, key=lambda p: (-score(p), p))
        out.append(best)
        merged = []
        for s, n in corpus:
            t = []
            for c in s:
                if t and t[-1] == best[0] and c == best[1]:
                    t[-1] = best[0] + best[1]
                else:
                    t.append(c)
            merged.append((t, n))
        corpus = merged
    return out


def corpus(seed):
    rng = random.Random(seed)
    return {"".join(rng.choice("aabc") for _ in range(rng.randrange(1, 7))): rng.randrange(1, 9) for _ in range(40)}


@pytest.mark.parametrize("kind", ["bpe", "piece"])
def test_training_equals_recounting(spark, kind):
    for seed in range(4):
        counts = corpus(seed)
        df = spark.createDataFrame(list(counts.items()), "word string, freq bigint")
        assert training.train_merges(df, 25, kind) == plain_merges(counts, 25, kind)


@pytest.mark.parametrize("kind", ["bpe", "piece"])
def test_distributed_training_gives_the_same_merges(spark, kind):
    counts = corpus(9)
    df = spark.createDataFrame(list(counts.items()), "word string, freq bigint")
    assert training.train_merges(df, 4, kind, driver_words=3) == plain_merges(counts, 4, kind)


def test_flat_arrays_equal_recounting(monkeypatch):
    """Places one by one and by array operations, with an index built in several stretches."""
    for many, stretch in ((1, 7), (4, 1 << 21), (1 << 30, 50)):
        monkeypatch.setattr(training._Corpus, "MANY", many)
        monkeypatch.setattr(training._Corpus, "STRETCH", stretch)
        for seed in range(12):
            rng = random.Random(seed)
            letters = rng.choice(["ab", "aabc", "</s>b", "aé漢😀"])
            counts = {"".join(rng.choice(letters) for _ in range(rng.randrange(0, 14))): rng.choice([1, 2, 900]) for _ in range(60)}
            for kind in ("bpe", "piece"):
                state, got = training._Corpus(list(counts), list(counts.values()), kind), []
                while len(got) < 50 and (p := state.best()):
                    state.merge(p)
                    got.append(p)
                assert got == plain_merges(counts, 50, kind)


def test_score_bounds_equal_recounting(monkeypatch):
    """Counts that are bounded loosely or exactly, that fall, and symbols made in two ways."""
    for slack in (2, 3, 8):
        monkeypatch.setattr(training._ByScore, "SLACK", slack)
        for seed in range(15):
            rng = random.Random(seed)
            counts = {"".join(rng.choices("01234abxyzé", [9, 8, 7, 6, 5, 4, 3, 2, 1, 1, 1], k=rng.randrange(1, 9))): rng.choice([1, 1, 1, 2, 3, 70, 900]) for _ in range(150)}
            state, got = training._Corpus(list(counts), list(counts.values()), "piece"), []
            while len(got) < 90 and (p := state.best()):
                state.merge(p)
                got.append(p)
            assert got == plain_merges(counts, 90, "piece")


def test_pairs_of_frequent_symbols_are_not_entered_for_each_merge(monkeypatch):
    entered = []

    class Counted:
        heappop, heapify, heapreplace = staticmethod(heapq.heappop), staticmethod(heapq.heapify), staticmethod(lambda heap, x: (entered.append(x), heapq.heapreplace(heap, x))[1])
        heappush = staticmethod(lambda heap, x: (entered.append(x), heapq.heappush(heap, x))[1])

    numbers = [str(k) for k in range(1000, 10_000)]
    tails = ["".join(chr(0x4E00 + 3 * k + x) for x in range(3)) for k in range(1000)]
    words = [*numbers, *(n + t for n, t in zip(numbers, tails, strict=False))]
    state = training._Corpus(words, [50] * len(numbers) + [1] * len(tails), "piece")
    monkeypatch.setattr(training, "heapq", Counted)
    for _ in range(4000):
        state.merge(state.best())
    assert len(entered) < 4 * 4000


def jobs_of_training(spark, kind):
    """Spark jobs that 30 merges over 550,000 distinct words take."""
    df = spark.range(550_000).select(F.lower(F.conv(F.col("id").cast("string"), 10, 36)).alias("word"), F.lit(1).cast("bigint").alias("freq"))
    spark.sparkContext.setJobGroup(f"train {kind}", "")
    assert len(training.train_merges(df, 30, kind)) == 30
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"train {kind}")
    spark.sparkContext.setJobGroup("", "")
    return len(jobs)


def test_jobs_do_not_grow_with_the_merges(spark):
    assert jobs_of_training(spark, "bpe") < 20


def test_jobs_of_word_pieces_do_not_grow_with_the_merges(spark):
    assert jobs_of_training(spark, "piece") < 20


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("aab", min_size=1, max_size=8), st.integers(1, 5)), min_size=1, max_size=12))
def test_driver_merge_handles_runs(pairs):
    counts = dict(pairs)
    state = training._Corpus(list(counts), list(counts.values()), "bpe")
    got = []
    while len(got) < 8 and (p := state.best()):
        state.merge(p)
        got.append(p)
    assert got == plain_merges(counts, 8, "bpe")


def test_replay_equals_greedy(spark):
    df = spark.createDataFrame(list(corpus(3).items()), "word string, freq bigint")
    model = models.BPE.fit(df, 20)
    rows = df.select("word", model.replay(F.col("word")).alias("r"), F.get(model.tokenize(F.array("word")), F.lit(0))["subtokens"].alias("g")).collect()
    assert all(r["r"] == r["g"] == model.split(r["word"]) for r in rows)
    with pytest.raises(ValueError):
        models.BPE([], [("ab", "c"), ("a", "b")]).replay(F.lit("abc"))


def test_dropout_is_lossless_and_repeatable(spark):
    model = models.BPE(["[UNK]"], [("a", "b"), ("ab", "c")])
    df = spark.createDataFrame([(k, ["abcabc", "zab"]) for k in range(20)], "k int, t array<string>")
    split = lambda: df.orderBy("k").select(model.tokenize(F.col("t"), key=F.col("k"), dropout=0.5, seed=1)).collect()
    first = split()
    assert first == split() and len({str(r) for r in first}) > 1
    assert all("".join(w["subtokens"]) == x + "</s>" for r in first for w, x in zip(r[0], ["abcabc", "zab"], strict=True))


def test_split_looks_up_each_pair_once():
    class Counted(dict):
        looked = 0

        def get(self, *args):
            self.looked += 1
            return super().get(*args)

    model = models.BPE(["[UNK]"], [(chr(k), chr(k + 1)) for k in range(97, 121, 2)])
    model.ranks = Counted(model.ranks)
    word = "abcdefghijklmnopqrstuvwx" * 4
    assert "".join(model.split(word)) == word + "</s>" and model.ranks.looked <= 4 * len(word)
    assert models.BPE([], [("a", "a"), ("aa", "a")]).split("aaaaa") == ["aa", "aaa", "</s>"]


def test_word_piece_tries_only_lengths_that_occur():
    class Counted(frozenset):
        tried = 0

        def __contains__(self, x):
            Counted.tried += 1
            return super().__contains__(x)

    model = models.WordPiece(["[UNK]", "</b>", *"abcdefghij", "xy" * 45])
    model.known = Counted(model.known)
    assert model.split("abcdefghij" * 5) == ["</b>", *"abcdefghij" * 5] and Counted.tried <= 60


def test_first_pieces_are_looked_up_behind_the_mark():
    class Counted(frozenset):
        tried = 0

        def __contains__(self, x):
            Counted.tried += 1
            return super().__contains__(x)

    model = models.WordPiece(["[UNK]", "</b>", "</b>q", "</b>qrst", *"qrstu", *("</b>" + "abcdefghij"[k % 10] * k for k in range(4, 90))])
    model.known = Counted(model.known)
    assert model.split("qrstu" * 15) == ["</b>qrst", "u", *"qrstu" * 14] and Counted.tried <= 80
    assert model.split("q") == ["</b>q"] and model.split("qr") == ["</b>q", "r"] and model.split("eeee") == ["</b>eeee"]
    assert model.split("eee") == ["[UNK]"] and model.split("") == ["</b>"]


def test_encoding_leaves_the_subtokens_in_python(spark):
    piece, bpe = models.WordPiece(["[UNK]", "</b>", "</b>ab", "c", "b"]), models.BPE(["[UNK]", "a", "b", "ab"], [("a", "b")])
    rows = [(0, ["abc", "abx", ""]), (1, []), (2, None), (3, ["b"] * 5)]
    df = spark.createDataFrame(rows, "k int, t array<string>")
    drawn = {"key": F.col("k"), "dropout": 0.5, "seed": 3}
    for model, options in ((piece, {}), (bpe, {}), (bpe, drawn)):
        encoded = df.select("k", model.encode(F.col("t"), **options).alias("ids"))
        assert "subtokens" not in encoded._jdf.queryExecution().optimizedPlan().toJSON()
        asked = df.select("k", F.flatten(F.transform(model.tokenize(F.col("t"), **options), lambda t: t["ids"])).alias("ids"))
        assert sorted(encoded.collect()) == sorted(asked.collect())
    assert {r["k"]: r["ids"] for r in df.select("k", piece.encode(F.col("t")).alias("ids")).collect()} == {0: [2, 3, 0, 1], 1: [], 2: None, 3: [1, 4] * 5}


def test_word_piece_unknown_words():
    model = models.WordPiece(["[UNK]", "</b>", "</b>ab", "c", "b"], longest_word=5)
    assert model.split("abc") == ["</b>ab", "c"]
    assert model.split("abx") == ["[UNK]"] and model.split("a" * 6) == ["[UNK]"]


def test_save_and_load(spark, tmp_path):
    df = spark.createDataFrame(list(corpus(1).items()), "word string, freq bigint")
    for model in (models.BPE.fit(df, 10), models.WordPiece.fit(df, 10)):
        models.save(model, spark, f"{tmp_path}/m")
        again = models.load(spark, f"{tmp_path}/m")
        assert type(again) is type(model) and again.vocabulary == model.vocabulary and again.split("abc") == model.split("abc")
    with pytest.raises(NotImplementedError):
        models.Unigram().split("x")


def test_pipeline_lengths_and_nulls(spark):
    docs = spark.createDataFrame([(0, "Brown fox jumps over the lazy dog."), (1, "Hug Hugging Hugged"), (2, ""), (3, None)], "doc_id int, text string")
    rows = {r["doc_id"]: r for r in TokenizationPipeline(merges=20).fit(docs).encode(docs, 10).collect()}
    assert len(rows[0]["ids"]) == 12 and rows[0]["ids"][0] == 3 and rows[0]["ids"][11] == 4
    assert len(rows[2]["ids"]) == 10 and rows[2]["attention_mask"] == [0] * 10 and rows[3]["ids"] is None
    assert all(len(r["ids"]) == len(r["attention_mask"]) for r in rows.values() if r["ids"])


def test_pipeline_parts_can_be_replaced(spark):
    docs = spark.createDataFrame([(0, "Brown  fox jumps"), (1, "the FOX"), (2, None)], "doc_id int, text string")
    pipe = TokenizationPipeline(merges=30, normaliser=text.lower, splitter=text.split_blanks, byte_letters=False, kind=models.WordPiece, items=("[CLS]", "$"), pad_side="left")
    rows = {r["doc_id"]: r for r in pipe.fit(docs).encode(docs, 8, strict=True).collect()}
    known = pipe.model.vocabulary
    assert isinstance(pipe.model, models.WordPiece) and "</b>fox" in known
    assert [known[i] for i in rows[1]["ids"]][-3:] == ["[CLS]", "</b>the", "</b>fox"] and len(rows[1]["ids"]) == 8
    assert {r["doc_id"]: r["subtokens"] for r in pipe.tokenize(docs).collect()}[1] == ["</b>the", "</b>fox"]


def test_subtoken_places(spark):
    model = models.BPE(["[UNK]", "a", "b"], [("a", "b"), ("ab", "</s>")])
    df = spark.createDataFrame([(0, ["ab", " ", "aab"]), (1, []), (2, None)], "k int, t array<string>")
    parts = F.transform(model.tokenize(F.col("t")), lambda t: t["subtokens"])
    got = [r[0] for r in df.orderBy("k").select(places.placed_subtokens(F.col("t"), parts)).collect()]
    flat = [[tuple(p) for p in w] for w in got[0]]
    assert flat == [[("ab</s>", 0, 2)], [(" ", 2, 3), ("</s>", 3, 3)], [("a", 3, 4), ("ab</s>", 4, 6)]] and got[1] == [] and got[2] is None
    piece = models.WordPiece(["[UNK]", "</b>a", "b"])
    parts = F.transform(piece.tokenize(F.col("t")), lambda t: t["subtokens"])
    got = df.where("k = 0").select(places.placed_subtokens(F.col("t"), parts)).first()[0]
    assert [[tuple(p) for p in w] for w in got] == [[("</b>a", 0, 1), ("b", 1, 2)], [("[UNK]", 2, 3)], [("[UNK]", 3, 6)]]


def test_places_come_a_few_texts_at_a_time(spark, sf, monkeypatch):
    """The same places whatever the slice; no array of all subtokens of a text is built."""
    from threadloom.plans import core_queries as q

    plan = q.bpe_places(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "ArrowEvalPython" not in plan
    model = models.BPE(["[UNK]", "a", "b"], [("a", "b"), ("ab", "</s>")])
    df = spark.createDataFrame([(k, ["ab", " ", "aab"]) for k in range(5)] + [(7, []), (8, None)], "k int, t array<string>")
    for size in (2, 256):
        monkeypatch.setattr(places, "TEXTS", size)
        got = [tuple(r) for r in places.subtoken_rows(df, "k", F.col("t"), lambda t: t != " ", model).collect()]
        assert sorted(got) == [x for k in range(5) for x in ((k, "a", 3, 4), (k, "ab</s>", 0, 2), (k, "ab</s>", 4, 6))]


def test_pair_counts_overlap(spark):
    df = spark.createDataFrame([("aaa", 2)], "word string, freq bigint")
    assert {(r["l"], r["r"]): r["n"] for r in words.pair_counts(df).collect()} == {("a", "a"): 4, ("a", "</s>"): 2}


def test_registered_training_has_the_default_budget(spark, sf):
    from threadloom.plans import core_queries as q

    budget = q.merge_budget(spark, sf).first()["merges"]
    assert budget > 200 and q.bpe_train(spark, sf).count() == budget
    start = len(models._start_vocabulary(q._words(spark, sf), "</b>", models.SPECIAL))
    assert q.wp_train(spark, sf).count() > start + 200
    sizes = [r["n"] for r in q.pipeline_encode(spark, sf).where("ids IS NOT NULL").select(F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n")).collect()]
    assert sum(n < q.ENCODED_LENGTH for n in sizes) >= 0.99 * len(sizes)
