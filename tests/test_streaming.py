import datetime as dt

from threadloom.streaming import text_stream


def test_counts_of_a_stream(spark, tmp_path):
    schema = "doc_id bigint, text string, created_at timestamp"
    rows = [(1, "A b  b", dt.datetime(2025, 1, 1)), (2, None, dt.datetime(2025, 1, 1)), (3, "b", dt.datetime(2025, 1, 3)), (4, "", dt.datetime(2025, 1, 9))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    counts = text_stream.windowed_counts(text_stream.stream_texts(spark, f"{tmp_path}/in", schema), "created_at")
    run = counts.writeStream.format("memory").queryName("streamed").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    got = {(r["window"]["start"].day, r["token"]): r["n"] for r in spark.table("streamed").collect()}
    assert got == {(1, "a"): 1, (1, " b"): 2, (3, "b"): 1}
