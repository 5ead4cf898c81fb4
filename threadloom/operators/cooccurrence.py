"""Windowed token co-occurrence: pairs within a window, both ways, weighted by distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LARGEST = 2**31 - 1
SCHEMA = "i int, j int, value double"
RECORD = np.dtype([("i", "<i4"), ("j", "<i4"), ("value", "<f8")])


def window_pairs(tokens: Column, window: int = 5, weighted: bool = True) -> Column:
    """array of struct(i, j, value) for tokens at most ``window`` apart, in both directions.

    The weight is 1 / distance, or 1. A token next to itself counts twice, once each way.
    """
    size = F.size(tokens)

    def at_distance(d: Column) -> Column:
        left = F.slice(tokens, F.lit(1), size - d)
        right = F.slice(tokens, d + 1, size - d)
        w = F.lit(1.0) / d if weighted else F.lit(1.0)
        one = lambda a, b: F.array(F.struct(a.alias("i"), b.alias("j"), w.alias("value")), F.struct(b.alias("i"), a.alias("j"), w.alias("value")))
        return F.flatten(F.zip_with(left, right, one))

    distances = F.sequence(F.lit(1), F.least(F.lit(window), size - 1))
    return F.when(size >= 2, F.flatten(F.transform(distances, at_distance)))


def cooccurrence(sentences: DataFrame, window: int = 5, weighted: bool = True, check: bool = True) -> DataFrame:
    """(i, j, value) over rows with ``tokens array<int>``; pairs never cross a row.

    Sentences of fewer than two tokens, empty and NULL ones add nothing. With ``check`` an
    id that is NULL or negative raises an error. The sums are combined before the shuffle,
    and a hot pair arrives as one partial sum for each task.
    """
    tokens = F.col("tokens")
    if check:
        bad = F.exists(tokens, lambda t: t.isNull() | (t < 0) | (t > LARGEST))
        tokens = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("token ids must be 0 to 2**31 - 1")).cast("array<int>")).otherwise(tokens)
    pairs = sentences.select(tokens.alias("tokens")).select(F.explode(window_pairs(F.col("tokens"), window, weighted)).alias("p"))
    return pairs.groupBy(F.col("p.i").alias("i"), F.col("p.j").alias("j")).agg(F.sum("p.value").alias("value"))


def shuffle_rows(rows: DataFrame, seed: int = 0) -> DataFrame:
    """The same rows in a random order that depends on the seed and the rows only."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *rows.columns), *rows.columns)


def pack(i: Column, j: Column) -> Column:
    return F.shiftleft(i.cast("bigint"), 32).bitwiseOR(j.cast("bigint"))


def unpack(code: Column) -> tuple[Column, Column]:
    return F.shiftright(code, 32).cast("int"), code.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def write(rows: DataFrame, path: str, sort: bool = True) -> None:
    (rows.orderBy("i", "j") if sort else rows).write.mode("overwrite").parquet(path)


def read(spark, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def count(rows: DataFrame) -> int:
    return rows.count()


def batches(rows: DataFrame, batch_size: int = 100_000) -> Iterator[np.ndarray]:
    """Records on the driver in arrays of at most ``batch_size``, with the fields of `RECORD`.

    Tasks pack their records into blocks of bytes, one row each, and the driver fetches one
    partition after the other. NULL ids become -1 and NULL values NaN.
    """

    def pack_block(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            block = np.empty(part.num_rows, RECORD)
            for name, missing in (("i", -1), ("j", -1), ("value", np.nan)):
                block[name] = pc.fill_null(part[name], missing).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([block.tobytes()], pa.binary())], names=["block"])

    held = np.empty(0, RECORD)
    for row in rows.select("i", "j", "value").mapInArrow(pack_block, "block binary").toLocalIterator(prefetchPartitions=True):
        held = np.concatenate([held, np.frombuffer(bytes(row["block"]), RECORD)])
        while len(held) >= batch_size:
            yield held[:batch_size]
            held = held[batch_size:]
    if len(held):
        yield held
