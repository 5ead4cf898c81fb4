"""Data sets: contiguous split, shuffle and mini-batches, without a single-task sort."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.vocabulary import _global_rank


def ranked(rows: DataFrame, key: str) -> DataFrame:
    """Add ``rank`` 1, 2, ... in the order of a unique key."""
    return rows.join(_global_rank(rows.select(key), key), key)


def split(rows: DataFrame, key: str, share: float = 0.5) -> DataFrame:
    """Add ``part``: `head` for the first ceil(n * share) rows by key, `tail` for the rest."""
    cut = math.ceil(rows.count() * share)
    return ranked(rows, key).withColumn("part", F.when(F.col("rank") <= cut, "head").otherwise("tail")).drop("rank")


def batches(rows: DataFrame, key: str, size: int | None = None) -> DataFrame:
    """Add ``batch`` 0, 1, ... of consecutive rows by key; the last may be smaller.

    Without a size all rows are one batch.
    """
    if size is None:
        return rows.withColumn("batch", F.lit(0).cast("bigint"))
    return ranked(rows, key).withColumn("batch", F.floor((F.col("rank") - 1) / size)).drop("rank")


def shuffle(rows: DataFrame, key: str, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Add ``place``, a new random order for each epoch, by a hash of key and seed."""
    mixed = rows.withColumn("draw", F.xxhash64(F.lit(seed), F.lit(epoch), key))
    order = F.struct("draw", key)
    keyed = mixed.withColumn("order", order)
    return keyed.join(_global_rank(keyed.select("order"), "order"), "order").withColumnRenamed("rank", "place").drop("order", "draw")
