"""Session helpers shared by every operator: table access, spreading, lineage cuts."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder; the path may be a file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``.

    Only a session inside one process (tests, a laptop) that names none gets a temporary
    one; on a cluster such a folder would exist on one machine only, so that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
    elif sc.getCheckpointDir() is None:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="threadloom-checkpoint-"))


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and continue from the files.

    Results that are read more than once go through here, so they are neither computed
    twice nor lost with an executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str | Column, at_least: int | None = None) -> DataFrame:
    """Give CPU-heavy stages at least as many tasks as there are cores.

    A table of one small file is one task; hashing it by a unique key spreads it. Large
    tables already have enough splits and are returned as they are, without a shuffle.
    """
    spark = df.sparkSession
    want = at_least or spark.sparkContext.defaultParallelism
    have = df.rdd.getNumPartitions()
    if have >= want or not keys:
        return df
    return df.repartition(want, *keys)


def summed_blocks(parts: DataFrame, numbers: list[str], block: str, fan_in: int = 32) -> tuple[list[float], np.ndarray | None]:
    """Sums of number columns and of a column of equally long float64 blocks.

    With many tasks the blocks are first added in ``fan_in`` tasks, so that the driver
    receives at most that many. Without rows the block is None.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, total = [0.0] * len(numbers), None
        for b in batches:
            for k, n in enumerate(numbers):
                sums[k] += float(np.sum(b[n].to_numpy()))
            for raw in b[block].to_pylist():
                v = np.frombuffer(raw)
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([*[pa.array([s]) for s in sums], pa.array([total.tobytes()], pa.binary())], names=[*numbers, block])

    schema = ", ".join([*(f"{n} double" for n in numbers), f"{block} binary"])
    parts = parts.select(*[F.col(n).cast("double").alias(n) for n in numbers], block)
    if parts.sparkSession.sparkContext.defaultParallelism > fan_in:
        parts = parts.repartition(fan_in).mapInArrow(add, schema)
    rows = parts.collect()
    sums, total = [sum(r[n] for r in rows) for n in numbers], None
    for r in rows:
        v = np.frombuffer(bytes(r[block]))
        total = v.copy() if total is None else total + v
    return sums, total


def shuffle_width(spark: SparkSession) -> int:
    """Upper bound of the number of tasks after a shuffle."""
    conf = spark.conf
    first = conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return max(int(conf.get("spark.sql.shuffle.partitions")), int(first) if first else 1)


def finite(value: Column) -> Column:
    """``value`` if it is a finite, non-negative number, else 0: NULL, NaN and dirt add nothing."""
    v = value.cast("double")
    bad = v.isNull() | F.isnan(v) | (v < 0) | (v == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(v)

