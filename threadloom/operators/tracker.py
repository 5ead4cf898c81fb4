"""Histories of values: log every nth call on the driver, or the same over a table."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Tracker:
    def __init__(self, every: int = 1) -> None:
        if every < 1:
            raise ValueError("every is at least 1")
        self.every, self.calls, self.data = every, 0, defaultdict(list)

    def log(self, values: dict) -> None:
        if self.calls % self.every == 0:
            for k, v in values.items():
                self.data[k].append(v)
        self.calls += 1

    def clear(self) -> None:
        self.data.clear()
        self.calls = 0

    def __repr__(self) -> str:
        return ", ".join(f"{k}: {v[-1]}" for k, v in self.data.items())

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(k, name, float(v)) for name, values in self.data.items() for k, v in enumerate(values)]
        return spark.createDataFrame(rows, "step int, metric string, value double")


def _value(column: str = "value") -> Column:
    """A value that is not a number is none: NaN counts as NULL."""
    return F.nanvl(F.col(column), F.lit(None).cast("double"))


def sampled(history: DataFrame, every: int) -> DataFrame:
    """Rows of every nth step; NaN values become NULL."""
    return history.where(F.col("step") % every == 0).withColumn("value", _value())


def last_values(history: DataFrame, *keys: str) -> DataFrame:
    """The value of the largest step of each group; of equal steps the largest value.

    NaN values count as NULL, and NULL is the smallest value.
    """
    return history.groupBy(*keys).agg(F.max(F.struct("step", _value().alias("value"))).alias("last")).select(*keys, "last.step", "last.value")
