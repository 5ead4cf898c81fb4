"""Parameter initialisation: on the driver with NumPy, or as a frame of cells."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NORMAL, UNIFORM = ("normal", "gaussian"), ("uniform",)


@dataclass
class Static:
    number: float = 0.0

    def draw(self, n_inputs: int, n_outputs: int) -> np.ndarray:
        return np.full((n_inputs, n_outputs), float(self.number))

    def frame(self, spark: SparkSession, n_inputs: int, n_outputs: int) -> DataFrame:
        return _cells(spark, n_inputs, n_outputs).withColumn("value", F.lit(float(self.number)))


@dataclass
class Random:
    """N(0, 1) * multiplier, or U(-alpha, alpha) * multiplier."""

    mode: str = "normal"
    multiplier: float = 1.0
    alpha: float = 1.0
    seed: int | None = None

    def __post_init__(self) -> None:
        if self.mode not in NORMAL + UNIFORM:
            raise ValueError(f"mode is normal, gaussian or uniform, not {self.mode}")

    def spread(self, n_inputs: int, n_outputs: int) -> float:
        """Standard deviation of the normal mode, bound of the uniform one."""
        return self.multiplier * (self.alpha if self.mode in UNIFORM else 1.0)

    def draw(self, n_inputs: int, n_outputs: int) -> np.ndarray:
        rng, s = np.random.default_rng(self.seed), self.spread(n_inputs, n_outputs)
        shape = (n_inputs, n_outputs)
        return rng.uniform(-s, s, shape) if self.mode in UNIFORM else rng.normal(0.0, 1.0, shape) * s

    def frame(self, spark: SparkSession, n_inputs: int, n_outputs: int) -> DataFrame:
        """The same distribution, drawn by Spark from the seed."""
        s, seed = self.spread(n_inputs, n_outputs), self.seed or 0
        value = (F.rand(seed) * 2 - 1) * s if self.mode in UNIFORM else F.randn(seed) * s
        return _cells(spark, n_inputs, n_outputs).withColumn("value", value)


@dataclass
class XavierGlorot(Random):
    def spread(self, n_inputs: int, n_outputs: int) -> float:
        return math.sqrt((6 if self.mode in UNIFORM else 2) / (n_inputs + n_outputs))


@dataclass
class HeKaiming(Random):
    def spread(self, n_inputs: int, n_outputs: int) -> float:
        return math.sqrt((6 if self.mode in UNIFORM else 2) / n_inputs)


@dataclass
class LeCun(Random):
    def spread(self, n_inputs: int, n_outputs: int) -> float:
        return math.sqrt((3 if self.mode in UNIFORM else 1) / n_inputs)


def _cells(spark: SparkSession, n_inputs: int, n_outputs: int) -> DataFrame:
    return spark.range(n_inputs * n_outputs).select((F.col("id") / n_outputs).cast("int").alias("i"), (F.col("id") % n_outputs).cast("int").alias("j"))
