"""A dense layer as expressions: x W + b for each row, and its gradients as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


#: Weights that a plan may hold as literals; larger layers come as columns or through a model.
MOST_LITERALS = 100_000


def _check(weights) -> None:
    if len(weights) * len(weights[0] if len(weights) else ()) > MOST_LITERALS:
        raise ValueError("too many weights for a plan; give them as array columns or use a model")


def dense(x: Column, weights, biases) -> Column:
    """``weights`` (inputs x outputs) and ``biases`` are driver values or nested array columns."""
    if not isinstance(weights, Column):
        _check(weights)
        weights = F.array(*[_literal(col) for col in zip(*weights, strict=True)])
        biases = _literal(biases)
    products = F.transform(weights, lambda w: F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    return F.zip_with(products, biases, lambda p, b: p + b)


def weight_gradient(rows: DataFrame, x: str, dv: str) -> DataFrame:
    """(i, j, dw): sums of x_i * dv_j over all rows, combined before the shuffle."""
    flat = rows.select(F.posexplode(x).alias("i", "x"), dv).select("i", "x", F.posexplode(dv).alias("j", "d"))
    return flat.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("d")).alias("dw"))


def bias_gradient(rows: DataFrame, dv: str) -> DataFrame:
    return rows.select(F.posexplode(dv).alias("j", "d")).groupBy("j").agg(F.sum("d").alias("db"))


def input_gradient(dv: Column, weights) -> Column:
    """dv W**T for each row."""
    if not isinstance(weights, Column):
        _check(weights)
    rows = weights if isinstance(weights, Column) else F.array(*[_literal(r) for r in weights])
    return F.transform(rows, lambda w: F.aggregate(F.zip_with(dv, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
