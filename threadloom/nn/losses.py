"""Losses as aggregates over rows of arrays, and their gradients for each row.

``n`` in a gradient is the number of rows of the batch.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-7


def clip(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values)


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.when(k == label, 1.0).otherwise(0.0))


def categorical_cross_entropy(p: Column, label: Column) -> Column:
    """Mean of -ln p of the true class, p clipped; ``label`` is a class id from 0."""
    return F.avg(-F.log(clip(F.get(p, label))))


def categorical_cross_entropy_gradient(p: Column, label: Column, n: Column) -> Column:
    return F.transform(p, lambda x, k: F.when(k == label, -1 / clip(x) / n).otherwise(F.lit(0.0)))


def mean_squared_error(x: Column, y: Column) -> Column:
    return F.avg(_mean(F.zip_with(x, y, lambda a, b: (a - b) * (a - b))))


def mean_squared_error_gradient(x: Column, y: Column, n: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: -2 * (b - a) / F.size(x) / n)


def binary_cross_entropy(p: Column, y: Column) -> Column:
    return F.avg(_mean(F.zip_with(p, y, lambda a, b: -(b * F.log(clip(a)) + (1 - b) * F.log(1 - clip(a))))))


def binary_cross_entropy_gradient(p: Column, y: Column, n: Column) -> Column:
    return F.zip_with(p, y, lambda a, b: -(b / clip(a) - (1 - b) / (1 - clip(a))) / F.size(p) / n)


def mean_absolute_error(x: Column, y: Column) -> Column:
    return F.avg(_mean(F.zip_with(x, y, lambda a, b: F.abs(a - b))))


def mean_absolute_error_gradient(x: Column, y: Column, n: Column) -> Column:
    """The true gradient, which descends: sign(x - y)."""
    return F.zip_with(x, y, lambda a, b: F.signum(a - b) / F.size(x) / n)
