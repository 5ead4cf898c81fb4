"""Post-processing of token id arrays: flatten, truncate, template, pad."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flatten(nested: Column) -> Column:
    return F.flatten(nested)


def ones(tokens: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(tokens))


def truncate(values: Column, length: int, side: str = "right") -> Column:
    """At most ``length`` values: `right` cuts the end off, `left` the beginning."""
    if side == "right":
        return F.slice(values, 1, length)
    if side == "left":
        return F.slice(values, F.greatest(F.size(values) - length, F.lit(0)) + 1, F.lit(length))
    raise ValueError("side is right or left")


def pad(values: Column, length: int, value: int, side: str = "right") -> Column:
    """At least ``length`` values; never shorter than before."""
    fill = F.array_repeat(F.lit(value), F.greatest(F.lit(length) - F.size(values), F.lit(0)))
    if side == "right":
        return F.concat(values, fill)
    if side == "left":
        return F.concat(fill, values)
    raise ValueError("side is right or left")


def template(tokens: Column, mask: Column, items: list[str], ids: dict[str, int], special: set[str]) -> tuple[Column, Column]:
    """Tokens and mask with the template around them; items that start with $ are the sequence.

    The mask keeps its values in place, is 0 for special tokens and 1 for other items.
    """
    if not any(i.startswith("$") for i in items):
        raise ValueError("the template has no $")
    parts = [tokens if i.startswith("$") else F.array(F.lit(ids.get(i, 0))) for i in items]
    masks = [mask if i.startswith("$") else F.array(F.lit(0 if i in special else 1)) for i in items]
    return F.concat(*parts), F.concat(*masks)
