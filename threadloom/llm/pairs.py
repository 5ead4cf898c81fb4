"""How often two items meet in the same record, and how much more often than chance.

Pairs are packed into 64-bit codes and sorted externally: tasks sort their codes (Spark's
sorter spills sorted runs and merges them), count runs, exchange the counted runs by code,
merge them in a second external sort and count again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import bitmaps
from threadloom.session import finite

_RUN = "code bigint, n bigint, total double"
_ARROW = pa.schema([("code", pa.int64()), ("n", pa.int64()), ("total", pa.float64())])


def pack(a: Column, b: Column) -> Column:
    """Order-preserving 64-bit code of two ids of 0 to 2**31 - 1."""
    return F.shiftleft(a.cast("bigint"), 32).bitwiseOR(b.cast("bigint"))


def _same(t: pa.Table) -> np.ndarray:
    code = t["code"].to_numpy()
    return code[1:] == code[:-1]


def _combine(t: pa.Table, starts: np.ndarray) -> pa.Table:
    code, n, total = (t[c].to_numpy() for c in ("code", "n", "total"))
    return pa.table([code[starts], np.add.reduceat(n, starts), np.add.reduceat(total, starts)], schema=_ARROW)


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return bitmaps.merge_sorted(batches, _same, _combine)


def pair_records(records: DataFrame) -> DataFrame:
    """(sentence_id, a, b, value) with a < b: one row for each sentence that holds the pair.

    Valid records have both ids, not negative; rows that repeat (sentence_id, i, j) count
    once, with the latest value (of equal times the largest). The value of a pair is the
    sum of its two directions; NULL, NaN, infinite and negative values add 0. Records of a
    token with itself make no pair. A NULL sentence_id is one sentence of its own.
    """
    i, j = F.col("i"), F.col("j")
    stamped = F.struct("written_at", "value")
    latest = (
        records.select("sentence_id", "i", "j", "value", "written_at")
        .where((i >= 0) & (j >= 0) & (i != j))
        .groupBy("sentence_id", F.least(i, j).alias("a"), F.greatest(i, j).alias("b"))
        .agg(F.max(F.when(i < j, stamped)).alias("x"), F.max(F.when(i > j, stamped)).alias("y"))
    )
    return latest.select("sentence_id", "a", "b", (finite(F.col("x.value")) + finite(F.col("y.value"))).alias("value"))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(token_a, token_b, n_ab, total_value) from rows (a, b, value), one for each meeting."""
    codes = pairs.select(pack(F.col("a"), F.col("b")).alias("code"), F.lit(1).cast("bigint").alias("n"), F.col("value").alias("total"))
    runs = codes.sortWithinPartitions("code").mapInArrow(_count_runs, _RUN)
    counted = runs.repartition("code").sortWithinPartitions("code").mapInArrow(_count_runs, _RUN)
    return counted.select(
        F.shiftright("code", 32).cast("int").alias("token_a"),
        F.col("code").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("token_b"),
        F.col("n").alias("n_ab"),
        F.col("total").alias("total_value"),
    )


#: Token of the row of `token_sentences` that counts all sentences.
EVERY = -1


def token_sentences(records: DataFrame) -> DataFrame:
    """(token, n) sentences that hold the token as i or j, over the valid records.

    The row with the token `EVERY` counts all sentences, so one pass gives both. An empty
    table has no rows.
    """
    held = F.array("i", "j", F.lit(EVERY))
    return (
        records.where((F.col("i") >= 0) & (F.col("j") >= 0))
        .select("sentence_id", F.explode(held).alias("token"))
        .distinct()
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def count_sentences(tokens: DataFrame) -> int:
    """Number of all sentences, from the table of `token_sentences`."""
    row = tokens.where(F.col("token") == EVERY).first()
    return row["n"] if row else 0


def associations(pairs: DataFrame, tokens: DataFrame, n: int) -> DataFrame:
    """Add n_a, n_b, lift, pmi and log_odds to pair counts.

    lift is n * n_ab / (n_a * n_b). log_odds is the logarithm of the odds ratio of the
    2 x 2 table of sentences, with the continuity correction of 0.5 in each cell, so it is
    finite when a cell is empty. Tokens of one sentence that are too far apart for a record
    do not meet, so n - n_a - n_b + n_ab may fall below 0; the last cell is 0 then. Products
    are formed as doubles, so no count is too large for them. The token counts are joined
    without a hint: the size of the vocabulary decides on the strategy at run time.
    """
    a = tokens.select(F.col("token").alias("token_a"), F.col("n").alias("n_a"))
    b = tokens.select(F.col("token").alias("token_b"), F.col("n").alias("n_b"))
    both = pairs.join(a, "token_a").join(b, "token_b")
    n11, n_a, n_b, total = *(F.col(c).cast("double") for c in ("n_ab", "n_a", "n_b")), F.lit(float(n))
    n10, n01 = n_a - n11, n_b - n11
    n00 = F.greatest(total - n_a - n_b + n11, F.lit(0.0))
    lift = total * n11 / (n_a * n_b)
    odds = (n11 + 0.5) * (n00 + 0.5) / ((n10 + 0.5) * (n01 + 0.5))
    return both.select(
        "token_a", "token_b", "n_ab", "n_a", "n_b", "total_value", lift.alias("lift"), F.log2(lift).alias("pmi"), F.log(odds).alias("log_odds")
    )
