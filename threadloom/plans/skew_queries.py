"""Queries of problem 2: results for every key although few keys hold most records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import keyagg
from threadloom.session import materialise, table

HOT_SHARE = 0.02


def p2_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record count, value sum and distinct partners of every key of both sides."""
    profile = keyagg.tree_profile(keyagg.valid_records(table(spark, sf_dir, "cooccurrence")))
    return profile.withColumn("total_value", F.round("total_value", 4))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that hold at least 2 % of the valid records of their side."""
    return keyagg.hot_keys(materialise(p2_profile(spark, sf_dir)), HOT_SHARE)


_GOOD = """
WITH latest AS (
  SELECT sentence_id, i, j, value,
         row_number() OVER (PARTITION BY sentence_id, i, j ORDER BY written_at DESC NULLS LAST, value DESC NULLS LAST) AS rn
  FROM cooccurrence WHERE i >= 0 AND j >= 0),
good AS (
  SELECT i, j, CASE WHEN value IS NULL OR isnan(value) OR isinf(value) OR value < 0 THEN 0.0 ELSE value END AS v
  FROM latest WHERE rn = 1),
profile AS (
  SELECT 'i' AS side, i AS token_id, count(*) AS n_records, sum(v) AS total_value, count(DISTINCT j) AS n_partners FROM good GROUP BY i
  UNION ALL
  SELECT 'j', j, count(*), sum(v), count(DISTINCT i) FROM good GROUP BY j)
"""

QUERIES = {"p2_found": p2_found, "p2_profile": p2_profile}

SQL = {
    "p2_found": _GOOD + "SELECT side, token_id FROM profile WHERE n_records >= 0.02 * (SELECT count(*) FROM good)",
    "p2_profile": _GOOD + "SELECT side, token_id, n_records, round(total_value, 4) AS total_value, n_partners FROM profile",
}
