"""The stateless text operators on a stream of texts.

Normalisation, pre-tokenisation and post-processing are column expressions, so they run on
a streaming frame as they are; counts are kept for event-time windows with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text


def stream_texts(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tokens(rows: DataFrame, column: str = "text") -> DataFrame:
    clean = text.lower(text.collapse_blanks(F.col(column)))
    return rows.withColumn("token", F.explode(text.split_keep(clean, text.GPT2)))


def windowed_counts(rows: DataFrame, at: str, window: str = "1 day", late: str = "1 day", column: str = "text") -> DataFrame:
    """(window, token, n) of a stream; rows later than the watermark are left out."""
    counted = tokens(rows.withWatermark(at, late), column).groupBy(F.window(at, window).alias("window"), "token")
    return counted.agg(F.count(F.lit(1)).alias("n"))
