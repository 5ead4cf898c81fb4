"""Vocabularies as tables (id, token, special_name); id 0 is the unknown token."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The special tokens and their names, ids 0 to 6.
SPECIAL = {
    "unk_token": "[UNK]", "pad_token": "[PAD]", "sep_token": "<SEP>", "bos_token": "<BOS>", "eos_token": "<EOS>", "mask_token": "[MASK]", "cls_token": "[CLS]",
}
SCHEMA = "id int, token string, special_name string"


def special_rows(special: dict[str, str] | None = None) -> list[tuple[int, str, str]]:
    return [(k, token, name) for k, (name, token) in enumerate((special or SPECIAL).items())]


def create(spark: SparkSession, special: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(special_rows(special), SCHEMA)


def add(vocabulary: DataFrame, tokens: DataFrame) -> DataFrame:
    """Append the tokens (column ``token``) that are not there yet, in code point order.

    New ids follow the largest id. Ranks come from a range partition with an offset for
    each part, so no task sees all new tokens. NULL tokens are left out.
    """
    new = tokens.select("token").where("token IS NOT NULL").distinct().join(vocabulary.select("token"), "token", "left_anti")
    ranked = _global_rank(new, "token")
    last = vocabulary.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
    fresh = ranked.select((F.col("rank") + F.lit(last)).cast("int").alias("id"), "token", F.lit(None).cast("string").alias("special_name"))
    return vocabulary.select("id", "token", "special_name").unionByName(fresh)


def _global_rank(df: DataFrame, key: str) -> DataFrame:
    """1, 2, ... in the order of ``key`` without a single-task sort."""
    from threadloom.session import materialise

    part = materialise(df.repartitionByRange(F.col(key)).withColumn("part", F.spark_partition_id()))
    local = part.withColumn("row", F.row_number().over(Window.partitionBy("part").orderBy(key)))
    sizes = [(r["part"], r["n"]) for r in part.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()]
    before, offsets = 0, []
    for p, n in sizes:
        offsets.append((p, before))
        before += n
    table = df.sparkSession.createDataFrame(offsets, "part int, before bigint")
    return local.join(F.broadcast(table), "part").select(key, (F.col("row") + F.col("before")).alias("rank"))


def encode(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Add ``id`` to rows with a ``token``: 0 for tokens that are not in the vocabulary."""
    known = vocabulary.select(F.col("id"), F.col("token"))
    return tokens.join(known, "token", "left").withColumn("id", F.coalesce("id", F.lit(0)))


def decode(ids: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Add ``token`` to rows with an ``id``; NULL for an id that is not in the vocabulary."""
    return ids.join(vocabulary.select("id", "token"), "id", "left")


#: Characters of a token list that is sent to the tasks; longer lists are joined (`decode`).
MOST_CHARACTERS = 64 << 20


def decode_arrays(ids: Column, tokens: list[str | None], nested: bool = False) -> Column:
    """Arrays of tokens from arrays of ids, or arrays of arrays if ``nested``; places are kept.

    NULL arrays and NULL ids stay NULL, ids outside the list give NULL. The list is checked
    for its size; beyond it explode the ids and use `decode`.
    """
    if sum(len(t or "") for t in tokens) > MOST_CHARACTERS:
        raise ValueError("the token list is too large to send to the tasks; use decode")
    known = pa.array(tokens, pa.string())

    def look_up(values: pa.Array) -> pa.Array:
        inside = pc.and_(pc.greater_equal(values, 0), pc.less(values, len(known)))
        return known.take(pc.if_else(inside, values, pa.scalar(None, values.type)))

    def unwrap(arrays: pa.Array) -> pa.Array:
        if not pa.types.is_list(arrays.type):
            return look_up(arrays)
        n = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False)
        values = unwrap(arrays.flatten())
        offsets = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
        return pa.ListArray.from_arrays(offsets, values, mask=pc.is_null(arrays)) if arrays.null_count else pa.ListArray.from_arrays(offsets, values)

    @F.arrow_udf("array<array<string>>" if nested else "array<string>")
    def run(arrays: pa.Array) -> pa.Array:
        return unwrap(arrays)

    return run(ids)


def token_list(vocabulary: DataFrame) -> list[str | None]:
    """The tokens by id, NULL for ids between that have none."""
    rows = vocabulary.select("id", "token").collect()
    out: list[str | None] = [None] * (max((r["id"] for r in rows), default=-1) + 1)
    for r in rows:
        out[r["id"]] = r["token"]
    return out


def contains(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    return tokens.join(vocabulary.select("token"), "token", "left_semi")


def encode_with(mapping: Column, token: Column) -> Column:
    """Id by a map literal of a small vocabulary: 0 for unknown tokens."""
    return F.coalesce(F.try_element_at(mapping, token), F.lit(0))


def save(vocabulary: DataFrame, path: str) -> None:
    vocabulary.select("id", "token", "special_name").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def lookup(vocabulary: DataFrame, key: str | int) -> int | str | None:
    """Id of a token (0 if unknown), or token of an id (NULL if there is none)."""
    if isinstance(key, str):
        row = vocabulary.where(F.col("token") == key).select("id").first()
        return row[0] if row else 0
    row = vocabulary.where(F.col("id") == key).select("token").first()
    return row[0] if row else None
