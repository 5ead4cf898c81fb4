"""Queries of the training-data problems and, where SQL can express them, their oracles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import encode, mixture, pairs, pii, sentences, terms, unify
from threadloom.session import materialise, spread, table

PAIR_LEAST = 4
PAIR_SHARE = 0.001
PAIR_LIFT = 4


def _strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.latest_text(table(spark, sf_dir, "mapped_string"), "string_id", "text", "loaded_at")


def _marked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = materialise(terms.term_counts(_strings(spark, sf_dir)))
    everyone = counts.where(F.col("term").isNull()).first()
    return terms.mark_terms(counts.where(F.col("term").isNotNull()), everyone["n_records"] if everyone else 0)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of exactly one string (rare) or of at least 10 % of all strings (common)."""
    return _marked_terms(spark, sf_dir).where(F.col("mark").isNotNull()).select("term", "mark")


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term with its occurrences, the strings that hold it, and its mark."""
    return _marked_terms(spark, sf_dir)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of strings that read the same but differ in their code points."""
    found = unify.same_to_the_eye(_strings(spark, sf_dir), keep=materialise)
    return found.select(F.col("a").alias("string_id_a"), F.col("b").alias("string_id_b"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per string: the class of strings that read the same, its text's class, and its number of pairs."""
    return unify.eye_classes(_strings(spark, sf_dir), keep=materialise).withColumnRenamed("id", "string_id")


def p3_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's text in the consistent form, with its alignment to the original."""
    rows = table(spark, sf_dir, "mapped_string").select(F.col("string_id").alias("id"), "text", "alignment", "original")
    return unify.unify_strings(spread(rows, "id")).withColumnRenamed("id", "string_id")


def _associations(spark: SparkSession, sf_dir: str, keep=lambda counted, n: counted) -> tuple[DataFrame, int]:
    records = table(spark, sf_dir, "cooccurrence")
    tokens = materialise(pairs.token_sentences(records))
    n = pairs.count_sentences(tokens)
    counted = keep(pairs.pair_counts(pairs.pair_records(records)), n)
    return pairs.associations(counted, tokens, n), n


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that meet in at least 4 sentences, in 0.1 % of all, and 4 times chance.

    The corrected odds ratio chooses them: where n_ab >= 1 and the lift is at least 4, the
    cell of neither is at least 3 (n_ab + n10 + n01) + 4 n10 n01 / n_ab, so the corrected
    ratio is at least 4 as well. The exact check of the lift follows.
    """
    scored, n = _associations(spark, sf_dir, lambda counted, n: counted.where((F.col("n_ab") >= PAIR_LEAST) & (F.col("n_ab") >= PAIR_SHARE * F.lit(n))))
    chosen = scored.where(F.col("log_odds") >= math.log(PAIR_LIFT) - 1e-9)
    return chosen.where(F.lit(float(n)) * F.col("n_ab") >= F.lit(float(PAIR_LIFT)) * F.col("n_a") * F.col("n_b")).select("token_a", "token_b")


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair with its sentences, summed value, lift, PMI and corrected log odds ratio."""
    rounded = {c: F.round(c, 6) for c in ("lift", "pmi", "log_odds")} | {"total_value": F.round("total_value", 4)}
    return _associations(spark, sf_dir)[0].withColumns(rounded)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of every sentence of every string."""
    found = sentences.split_sentences(_strings(spark, sf_dir))
    return found.select(F.col("id").alias("string_id"), "start_pos", "end_pos")


def p5_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every document, with its place."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return sentences.split_sentences(spread(docs, "id")).withColumnRenamed("id", "doc_id")


def p5_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per string its sentences put together again, without white space and control signs."""
    found = sentences.split_sentences(_strings(spark, sf_dir)).groupBy("id")
    whole = found.agg(F.array_sort(F.collect_list(F.struct("start_pos", "sentence"))).alias("s"), F.count(F.lit(1)).alias("n_sentences"))
    text = F.regexp_replace(F.array_join(F.transform("s", lambda s: s["sentence"]), ""), r"[\p{Z}\p{C}]", "")
    return whole.select(F.col("id").alias("string_id"), text.alias("text"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encode.encode_corpus(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"))


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of bytes, and whether the decoded ids are the text."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    encoded = encode.encode_corpus(docs, keep=("doc_id", "text"))
    raw = encode.decode_corpus(encoded, keep=("doc_id", "text"))
    same = F.col("raw") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return raw.select("doc_id", F.length("raw").alias("n_bytes"), same.alias("same"))


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
    sizes = materialise(encode.count_tokens(docs, keep=("doc_id", "source")))
    plan = mixture.source_plan(sizes, table(spark, sf_dir, "source_weights"))
    return mixture.mixture(sizes, plan), plan


def p7_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document goes into the mixture of the sources."""
    return _mixture(spark, sf_dir)[0]


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: target share, reached share and repeats of the mixture."""
    return mixture.mixture_report(*_mixture(spark, sf_dir))


def p7_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source with documents: whether the mixture keeps the repeat cap and reaches its share.

    A share is reached if the tokens miss its part of the planned mixture by at most the
    largest document of the source.
    """
    copies, plan = _mixture(spark, sf_dir)
    per = copies.withColumn("used", F.col("copies") * F.col("n_tokens"))
    per = per.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.max("copies").alias("most"), F.min("copies").alias("least"), F.sum("used").alias("used"), F.max("n_tokens").alias("largest")
    )
    both = per.join(plan.select("source", "max_repeats", "aim_tokens"), "source")
    miss = F.abs(F.col("used") - F.col("aim_tokens"))
    return both.select(
        "source", "n_docs", "max_repeats", ((F.col("most") <= F.col("max_repeats")) & (F.col("least") >= 0)).alias("caps_kept"), (miss <= F.col("largest") + 1e-6 * F.col("aim_tokens")).alias("share_reached")
    )


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the personal information of every document."""
    docs = _documents(spark, sf_dir)
    return pii.find_personal(docs, *pii.train(docs)).withColumnRenamed("id", "doc_id")


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with typed placeholders in place of personal information."""
    docs = _documents(spark, sf_dir)
    return pii.replace_personal(docs, *pii.train(docs)).withColumnRenamed("id", "doc_id")


def p8_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per type: proposed spans, and decisions changed by the estimation and by the classifier."""
    report = pii.train(_documents(spark, sf_dir))[0].report
    return spark.createDataFrame(report, "pii_type string, n_spans bigint, changed_by_estimation bigint, changed_by_classifier bigint")


QUERIES = {
    "p1_found": p1_found, "p1_terms": p1_terms, "p3_found": p3_found, "p3_classes": p3_classes, "p3_unified": p3_unified, "p4_found": p4_found,
    "p4_pairs": p4_pairs, "p5_found": p5_found, "p5_sentences": p5_sentences, "p5_kept": p5_kept, "p6_ids": p6_ids,
    "p6_roundtrip": p6_roundtrip, "p7_copies": p7_copies, "p7_report": p7_report, "p7_kept": p7_kept, "p8_found": p8_found,
    "p8_redacted": p8_redacted, "p8_model": p8_model,
}

_TERMS = r"""
WITH latest AS (
  SELECT string_id, text,
         row_number() OVER (PARTITION BY string_id ORDER BY loaded_at DESC NULLS LAST, text DESC) AS rn
  FROM mapped_string WHERE string_id IS NOT NULL AND text IS NOT NULL),
strings AS (SELECT string_id, text FROM latest WHERE rn = 1),
found AS (SELECT string_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}\p{Cf}]+')) AS term FROM strings),
counts AS (SELECT term, count(*) AS n_occurrences, count(DISTINCT string_id) AS n_records FROM found GROUP BY term),
marked AS (
  SELECT term, n_occurrences, n_records,
         CASE WHEN n_records = 1 THEN 'rare' WHEN n_records >= 0.1 * (SELECT count(*) FROM strings) THEN 'common' END AS mark
  FROM counts)
"""

_PAIRS = """
WITH latest AS (
  SELECT sentence_id, i, j, value,
         row_number() OVER (PARTITION BY sentence_id, i, j ORDER BY written_at DESC NULLS LAST, value DESC NULLS LAST) AS rn
  FROM cooccurrence WHERE i >= 0 AND j >= 0),
good AS (
  SELECT sentence_id, i, j, CASE WHEN value IS NULL OR isnan(value) OR isinf(value) OR value < 0 THEN 0.0 ELSE value END AS v
  FROM latest WHERE rn = 1),
total AS (SELECT count(DISTINCT sentence_id) AS n FROM good),
tokens AS (
  SELECT token, count(DISTINCT sentence_id) AS n
  FROM (SELECT sentence_id, i AS token FROM good UNION ALL SELECT sentence_id, j FROM good) GROUP BY token),
pairs AS (
  SELECT least(i, j) AS token_a, greatest(i, j) AS token_b, count(DISTINCT sentence_id) AS n_ab, sum(v) AS total_value
  FROM good WHERE i <> j GROUP BY ALL),
scored AS (
  SELECT token_a, token_b, n_ab, a.n AS n_a, b.n AS n_b, total_value, total.n AS n
  FROM pairs JOIN tokens a ON token_a = a.token JOIN tokens b ON token_b = b.token, total)
"""

_NEWEST = """
WITH latest AS (
  SELECT string_id, text,
         row_number() OVER (PARTITION BY string_id ORDER BY loaded_at DESC NULLS LAST, text DESC) AS rn
  FROM mapped_string WHERE string_id IS NOT NULL AND text IS NOT NULL)
"""

SQL = {
    "p1_found": _TERMS + "SELECT term, mark FROM marked WHERE mark IS NOT NULL",
    "p1_terms": _TERMS + "SELECT term, n_occurrences, n_records, mark FROM marked",
    "p4_found": _PAIRS + """SELECT token_a, token_b FROM scored
        WHERE n_ab >= 4 AND n_ab >= 0.001 * n AND n * n_ab >= 4 * n_a * n_b""",
    "p4_pairs": _PAIRS + """SELECT token_a, token_b, n_ab, n_a, n_b, round(total_value, 4) AS total_value,
        round(n * n_ab / (n_a * n_b)::DOUBLE, 6) AS lift, round(log2(n * n_ab / (n_a * n_b)::DOUBLE), 6) AS pmi,
        round(ln((n_ab + 0.5) * (greatest(n - n_a - n_b + n_ab, 0) + 0.5) / ((n_a - n_ab + 0.5) * (n_b - n_ab + 0.5))), 6) AS log_odds
        FROM scored""",
    "p5_kept": _NEWEST + r"""SELECT string_id, regexp_replace(text, '[\p{Z}\p{C}]', '', 'g') AS text FROM latest
        WHERE rn = 1 AND regexp_replace(text, '[\p{Z}\p{C}]', '', 'g') <> ''""",
    "p7_kept": """SELECT source, count(DISTINCT doc_id) AS n_docs, any_value(max_repeats) AS max_repeats, true AS caps_kept, true AS share_reached
        FROM documents JOIN source_weights USING (source) GROUP BY source""",
    "p6_roundtrip": "SELECT doc_id, octet_length(encode(coalesce(text, '')))::INT AS n_bytes, true AS same FROM documents",
}
