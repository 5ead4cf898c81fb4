"""Word, character and adjacent-pair counts of a corpus, as distributed aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BPE_END = "</s>"
PIECE_START = "</b>"


def characters(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda c: c != "")


def word_counts(tokens: DataFrame) -> DataFrame:
    """(word, freq) of rows with an array ``tokens``; NULL and empty arrays add nothing."""
    return tokens.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def merge_budget(words: DataFrame, merges: float) -> int:
    """Number of merges; a value below 1 is a share of the distinct words."""
    return int(words.count() * merges) if merges < 1 else int(merges)


def alphabet(words: DataFrame) -> DataFrame:
    return words.select(F.explode(characters(F.col("word"))).alias("char")).distinct()


def bpe_symbols(word: Column) -> Column:
    return F.concat(characters(word), F.array(F.lit(BPE_END)))


def piece_symbols(word: Column) -> Column:
    return F.concat(F.array(F.lit(PIECE_START)), characters(word))


def pair_counts(words: DataFrame, symbols=bpe_symbols) -> DataFrame:
    """(l, r, n): adjacent symbols, overlapping ones included, weighted by word frequency."""
    s = words.select(symbols(F.col("word")).alias("s"), "freq")
    both = F.zip_with(F.slice(F.col("s"), F.lit(1), F.size("s") - 1), F.slice(F.col("s"), F.lit(2), F.size("s") - 1), lambda a, b: F.struct(a.alias("l"), b.alias("r")))
    pairs = s.where(F.size("s") > 1).select(F.explode(both).alias("p"), "freq")
    return pairs.groupBy("p.l", "p.r").agg(F.sum("freq").alias("n"))


def symbol_counts(words: DataFrame, symbols=piece_symbols) -> DataFrame:
    return words.select(F.explode(symbols(F.col("word"))).alias("symbol"), "freq").groupBy("symbol").agg(F.sum("freq").alias("n"))


def piece_scores(words: DataFrame) -> DataFrame:
    """(l, r, n, score): pair count over the product of the counts of both symbols."""
    singles = symbol_counts(words)
    left = singles.select(F.col("symbol").alias("l"), F.col("n").alias("n_l"))
    right = singles.select(F.col("symbol").alias("r"), F.col("n").alias("n_r"))
    pairs = pair_counts(words, piece_symbols).join(left, "l").join(right, "r")
    return pairs.select("l", "r", "n", (F.col("n") / (F.col("n_l") * F.col("n_r")).cast("double")).alias("score"))


def best_pair(scored: DataFrame, score: str) -> DataFrame:
    """The pair with the largest score; of ties the smallest in code point order."""
    return scored.agg(F.min(F.struct((-F.col(score)).alias("s"), "l", "r")).alias("b")).where("b IS NOT NULL").select("b.l", "b.r", (-F.col("b.s")).alias(score))
