"""Mixing sources to target weights with dependent rounding of fractional copies.

Every document of a source gets the same fractional number of copies, so that the sources
reach their shares. The whole part is given at once. The fractional parts are rounded by
the pivotal method: two documents exchange mass along the direction that keeps the tokens
of the pair unchanged, with odds that keep both expectations, until one of them is whole.
Chunks of bounded size leave one fractional document each; these meet in rounds of bounded
fan-in until one is left for a source, which is rounded at random. So the tokens of a
source miss their target by less than one document, and as large documents go first, by a
small one as a rule.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import materialise

CHUNK = 8192
FAN_IN = 256
#: Sources up to which the plan is broadcast; a longer plan is joined with salted keys.
BROADCAST_SOURCES = 10_000
SALTS = 16
_EPS = 1e-9


def pivotal(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Round ``p`` in order; the index of the one document left fractional, or -1.

    ``p`` in [0, 1], ``size`` > 0, one draw of [0, 1) for each document. The sum of p * size
    stays the same, and so does the expectation of every p.
    """
    p = p.astype(float).copy()
    live = -1
    for k in range(len(p)):
        if not _EPS < p[k] < 1 - _EPS:
            p[k] = round(p[k])
            continue
        if live < 0:
            live = k
            continue
        a, b = live, k
        up = min((1 - p[a]) * size[a], p[b] * size[b])
        down = min(p[a] * size[a], (1 - p[b]) * size[b])
        if draws[k] * (up + down) < down:
            p[a] += up / size[a]
            p[b] -= up / size[b]
        else:
            p[a] -= down / size[a]
            p[b] += down / size[b]
        left = [x for x in (a, b) if _EPS < p[x] < 1 - _EPS]
        for x in (a, b):
            if x not in left:
                p[x] = round(p[x])
        live = left[0] if left else -1
    return p, live


def source_plan(sizes: DataFrame, weights: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """Per listed source: documents, tokens, the mixture's target tokens and copies a document.

    Sources without tokens cannot contribute; their weight is shared among the others in
    proportion (``share``). Without ``total_tokens`` the mixture is as large as the repeat
    caps let every other source reach its share exactly; with it, a source whose cap is too
    small is repeated to its cap and misses its share, which the report shows. NULL or
    non-positive weights and caps count as 0. A source listed twice counts once, with its
    largest weight and cap.
    """
    listed = (
        weights.where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(
            F.greatest(F.coalesce(F.max("target_weight"), F.lit(0.0)), F.lit(0.0)).alias("target_weight"),
            F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).alias("max_repeats"),
        )
    )
    have = sizes.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.coalesce("n_tokens", F.lit(0))).alias("n_tokens"),
        F.sum((F.col("n_tokens") > 0).cast("bigint")).alias("n_filled"),
    )
    plan = listed.join(have, "source", "left").fillna(0, ["n_docs", "n_tokens", "n_filled"])
    usable = (F.col("n_tokens") > 0) & (F.col("target_weight") > 0) & (F.col("max_repeats") > 0)
    plan = materialise(plan.withColumn("usable", usable))
    weight = F.sum(F.when(F.col("usable"), F.col("target_weight")))
    most = F.min(F.when(F.col("usable"), F.col("max_repeats") * F.col("n_tokens") / F.col("target_weight")))
    all_weight, ratio = plan.agg(weight, most).first()
    all_weight = all_weight or 1.0
    total = float(total_tokens) if total_tokens is not None else (ratio or 0.0) * all_weight
    share = F.when(F.col("usable"), F.col("target_weight") / F.lit(all_weight)).otherwise(F.lit(0.0))
    copies = F.when(F.col("usable"), F.least(F.col("max_repeats").cast("double"), F.lit(total) * F.col("share") / F.col("n_tokens"))).otherwise(0.0)
    return plan.withColumn("share", share).withColumn("rate", copies).withColumn("aim_tokens", F.col("rate") * F.col("n_tokens"))


def _round_group(last: bool, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id"], ascending=[False, True], kind="stable")
        p, live = pivotal(pdf["p"].to_numpy(), pdf["n_tokens"].to_numpy().astype(float), pdf["draw"].to_numpy())
        if last and live >= 0:
            key = int(pdf["doc_id"].iloc[live]) & 0xFFFFFFFF
            p[live] = float(np.random.default_rng([seed & 0xFFFFFFFF, key]).random() < p[live])
            live = -1
        out = pdf[["doc_id", "source", "n_tokens", "draw", "node", "p"]].copy()
        out["p"], out["open"] = p, np.arange(len(pdf)) == live
        return out

    return run


_GROUP = "doc_id bigint, source string, n_tokens bigint, draw double, node bigint, p double, open boolean"


def mixture(
    sizes: DataFrame, plan: DataFrame, seed: int = 0, chunk: int = CHUNK, fan_in: int = FAN_IN, broadcast_sources: int = BROADCAST_SOURCES
) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of every document of a source with a plan.

    ``sizes`` is (doc_id, source, n_tokens). A document is copied at most ``max_repeats``
    times. Documents without tokens get no copies; rows with a NULL doc_id, a NULL source
    or a source without a plan are left out. Repeated doc_ids count once, with their
    largest size. Draws and chunks come from hashes of doc_id and ``seed``, so the result
    does not depend on partitioning and a lost task is recomputed to the same rows.
    """
    rates = plan.select("source", "rate", "max_repeats", F.greatest(F.lit(1), F.ceil(F.col("n_filled") / chunk)).alias("nodes"))
    one = sizes.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("s"))
    mixed = F.xxhash64(F.lit(seed), "doc_id")
    one = one.select("doc_id", "s.source", "s.n_tokens")
    if plan.count() <= broadcast_sources:
        docs = one.join(F.broadcast(rates), "source")
    else:
        salted = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        docs = one.withColumn("salt", F.pmod(mixed, F.lit(SALTS)).cast("int")).join(salted, ["source", "salt"])
    docs = docs.withColumn("whole", F.floor("rate"))
    docs = docs.select(
        "doc_id", "source", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"), "whole",
        (F.col("rate") - F.col("whole")).alias("p"), F.pmod(mixed, F.col("nodes")).alias("node"),
        (F.pmod(F.xxhash64(mixed, F.lit(1)), F.lit(1 << 52)) / float(1 << 52)).alias("draw"), "nodes",
    )
    docs = materialise(docs)
    part = docs.where((F.col("n_tokens") > 0) & (F.col("p") > 0)).select("doc_id", "source", "n_tokens", "draw", "node", "p")
    most = docs.agg(F.max("nodes")).first()[0] or 1
    rounds = 1 + (math.ceil(math.log(most, fan_in)) if most > 1 else 0)
    closed = None
    for r in range(rounds):
        last = r == rounds - 1
        if r:
            part = part.withColumn("node", F.floor(F.col("node") / fan_in) if not last else F.lit(0).cast("bigint"))
        done = materialise(part.groupBy("source", "node").applyInPandas(_round_group(last, seed), _GROUP))
        ones = done.where(~F.col("open") & (F.col("p") > 0.5)).select("doc_id")
        closed = ones if closed is None else closed.unionByName(ones)
        part = done.where("open").drop("open")
    extra = closed.withColumn("extra", F.lit(1))
    copies = F.when(F.col("n_tokens") > 0, F.col("whole") + F.coalesce("extra", F.lit(0))).otherwise(0)
    return docs.join(extra, "doc_id", "left").select("doc_id", "source", "n_tokens", copies.cast("int").alias("copies"))


def mixture_report(copies: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source: target and reached shares of the mixture, and how much was repeated."""
    got = copies.groupBy("source").agg(
        F.sum("copies").alias("n_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"), F.max("copies").alias("most_copies")
    )
    rows = materialise(plan.join(got, "source", "left").fillna(0, ["n_copies", "mixed_tokens", "most_copies"]))
    total = rows.agg(F.sum("mixed_tokens")).first()[0] or 1
    return rows.select(
        "source", "target_weight", "share", "max_repeats", "n_docs", "n_tokens", "n_copies", "most_copies", "mixed_tokens",
        (F.col("mixed_tokens") / F.lit(int(total))).alias("reached_share"),
    )


def expand(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """The mixture itself: each document as often as its copies, numbered from 1."""
    chosen = copies.where(F.col("copies") > 0).select("doc_id", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return docs.join(chosen, "doc_id")


