"""Counts of every distinct term: occurrences, records that hold it, too rare or too common.

Vertical layout: a term owns compressed bitmaps of the record identifiers that hold it and
an occurrence counter beside them. Bitmaps of the same term and identifier block are merged
by union; the number of records is the cardinality of the union.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import bitmaps

TERM = r"[\p{L}\p{M}\p{N}\p{Cf}]+"
COMMON_SHARE = 0.1
POSTINGS = 1 << 21

_BLOCK = "term string, block bigint, n bigint, ids binary"
_ARROW = pa.schema([("term", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])


def latest_text(rows: DataFrame, key: str, text: str, at: str) -> DataFrame:
    """One row (id, text) for each ``key``: the non-NULL text with the latest ``at``.

    Rows with a NULL key or NULL text are left out, empty texts stay. Of equal times the
    largest text in code point order counts.
    """
    return (
        rows.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"), F.col(at).alias("at"))
        .where(F.col("id").isNotNull() & F.col("text").isNotNull())
        .groupBy("id")
        .agg(F.max(F.struct("at", "text"))["text"].alias("text"))
    )


def _postings(pattern: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        terms: list[str] = []
        ids: list[np.ndarray] = []
        seen: list[np.ndarray] = []
        held = 0
        number = TaskContext.get().partitionId() << 40  # records of a task are numbered without gaps

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal terms, ids, seen, held
            everyone = np.concatenate(seen)
            out = [(np.zeros(len(everyone), np.int64), everyone, np.array([None], dtype=object))]
            if terms:
                codes, names = pd.factorize(np.array(terms, dtype=object))
                out.append((codes.astype(np.int64), np.concatenate(ids), names))
            for codes, who, names in out:
                c, block, sets, n, _ = bitmaps.build_blocks(codes, who)
                t = pa.table([pa.array(names[c], pa.string()), pa.array(block), pa.array(n), pa.array(sets, pa.binary())], schema=_ARROW)
                yield from t.to_batches(max_chunksize=20_000)
            terms, ids, seen, held = [], [], [], 0

        for batch in batches:
            who = np.arange(number, number + batch.num_rows)
            number += batch.num_rows
            for start in range(0, len(who), 2000):
                part = who[start : start + 2000]
                found = [find(t.lower()) for t in batch["text"][start : start + 2000].to_pylist()]
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                for f in found:
                    terms += f
                ids.append(np.repeat(part, sizes))
                seen.append(part)
                held += int(sizes.sum()) + len(part)
                if held >= most:
                    yield from flush()
        if held:
            yield from flush()

    return run


def _same(t: pa.Table) -> np.ndarray:
    block = t["block"].to_numpy()
    term = t["term"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return (block[1:] == block[:-1]) & (term[1:] == term[:-1])


def _combine(t: pa.Table, starts: np.ndarray) -> pa.Table:
    if len(starts) == t.num_rows:
        return t
    ends = np.r_[starts[1:], t.num_rows].tolist()
    sets = t["ids"].to_pylist()
    merged = [sets[a] if b - a == 1 else bitmaps.union(sets[a:b]) for a, b in zip(starts.tolist(), ends, strict=True)]
    first = t.select(["term", "block"]).take(pa.array(starts))
    n = np.add.reduceat(t["n"].to_numpy(), starts)
    return pa.table([first["term"], first["block"], pa.array(n), pa.array(merged, pa.binary())], schema=_ARROW)


def _cardinality(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in bitmaps.merge_sorted(batches, _same, _combine):
        sizes = pa.array([bitmaps.cardinality(x) for x in b["ids"].to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([b["term"], b["n"], sizes], names=["term", "n", "records"])


def term_counts(records: DataFrame, pattern: str = TERM, most_postings: int = POSTINGS) -> DataFrame:
    """(term, n_occurrences, n_records) of every term of ``records`` (id, text).

    Terms are the matches of ``pattern`` in the lower-cased text, compared code point by
    code point. The row with a NULL term holds the number of all records, empty texts too;
    it comes from the bitmap of the whole collection. Identifiers must be distinct; NULL
    texts must be gone (see `latest_text`). An empty table gives no rows.

    Sparse identifiers would leave one record in each block. So a task numbers its records
    from its own offset, in the order of their identifiers, which a repeated task gives
    again; after `latest_text` the rows have that order already and the sort is free.

    A task keeps at most ``most_postings`` postings before it writes blocks. Blocks are
    hashed by term and identifier block, so a term that occurs everywhere is merged by as
    many tasks as there are identifier blocks, and its counts are summed at the end.
    """
    blocks = records.select("id", "text").sortWithinPartitions("id").mapInArrow(_postings(pattern, most_postings), _BLOCK)
    merged = blocks.repartition("term", "block").sortWithinPartitions("term", "block")
    counted = merged.mapInArrow(_cardinality, "term string, n bigint, records bigint")
    return counted.groupBy("term").agg(F.sum("n").alias("n_occurrences"), F.sum("records").alias("n_records"))


def mark_terms(counts: DataFrame, n_records: int, common_share: float = COMMON_SHARE) -> DataFrame:
    """``mark`` is `rare` for terms of one record, `common` for terms of a tenth or more.

    A term that is both, in a collection of at most ten records, is `rare`. Others: NULL.
    """
    common = F.col("n_records") >= F.lit(common_share) * F.lit(n_records)
    return counts.withColumn("mark", F.when(F.col("n_records") == 1, "rare").when(common, "common"))
