"""Per-key results where a few keys hold most of the records.

The states of a key are merged in a tree: every task combines its rows in fixed-size
chunks into one state per key, then rounds of bounded fan-in merge the states of
neighbouring tasks until one is left. No task ever receives all the records, or all the
partial states, of a hot key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import bitmaps
from threadloom.session import finite, shuffle_width

CHUNK_ROWS = 1 << 20
FAN_IN = 16
#: States a task holds; beyond it passes them on, so its memory does not grow with the keys.
HELD_STATES = 1 << 22

_STATE = "side int, key bigint, block bigint, slot int, n bigint, total double, partners binary"
_ARROW = pa.schema(
    [
        ("side", pa.int32()), ("key", pa.int64()), ("block", pa.int64()), ("slot", pa.int32()),
        ("n", pa.int64()), ("total", pa.float64()), ("partners", pa.binary()),
    ]
)


def valid_records(records: DataFrame) -> DataFrame:
    """Distinct (sentence_id, i, j) with both ids present and not negative, latest value each.

    Rows that repeat a key count once. The latest ``written_at`` gives the value; of rows
    written at the same time the largest value counts (NaN sorts highest, NULL lowest).
    A NULL ``sentence_id`` is a key of its own. Columns beyond these five are ignored.
    """
    return (
        records.select("sentence_id", "i", "j", "value", "written_at")
        .where((F.col("i") >= 0) & (F.col("j") >= 0))
        .groupBy("sentence_id", "i", "j")
        .agg(F.max(F.struct("written_at", "value"))["value"].alias("value"))
    )


def _states(side: int, key: np.ndarray, partner: np.ndarray, value: np.ndarray, slot: int) -> pa.Table:
    """One state for each (key, partner block) of a chunk of rows."""
    codes, blocks, sets, rows, order = bitmaps.build_blocks(key, partner)
    totals = np.add.reduceat(value[order], np.r_[0, np.cumsum(rows)[:-1]])
    n = len(rows)
    return pa.table(
        [
            pa.array(np.full(n, side, np.int32)), pa.array(codes, pa.int64()), pa.array(blocks, pa.int64()),
            pa.array(np.full(n, slot, np.int32)), pa.array(rows, pa.int64()), pa.array(totals, pa.float64()),
            pa.array(sets, pa.binary()),
        ],
        schema=_ARROW,
    )


def _same(t: pa.Table) -> np.ndarray:
    out = np.ones(max(t.num_rows - 1, 0), dtype=bool)
    for name in ("side", "key", "block", "slot"):
        v = t[name].to_numpy()
        out &= v[1:] == v[:-1]
    return out


def _combine(t: pa.Table, starts: np.ndarray) -> pa.Table:
    """Merge each run of equal keys: counts and sums add, partner sets unite."""
    if len(starts) == t.num_rows:
        return t
    ends = np.r_[starts[1:], t.num_rows]
    sets = t["partners"].to_pylist()
    merged = [sets[a] if b - a == 1 else bitmaps.union(sets[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    first = t.take(pa.array(starts))
    n = np.add.reduceat(t["n"].to_numpy(), starts)
    total = np.add.reduceat(t["total"].to_numpy(), starts)
    return pa.table(
        [first["side"], first["key"], first["block"], first["slot"], pa.array(n), pa.array(total), pa.array(merged, pa.binary())],
        schema=_ARROW,
    )


def _sorted(t: pa.Table) -> pa.Table:
    return t.take(pc.sort_indices(t, [(c, "ascending") for c in ("side", "key", "block", "slot")])).combine_chunks()


def _local_states(chunk_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId()
        runs: list[pa.Table] = []
        waiting: list[pa.RecordBatch] = []
        rows = 0

        def flush() -> None:
            nonlocal waiting, rows
            t = pa.Table.from_batches(waiting)
            i = t["i"].to_numpy().astype(np.int64)
            j = t["j"].to_numpy().astype(np.int64)
            v = t["value"].to_numpy()
            parts = [_states(0, i, j, v, slot), _states(1, j, i, v, slot)]
            runs.append(_sorted(pa.concat_tables(parts)))  # (side, key, block) are distinct within a chunk
            while len(runs) > 1 and runs[-2].num_rows <= 2 * runs[-1].num_rows:
                t = _sorted(pa.concat_tables(runs[-2:]))
                runs[-2:] = [_combine(t, np.flatnonzero(np.r_[True, ~_same(t)]))]
            waiting, rows = [], 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for run in runs:
                yield from run.combine_chunks().to_batches()
            runs.clear()

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                rows += batch.num_rows
            if rows >= chunk_rows:
                flush()
                if sum(r.num_rows for r in runs) > HELD_STATES:
                    yield from passed_on()
        if rows:
            flush()
        yield from passed_on()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return bitmaps.merge_sorted(batches, _same, _combine)


def _count_partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _merge(batches):
        sizes = [bitmaps.cardinality(x) for x in b["partners"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b["side"], b["key"], b["n"], b["total"], pa.array(sizes, pa.int64())],
            names=["side", "key", "n", "total", "partners"],
        )


def tree_profile(records: DataFrame, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN, tasks: int | None = None) -> DataFrame:
    """(side, token_id, n_records, total_value, n_partners) of every key of both sides.

    ``records`` has distinct (sentence_id, i, j) with a value, e.g. of `valid_records`.
    NULL, NaN, infinite and negative values count as records and add 0 to the sum.

    Round 0 combines rows inside each task: every chunk gives a run of sorted states, and
    runs of similar size are merged, so a state is sorted again a logarithmic number of
    times. Round r brings the states of ``fan_in``
    neighbouring nodes together, so a task reads at most ``fan_in`` states of a key and
    block, and log_fan_in(tasks) rounds are needed. Partner sets are compressed bitmaps
    in blocks of 65,536, so a state is at most 8 KiB however many partners a key has; the
    blocks of a key are merged apart and their counts are added at the end.
    An empty table gives no rows. ``tasks`` is the number of partitions of ``records`` if
    they do not come from a shuffle of the session's width.
    """
    rows = records.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), finite(F.col("value")).alias("value"))
    states = rows.mapInArrow(_local_states(chunk_rows), _STATE)
    rounds = max(1, math.ceil(math.log(max(shuffle_width(records.sparkSession), tasks or 0, 2), fan_in)))
    for r in range(1, rounds + 1):
        states = (
            states.withColumn("slot", F.floor(F.col("slot") / fan_in).cast("int") if r < rounds else F.lit(0))
            .repartition("side", "key", "block", "slot")
            .sortWithinPartitions("side", "key", "block", "slot")
        )
        if r < rounds:
            states = states.mapInArrow(_merge, _STATE)
    counted = states.mapInArrow(_count_partners, "side int, key bigint, n bigint, total double, partners bigint")
    side = F.when(F.col("side") == 0, "i").otherwise("j").alias("side")
    return counted.groupBy(side, F.col("key").cast("int").alias("token_id")).agg(
        F.sum("n").alias("n_records"), F.sum("total").alias("total_value"), F.sum("partners").alias("n_partners")
    )


def hot_keys(profile: DataFrame, share: float) -> DataFrame:
    """Keys with at least ``share`` of the records of their side; empty for an empty table."""
    total = profile.where(F.col("side") == "i").agg(F.sum("n_records")).first()[0] or 0
    return profile.where(F.col("n_records") >= F.lit(share) * F.lit(int(total))).select("side", "token_id")
