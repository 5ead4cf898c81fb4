"""Word vectors by weighted factorisation of the logarithm of co-occurrence, with AdaGrad."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST_BYTES = 256 << 20


def weight(value: Column, most: float = 100.0, alpha: float = 0.75) -> Column:
    return F.when(value < most, F.pow(value / most, F.lit(alpha))).otherwise(F.lit(1.0))


def grouped_sums(rows: DataFrame, index: str, vector: str, scalar: str) -> DataFrame:
    """Per index: sums and squared sums of a vector's places and of a scalar.

    One row (index, pos, total, total_sq) for each place; the scalar has pos -1.
    """
    flat = rows.select(F.col(index).alias("index"), F.posexplode(vector).alias("pos", "g")).unionByName(rows.select(F.col(index).alias("index"), F.lit(-1).alias("pos"), F.col(scalar).alias("g")))
    return flat.groupBy("index", "pos").agg(F.sum("g").alias("total"), F.sum(F.col("g") * F.col("g")).alias("total_sq"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def residuals(records: DataFrame, params: DataFrame, most: float = 100.0, alpha: float = 0.75) -> DataFrame:
    """Join records (i, j, value) with parameters (token_id, w, wc, b, bc).

    Gives f, diff, loss = f * diff**2 and g = 2 * f * diff. Values that are not positive
    have no logarithm and are left out. The joins carry no hint; the size of the
    vocabulary decides on the strategy at run time.
    """
    left = params.select(F.col("token_id").alias("i"), "w", "b")
    right = params.select(F.col("token_id").alias("j"), "wc", "bc")
    both = records.where((F.col("value") > 0) & ~F.isnan("value")).join(left, "i").join(right, "j")
    diff = dot(F.col("w"), F.col("wc")) + F.col("b") + F.col("bc") - F.log("value")
    both = both.withColumn("f", weight(F.col("value"), most, alpha)).withColumn("diff", diff)
    return both.withColumn("loss", F.col("f") * F.col("diff") * F.col("diff")).withColumn("g", 2 * F.col("f") * F.col("diff"))


_SUMS = "side int, token_id int, sums binary"


def _by_token(side: int, tokens: np.ndarray, g: np.ndarray, other: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each token of a batch: sums and squared sums of its gradients, the bias last."""
    order = np.argsort(tokens, kind="stable")
    tokens = tokens[order]
    starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    grads = np.c_[g[order, None] * other[order], g[order]]
    sums = np.c_[np.add.reduceat(grads, starts, axis=0), np.add.reduceat(grads * grads, starts, axis=0)]
    for token, row in zip(tokens[starts].tolist(), sums, strict=True):
        yield side, token, row


def _rows(held: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    sides, tokens = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(sides, pa.int32()), pa.array(tokens, pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["side", "token_id", "sums"])


#: Sums a task holds before it passes them on.
HELD = 50_000


def _add(held: dict[tuple[int, int], np.ndarray], parts: Iterator[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for side, token, row in parts:
        if (side, token) in held:
            held[side, token] = held[side, token] + row
        else:
            held[side, token] = row
    if len(held) >= HELD:
        yield _rows(held)
        held.clear()


def merged_sums(parts: DataFrame) -> DataFrame:
    """One row (side, token_id, sums) for each token from the partial sums of all tasks."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int] | None = None
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for side, token, raw in zip(*(b[c].to_pylist() for c in ("side", "token_id", "sums")), strict=True):
                if (side, token) != last and len(held) >= HELD:
                    yield _rows(held)
                    held = {}
                last = (side, token)
                row = np.frombuffer(raw)
                held[last] = held[last] + row if last in held else row
        if held:
            yield _rows(held)

    return parts.repartition("side", "token_id").sortWithinPartitions("side", "token_id").mapInArrow(merge, _SUMS)


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        if b.num_rows:
            g = b["g"].to_numpy()
            w, wc = (b[c].flatten().to_numpy().reshape(b.num_rows, -1) for c in ("w", "wc"))
            for side, token, other in ((0, "i", wc), (1, "j", w)):
                yield from _add(held, _by_token(side, b[token].to_numpy(), g, other))
    if held:
        yield _rows(held)


def step(records: DataFrame, params: DataFrame, learning_rate: float = 0.05, most: float = 100.0, alpha: float = 0.75) -> DataFrame:
    """Parameters and accumulators after one AdaGrad step over all records, without the driver.

    ``params`` has token_id, w, wc, b, bc and the accumulators gw, gwc, gb, gbc. Both sides
    use the values before the step. Accumulators grow by the sums of squares, then the
    parameters move by rate * sum / sqrt(accumulator). Tasks add up the gradients of their
    records by token, whatever the dimension, and only these sums are exchanged.
    """
    parts = residuals(records, params, most, alpha).select("i", "j", "g", "w", "wc").mapInArrow(_partial_sums, _SUMS)
    sums = merged_sums(parts)
    left, right = (sums.where(F.col("side") == k).select("token_id", F.col("sums").alias(f"s{k}")) for k in (0, 1))
    rows = params.join(left, "token_id", "left").join(right, "token_id", "left")
    names = ("token_id", "w", "wc", "b", "bc", "gw", "gwc", "gb", "gbc")

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = batch.select(list(names)).to_pydict()
            for raw, w, b in (("s0", "w", "b"), ("s1", "wc", "bc")):
                for k, x in enumerate(batch[raw].to_pylist()):
                    if x is None:
                        continue
                    total, squares = np.frombuffer(x).reshape(2, -1)
                    acc, bias = np.array(out[f"g{w}"][k]) + squares[:-1], out[f"g{b}"][k] + squares[-1]
                    out[w][k] = (np.array(out[w][k]) - learning_rate * total[:-1] / np.sqrt(acc)).tolist()
                    out[b][k] -= learning_rate * total[-1] / np.sqrt(bias)
                    out[f"g{w}"][k], out[f"g{b}"][k] = acc.tolist(), bias
            arrays = [pa.array(out["token_id"], batch["token_id"].type), *(pa.array(out[n], pa.list_(pa.float64()) if n in ("w", "wc", "gw", "gwc") else pa.float64()) for n in names[1:])]
            yield pa.RecordBatch.from_arrays(arrays, names=list(names))

    kind = dict(params.dtypes)["token_id"]
    fields = ", ".join(f"{n} {kind if n == 'token_id' else 'array<double>' if n in ('w', 'wc', 'gw', 'gwc') else 'double'}" for n in names)
    return rows.select(*names, "s0", "s1").mapInArrow(move, fields)


@dataclass
class GloVe:
    """Vectors of a fixed vocabulary; the parameters live on the driver and go out with each job.

    What goes out is vocabulary * (dimensions + 1) * 2 * 8 bytes, checked against a limit;
    beyond it use `step`, which keeps the parameters in a table. A task holds sums for the
    tokens it meets, at most `HELD` at a time.
    """

    vocabulary_size: int
    dimensions: int = 100
    most: float = 100.0
    alpha: float = 0.75
    seed: int = 0

    def __post_init__(self) -> None:
        bound = 0.5 / self.dimensions
        shape = (self.vocabulary_size, self.dimensions)
        first, second = np.random.default_rng(self.seed), np.random.default_rng(self.seed + 1)
        self.w, self.wc = first.uniform(-bound, bound, shape), second.uniform(-bound, bound, shape)
        self.b, self.bc = first.uniform(-bound, bound, self.vocabulary_size), second.uniform(-bound, bound, self.vocabulary_size)
        self.gw, self.gwc = np.ones(shape), np.ones(shape)
        self.gb, self.gbc = np.ones(self.vocabulary_size), np.ones(self.vocabulary_size)
        if (self.w.nbytes + self.b.nbytes) * 2 > MAX_BROADCAST_BYTES:
            raise ValueError("the parameters are too large to broadcast; use step() on a table of parameters")

    def _partial(self, params: tuple, most: float, alpha: float):
        w, wc, b, bc = params

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2)  # records and loss, under side -1
            held: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                i, j, x = (batch[c].to_numpy() for c in ("i", "j", "value"))
                f = np.where(x < most, (x / most) ** alpha, 1.0)
                diff = (w[i] * wc[j]).sum(1) + b[i] + bc[j] - np.log(x)
                total += (len(x), float((f * diff * diff).sum()))
                g = 2 * f * diff
                yield from _add(held, itertools.chain(_by_token(0, i, g, wc[j]), _by_token(1, j, g, w[i])))
            if total[0]:
                yield _rows(held | {(-1, 0): total})

        return run

    def train(self, records: DataFrame, epochs: int = 20, learning_rate: float = 0.05, batches: int = 1, tracker=None) -> list[float]:
        """Mean loss of each epoch. An epoch makes ``batches`` steps over hash-chosen parts.

        Each task adds up the gradients of its records for the tokens it meets; the sums of
        a token are added by token, and the driver, which holds the parameters anyway,
        receives one row for each token that occurs.
        """
        valid = records.where((F.col("value") > 0) & ~F.isnan("value") & (F.col("i") >= 0) & (F.col("j") >= 0) & (F.col("i") < self.vocabulary_size) & (F.col("j") < self.vocabulary_size)).select("i", "j", "value")
        history = []
        for epoch in range(epochs):
            n = total = 0.0
            for k in range(batches):
                part = valid.where(F.pmod(F.xxhash64(F.lit(self.seed + epoch), "i", "j"), F.lit(batches)) == k) if batches > 1 else valid
                sums = merged_sums(part.mapInArrow(self._partial((self.w, self.wc, self.b, self.bc), self.most, self.alpha), _SUMS))
                moved: dict[int, list] = {0: [], 1: []}
                for row in sums.collect():
                    value = np.frombuffer(bytes(row["sums"]))
                    if row["side"] < 0:
                        n, total = n + value[0], total + value[1]
                    else:
                        moved[row["side"]].append((row["token_id"], value))
                for side, (w, b) in enumerate((("w", "b"), ("wc", "bc"))):
                    if moved[side]:
                        self._apply(w, b, *zip(*moved[side], strict=True), learning_rate)
            history.append(total / max(n, 1))
            if tracker is not None:
                tracker.log({"epoch": epoch, "loss": history[-1]})
        return history

    def _apply(self, w: str, b: str, tokens: tuple[int, ...], sums: tuple[np.ndarray, ...], rate: float) -> None:
        at = np.array(tokens)
        total, squares = np.split(np.array(sums), 2, axis=1)
        for name, t, s in ((w, total[:, :-1], squares[:, :-1]), (b, total[:, -1], squares[:, -1])):
            value, acc = getattr(self, name), getattr(self, f"g{name}")
            acc[at] += s
            value[at] -= rate * t / np.sqrt(acc[at])

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(k, self.w[k].tolist(), self.wc[k].tolist(), float(self.b[k]), float(self.bc[k])) for k in range(self.vocabulary_size)]
        return spark.createDataFrame(rows, "token_id int, w array<double>, wc array<double>, b double, bc double")
