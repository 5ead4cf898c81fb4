"""Classification metrics from confusion counts.

Counting is one distributed aggregate; what follows works on the table of classes, which is
as small as the number of classes. A zero denominator gives 0, likelihood ratios infinity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CATEGORICAL = ("accuracy", "precision", "recall", "f1")
CATEGORICAL_MORE = ("mcc", "specificity", "npv", "k", "lr_plus", "lr_minus")


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def or_infinite(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(float("inf")))


def valid_predictions(rows: DataFrame, classes: int, scores: str = "scores", truth: str = "truth") -> DataFrame:
    """Rows whose scores are ``classes`` numbers and whose truth is a class; others are left out."""
    s, t = F.col(scores), F.col(truth)
    numbers = (F.size(s) == classes) & ~F.exists(s, lambda x: x.isNull() | F.isnan(x))
    return rows.where(s.isNotNull() & t.isNotNull() & numbers & (t >= 0) & (t < classes))


def arg_max(scores: Column) -> Column:
    """Place of the largest score; of ties the first."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def confusion(rows: DataFrame, scores: str = "scores", truth: str = "truth") -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), arg_max(F.col(scores)).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_counts(cells: DataFrame, classes: int) -> DataFrame:
    """(class_id, tp, fp, fn, tn) for each class, classes without rows included."""
    sides = F.array(
        F.struct(F.col("truth").alias("class_id"), F.col("n").alias("row"), F.lit(0).cast("bigint").alias("col")),
        F.struct(F.col("pred").alias("class_id"), F.lit(0).cast("bigint").alias("row"), F.col("n").alias("col")),
    )
    hit = F.when((F.col("truth") == F.col("pred")) & (F.col("s.row") > 0), F.col("n")).otherwise(0)
    sums = cells.select("truth", "pred", "n", F.explode(sides).alias("s")).groupBy("s.class_id").agg(F.sum("s.row").alias("row"), F.sum("s.col").alias("col"), F.sum(hit).alias("tp"))
    every = cells.sparkSession.range(classes).select(F.col("id").cast("int").alias("class_id"))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    full = every.join(F.broadcast(sums), "class_id", "left").fillna(0, ["row", "col", "tp"]).withColumn("one", F.lit(1)).join(F.broadcast(total.withColumn("one", F.lit(1))), "one")
    tp, row, col = F.col("tp"), F.col("row"), F.col("col")
    return full.select("class_id", "tp", (col - tp).alias("fp"), (row - tp).alias("fn"), (F.col("total") - row - col + tp).alias("tn"))


def per_class(counts: DataFrame) -> DataFrame:
    """All metrics of each class (or label) of (tp, fp, fn, tn); products are formed as doubles."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    p, r, spec = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    expected = ratio((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), total * total)
    accuracy = ratio(tp + tn, total)
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.select(
        *[c for c in counts.columns if c not in ("tp", "fp", "fn", "tn")], "tp", "fp", "fn", "tn",
        accuracy.alias("accuracy"), p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"),
        spec.alias("specificity"), ratio(tn, tn + fn).alias("npv"), ratio(tp * tn - fp * fn, root).alias("mcc"),
        ratio(accuracy - expected, 1 - expected).alias("kappa"), or_infinite(r, 1 - spec).alias("lr_plus"), or_infinite(1 - r, spec).alias("lr_minus"),
        ratio(fp + fn, total).alias("hamming"),
    )


def macro(classes: DataFrame, *names: str) -> DataFrame:
    """Means over classes, one row."""
    return classes.agg(*[F.avg(n).alias(n) for n in names])


def overall(counts: DataFrame) -> DataFrame:
    """accuracy, Gorodkin's mcc and Cohen's kappa of all classes together, one row.

    Raises nothing for an empty table: every value is 0.
    """
    row, col = (F.col("tp").cast("double") + F.col(c) for c in ("fn", "fp"))
    s = counts.agg(
        F.sum("tp").cast("double").alias("c"), F.sum(row).alias("s"), F.sum(row * col).alias("pt"), F.sum(col * col).alias("pp"), F.sum(row * row).alias("tt"),
    )
    c, n, pt = F.col("c"), F.col("s"), F.col("pt")
    accuracy, expected = ratio(c, n), ratio(pt, n * n)
    root = F.sqrt((n * n - F.col("pp")) * (n * n - F.col("tt")))
    return s.select(accuracy.alias("accuracy"), ratio(c * n - pt, root).alias("mcc"), ratio(accuracy - expected, 1 - expected).alias("k"))


def top_k_accuracy(rows: DataFrame, k: int, classes: int, scores: str = "scores", truth: str = "truth") -> DataFrame:
    """Share of rows whose true class is among the k best; ties go to the lower class."""
    if k > classes:
        raise ValueError("k is larger than the number of classes")
    s, t = F.col(scores), F.col(truth)
    own = F.get(s, t)
    better = F.size(F.filter(s, lambda x: x > own)) + F.size(F.filter(F.slice(s, F.lit(1), t), lambda x: x == own))
    return rows.agg(F.coalesce(F.avg((better < k).cast("double")), F.lit(0.0)).alias("top_k_accuracy"))


# ---------------------------------------------------------------- multi-label

def label_counts(rows: DataFrame, scores: str = "scores", truth: str = "truth", threshold: float = 0.5) -> DataFrame:
    """(label, tp, fp, fn, tn) of arrays of scores and of 0/1 truths of the same length."""
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold is between 0 and 1")
    pairs = rows.select(F.posexplode(F.arrays_zip(F.col(scores).alias("s"), F.col(truth).alias("t"))).alias("label", "x"))
    pred, true = F.col("x.s") >= threshold, F.col("x.t") == 1
    return pairs.groupBy("label").agg(*[F.sum(cond.cast("bigint")).alias(n) for n, cond in (("tp", pred & true), ("fp", pred & ~true), ("fn", ~pred & true), ("tn", ~pred & ~true))])


def exact_match(rows: DataFrame, scores: str = "scores", truth: str = "truth", threshold: float = 0.5) -> DataFrame:
    same = F.forall(F.arrays_zip(F.col(scores).alias("s"), F.col(truth).alias("t")), lambda x: (x["s"] >= threshold) == (x["t"] == 1))
    return rows.agg(F.coalesce(F.avg(same.cast("double")), F.lit(0.0)).alias("exact_match"))


class _Accumulated:
    """Counts over several frames; every nth call computes, ``force`` always does.

    Each frame that is added is reduced to its counts at once, so what is kept is as small
    as the number of classes. Computed values are appended to ``history``.
    """

    def __init__(self, every: int = 1) -> None:
        if every < 1:
            raise ValueError("every is at least 1")
        self.every, self.calls, self.history = every, 0, []
        self.clear()

    def clear(self) -> None:
        self.cells: dict[tuple, int] = {}

    def _add(self, rows, width: int) -> None:
        for r in rows:
            key = tuple(r)[:width]
            self.cells[key] = self.cells.get(key, 0) + r[width]

    def _due(self, force: bool) -> bool:
        self.calls += 1
        return force or (self.calls - 1) % self.every == 0


class CategoricalMetrics(_Accumulated):
    """Metrics of one class for each row, over all frames added since the last clear."""

    def __init__(self, classes: int, every: int = 1) -> None:
        self.classes = classes
        super().__init__(every)

    def add(self, rows: DataFrame, scores: str = "scores", truth: str = "truth") -> None:
        self._add(confusion(valid_predictions(rows, self.classes, scores, truth), scores, truth).collect(), 2)

    def calculate(self, spark, force: bool = False) -> dict | None:
        """Overall values, macro means and values of each class; an error without any row."""
        if not self._due(force):
            return None
        if not self.cells:
            raise ValueError("no predictions were added")
        cells = spark.createDataFrame([(*k, n) for k, n in self.cells.items()], "truth int, pred int, n bigint")
        counts = class_counts(cells, self.classes)
        each = per_class(counts)
        names = [c for c in each.columns if c not in ("class_id", "tp", "fp", "fn", "tn", "hamming", "kappa", "mcc", "accuracy")]
        result = overall(counts).first().asDict() | {f"mean_{k}": v for k, v in macro(each, *names).first().asDict().items()}
        result["classes"] = {r["class_id"]: r.asDict() for r in each.collect()}
        self.history.append(result)
        return result


class MultiLabelMetrics(_Accumulated):
    """Metrics of several labels for each row, over all frames added since the last clear."""

    def __init__(self, threshold: float = 0.5, every: int = 1) -> None:
        self.threshold = threshold
        super().__init__(every)

    def add(self, rows: DataFrame, scores: str = "scores", truth: str = "truth") -> None:
        counts = label_counts(rows, scores, truth, self.threshold)
        kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), F.col(n).alias("n")) for n in ("tp", "fp", "fn", "tn")])).alias("c")
        self._add(counts.select("label", kinds).select("label", "c.kind", "c.n").collect(), 2)
        same = F.forall(F.arrays_zip(F.col(scores).alias("s"), F.col(truth).alias("t")), lambda x: (x["s"] >= self.threshold) == (x["t"] == 1))
        hits = rows.agg(F.count_if(same), F.count(F.lit(1))).first()
        self._add([("rows", "exact", hits[0]), ("rows", "all", hits[1])], 2)

    def calculate(self, spark, force: bool = False) -> dict | None:
        if not self._due(force):
            return None
        labels = sorted({k for k, _ in self.cells if k != "rows"})
        if not labels:
            raise ValueError("no predictions were added")
        counts = spark.createDataFrame([(k, *[self.cells.get((k, c), 0) for c in ("tp", "fp", "fn", "tn")]) for k in labels], "label int, tp bigint, fp bigint, fn bigint, tn bigint")
        each = per_class(counts)
        names = [c for c in each.columns if c not in ("label", "tp", "fp", "fn", "tn")]
        result = {f"mean_{k}": v for k, v in macro(each, *names).first().asDict().items()} | {"labels": {r["label"]: r.asDict() for r in each.collect()}}
        result["exact_match"] = self.cells["rows", "exact"] / max(self.cells["rows", "all"], 1)
        self.history.append(result)
        return result
