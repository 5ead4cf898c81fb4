"""Reading and writing of tables and models: parquet and JSON, never pickled objects."""

from __future__ import annotations

import json
from datetime import UTC, datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import identity_alignment
from threadloom.nn.model import REGISTRY, Loss, Model

CELL = "elem int, class string, param string, n_rows int, n_cols int, i int, j int, value double"


def texts(spark: SparkSession, values: list[str] | str) -> DataFrame:
    """(doc_id, text, alignment, original) of texts in memory; a single text is one row."""
    rows = [(k, t) for k, t in enumerate([values] if isinstance(values, str) else values)]
    return mapped(spark.createDataFrame(rows, "doc_id bigint, text string"))


def mapped(docs: DataFrame, column: str = "text") -> DataFrame:
    """Add the identity alignment and the original to rows with a text."""
    return docs.withColumn("alignment", identity_alignment(F.col(column))).withColumn("original", F.col(column))


def tensors(spark: SparkSession, inputs, answers) -> DataFrame:
    """(id, features, label) of arrays in memory; raises if their lengths differ."""
    if len(inputs) != len(answers):
        raise ValueError("inputs and answers differ in length")
    rows = [(k, [float(v) for v in np.atleast_1d(x)], [float(v) for v in np.atleast_1d(y)]) for k, (x, y) in enumerate(zip(inputs, answers, strict=True))]
    return spark.createDataFrame(rows, "id bigint, features array<double>, label array<double>")


def save_model(model: Model, spark: SparkSession, path: str, name: str | None = None, save_loss: bool = False) -> str:
    """Architecture as JSON text, parameters as cells; the optimizer's state is not kept."""
    name = name or datetime.now(UTC).strftime("model-%Y%m%d-%H%M%S")
    target = f"{path}/{name}"
    elements = [*model.elements, *([model.loss] if save_loss and model.loss else [])]
    meta = [{"class": type(e).__name__, "config": e.config()} for e in elements]
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{target}/architecture")
    cells = []
    for k, e in enumerate(elements):
        for p, v in e.get_parameters().items():
            grid = np.atleast_2d(v)
            cells += [(k, type(e).__name__, p, grid.shape[0] if v.ndim == 2 else 0, grid.shape[1], i, j, float(grid[i, j])) for i in range(grid.shape[0]) for j in range(grid.shape[1])]
    spark.createDataFrame(cells, CELL).write.mode("overwrite").parquet(f"{target}/parameters")
    return target


def load_model(spark: SparkSession, target: str) -> Model:
    meta = json.loads(spark.read.text(f"{target}/architecture").first()[0])
    elements = []
    for item in meta:
        if item["class"] not in REGISTRY:
            raise ValueError(f"unknown element: {item['class']}")
        elements.append(REGISTRY[item["class"]](**item["config"]))
    params: dict[tuple[int, str], np.ndarray] = {}
    for r in spark.read.parquet(f"{target}/parameters").toLocalIterator():
        grid = params.setdefault((r["elem"], r["param"]), np.zeros((max(r["n_rows"], 1), r["n_cols"])))
        grid[r["i"], r["j"]] = r["value"]
        if not r["n_rows"]:
            params[r["elem"], r["param"]] = grid
    flat = {(r["elem"], r["param"]) for r in spark.read.parquet(f"{target}/parameters").where("n_rows = 0").select("elem", "param").distinct().collect()}
    for (k, p), v in params.items():
        elements[k].set_parameters({p: v[0] if (k, p) in flat else v})
    loss = elements.pop() if elements and isinstance(elements[-1], Loss) else None
    return Model(elements, loss)
