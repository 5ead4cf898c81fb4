import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom import session
from threadloom.nn import activations, initializers, layers, losses, optimizers
from threadloom.nn import model as nn
from threadloom.operators import cooccurrence, dataset, glove, metrics
from threadloom.operators.tracker import Tracker, last_values, sampled
from threadloom.sources import store


def test_activation_gradients_match_differences(spark):
    xs = [x + 0.013 for x in (-30.0, -3.0, -0.5, 0.2, 1.0, 5.0, 9.0, 40.0)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    h = 1e-5
    for name, f in activations.FORWARD.items():
        slope = (f(F.col("x") + h) - f(F.col("x") - h)) / (2 * h)
        for r in df.select(slope.alias("a"), activations.GRADIENT[name](F.col("x")).alias("b")).collect():
            assert r["a"] == pytest.approx(r["b"], abs=1e-4), name


def test_driver_elements_agree_with_columns(spark):
    xs = [-30.0, -1.0, -0.2, 0.3, 2.0, 9.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    pairs = {"relu": nn.ReLU(), "leaky_relu": nn.LeakyReLU(), "elu": nn.ELU(), "sigmoid": nn.Sigmoid(), "tanh": nn.Tanh(), "sin": nn.Sin(), "identity": nn.Identity(), "softplus": nn.Softplus(), "mish": nn.Mish(), "relu_clip": nn.ReLUClip(), "prelu": nn.PReLU()}
    for name, element in pairs.items():
        got = [r[0] for r in df.select(activations.FORWARD[name](F.col("x")).cast("double")).collect()]
        assert np.allclose(element.forward(np.array(xs)[:, None])[:, 0], got), name


def test_softmax_sums_to_one(spark):
    df = spark.createDataFrame([([1000.0, 1001.0, 999.0],), ([0.0],)], "x array<double>")
    assert [sum(r[0]) for r in df.select(activations.softmax(F.col("x"))).collect()] == pytest.approx([1.0, 1.0])


@pytest.mark.parametrize("loss", [nn.MeanSquaredError(), nn.BinaryCrossEntropy(), nn.CategoricalCrossEntropy()])
def test_model_gradients_match_differences(loss):
    rng = np.random.default_rng(0)
    y = np.eye(3)[rng.integers(0, 3, 6)]
    x = rng.normal(size=(6, 4))
    last = nn.Softmax() if isinstance(loss, nn.CategoricalCrossEntropy) else nn.Sigmoid()
    model = nn.Model([nn.NLayer(4, 5, initializers.Random(seed=1)), nn.PReLU(multichannel=True), nn.NLayer(5, 3, initializers.Random(seed=2)), last], loss)
    model.backward(loss.backward(model.forward(x), y, len(x)))
    grads = model.gradients()
    for key, g in grads.items():
        values = model.parameters()[key]
        at = (0,) * values.ndim
        keep = values[at]
        values[at] = keep + 1e-5
        up = loss.forward(model.forward(x), y).mean()
        values[at] = keep - 1e-5
        down = loss.forward(model.forward(x), y).mean()
        values[at] = keep
        assert (up - down) / 2e-5 == pytest.approx(g[at], abs=1e-5), key


@pytest.mark.parametrize("optimizer", [optimizers.SGD(0.5), optimizers.SGD(0.2, momentum=0.9), optimizers.AdaGrad(0.1), optimizers.RMSProp(0.01), optimizers.Adam(0.02), optimizers.AdamW(0.02), optimizers.Muon(0.05)])
def test_training_lowers_the_loss(spark, optimizer):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 3))
    y = (x.sum(1) > 0).astype(int)
    rows = store.tensors(spark, x, y)
    model = nn.Model([nn.NLayer(3, 8, initializers.HeKaiming(seed=1)), nn.Tanh(), nn.NLayer(8, 2, initializers.XavierGlorot(seed=2)), nn.Softmax()], nn.CategoricalCrossEntropy())
    tracker = Tracker()
    history = model.train(dataset.batches(rows, "id", 60), optimizer, epochs=5, tracker=tracker)
    assert history[-1] < history[0] and tracker.data["loss"] == history


def test_orthogonal_update_and_scales():
    m = optimizers.Muon()
    x = m.orthogonal(np.random.default_rng(0).normal(size=(6, 4)))
    assert np.all(np.abs(np.linalg.svd(x, compute_uv=False) - 1) < 0.4)
    assert optimizers.scale("moonlight", 4, 9) == pytest.approx(0.6) and optimizers.scale("kellerjordan", 9, 4) == 1
    with pytest.raises(ValueError):
        optimizers.Muon(mode="other")


def test_save_and_load_model(spark, tmp_path):
    model = nn.Model([nn.NLayer(3, 2, initializers.Random(seed=3)), nn.PReLU(), nn.Softmax()], nn.CategoricalCrossEntropy())
    x = np.array([[1.0, 2.0, 3.0]])
    again = store.load_model(spark, store.save_model(model, spark, str(tmp_path), "m", save_loss=True))
    assert np.allclose(model.forward(x), again.forward(x)) and isinstance(again.loss, nn.CategoricalCrossEntropy)


def test_inference_keeps_null_rows(spark):
    model = nn.Model([nn.NLayer(2, 5, initializers.Static(1))])
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, None)], "id int, features array<double>")
    assert [r["output"] for r in model.inference(df).orderBy("id").collect()] == [[3.0] * 5, None]


def test_losses_on_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], 1), ([0.5, 0.5], 0)], "p array<double>, y int")
    got = df.agg(losses.categorical_cross_entropy(F.col("p"), F.col("y"))).first()[0]
    assert got == pytest.approx((-math.log(1e-7) - math.log(0.5)) / 2)


def test_cooccurrence_equals_brute_force(spark):
    rng = random.Random(5)
    sentences = [[1, 2, 1, 1, 3], [2], [3, 3], [], [5, 4, 3, 2, 1, 0, 7], None, *[[rng.randrange(5) for _ in range(rng.randrange(9))] for _ in range(60)]]
    df = spark.createDataFrame([(s,) for s in sentences], "tokens array<int>")
    for window, weighted in ((1, True), (5, True), (50, False)):
        want = {}
        for s in sentences:
            for p, a in enumerate(s or []):
                for d in range(1, window + 1):
                    if p + d < len(s):
                        for key in ((a, s[p + d]), (s[p + d], a)):
                            want[key] = want.get(key, 0) + (1 / d if weighted else 1)
        got = {(r["i"], r["j"]): r["value"] for r in cooccurrence.cooccurrence(df, window, weighted).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    with pytest.raises(Exception, match="token ids"):
        cooccurrence.cooccurrence(spark.createDataFrame([([1, -1],)], "tokens array<int>")).collect()


def test_cooccurrence_store_and_batches(spark, tmp_path):
    rows = spark.createDataFrame([(k % 7, k % 5, float(k)) for k in range(25)], cooccurrence.SCHEMA)
    cooccurrence.write(rows, f"{tmp_path}/c")
    again = cooccurrence.read(spark, f"{tmp_path}/c")
    blocks = list(cooccurrence.batches(again, 10))
    assert [len(b) for b in blocks] == [10, 10, 5] and cooccurrence.count(again) == 25
    assert sorted((int(r["i"]), int(r["j"]), float(r["value"])) for b in blocks for r in b) == sorted(map(tuple, rows.collect()))
    odd = next(iter(cooccurrence.batches(spark.createDataFrame([(None, 2, None)], cooccurrence.SCHEMA))))
    assert odd["i"][0] == -1 and np.isnan(odd["value"][0]) and list(cooccurrence.batches(rows.limit(0))) == []
    mixed = cooccurrence.shuffle_rows(again, 1)
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, rows.collect()))


def test_glove_driver_and_table_steps_agree(spark):
    rng = np.random.default_rng(0)
    records = spark.createDataFrame([(int(a), int(b), float(v)) for a, b, v in zip(rng.integers(0, 6, 40), rng.integers(0, 6, 40), rng.uniform(0.1, 120, 40), strict=True)] + [(1, 2, -1.0), (1, 2, float("nan"))], cooccurrence.SCHEMA)
    model = glove.GloVe(6, dimensions=3, seed=4)
    ones = F.array(*[F.lit(1.0)] * 3)
    params = model.frame(spark).withColumns({"gw": ones, "gwc": ones, "gb": F.lit(1.0), "gbc": F.lit(1.0)})
    new = {r["token_id"]: r for r in glove.step(records, params).collect()}
    history = model.train(records, epochs=4)
    assert history[-1] < history[0]
    fresh = glove.GloVe(6, dimensions=3, seed=4)
    fresh.train(records, epochs=1)
    for k in range(6):
        assert new[k]["w"] == pytest.approx(fresh.w[k].tolist()) and new[k]["bc"] == pytest.approx(fresh.bc[k])


def test_metrics_edges(spark):
    rows = spark.createDataFrame([(1, [0.5, 0.5, 0.0], 1), (2, [0.1, 0.2, 0.7], 2), (3, None, 0), (4, [0.1], 0), (5, [float("nan"), 0.0, 0.0], 0), (6, [1.0, 0.0, 0.0], None), (7, [1.0, 0.0, 0.0], 9)], "id int, scores array<double>, truth int")
    good = metrics.valid_predictions(rows, 3)
    assert good.count() == 2
    counts = metrics.class_counts(metrics.confusion(good), 3)
    assert {r["class_id"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in counts.collect()} == {0: (0, 1, 0, 1), 1: (0, 0, 1, 1), 2: (1, 0, 0, 1)}
    assert metrics.top_k_accuracy(good, 1, 3).first()[0] == 0.5 and metrics.top_k_accuracy(good, 2, 3).first()[0] == 1.0
    empty = metrics.class_counts(metrics.confusion(good.limit(0)), 3)
    assert {(r["tp"], r["tn"]) for r in empty.collect()} == {(0, 0)} and metrics.overall(empty).first()["accuracy"] == 0
    with pytest.raises(ValueError):
        metrics.top_k_accuracy(good, 4, 3)


def test_counts_beyond_32_bits(spark):
    big = 5_000_000_000
    counts = spark.createDataFrame([(0, big, big, 2 * big, 6 * big), (1, 2 * big, big, big, 6 * big)], "class_id int, tp bigint, fp bigint, fn bigint, tn bigint")
    first = metrics.per_class(counts).where("class_id = 0").first()
    assert first["precision"] == 0.5 and first["recall"] == pytest.approx(1 / 3) and first["mcc"] == pytest.approx(4 / math.sqrt(2 * 3 * 7 * 8)) and first["kappa"] > 0
    assert metrics.overall(counts).first()["accuracy"] == 0.5


def test_values_that_are_no_numbers(spark):
    history = spark.createDataFrame([(0, 1, float("nan")), (0, 1, 2.0), (0, 0, 3.0), (1, 5, float("nan"))], "run int, step int, value double")
    assert {(r["run"], r["step"], r["value"]) for r in last_values(history, "run").collect()} == {(0, 1, 2.0), (1, 5, None)}
    assert sorted((r["step"], str(r["value"])) for r in sampled(history, 5).collect()) == [(0, "3.0"), (5, "None")]


def test_sizes_are_checked():
    with pytest.raises(ValueError, match="too many"):
        layers.dense(F.lit(1), np.zeros((1000, 1000)), np.zeros(1000))
    model = nn.Model([nn.NLayer(2, 2)])
    nn.MOST_BYTES, kept = 8, nn.MOST_BYTES
    try:
        with pytest.raises(ValueError, match="parameters"):
            model.check_size()
    finally:
        nn.MOST_BYTES = kept


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="checkpoint"):
        session.ensure_checkpoint_dir(Session())


def test_data_sets(spark):
    df = spark.range(11).withColumnRenamed("id", "key")
    assert dataset.split(df, "key", 0.5).where("part = 'head'").agg(F.count("key"), F.max("key")).first() == (6, 5)
    assert [r["count"] for r in dataset.batches(df, "key", 4).groupBy("batch").count().orderBy("batch").collect()] == [4, 4, 3]
    first, second = ([r["key"] for r in dataset.shuffle(df, "key", 1, e).orderBy("place").collect()] for e in (0, 1))
    assert sorted(first) == sorted(second) == list(range(11)) and first != second
    with pytest.raises(ValueError):
        store.tensors(spark, [[1]], [])


def test_tracker():
    t = Tracker(every=2)
    for k in range(5):
        t.log({"loss": k})
    assert t.data["loss"] == [0, 2, 4] and repr(t) == "loss: 4"
    with pytest.raises(ValueError):
        Tracker(0)


def test_accumulated_metrics(spark):
    df = spark.createDataFrame([([0.9, 0.1], 0), ([0.2, 0.8], 0)], "scores array<double>, truth int")
    m = metrics.CategoricalMetrics(2, every=2)
    with pytest.raises(ValueError):
        m.calculate(spark)
    m.add(df)
    m.add(df)
    assert m.calculate(spark) is None and m.calculate(spark, force=True)["accuracy"] == 0.5
    assert m.history[0]["classes"][0]["recall"] == 0.5 and m.history[0]["mean_precision"] == 0.5
    multi = metrics.MultiLabelMetrics()
    multi.add(spark.createDataFrame([([0.9, 0.1], [1, 0]), ([0.9, 0.9], [1, 0])], "scores array<double>, truth array<int>"))
    got = multi.calculate(spark)
    assert got["exact_match"] == 0.5 and got["labels"][1]["fp"] == 1 and got["mean_accuracy"] == 0.75
    multi.clear()
    with pytest.raises(ValueError):
        multi.calculate(spark, force=True)
