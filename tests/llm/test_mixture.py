import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import mixture

SIZES = "doc_id bigint, source string, n_tokens bigint, rate double, node int"
WEIGHTS = "source string, target_weight double, max_repeats int, share double"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 500)), min_size=1, max_size=60), st.integers(0, 99))
def test_pivotal_keeps_the_tokens(rows, seed):
    p, size = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out, live = mixture.pivotal(p, size, np.random.default_rng(seed).random(len(rows)))
    whole = (out <= mixture._EPS) | (out >= 1 - mixture._EPS)
    assert (~whole).sum() == (live >= 0) and (live < 0 or not whole[live])
    assert abs((out * size).sum() - (p * size).sum()) < 1e-3 * len(rows) + 1e-6 * size.sum()


def test_pivotal_keeps_expectations():
    p, size = np.array([0.3, 0.6, 0.5, 0.2, 0.9]), np.array([1.0, 2.0, 3.0, 1.0, 2.0])
    mean = np.mean([mixture.pivotal(p, size, np.random.default_rng(k).random(5))[0] for k in range(4000)], axis=0)
    assert np.allclose(mean, p, atol=0.03)


def build(spark, sizes, weights, **kwargs):
    s = spark.createDataFrame([(*r, 1.0, 1) for r in sizes], SIZES)
    plan = mixture.source_plan(s, spark.createDataFrame([(*w, 0.5) for w in weights], WEIGHTS), kwargs.pop("total_tokens", None))
    copies = mixture.mixture(s, plan, **kwargs)
    return copies.collect(), {r["source"]: r for r in mixture.mixture_report(copies, plan).collect()}


def data():
    rng = np.random.default_rng(1)
    rows = [(k, "big", int(rng.integers(1, 900))) for k in range(3000)] + [(5000 + k, "small", int(rng.integers(1, 300))) for k in range(200)] + [(9000 + k, "tiny", 7) for k in range(5)]
    return rows + [(9100, None, 50), (9101, "other", 70), (9102, "big", 0), (9103, "big", None), (None, "big", 9), (0, "big", 1), (0, "big", 1)]


@pytest.mark.parametrize(("chunk", "fan_in"), [(50, 4), (8192, 256)])
def test_shares_and_caps(spark, chunk, fan_in):
    copies, report = build(spark, data(), [("big", 0.6, 1), ("small", 0.3, 4), ("tiny", 0.001, 9), ("absent", 0.1, 3)], chunk=chunk, fan_in=fan_in)
    caps = {"big": 1, "small": 4, "tiny": 9}
    assert all(0 <= r["copies"] <= caps[r["source"]] for r in copies)
    assert len({r["doc_id"] for r in copies}) == len(copies) and {9100, 9101} & {r["doc_id"] for r in copies} == set()
    for name in caps:
        total = sum(r["mixed_tokens"] for r in report.values())
        assert abs(report[name]["mixed_tokens"] - report[name]["share"] * total) <= 900
    assert report["absent"]["reached_share"] == 0 and report["absent"]["share"] == 0


def test_same_result_whatever_the_partitions(spark):
    salted = sorted(tuple(r) for r in build(spark, data(), [("big", 0.5, 2), ("small", 0.5, 2)], broadcast_sources=0)[0])
    once = sorted(tuple(r) for r in build(spark, data(), [("big", 0.5, 2), ("small", 0.5, 2)])[0])
    again = sorted(tuple(r) for r in build(spark, list(reversed(data())), [("big", 0.5, 2), ("small", 0.5, 2)])[0])
    assert once == again == salted


def test_fixed_total_hits_caps(spark):
    _, report = build(spark, data(), [("big", 0.5, 1), ("tiny", 0.5, 2)], total_tokens=10_000)
    assert report["tiny"]["n_copies"] == 10 and report["tiny"]["reached_share"] < 0.1


def test_empty_tables(spark):
    assert build(spark, [], [("a", 1.0, 1)])[0] == []
    copies, report = build(spark, data(), [])
    assert copies == [] and report == {}
    assert build(spark, [(1, "a", 0), (2, "a", None)], [("a", None, 2)])[1]["a"]["mixed_tokens"] == 0


def test_expand(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id bigint, text string")
    copies = spark.createDataFrame([(1, 3), (2, 0)], "doc_id bigint, copies int")
    assert sorted(tuple(r) for r in mixture.expand(docs, copies).collect()) == [(1, "x", 1), (1, "x", 2), (1, "x", 3)]
