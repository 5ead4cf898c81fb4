import datetime as dt
import math
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import pairs

T = dt.datetime(2025, 1, 1)
SCHEMA = "sentence_id bigint, shard int, i int, j int, value double, written_at timestamp, a int, code string, token string"


def frame(spark, rows):
    return spark.createDataFrame([(s, 0, i, j, v, T + dt.timedelta(seconds=t), 1, "x", "y") for s, i, j, v, t in rows], SCHEMA)


def brute(rows):
    latest = {}
    for s, i, j, v, t in rows:
        if i is not None and j is not None and i >= 0 and j >= 0:
            rank = (t, v is not None, math.inf if v is not None and math.isnan(v) else v or 0)
            if (s, i, j) not in latest or rank > latest[s, i, j][0]:
                latest[s, i, j] = (rank, v)
    together, total, single = defaultdict(set), defaultdict(float), defaultdict(set)
    for (s, i, j), (_, v) in latest.items():
        single[i].add(s)
        single[j].add(s)
        if i != j:
            key = (min(i, j), max(i, j))
            together[key].add(s)
            total[key] += v if v is not None and v >= 0 and not math.isnan(v) else 0.0
    n = len({s for s, _, _ in latest})
    return n, {k: (len(v), round(total[k], 6), len(single[k[0]]), len(single[k[1]])) for k, v in together.items()}


def run(spark, rows):
    df = frame(spark, rows)
    tokens = pairs.token_sentences(df)
    n = pairs.count_sentences(tokens)
    out = pairs.associations(pairs.pair_counts(pairs.pair_records(df)), tokens, n)
    return n, out.collect()


def test_equals_brute_force(spark):
    rng = random.Random(8)
    value = lambda: rng.choice([0.5, None, float("nan"), -1.0, 2.0])
    rows = [(rng.choice([None, *range(30)]), 3 if rng.random() < 0.3 else rng.choice([None, -1, *range(12), 2**31 - 1]), rng.choice([None, *range(12)]), value(), rng.randrange(3)) for _ in range(3000)]
    n, got = run(spark, rows)
    want_n, want = brute(rows)
    assert n == want_n
    assert {(r["token_a"], r["token_b"]): (r["n_ab"], round(r["total_value"], 6), r["n_a"], r["n_b"]) for r in got} == want
    for r in got:
        a, b, c, d = r["n_ab"], r["n_a"] - r["n_ab"], r["n_b"] - r["n_ab"], max(n - r["n_a"] - r["n_b"] + r["n_ab"], 0)
        assert r["log_odds"] == pytest.approx(math.log((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))))
        assert r["lift"] == pytest.approx(n * a / (r["n_a"] * r["n_b"])) and r["pmi"] == pytest.approx(math.log2(r["lift"]))


def test_one_direction_self_pairs_and_repeats(spark):
    rows = [(1, 5, 2, 1.0, 0), (1, 5, 2, 4.0, 1), (2, 2, 5, 1.0, 0), (3, 7, 7, 1.0, 0)]
    n, got = run(spark, rows)
    assert n == 3 and [(r["token_a"], r["token_b"], r["n_ab"], r["total_value"]) for r in got] == [(2, 5, 2, 5.0)]


def test_empty(spark):
    assert run(spark, []) == (0, [])
    assert run(spark, [(1, None, 2, 1.0, 0), (1, -1, 2, 1.0, 0)]) == (0, [])


def test_counts_beyond_32_bits(spark):
    big = 5_000_000_000
    pair = spark.createDataFrame([(1, 2, big, 1.0)], "token_a int, token_b int, n_ab bigint, total_value double")
    tokens = spark.createDataFrame([(1, 2 * big), (2, 3 * big), (pairs.EVERY, 40 * big)], "token int, n bigint")
    n = pairs.count_sentences(tokens)
    r = pairs.associations(pair, tokens, n).first()
    assert n == 40 * big and r["lift"] == pytest.approx(40 / 6) and r["log_odds"] == pytest.approx(math.log(36 / 2), rel=1e-6)


@settings(max_examples=400, deadline=None)
@given(st.integers(1, 500), st.integers(0, 500), st.integers(0, 500), st.integers(0, 10**6))
def test_lift_of_four_means_corrected_odds_of_four(a, b, c, rest):
    n = a + b + c + rest
    if n * a >= 4 * (a + b) * (a + c):
        assert (a + 0.5) * (rest + 0.5) >= 4 * (b + 0.5) * (c + 0.5)
