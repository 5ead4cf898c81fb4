import datetime as dt
import math
import random
from collections import defaultdict

import pytest

from threadloom.operators import keyagg

SCHEMA = "sentence_id bigint, shard int, i int, j int, value double, written_at timestamp, key string, side int, slot int, n int"
T = dt.datetime(2025, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(s, 0, i, j, v, T + dt.timedelta(seconds=t), "x", 1, 2, 3) for s, i, j, v, t in rows], SCHEMA)


def brute(rows):
    latest = {}
    for s, i, j, v, t in rows:
        if i is not None and j is not None and i >= 0 and j >= 0:
            rank = (t, v is not None, math.inf if v is not None and math.isnan(v) else v or 0)
            if (s, i, j) not in latest or rank > latest[s, i, j][0]:
                latest[s, i, j] = (rank, v)
    out = defaultdict(lambda: [0, 0.0, set()])
    for (s, i, j), (_, v) in latest.items():
        good = v if v is not None and v >= 0 and not math.isnan(v) and not math.isinf(v) else 0.0
        for key, partner in ((("i", i), j), (("j", j), i)):
            out[key][0] += 1
            out[key][1] += good
            out[key][2].add(partner)
    return {k: (n, round(t, 6), len(p)) for k, (n, t, p) in out.items()}


@pytest.mark.parametrize("fan_in", [2, 16])
def test_profile_with_hot_key_and_dirt(spark, fan_in):
    rng = random.Random(fan_in)
    value = lambda: rng.choice([0.5, 1.0, None, float("nan"), -1.0, float("inf"), 0.25])
    rows = [(rng.choice([None, *range(40)]), 7 if rng.random() < 0.35 else rng.choice([None, -1, *range(30)]), rng.choice([None, -2, *range(30), 200000]), value(), rng.randrange(3)) for _ in range(4000)]
    got = keyagg.tree_profile(keyagg.valid_records(frame(spark, rows)), chunk_rows=256, fan_in=fan_in).collect()
    assert {(r["side"], r["token_id"]): (r["n_records"], round(r["total_value"], 6), r["n_partners"]) for r in got} == brute(rows)


def test_latest_value_and_ties(spark):
    rows = [(1, 2, 3, 5.0, 0), (1, 2, 3, 1.0, 9), (1, 2, 3, 2.0, 9), (1, 2, 3, None, 9)]
    got = keyagg.tree_profile(keyagg.valid_records(frame(spark, rows))).where("side = 'i'").collect()
    assert [(r["n_records"], r["total_value"]) for r in got] == [(1, 2.0)]


def test_empty_table(spark):
    profile = keyagg.tree_profile(keyagg.valid_records(frame(spark, [])))
    assert profile.count() == 0 and keyagg.hot_keys(profile, 0.02).count() == 0


def test_hot_keys_counts_share_of_valid_records(spark):
    rows = [(s, 1, s, 1.0, 0) for s in range(50)] + [(s, 2 + s, 1, 1.0, 0) for s in range(50)]
    hot = keyagg.hot_keys(keyagg.tree_profile(keyagg.valid_records(frame(spark, rows))), 0.2)
    assert sorted(map(tuple, hot.collect())) == [("i", 1), ("j", 1)]
