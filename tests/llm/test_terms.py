import datetime as dt
from collections import Counter, defaultdict

import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import terms

T = dt.datetime(2025, 1, 1)
SCHEMA = "string_id bigint, text string, loaded_at timestamp, term string, id bigint, n int, block int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, T + dt.timedelta(seconds=s), "x", 1, 2, 3) for i, t, s in rows], SCHEMA)


def counts(spark, rows, **kwargs):
    latest = terms.latest_text(frame(spark, rows), "string_id", "text", "loaded_at")
    return {r["term"]: (r["n_occurrences"], r["n_records"]) for r in terms.term_counts(latest, **kwargs).collect()}


def brute(rows):
    latest = {}
    for i, t, s in rows:
        if i is not None and t is not None and (i not in latest or (s, t) > latest[i]):
            latest[i] = (s, t)
    n, df = Counter(), defaultdict(set)
    for i, (_, t) in latest.items():
        for w in regex.findall(terms.TERM, t.lower()):
            n[w] += 1
            df[w].add(i)
    out = {w: (n[w], len(df[w])) for w in n}
    return out | ({None: (len(latest), len(latest))} if latest else {})


@settings(max_examples=8, deadline=None)
@given(rows=st.lists(st.tuples(st.sampled_from([None, 1, 2, 3, 70000, -5, 2**40]), st.sampled_from([None, "", "a b A", "ab​c ab​c", "é é İ", "同じ 同じ、x_y 1.5"]), st.integers(0, 2)), max_size=12))
def test_equals_brute_force(spark, rows):
    assert counts(spark, rows) == brute(rows)


def test_many_small_blocks_and_hot_term(spark):
    rows = [(k, f"the w{k % 700} w{k}", 0) for k in range(3000)] + [(k, "the again", 1) for k in range(100)]
    assert counts(spark, rows, most_postings=50) == brute(rows)


def test_very_long_text(spark):
    rows = [(1, "word " * 200_000 + "x" * 300_000, 0), (2, "", 0)]
    got = counts(spark, rows)
    assert got["word"] == (200_000, 1) and got[None] == (2, 2)


def test_empty_table_and_marks(spark):
    assert counts(spark, []) == {}
    latest = terms.latest_text(frame(spark, [(k, f"all {'most' if k < 3 else 'few'} only{k}", 0) for k in range(20)]), "string_id", "text", "loaded_at")
    marked = {r["term"]: r["mark"] for r in terms.mark_terms(terms.term_counts(latest), 20).collect()}
    assert marked["all"] == marked["most"] == "common" and marked["only3"] == "rare"
    latest = terms.latest_text(frame(spark, [(k, "a b" if k == 1 else "b", 0) for k in range(40)]), "string_id", "text", "loaded_at")
    marked = {r["term"]: r["mark"] for r in terms.mark_terms(terms.term_counts(latest), 400).collect()}
    assert marked["b"] == "common" and marked["a"] == "rare"
    assert {r["term"]: r["mark"] for r in terms.mark_terms(terms.term_counts(latest), 401).collect()}["b"] is None
