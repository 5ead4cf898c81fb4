import unicodedata

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.functions import aligned, places, text
from threadloom.sources.store import mapped, texts

PIECES = [
    "abc", "It's", "'LL", "’re", "_x", "camelCase", "snake_case", "1", "1234567", "٣", "Ⅷ", ".", "?!", "\n", "\r\n", "\t", "   ", " ", " ", "　", "\x1c", "\x1f", "\x85", " ", "​", "﻿",
    "ą", "ą", "́", "ǅ", "ʰ", "中", "ん", "𝓗", "😀", "ß", "İ", "ﬁ", "x" * 101, "</s>", "[PAD]", "",
]
mixed = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)


def column(spark, values, expr):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, text string")
    return [r[0] for r in df.orderBy("k").select(expr(F.col("text"))).collect()]


def sample():
    import random

    rng = random.Random(11)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(12))) for _ in range(1500)] + [None, ""]


def test_split_keep_is_lossless_and_equals_a_regex_engine(spark):
    values = sample()
    for name, pattern in text.PATTERNS.items():
        got = column(spark, values, lambda c, p=pattern: text.split_keep(c, p))
        compiled = regex.compile(pattern)
        for v, tokens in zip(values, got, strict=True):
            if v is None:
                assert tokens is None
                continue
            assert "".join(tokens) == v, name
            want, at = [], 0
            for m in compiled.finditer(v):
                want += [v[at : m.start()], m[0]]
                at = m.end()
            assert tokens == [t for t in [*want, v[at:]] if t], (name, v)


def test_collapse_blanks_keeps_the_first(spark):
    values = ["  a   b\n\n", "\x1ca\x1f\x1fb", "", None, " \t "]
    assert column(spark, values, text.collapse_blanks) == ["a b", "a\x1fb", "", None, ""]


def test_byte_level(spark):
    values = ["怨ン縁", "ゔみバ", "𝓗𝓮", "Lorem ipsum", "\x00é", None, ""]
    alphabet = text.byte_alphabet()
    want = [None if v is None else "".join(alphabet[b] for b in v.encode()) for v in values]
    assert column(spark, values, text.byte_level) == want
    assert want[0] == "æĢ¨ãĥ³ç¸ģ"


def test_unicode_forms_and_marks(spark):
    assert column(spark, ["ą", None], lambda c: text.unicode_form(c, "NFC")) == ["ą", None]
    assert column(spark, ["𝓗𝓮𝓵𝓵𝓸"], lambda c: text.unicode_form(c, "NFKC")) == ["Hello"]
    assert column(spark, ["ą ą"], text.strip_marks) == ["a ą"]


def test_splits(spark):
    assert column(spark, ["Lorem  ipsum, dolor"], text.split_blanks) == [["Lorem", "ipsum,", "dolor"]]
    assert column(spark, ["Hug Hugged, Face."], text.split_punctuation) == [["Hug Hugged", ",", " Face", "."]]
    assert column(spark, ["a,b c", "", None], lambda c: text.in_sequence(c, text.split_blanks, text.split_punctuation)) == [["a", ",", "b", "c"], [], None]


def test_span_and_alignment(spark):
    df = mapped(spark.createDataFrame([("abcdef",), ("",)], "text string"))
    spans = df.select(*[text.span(F.col("alignment"), F.lit(a), F.lit(b)).alias(f"s{a}{b}") for a, b in ((1, 3), (2, 2), (4, 9), (0, 0))]).collect()
    assert [tuple(x) if x else None for x in spans[0]] == [(1, 3), (2, 2), None, None]
    assert all(x is None for x in spans[1])
    assert [r["alignment"] for r in texts(spark, ["ab", ""]).orderBy("doc_id").collect()] == [[0, 1], []]


@settings(max_examples=150, deadline=None)
@given(mixed)
def test_aligned_steps_agree_with_plain_ones(value):
    places = list(range(len(value)))
    for form in ("NFC", "NFD", "NFKC", "NFKD"):
        out, where = aligned.unicode_form(form)(value, places)
        assert out == unicodedata.normalize(form, value) and len(out) == len(where)
        assert where == sorted(where) and all(0 <= p < len(value) for p in where)
    low, where = aligned.lower(value, places)
    assert low == value.lower() or len(low) == len(where)
    clean, where = aligned.collapse_blanks(value, places)
    assert len(clean) == len(where) and all(value[p] == c for p, c in zip(where, clean, strict=True))
    bare, where = aligned.strip_marks(value, places)
    assert len(bare) == len(where)


def test_aligned_chain(spark):
    steps = [aligned.lower, aligned.replace_literal("hug", "mu"), aligned.collapse_blanks]
    got = column(spark, ["Hugging  Hug", "", None], lambda c: aligned.chain(c, *steps))
    assert got[0]["text"] == "muging mu" and got[0]["alignment"] == [2, 2, 3, 4, 5, 6, 7, 11, 11]
    assert got[1]["text"] == "" and got[1]["alignment"] == [] and got[2] is None


@pytest.mark.parametrize("name", sorted(text.PATTERNS))
def test_long_runs(spark, name):
    n = 2_000 if name == "gpt4o_literal" else 200_000  # the gaps of the literal take a look ahead for each letter
    values = ["x" * n, "X" * n, "中" * n, "1" * n, "." * n, " " * n, "\n" * n, "e\u0301" * n, "aB" * n, "ab " * (n // 4)]
    tokens = column(spark, values, lambda c: text.split_keep(c, text.PATTERNS[name]))
    assert all("".join(t) == v for t, v in zip(tokens, values, strict=True))
    if name == "boundless":
        assert [len(t) for t in tokens] == [1, 1, 1, (n + 2) // 3, 1, 1, 1, 1, n + 1, n // 4 + 1]
        assert tokens[3][:2] == ["1" * ((n - 1) % 3 + 1), "111"]


def test_boundless_groups_digits_with_marks(spark):
    values = ["".join(c + "\u0301" * (k % 3 == 0) for k, c in enumerate("12345678"[:n])) + "x" for n in range(1, 9)]
    got = column(spark, values, text.split_boundless)
    assert got == [regex.findall(text.BOUNDLESS, v) for v in values]


def test_places_point_to_the_tokens(spark):
    values = sample()
    for name, pattern in text.PATTERNS.items():
        got = column(spark, values, lambda c, p=pattern: places.placed(text.split_keep(c, p)))
        for v, tokens in zip(values, got, strict=True):
            assert (v is None) == (tokens is None)
            assert all(v[t["start"] : t["end"]] == t["token"] for t in tokens or []), name
            assert sum(t["end"] - t["start"] for t in tokens or []) == len(v or "")
    words = column(spark, [" a  bc", "", None], lambda c: places.placed_where(text.split_keep(c, r"\s+"), lambda t: ~t.rlike(r"(?U)^\s")))
    assert [[tuple(t) for t in w] if w is not None else None for w in words] == [[("a", 1, 2), ("bc", 4, 6)], [], None]


def test_byte_places(spark):
    values = ["aé中😀", "", None, "x"]
    assert column(spark, values, places.byte_places) == [[0, 1, 1, 2, 2, 2, 3, 3, 3, 3], [], None, [0]]
    letters = column(spark, values, text.byte_level)
    assert [len(x) for x in letters if x is not None] == [10, 0, 1]
