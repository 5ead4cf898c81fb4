import random
import unicodedata
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import unify as U

CHARS = "abcoepxyABC zwqié ą̨̧́​‍­﻿   　ＡｂＣ１２ﬁⅰⅽ𝓗𝓮аеосрухѕіԁԝАВСΟοɑɡйёжшщ中ガｶﾞ한각가ε.,!?\n\t👩🔬"
mixed = st.text(st.sampled_from(CHARS), max_size=24)


@settings(max_examples=400, deadline=None)
@given(mixed)
def test_stable_and_aligned(text):
    form, places = U.unify(text)
    assert U.unify(form)[0] == form
    assert unicodedata.is_normalized("NFC", form) or any(U.is_invisible(c) for c in form)
    if places is None:
        assert len(form) == len(text)
    else:
        assert len(places) == len(form) and all(0 <= p < len(text) for p in places)


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("ꮃord", "word"), ("fⲟo", "foo"), ("ꓡisu", "Lisu"), ("ɪs", "is"), ("ʏes", "yes"), ("Ꮪtep", "Step"),
        ("the list", "the ｌｉｓｔ"), ("v3.9.6", "v3.９.6"), ("café", "café"), ("frozen", "froze​n"), ("a b", "a b"), ("scope", "ѕсоре"), ("étranges", "étrɑngеs"),
        ("fine", "ﬁne"), ("Hello", "𝓗𝓮𝓵𝓵𝓸"), ("バイト", "ﾊﾞｲﾄ"), ("матрица весов", "мaтpицa вecoв"), ("mode", "mοdе"), ("ёж", "ёж"), ("mic", "mⅰⅽ"), ("ąx", "ąx"),
    ],
)
def test_same_to_the_eye(a, b):
    assert U.unify(a)[0] == U.unify(b)[0]


@pytest.mark.parametrize(("a", "b"), [("Dr", "dr"), ("o", "ó"), ("1", "2"), ("a b", "a  b"), ("a b", "a\nb"), ("...", "…"), ("a,b", "a，b"), ("x2", "x²"), ("a b", "ab")])
def test_different_to_the_eye(a, b):
    assert U.unify(a)[0] != U.unify(b)[0]


def test_russian_text_stays_russian():
    text = "Ошибка упала до 8,80 (см. рис. 179), а в loss_v2.py сор и рост."
    assert U.unify(text)[0] == text
    assert U.unify("👩‍🔬")[0] == "👩‍🔬"


@pytest.mark.parametrize("text", ["ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ", "ⲟⲩⲟϩ ⲥⲟⲡ", "Հայաստան սոսի", "ꓡꓲ ꓢꓴ ꓶꓷ"])
def test_texts_of_other_alphabets_stay(text):
    assert U.unify(text)[0] == unicodedata.normalize("NFC", text)


def _lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for k, y in enumerate(b):
            table[i + 1][k + 1] = table[i][k] + 1 if x == y else max(table[i][k + 1], table[i + 1][k])
    return table[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=30), st.text("abc ", max_size=30), st.sampled_from([40, 1 << 26]))
def test_common_subsequence_is_a_longest_one(a, b, bits):
    kept, U._TABLE_BITS = U._TABLE_BITS, bits
    try:
        pairs = U.common_subsequence(a, b)
    finally:
        U._TABLE_BITS = kept
    assert all(a[i] == b[k] for i, k in pairs) and len(pairs) == _lcs(a, b)
    assert all(i < x and k < y for (i, k), (x, y) in zip(pairs, pairs[1:], strict=False))


@pytest.mark.parametrize("gap", [1, 63, 100, 5000])
def test_realign_has_no_window(gap):
    for filler in "- ":
        assert U.realign("az", f"a{filler * gap}z") == [0, gap + 1]
    assert U.realign("héllo wor", f"He{'-' * gap}\u0301ｌＬo{' ' * gap}Wor")[-3:] == [2 * gap + 6, 2 * gap + 7, 2 * gap + 8]
    assert U.realign("ab?cd", f"ab{'x' * gap}cd") == [0, 1, 2, gap + 2, gap + 3]


STRINGS = "id bigint, text string, alignment array<int>, original string, form string, t1 int, salt int"


def test_alignment_points_into_the_original(spark):
    rows = [
        (1, "café x", [2, 3, 4, 5, 6, 7, 8], "  café x", "z", 1, 1), (2, "ab", [0], "xab", "z", 1, 1), (3, None, None, "q", "z", 1, 1),
        (4, "", [], "", "z", 1, 1), (5, "ab", None, None, "z", 1, 1), (6, "hello", None, "He​LLo", "z", 1, 1),
    ]
    got = {r["id"]: (r["text"], r["alignment"]) for r in U.unify_strings(spark.createDataFrame(rows, STRINGS)).collect()}
    assert got == {1: ("café x", [2, 3, 4, 5, 7, 8]), 2: ("ab", [1, 2]), 3: (None, None), 4: ("", []), 5: ("ab", [0, 1]), 6: ("hello", [0, 1, 3, 4, 5])}


def test_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    base = ["mode of the scope", "list one", "café noir", "zzz", ""]
    swap = {"e": "е", "o": "ο", "s": "ѕ", " ": " ", "l": "ｌ"}
    texts = ["".join(swap.get(c, c) if rng.random() < 0.15 else c for c in rng.choice(base)) for _ in range(120)] + ["mode of the scope"] * 60
    ids = rng.sample(range(10**6), len(texts))
    rows = [(i, t, None, None, "f", 1, 1) for i, t in zip(ids, texts, strict=True)]
    got = sorted(tuple(r) for r in U.same_to_the_eye(spark.createDataFrame(rows, STRINGS), salts=3).collect())
    groups = defaultdict(list)
    for i, t in zip(ids, texts, strict=True):
        groups[U.unify(t)[0]].append((i, t))
    want = sorted((min(i, j), max(i, j)) for g in groups.values() for k, (i, s) in enumerate(g) for j, t in g[k + 1 :] if s != t)
    assert got == want
    rows = U.eye_classes(spark.createDataFrame(rows, STRINGS), salts=3).collect()
    assert len(rows) == len(texts)
    assert got == sorted((min(x["id"], y["id"]), max(x["id"], y["id"])) for k, x in enumerate(rows) for y in rows[k + 1 :] if x["class_id"] == y["class_id"] and x["text_id"] != y["text_id"])
    links = Counter(i for pair in got for i in pair)
    assert all(r["n_links"] == links[r["id"]] for r in rows)
    assert U.same_to_the_eye(spark.createDataFrame([], STRINGS)).count() == 0 == U.eye_classes(spark.createDataFrame([], STRINGS)).count()


def test_very_long_text():
    text = ("frozе​n ｌist " * 50_000) + "x" * 100_000
    form, places = U.unify(text)
    assert form == ("frozen list " * 50_000) + "x" * 100_000 and len(places) == len(form)


@pytest.mark.parametrize("whole", ["ো", "ৌ", "ொ", "ೊ", "ൊ", "ဦ"])
def test_split_vowel_signs_are_composed(whole):
    text = f"xক{unicodedata.normalize('NFD', whole)} y"
    assert text != unicodedata.normalize("NFC", text) == U.unify(text)[0]
