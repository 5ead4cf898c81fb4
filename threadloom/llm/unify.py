"""One consistent form for text that looks the same but differs in its code points.

Normalisation quick-check properties find the unstable stretches of a text. Only these are
rewritten, together with the character before them, which a mark may compose with; stable
text is copied unchanged, and ASCII text is returned as it is. Letters of other alphabets
that are drawn alike are settled by the unit of letters, digits and joining signs they stand in: evidence that
does not depend on the drawn-alike letters decides on its alphabet.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.lookalikes import ALPHABETS, DRAWN_ALIKE, alphabet, latin_of

#: Letters that both the Latin and the Russian alphabet use; they tell nothing.
NEUTRAL = frozenset("aceopxyABCEHKMOPTXY")
#: Kinds of compatibility form that leave a letter or digit readable as itself.
_KINDS = ("<wide>", "<narrow>", "<font>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")

_LATIN = latin_of()
#: Alphabets of the fixed list; their words weigh against Latin ones letter by letter.
_NEAR = ("CYRILLIC", "GREEK")


def _doubles_in(name: str) -> dict[str, str]:
    """Latin letter to its double in an alphabet; the first listed counts."""
    out: dict[str, str] = {}
    for double, latin in _LATIN.items():
        if alphabet(double) == name:
            out.setdefault(latin, double)
    return out


_IN = {name: _doubles_in(name) for name in sorted(ALPHABETS - {"LATIN"})}
_FILLERS = frozenset("\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u3164\uffa0") | {chr(c) for c in range(0xFE00, 0xFE10)}


def is_invisible(c: str) -> bool:
    return unicodedata.category(c) == "Cf" and not 0x600 <= ord(c) <= 0x6DD and ord(c) not in (0x70F, 0x110BD) or c in _FILLERS


def _readable(c: str) -> str:
    """The plain letters or digits of a compatibility form, or ``c`` itself."""
    kind, _, rest = unicodedata.decomposition(c).partition(" ")
    if kind not in _KINDS or unicodedata.category(c)[0] not in "LNM":
        return c
    plain = unicodedata.normalize("NFKC", c)
    return plain if all(unicodedata.category(x)[0] in "LNM" for x in plain) else c


@lru_cache(maxsize=1)
def _joining() -> frozenset[str]:
    """Characters that compose with the one before them, marks of combining class 0 included."""
    whole = (c for c in map(chr, range(0x80, 0x1_2000)) if unicodedata.decomposition(c)[:1] not in ("", "<") and unicodedata.is_normalized("NFC", c))
    return frozenset(x for c in whole for x in unicodedata.normalize("NFD", c)[1:])


def _is_unstable(c: str) -> bool:
    """Quick check: may this character change, or compose with the one before it?"""
    return (
        is_invisible(c)
        or (unicodedata.category(c) == "Zs" and c != " ")
        or unicodedata.combining(c) != 0
        or not unicodedata.is_normalized("NFC", c)
        or 0x1160 <= ord(c) < 0x1200
        or c in _joining()
        or _readable(c) != c
    )


@lru_cache(maxsize=1)
def _unstable() -> frozenset[str]:
    """All unstable characters, by their properties, over the blocks that hold any."""
    blocks = ((0x80, 0x3400), (0xA000, 0xAC00), (0xF900, 0x1_2000), (0x1_D000, 0x1_F000), (0x1_FB00, 0x1_FC00), (0x2_F800, 0x2_FA20), (0xE_0000, 0xE_0200))
    return frozenset(c for a, b in blocks for c in map(chr, range(a, b)) if _is_unstable(c))


@lru_cache(maxsize=1)
def _unstable_points() -> np.ndarray:
    """For every code point whether it is unstable."""
    mask = np.zeros(0x11_0000, bool)
    mask[[ord(c) for c in _unstable()]] = True
    return mask


def _stretches(text: str) -> list[tuple[int, int]]:
    """Runs of unstable characters, each with the one character before it."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(_unstable_points()[points])
    if not len(at):
        return []
    gaps = np.flatnonzero(np.diff(at) > 1)
    starts, ends = at[np.r_[0, gaps + 1]], at[np.r_[gaps, len(at) - 1]] + 1
    return list(zip(np.maximum(starts - 1, 0).tolist(), ends.tolist(), strict=True))


def _segment(text: str, start: int, end: int) -> tuple[str, list[int]]:
    """Canonical form of an unstable stretch and the place of each of its characters."""
    parts: list[tuple[str, int]] = []
    for k in range(start, end):
        c = text[k]
        if is_invisible(c):
            joins = c == "\u200d" and 0 < k < len(text) - 1
            if not (joins and unicodedata.category(text[k + 1]) == "So" and unicodedata.category(text[k - 1]) in ("So", "Sk", "Mn")):
                continue
        elif unicodedata.category(c) == "Zs":
            c = " "
        for x in _readable(c):
            parts += [(d, k) for d in unicodedata.normalize("NFD", x)]
    run: list[tuple[str, int]] = []
    ordered: list[tuple[str, int]] = []
    for d in parts:
        if unicodedata.combining(d[0]):
            run.append(d)
        else:
            ordered += sorted(run, key=lambda x: unicodedata.combining(x[0]))
            ordered.append(d)
            run = []
    ordered += sorted(run, key=lambda x: unicodedata.combining(x[0]))
    out = unicodedata.normalize("NFC", "".join(d for d, _ in ordered))
    places, at = [], 0
    for c in out:
        places.append(ordered[at][1])
        at += len(unicodedata.normalize("NFD", c))
    return out, places


#: Blocks of the alphabets that share shapes.
_SHARED = ((0x370, 0x590), (0x13A0, 0x1400), (0x1C80, 0x1C90), (0x1F00, 0x2000), (0x2C80, 0x2D00), (0xA4D0, 0xA500), (0xA640, 0xA6A0), (0xAB70, 0xABC0), (0x10400, 0x10450))
_OTHER_ALPHABETS = frozenset(_LATIN) | {chr(c) for a, b in _SHARED for c in range(a, b)}
_RARE = frozenset(c for c in _OTHER_ALPHABETS if alphabet(c) in ALPHABETS and alphabet(c) not in ("LATIN", *_NEAR))
#: A unit: letters of these alphabets, marks, digits, and what joins them in names.
_UNIT = re.compile(
    "[0-9A-Za-z\u00aa\u00b5\u00ba\u00c0-\u02af\u0300-\u036f\u1d00-\u1dbf\u1e00-\u1fff\u2c60-\u2c7f\ua720-\ua7ff\uab30-\uab6f._'’"
    + "".join(f"{chr(a)}-{chr(b - 1)}" for a, b in _SHARED) + "-]+"
)


@lru_cache(maxsize=1 << 14)
def _letter(c: str) -> tuple[str, str]:
    """Latin look of a character, and the alphabet it is evidence for.

    Letters of the fixed list are weak evidence, "latin", or none. A character and its
    doubles give the same evidence.
    """
    base = unicodedata.normalize("NFD", c)
    latin = _LATIN.get(base[0], base[0])
    look = unicodedata.normalize("NFC", latin + base[1:])
    if latin in DRAWN_ALIKE:
        return look, "" if latin in NEUTRAL else "latin"
    if latin != base[0]:
        return look, "LATIN"
    if not base[0].isalpha():
        return c, ""
    name = alphabet(base[0])
    return c, name if name in ALPHABETS else ""


@lru_cache(maxsize=1 << 14)
def _as(look: str, name: str) -> str:
    base = unicodedata.normalize("NFD", look)
    double = _IN[name].get(base[0])
    out = unicodedata.normalize("NFC", double + base[1:]) if double else look
    return out if len(out) == 1 else look


def _foreign(looks: str, name: str) -> int:
    """Letters of a unit that the alphabet ``name`` has neither itself nor a double of."""
    own = _IN[name]
    return sum(x.isalpha() and alphabet(b := unicodedata.normalize("NFD", x)[0]) != name and b not in own for x in looks)


@lru_cache(maxsize=1 << 16)
def _settle(unit: str) -> tuple[str, str]:
    """A unit in the alphabet its own letters give evidence for, and the alphabet.

    Without evidence the alphabet is empty and the unit is given by its Latin look.
    """
    letters = [_letter(c) for c in unit]
    count = Counter(e for _, e in letters)
    looks = "".join(look for look, _ in letters)
    name = _leading(count)
    if name and (count[name] > count["LATIN"] if name in _NEAR else count[name] > _foreign(looks, name)):
        return "".join(_as(x, name) for x in looks), name
    return looks, "LATIN" if count["LATIN"] or count["latin"] else ""


def _leading(count: Counter) -> str:
    """The alphabet besides the Latin one with the most evidence; of ties the first by name."""
    return max(sorted(e for e in count if e in _IN), key=count.__getitem__, default="")


def _main_alphabet(text: str) -> str:
    """The alphabet most letters of a text are evidence for."""
    votes = Counter(_letter(c)[1] for c in text)
    name = _leading(votes)
    return name if name and votes[name] > votes["LATIN"] else "LATIN"


def _normalise_stretches(text: str) -> tuple[str, list[int] | None]:
    """Rewrite the unstable stretches of a text and splice them into the rest."""
    stretches = _stretches(text)
    if not stretches:
        return text, None
    out: list[str] = []
    places: list[int] = []
    at = 0
    for start, end in stretches:
        out.append(text[at:start])
        places += range(at, start)
        part, where = _segment(text, start, end)
        out.append(part)
        places += where
        at = end
    out.append(text[at:])
    places += range(at, len(text))
    return "".join(out), places


def unify(text: str) -> tuple[str, list[int] | None]:
    """The consistent form of a text, and the place in it of each character (None: unchanged)."""
    if text.isascii():
        return text, None
    text, places = _normalise_stretches(text)
    if _OTHER_ALPHABETS.isdisjoint(text):
        return text, places
    units = [(m.start(), m.end(), *_settle(m[0])) for m in _UNIT.finditer(text)]
    main = "LATIN" if all(name for *_, name in units) and _RARE.isdisjoint(text) else _main_alphabet(text)
    if main not in ("LATIN", *_NEAR):  # words of doubles only look Latin in a text of that alphabet
        units = [(a, b, u, "" if name == "LATIN" and not _foreign(u, main) else name) for a, b, u, name in units]
    out, at = [], 0
    for start, end, settled, name in units:
        out.append(text[at:start])
        out.append("".join(_as(x, main) for x in settled) if not name and main != "LATIN" else settled)
        at = end
    out.append(text[at:])
    text = "".join(out)
    if not unicodedata.is_normalized("NFC", text):  # a settled letter may compose with its mark
        text, again = _normalise_stretches(text)
        places = again if places is None else [places[p] for p in again]
    return text, places


def _looks(text: str) -> tuple[str, list[int]]:
    """The characters of a text as they are compared, decomposed, with the place of each."""
    out, places = [], []
    for k, c in enumerate(text):
        for x in _look(c):
            out.append(x)
            places.append(k)
    return "".join(out), places


@lru_cache(maxsize=1 << 14)
def _look(c: str) -> str:
    return unicodedata.normalize("NFD", unify(c)[0].lower())


def _masks(text: str) -> dict[str, int]:
    masks: dict[str, list[int]] = {}
    for k, c in enumerate(text):
        masks.setdefault(c, []).append(k)
    out = {}
    for c, at in masks.items():
        bits = np.zeros(len(text), np.uint8)
        bits[at] = 1
        out[c] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    return out


def _rows(a: str, b: str) -> Iterator[int]:
    """Bit k of row i is 0 if the longest common subsequence of a[: i + 1] grows at b[k]."""
    masks, full = _masks(b), (1 << len(b)) - 1
    row = full
    for c in a:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _lengths(a: str, b: str) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with each b[:k]."""
    row = deque(_rows(a, b), maxlen=1).pop() if a else (1 << len(b)) - 1
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.r_[0, np.cumsum(bits == 0)]


#: Bits of the table kept at once; longer texts are halved first, which gives a subsequence as long.
_TABLE_BITS = 1 << 26


def common_subsequence(a: str, b: str) -> list[tuple[int, int]]:
    """Places (in a, in b) of a longest common subsequence, in order.

    By bit-parallel rows: len(a) * len(b) / 64 steps on words. Texts of any length are
    compared whole; memory stays bounded, as large tables are halved.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        n, m = a1 - a0, b1 - b0
        if n > 1 and n * m > _TABLE_BITS:
            mid = a0 + n // 2
            total = _lengths(a[a0:mid], b[b0:b1]) + _lengths(a[mid:a1][::-1], b[b0:b1][::-1])[::-1]
            cut = b0 + int(total.argmax())
            todo += [(a0, mid, b0, cut), (mid, a1, cut, b1)]
            continue
        rows = list(_rows(a[a0:a1], b[b0:b1]))
        i, k = n - 1, m - 1
        while i >= 0 and k >= 0:
            if rows[i] >> k & 1:
                k -= 1
            elif i and not rows[i - 1] >> k & 1:
                i -= 1
            else:
                out.append((a0 + i, b0 + k))
                i, k = i - 1, k - 1
    return sorted(out)


def realign(text: str, original: str | None) -> list[int]:
    """Places in ``original`` for a text whose alignment is missing or has the wrong length.

    A text that stands in the original as it is has its first place there. Else the two are
    compared in the look of their characters (consistent form, small letters, decomposed)
    by a longest common subsequence; a character without a partner gets the place after the
    last one, at most the last place. Without an original the places count in the text itself.
    """
    if not original:
        return list(range(len(text)))
    if (at := original.find(text)) >= 0:
        return list(range(at, at + len(text)))
    (mine, owner), (theirs, place) = _looks(text), _looks(original)
    found: dict[int, int] = {}
    for i, k in common_subsequence(mine, theirs):
        found.setdefault(owner[i], place[k])
    out, at = [], 0
    for k in range(len(text)):
        at = found.get(k, min(at, len(original) - 1))
        out.append(at)
        at += 1
    return out


def _unified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            texts, maps = [], []
            for text, alignment, original in zip(*(part[c].to_pylist() for c in ("text", "alignment", "original")), strict=True):
                if text is None:
                    texts.append(None)
                    maps.append(None)
                    continue
                form, places = unify(text)
                if alignment is None or len(alignment) != len(text) or None in alignment:
                    alignment = realign(text, original)
                texts.append(form)
                maps.append(alignment if places is None else [alignment[p] for p in places])
            yield pa.RecordBatch.from_arrays([part["id"], pa.array(texts, pa.string()), pa.array(maps, pa.list_(pa.int32()))], names=["id", "text", "alignment"])


def unify_strings(strings: DataFrame) -> DataFrame:
    """(id, text, alignment) of each row of (id, text, alignment, original).

    ``alignment`` points into ``original`` for each character of the new text. A NULL text
    gives NULLs, an empty one an empty text and alignment. See `realign` for rows without
    a usable alignment. Rows stay one to one; there is no shuffle.
    """
    return strings.select("id", "text", "alignment", "original").mapInArrow(_unified, "id bigint, text string, alignment array<int>")


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        forms = [unify(t)[0] for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["id"], batch["text"], pa.array(forms, pa.string())], names=["id", "text", "form"])


def _salted(big: DataFrame, small: DataFrame, on: list[str], spread_by: str, salts: int) -> DataFrame:
    """Inner join whose hot keys are spread over ``salts`` tasks; ``small`` is repeated as often."""
    left = big.withColumn("salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    right = small.withColumn("salt", F.explode(F.array(*[F.lit(s) for s in range(salts)])))
    return left.join(right, [*on, "salt"]).drop("salt")


def _hashed(strings: DataFrame) -> DataFrame:
    """(id, t1, t2, f1, f2): two 64-bit hashes each of the text and of its form."""
    forms = strings.select("id", "text").mapInArrow(_forms, "id bigint, text string, form string")
    hashes = {f"{n}{k}": F.xxhash64(F.col(c), F.lit(k)) for n, c in (("t", "text"), ("f", "form")) for k in (1, 2)}
    return forms.select("id", *[h.alias(n) for n, h in hashes.items()])


def eye_classes(strings: DataFrame, salts: int = 16, keep=lambda df: df) -> DataFrame:
    """(id, class_id, text_id, n_links) of every row (id, text): membership instead of pairs.

    Rows of one ``class_id`` read the same, rows of one ``text_id`` are equal; both are the
    smallest id of their class. ``n_links`` counts the rows that read the same but differ.
    Two rows are a pair of `same_to_the_eye` exactly if their class_id is equal and their
    text_id is not. The size of this table does not grow with the size of a class; sums are
    combined before each shuffle, and the joins back to the rows are salted by id.
    """
    rows = keep(_hashed(strings))
    texts = rows.groupBy("f1", "f2", "t1", "t2").agg(F.min("id").alias("text_id"), F.count(F.lit(1)).alias("n_text"))
    texts = keep(texts)
    forms = texts.groupBy("f1", "f2").agg(F.min("text_id").alias("class_id"), F.sum("n_text").alias("n_form"))
    both = _salted(texts, forms, ["f1", "f2"], "t1", salts).select("f1", "f2", "t1", "t2", "text_id", "class_id", (F.col("n_form") - F.col("n_text")).alias("n_links"))
    return _salted(rows, both, ["f1", "f2", "t1", "t2"], "id", salts).select("id", "class_id", "text_id", "n_links")


def same_to_the_eye(strings: DataFrame, salts: int = 16, keep=lambda df: df) -> DataFrame:
    """(a, b) ids, a < b, of rows (id, text) with different texts and the same form.

    Texts are compared by two 64-bit hashes. Only forms with at least two different texts
    go on; their texts are paired as classes, and classes are expanded to ids last. So a
    text with very many copies and no look-alike costs nothing, and copies of the same text
    are never paired. The pairing of classes and the expansions are salted, so a form with
    very many texts and a class with a large share of all rows are spread over ``salts``
    tasks. ``keep`` is applied to the hashes, which are used several times (e.g. to write
    them to a shared folder). NULL texts must be gone.
    """
    rows = keep(_hashed(strings))
    spans = [f(c).alias(f"{f.__name__}_{c}") for c in ("t1", "t2") for f in (F.min, F.max)]
    several = rows.groupBy("f1", "f2").agg(*spans).where("min_t1 <> max_t1 OR min_t2 <> max_t2").select("f1", "f2")
    members = keep(_salted(rows, several, ["f1", "f2"], "id", salts))
    classes = members.select("f1", "f2", "t1", "t2").distinct()
    others = classes.select("f1", "f2", F.col("t1").alias("u1"), F.col("t2").alias("u2"))
    pairs = _salted(classes, others, ["f1", "f2"], "t1", salts).where("t1 < u1 OR (t1 = u1 AND t2 < u2)").drop("f1", "f2")
    first = _salted(members.select("t1", "t2", F.col("id").alias("x")), pairs, ["t1", "t2"], "x", salts)
    second = members.select(F.col("t1").alias("u1"), F.col("t2").alias("u2"), F.col("id").alias("y"))
    both = _salted(first.select("u1", "u2", "x"), second, ["u1", "u2"], "x", salts)
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
