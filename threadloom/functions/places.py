"""Tokens with their places in the text they were split from.

A split that loses nothing fixes the places: a token starts where the one before it ends.
Places count code points, the end exclusive; they come from running sums over Arrow arrays.
To point into the text before normalisation, look them up in its alignment (`text.span`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACED = "array<struct<token:string,start:int,end:int>>"
_TYPE = pa.struct([("token", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _running(sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Where each item starts within its row, for rows of ``counts`` items one after the other."""
    before = np.cumsum(sizes) - sizes
    first = np.repeat(np.r_[0, np.cumsum(counts)[:-1]].astype(np.int64), counts)
    return before - before[first] if len(before) else before


def _lists(arrays: pa.Array, values: pa.Array, counts: np.ndarray) -> pa.Array:
    offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
    return pa.ListArray.from_arrays(offsets, values, mask=pc.is_null(arrays)) if arrays.null_count else pa.ListArray.from_arrays(offsets, values)


def _counts(arrays: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _lengths(tokens: pa.Array) -> np.ndarray:
    return pc.utf8_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)


def _placed(arrays: pa.Array) -> pa.Array:
    tokens, counts = arrays.flatten(), _counts(arrays)
    sizes = _lengths(tokens)
    start = _running(sizes, counts)
    return _lists(arrays, pa.StructArray.from_arrays([tokens, pa.array(start, pa.int32()), pa.array(start + sizes, pa.int32())], fields=list(_TYPE)), counts)


def placed(tokens: Column) -> Column:
    """array of struct(token, start, end) for tokens that together are the whole text."""
    return F.arrow_udf(PLACED)(_placed)(tokens)


def placed_where(tokens: Column, keep) -> Column:
    """The placed tokens for which ``keep(token)`` holds, e.g. without the separators of a split."""
    return F.filter(placed(tokens), lambda t: keep(t["token"]))


def _byte_places(texts: pa.Array) -> pa.Array:
    present = [t or "" for t in texts.to_pylist()]
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in present]
    widths = [1 + (p > 0x7F) + (p > 0x7FF) + (p > 0xFFFF) for p in points]
    places = [np.repeat(np.arange(len(p)), w) for p, w in zip(points, widths, strict=True)]
    flat = np.concatenate(places) if places else np.empty(0)
    return _lists(texts, pa.array(flat, pa.int32()), np.array([len(p) for p in places], np.int64))


def byte_places(text: Column) -> Column:
    """For each byte letter of `text.byte_level` the place of the character it belongs to."""
    return F.arrow_udf("array<int>")(_byte_places)(text)


def _room(pieces: pa.Array, n: np.ndarray, sizes: np.ndarray, marks: tuple[str, ...], unknown: str) -> np.ndarray:
    """Code points that each subtoken takes, for words of these sizes with ``n`` subtokens each."""
    room = _lengths(pieces)
    for mark in marks:
        begins, ends = (f(pieces, mark).to_numpy(zero_copy_only=False) for f in (pc.starts_with, pc.ends_with))
        room = room - len(mark) * (begins if mark == "</b>" else ends)
    alone = np.repeat(n == 1, n) & pc.equal(pieces, unknown).to_numpy(zero_copy_only=False)
    return np.where(alone, np.repeat(sizes, n), room)


#: Texts whose subtokens are placed and given on at once.
TEXTS = 256


def subtoken_rows(rows: DataFrame, key: str, tokens: Column, keep, model, marks: tuple[str, ...] = ("</s>", "</b>"), unknown: str = "[UNK]") -> DataFrame:
    """(key, token, start, end): a row for each subtoken of the pre-tokens for which ``keep(token)`` holds.

    As `placed_subtokens`, but a few texts at a time and as rows, so that neither side ever
    holds the subtokens of a whole Arrow batch.
    """
    ids, mark = model.ids(), model.fingerprint()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), TEXTS):
                part = batch.slice(k, TEXTS)
                words, counts = part["tokens"].flatten(), _counts(part["tokens"])
                kept = part["kept"].flatten().to_numpy(zero_copy_only=False)
                sizes = _lengths(words)
                start, text = _running(sizes, counts)[kept], np.repeat(np.arange(len(counts)), counts)[kept]
                if not len(start):
                    continue
                parts = model.split_all(words.filter(pa.array(kept)), ids, mark).flatten()[0]
                n, pieces = _counts(parts), parts.flatten()
                room = _room(pieces, n, sizes[kept], marks, unknown)
                at = np.repeat(start, n) + _running(room, n)
                yield pa.RecordBatch.from_arrays([part[key].take(pa.array(np.repeat(text, n))), pieces, pa.array(at, pa.int32()), pa.array(at + room, pa.int32())], names=[key, "token", "start", "end"])

    rows = rows.select(key, tokens.alias("tokens")).where("tokens IS NOT NULL")
    kept = F.transform("tokens", lambda t: F.coalesce(keep(t), F.lit(False)))
    return rows.select(key, "tokens", kept.alias("kept")).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, token string, start int, end int")


_INNER = "array<array<struct<token:string,start:int,end:int>>>"


def placed_subtokens(tokens: Column, subtokens: Column, marks: tuple[str, ...] = ("</s>", "</b>"), unknown: str = "[UNK]") -> Column:
    """For each pre-token its subtokens with their places in the whole text.

    ``tokens`` are pre-tokens that together are the text, ``subtokens`` an array of arrays,
    one for each of them. Marks of a word's begin or end take no room; an unknown token
    takes the room of its word.
    """

    def run(words: pa.Array, parts: pa.Array) -> pa.Array:
        counts = _counts(words)
        flat_words, inner = words.flatten(), parts.flatten()
        sizes = _lengths(flat_words)
        start, n = _running(sizes, counts), _counts(inner)
        pieces = inner.flatten()
        room = _room(pieces, n, sizes, marks, unknown)
        at = np.repeat(start, n) + _running(room, n)
        placed = pa.StructArray.from_arrays([pieces, pa.array(at, pa.int32()), pa.array(at + room, pa.int32())], fields=list(_TYPE))
        return _lists(words, _lists(inner, placed, n), counts)

    return F.arrow_udf(_INNER)(run)(tokens, subtokens)
