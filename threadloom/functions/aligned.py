"""Normalisation that keeps, for each character, its place in the original text.

All steps of a chain run in one Arrow pass and compose their alignments.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Mapped = tuple[str, list[int]]
RESULT = "text string, alignment array<int>"


def _each(text: str, places: list[int], change) -> Mapped:
    parts = [change(c) for c in text]
    return "".join(parts), [p for part, p in zip(parts, places, strict=True) for _ in part]


def lower(text: str, places: list[int]) -> Mapped:
    """Small letters; a letter that becomes several gives its place to each."""
    if len(low := text.lower()) == len(text):
        return low, places
    return _each(text, places, str.lower)


def collapse_blanks(text: str, places: list[int]) -> Mapped:
    kept = [k for k, c in enumerate(text) if not (c.isspace() and k and text[k - 1].isspace())]
    while kept and text[kept[-1]].isspace():
        kept.pop()
    if kept and text[kept[0]].isspace():
        kept = kept[1:]
    return "".join(text[k] for k in kept), [places[k] for k in kept]


def unicode_form(form: str):
    """Composed or decomposed characters point to the first character they come from."""

    def run(text: str, places: list[int]) -> Mapped:
        if text.isascii() or unicodedata.is_normalized(form, text):
            return text, places
        out, where, start = [], [], 0
        breaks = [k for k in range(1, len(text)) if _breaks(form, text, k)]
        for stop in [*breaks, len(text)]:
            piece = unicodedata.normalize(form, text[start:stop])
            steps = stop - start
            out.append(piece)
            where += [places[start + min(k, steps - 1)] for k in range(len(piece))] if len(piece) <= steps else [places[start + k * steps // len(piece)] for k in range(len(piece))]
            start = stop
        return "".join(out), where

    return run


def _breaks(form: str, text: str, k: int) -> bool:
    """A place no character composes across: before a starter that never joins its left."""
    c = text[k]
    return unicodedata.combining(c) == 0 and not 0x1160 <= ord(c) < 0x1200 and unicodedata.normalize(form, text[k - 1] + c) == unicodedata.normalize(form, text[k - 1]) + unicodedata.normalize(form, c)


def strip_marks(text: str, places: list[int]) -> Mapped:
    kept = [k for k, c in enumerate(text) if unicodedata.category(c) != "Mn"]
    return "".join(text[k] for k in kept), [places[k] for k in kept]


def replace_literal(target: str, replacement: str):
    """Each character of a replacement points to the last character it replaces."""
    if not target:
        raise ValueError("the target of a replacement is empty")

    def run(text: str, places: list[int]) -> Mapped:
        out, where, at = [], [], 0
        while (hit := text.find(target, at)) >= 0:
            end = hit + len(target)
            out += [text[at:hit], replacement]
            where += places[at:hit] + [places[end - 1]] * len(replacement)
            at = end
        return "".join([*out, text[at:]]), where + places[at:]

    return run


def chain(text: Column, *steps) -> Column:
    """struct(text, alignment) after all ``steps``; NULL text gives NULL."""

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            if t is None:
                rows.append((None, None))
                continue
            mapped: Mapped = (t, list(range(len(t))))
            for step in steps:
                mapped = step(*mapped)
            rows.append(mapped)
        return pd.DataFrame(rows, columns=["text", "alignment"])

    return F.when(text.isNotNull(), run(text))
