"""Text normalisation and pre-tokenisation as column expressions.

Everything here stays in the JVM except Unicode normalisation, for which Spark has no
expression. NULL text gives NULL, empty text an empty string or an empty array.
"""

from __future__ import annotations

import string
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the source semantics: Unicode white space and the four separators.
BLANK = r"[\s\x1c-\x1f]"

# Split patterns of well-known vocabularies, branch by branch.
GPT2 = "|".join(
    [
        r"'(?:[sdmt]|ll|ve|re)",
        r" ?\p{L}+",
        r" ?\p{N}+",
        r" ?[^\s\p{L}\p{N}]+",
        r"\s+(?!\S)",
        r"\s+",
    ]
)
GPT4 = "|".join(
    [
        r"'(?i:[sdmt]|ll|ve|re)",
        r"[^\r\n\p{L}\p{N}]?+\p{L}+",
        r"\p{N}{1,3}",
        r" ?[^\s\p{L}\p{N}]++[\r\n]*",
        r"\s*[\r\n]",
        r"\s+(?!\S)",
        r"\s+",
    ]
)
GPT4O = "|".join(
    [
        r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?",
        r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?",
        r"\p{N}{1,3}",
        r" ?[^\s\p{L}\p{N}]+[\r\n/]*",
        r"\s*[\r\n]+",
        r"\s+(?!\S)",
        r"\s+",
    ]
)
#: The same with the line breaks that a broken literal puts into the word branches.
GPT4O_LITERAL = "|".join(
    [
        "[^\\r\\n\\p{L}\\p{N}]?[\\p{Lu}\\p{Lt}\\p{Lm}\\p{Lo}\\p{M}]*\\\n        [\\p{Ll}\\p{Lm}\\p{Lo}\\p{M}]+\\\n        (?i:'s|'t|'re|'ve|'m|'ll|'d)?",
        "[^\\r\\n\\p{L}\\p{N}]?[\\p{Lu}\\p{Lt}\\p{Lm}\\p{Lo}\\p{M}]+\\\n        [\\p{Ll}\\p{Lm}\\p{Lo}\\p{M}]*\\\n        (?i:'s|'t|'re|'ve|'m|'ll|'d)?",
        r"\p{N}{1,3}",
        r" ?[^\s\p{L}\p{N}]+[\r\n/]*",
        r"\s*[\r\n]+",
        r"\s+(?!\S)",
        r"\s+",
    ]
)
BOUNDLESS = "|".join(
    [
        r" ?(?:\p{L}\p{M}*)+['’](?:\p{L}\p{M}*)+",
        r"_(?:\p{Ll}\p{M}*)+",
        r" ?(?:\p{Lu}\p{M}*)+(?=(?:\p{Lu}\p{M}*)(?:\p{Ll}\p{M}*))",
        r" ?(?:\p{Lu}\p{M}*)?(?:\p{Ll}\p{M}*)+",
        r" ?(?:\p{Lu}\p{M}*)+",
        r" ?(?:[\p{Lt}\p{Lm}\p{Lo}]\p{M}*)+",
        r"(?:\p{N}\p{M}*){1,3}(?=(?:(?:\p{N}\p{M}*){3})*(?:(?:\P{N}\p{M}*)|$))",
        r" ?(?:[\p{P}\p{S}]\p{M}*)+",
        r"[^\S\r\n]*[\n\r]+|[^\S\r\n]+",
        r"(?:[\p{Z}\p{C}]\p{M}*)+",
        r"\p{M}+",
    ]
)
#: What `BOUNDLESS` matches, written without repeated groups, which take a stack frame for each
#: letter. Digits come as whole runs; `split_boundless` cuts them into threes from the right.
_ELISION = r" ?\p{L}[\p{L}\p{M}]*['’]\p{L}[\p{L}\p{M}]*|"
_BOUNDLESS_RUNS = "|".join(
    [
        r"_\p{Ll}[\p{Ll}\p{M}]*",
        r" ?\p{Lu}[\p{Lu}\p{M}]*(?=\p{Lu}\p{M}*\p{Ll})",
        r" ?(?:\p{Lu}\p{M}*)?\p{Ll}[\p{Ll}\p{M}]*",
        r" ?\p{Lu}[\p{Lu}\p{M}]*",
        r" ?[\p{Lt}\p{Lm}\p{Lo}][\p{Lt}\p{Lm}\p{Lo}\p{M}]*",
        r"\p{N}[\p{N}\p{M}]*",
        r" ?[\p{P}\p{S}][\p{P}\p{S}\p{M}]*",
        r"[^\S\r\n]*[\n\r]+|[^\S\r\n]+",
        r"[\p{Z}\p{C}][\p{Z}\p{C}\p{M}]*",
        r"\p{M}+",
    ]
)
PUNCTUATION = "[" + "".join(f"\\{c}" for c in string.punctuation) + "]"

PATTERNS = {"gpt2": GPT2, "gpt4": GPT4, "gpt4o": GPT4O, "gpt4o_literal": GPT4O_LITERAL, "boundless": BOUNDLESS, "punctuation": PUNCTUATION}


# ---------------------------------------------------------------- normalisation

def lower(text: Column) -> Column:
    return F.lower(text)


def collapse_blanks(text: Column) -> Column:
    """Strip both ends; of a run of white space only its first character stays."""
    stripped = F.regexp_replace(text, f"(?U)^{BLANK}+|{BLANK}+$", "")
    return F.regexp_replace(stripped, f"(?U)({BLANK}){BLANK}+", "$1")


def _normaliser(form: str):
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(form, t))

    return run


def unicode_form(text: Column, form: str = "NFC") -> Column:
    """NFC, NFD, NFKC or NFKD, in Arrow batches; the only step here that leaves the JVM."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"not a normalisation form: {form}")
    return _normaliser(form)(text)


def strip_marks(text: Column) -> Column:
    """Remove non-spacing marks; precomposed letters keep theirs unless NFD comes first."""
    return F.regexp_replace(text, r"\p{Mn}", "")


def replace_literal(text: Column, target: str, replacement: str) -> Column:
    if not target:
        raise ValueError("the target of a replacement is empty")
    return F.replace(text, F.lit(target), F.lit(replacement))


def identity_alignment(text: Column) -> Column:
    """0, 1, ... for each code point."""
    n = F.length(text)
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n - 1))


def span(alignment: Column, start: Column, end: Column) -> Column:
    """Span of the original for [start, end); NULL if end - 1 is no place of the text.

    An empty or reversed span ends where it starts.
    """
    last, first = F.get(alignment, end - 1), F.get(alignment, start)
    stop = F.when(end <= start, first).otherwise(last + 1)
    inside = (end - 1 >= 0) & (end - 1 < F.size(alignment))
    return F.when(inside, F.struct(first.alias("start"), stop.alias("end")))


# ------------------------------------------------------------- pre-tokenisation

def _gaps(pattern: str) -> str:
    """A run of characters at none of which ``pattern`` matches, with a step but no stack for each."""
    return f"(?:(?!{pattern}).)++"


def split_keep(text: Column, pattern: str) -> Column:
    """Matches of ``pattern`` and the gaps between them, in order; nothing is lost."""
    if pattern == BOUNDLESS:
        return split_boundless(text)
    if pattern == PUNCTUATION:
        both = f"(?U){pattern}|[^{pattern[1:-1]}]+"
    else:
        both = f"(?Us)(?:{pattern})|{_gaps(pattern)}"
    return F.filter(F.regexp_extract_all(text, F.lit(both), F.lit(0)), lambda t: t != "")


def split_boundless(text: Column) -> Column:
    """The tokens of `BOUNDLESS`, for runs of letters and digits of any length.

    Only texts with an apostrophe are tried for words around one, as each try reads on to
    the end of the letters.
    """
    plain, elided = (F.regexp_extract_all(text, F.lit(f"(?Us){p}{_BOUNDLESS_RUNS}"), F.lit(0)) for p in ("", _ELISION))
    tokens = F.when(text.rlike("['’]"), elided).otherwise(plain)

    def threes(run: Column) -> Column:  # read from the right, a sign after every third digit that others follow
        signed = F.regexp_replace(F.reverse(run), r"(?U)((?:\p{M}*\p{N}){3})(?=.)", "$1\ue000")
        return F.split(F.reverse(signed), "\ue000")

    return F.flatten(F.transform(tokens, lambda t: F.when(t.rlike(r"^\p{N}"), threes(t)).otherwise(F.array(t))))


def split_drop(text: Column, pattern: str) -> Column:
    """The gaps between the matches of ``pattern``."""
    return F.filter(F.split(text, f"(?U){pattern}", -1), lambda t: t != "")


def split_blanks(text: Column) -> Column:
    return split_drop(text, r"\s+")


def split_punctuation(text: Column) -> Column:
    return split_keep(text, PUNCTUATION)


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself, or the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


def byte_level(text: Column) -> Column:
    """UTF-8 bytes as printable characters, by one translation in the JVM."""
    letters = byte_alphabet()
    moved = [b for b in range(256) if letters[b] != chr(b)]
    latin = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return F.translate(latin, "".join(map(chr, moved)), "".join(letters[b] for b in moved))


def on_each(stage):
    """Run an array-producing stage on every token of an array."""
    return lambda tokens: F.flatten(F.transform(tokens, stage))


def in_sequence(text: Column, *stages) -> Column:
    """Pre-tokenisers one after the other; each runs on every token so far."""
    tokens = F.array(text)
    for stage in stages:
        tokens = on_each(stage)(tokens)
    return F.when(text.isNotNull(), F.filter(tokens, lambda t: t != ""))
