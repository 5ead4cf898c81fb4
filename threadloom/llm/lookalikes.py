"""Letters of other alphabets that are drawn like Latin letters.

The Unicode confusables come with every Spark distribution, inside its ICU library, and are
read from there, so that no copy of that table has to be kept. A short fixed list holds the
letters of the Russian, Greek, Armenian and Cherokee alphabets that count first.
"""

from __future__ import annotations

import glob
import os
import struct
import unicodedata
import zipfile
from functools import lru_cache

# Letters drawn alike, each line a Latin letter and its doubles.
DRAWN_ALIKE = {
    "a": "аαɑ", "c": "с", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "іι", "j": "јյϳ", "l": "ӏ",
    "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛզ", "s": "ѕ", "u": "սυ", "v": "ѵν", "w": "ԝ", "x": "х", "y": "уү",
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СᏟ", "E": "ЕΕᎬ", "G": "Ԍ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈͿᎫ", "K": "КΚᏦ",
    "L": "Ꮮ", "M": "МΜᎷ", "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "S": "ЅՏᏚ", "T": "ТΤᎢ", "V": "ѴᏙ",
    "W": "ԜᎳ", "X": "ХΧ", "Y": "УΥҮ", "Z": "ΖᏃ",
}
#: Alphabets whose letters are looked up in the Unicode table, by the first word of their names.
ALPHABETS = frozenset("LATIN CYRILLIC GREEK COPTIC ARMENIAN CHEROKEE LISU DESERET".split())
_JAR, _MEMBER, _MAGIC = "icu4j-*.jar", "com/ibm/icu/impl/data/icudata/confusables.cfu", 0x3845FDEF


def alphabet(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0]


def jar() -> str:
    """The ICU library of the Spark distribution that this process belongs to."""
    import pyspark

    for home in (os.environ.get("SPARK_HOME"), os.path.dirname(pyspark.__file__)):
        if home and (found := sorted(glob.glob(os.path.join(home, "jars", _JAR)))):
            return found[0]
    raise FileNotFoundError("no ICU library beside Spark; set SPARK_HOME")


def prototypes(path: str) -> dict[str, str]:
    """Character to its prototype, from ICU's binary table: sorted keys, values, long strings.

    A key is a code point with the length of its prototype above it; a value is the
    prototype itself if that is one unit long, else its place in the strings.
    """
    with zipfile.ZipFile(path) as archive:
        raw = archive.read(_MEMBER)
    body = raw[struct.unpack_from(">H", raw)[0] :]
    magic, _, _, keys, n, values, _, text, size = struct.unpack_from(">I4s7i", body)
    if magic != _MAGIC:
        raise ValueError(f"not a table of confusables: {path}")
    strings = body[text : text + 2 * size]
    out = {}
    for key, value in zip(struct.unpack_from(f">{n}I", body, keys), struct.unpack_from(f">{n}H", body, values), strict=True):
        length = (key >> 24) + 1
        unit = struct.pack(">H", value) if length == 1 else strings[2 * value : 2 * (value + length)]
        out[chr(key & 0xFFFFFF)] = unit.decode("utf-16-be", "surrogatepass")
    return out


def _kept_apart(c: str) -> bool:
    """Basic Russian and Greek letters that the fixed list leaves out, and some Latin ones.

    The former show the alphabet of a word (a Russian ghe is an r in that table only); the
    latter are letters of living Latin alphabets that differ to the eye.
    """
    return 0x391 <= ord(c) <= 0x3CE or 0x400 <= ord(c) <= 0x45F or c in "ıɣɩʋ"


@lru_cache(maxsize=1)
def latin_of() -> dict[str, str]:
    """Letter to the Latin letter it is drawn like, of the same case where there is one."""
    fixed = {double: latin for latin, doubles in DRAWN_ALIKE.items() for double in doubles}
    table = prototypes(jar())
    shape: dict[str, list[str]] = {}
    for k in (*range(65, 91), *range(97, 123)):
        shape.setdefault(table.get(chr(k), chr(k)), []).append(chr(k))
    out = {}
    for c, prototype in table.items():
        known = shape.get(prototype)
        if known is None or c.isascii() or c in fixed or not c.isalpha() or unicodedata.decomposition(c) or alphabet(c) not in ALPHABETS or _kept_apart(c):
            continue
        kind = unicodedata.category(c)
        out[c] = next((x for x in known if unicodedata.category(x) == kind), known[0])
    return fixed | out
