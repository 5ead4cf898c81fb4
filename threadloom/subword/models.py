"""Byte-pair and word-piece models: fitted on a corpus, applied without a shuffle."""

from __future__ import annotations

import json
import random
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.vocabulary import SPECIAL
from threadloom.session import materialise
from threadloom.subword import words as W
from threadloom.subword.training import train_merges

#: Subtokens of the splits that a worker process keeps.
CACHE = 1 << 20
#: Words of a batch that are split and written at once.
SLICE = 1 << 16
LONGEST_WORD = 100
#: Letters by which word pieces are looked up, the long and the short ones; every first piece
#: begins with the mark, so the long ones go on behind it.
STARTS = (len(W.PIECE_START) + 4, 2)
#: Delimiters of the replayed merge; they must not occur in the text.
OPEN, SHUT = "\ue001", "\ue002"
_RESULT = "array<struct<subtokens:array<string>,ids:array<int>>>"
_IDS = "array<array<int>>"


class SubwordModel(ABC):
    """A fitted model with a token list; the first token is the unknown one."""

    vocabulary: list[str]

    @abstractmethod
    def split(self, word: str, draw: Callable[[], float] | None = None) -> list[str]: ...

    def fingerprint(self) -> int:
        """Equal models have equal fingerprints."""
        return xxhash.xxh64_intdigest(repr((type(self).__name__, self.vocabulary, getattr(self, "merges", None), getattr(self, "longest_word", None))))

    def ids(self) -> dict[str, int]:
        return {t: k for k, t in enumerate(self.vocabulary)}

    def tokenize(self, tokens: Column, key: Column | None = None, dropout: float = 0.0, seed: int = 0) -> Column:
        """array of struct(subtokens, ids), one for each pre-token of an array column.

        A worker process keeps the splits of the words it has seen, for all batches and
        tasks of the same model, up to `CACHE` subtokens. The result is built as Arrow arrays,
        `SLICE` words at a time, without a Python object for each subtoken of a batch. With ``dropout`` every
        possible merge is left out with that probability; the draws come from a hash of
        ``seed``, ``key`` and the word's place, so a lost task repeats them.
        """
        return self._split_column(tokens, key, dropout, seed, _RESULT, lambda found: found)

    def _split_column(self, tokens: Column, key: Column | None, dropout: float, seed: int, schema: str, keep: Callable[[pa.Array], pa.Array]) -> Column:
        """An array column of what ``keep`` takes from the struct(subtokens, ids) of the words."""
        if dropout and key is None:
            raise ValueError("dropout needs a key column to draw from")
        model, ids, mark = self, self.ids(), self.fingerprint()

        def drawn(words: pa.Array, keys: list, places: list[int]) -> pa.Array:
            parts = []
            for word, key, place in zip(words.to_pylist(), keys, places, strict=True):
                rng = random.Random(xxhash.xxh64_intdigest(f"{seed}|{key}|{place}"))
                parts.append(model.split(word, lambda rng=rng: rng.random() < dropout))
            return _lists(parts, ids)

        @F.arrow_udf(schema)
        def run(arrays: pa.Array, keys: pa.Array) -> pa.Array:
            words, counts = arrays.flatten(), pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            offsets, out = np.r_[0, np.cumsum(counts)], []
            rows = np.repeat(np.arange(len(counts)), counts) if dropout else None
            for k in range(0, len(words), SLICE):
                part = words.slice(k, SLICE)
                if rows is None:
                    out.append(keep(model.split_all(part, ids, mark)))
                else:
                    row = rows[k : k + SLICE]
                    out.append(keep(drawn(part, keys.take(pa.array(row)).to_pylist(), (np.arange(k, k + len(row)) - offsets[row]).tolist())))
            values = pa.concat_arrays(out) if out else keep(_lists([], ids))
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pc.is_null(arrays) if arrays.null_count else None)

        return F.when(tokens.isNotNull(), run(tokens, key if key is not None else F.lit(0)))

    def split_all(self, words: pa.Array, ids: dict[str, int], mark: int) -> pa.Array:
        """struct(subtokens, ids) of words; each distinct one is split once, then taken to its places."""
        cache, coded = _cache_of(mark), words.dictionary_encode()
        parts = []
        for word in coded.dictionary.to_pylist():
            found = cache.get(word)
            if found is None:
                found = self.split(word)
                cache.keep(word, found)
            parts.append(found)
        return _lists(parts, ids).take(coded.indices)

    def encode(self, tokens: Column, key: Column | None = None, dropout: float = 0.0, seed: int = 0) -> Column:
        """Flat ids of all subtokens; the subtokens themselves stay in the worker process."""
        return F.flatten(self._split_column(tokens, key, dropout, seed, _IDS, lambda found: found.field("ids")))

    def vocabulary_frame(self, spark: SparkSession) -> DataFrame:
        names = {t: n for n, t in SPECIAL.items()}
        rows = [(k, t, names.get(t)) for k, t in enumerate(self.vocabulary)]
        return spark.createDataFrame(rows, "id int, token string, special_name string")


def _start_vocabulary(words: DataFrame, mark: str, special: dict[str, str]) -> list[str]:
    chars = sorted(r["char"] for r in W.alphabet(words).collect())
    return list(dict.fromkeys([*special.values(), *chars, mark]))


class _Cache(dict[str, list[str]]):
    """Splits of words, emptied when they have more than `CACHE` subtokens."""

    size = 0

    def keep(self, word: str, parts: list[str]) -> None:
        if self.size + len(parts) > CACHE:
            self.clear()
            self.size = 0
        self[word] = parts
        self.size += len(parts)


#: Splits by model, kept by a worker process; those of one model at a time.
_CACHES: dict[int, _Cache] = {}


def _cache_of(mark: int) -> _Cache:
    if mark not in _CACHES:
        _CACHES.clear()
        _CACHES[mark] = _Cache()
    return _CACHES[mark]


def _lists(parts: list[list[str]], ids: dict[str, int]) -> pa.Array:
    """struct(subtokens, ids) for each list of subtokens."""
    offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in parts], dtype=np.int64)], pa.int32())
    flat = [p for x in parts for p in x]
    numbers = pa.array([ids.get(p, 0) for p in flat], pa.int32())
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(flat, pa.string())), pa.ListArray.from_arrays(offsets, numbers)], names=["subtokens", "ids"])


@dataclass
class BPE(SubwordModel):
    """Byte-pair model: merges in order, applied by lowest rank first."""

    vocabulary: list[str]
    merges: list[tuple[str, str]]
    ranks: dict[tuple[str, str], int] = field(init=False)

    def __post_init__(self) -> None:
        self.ranks = {pair: k for k, pair in enumerate(self.merges)}

    @classmethod
    def fit(cls, words: DataFrame, merges: float = 0.35, special: dict[str, str] = SPECIAL, **kwargs) -> BPE:
        """Fit on (word, freq). The alphabet is as small as the characters of the corpus."""
        words = materialise(words)
        found = train_merges(words, merges, "bpe", **kwargs)
        start = _start_vocabulary(words, W.BPE_END, special)
        return cls(list(dict.fromkeys([*start, *(a + b for a, b in found)])), found)

    def split(self, word: str, draw: Callable[[], float] | None = None) -> list[str]:
        rank, none, symbols = self.ranks.get, len(self.ranks), [*word, W.BPE_END]
        ranks = [rank(pair, none) for pair in zip(symbols, symbols[1:], strict=False)]
        while ranks:
            if draw:
                best = none
                for r in ranks:
                    if r < best and not draw():
                        best = r
            else:
                best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            whole = symbols[at] + symbols[at + 1]
            while True:
                symbols[at : at + 2] = [whole]
                del ranks[at]
                if at:
                    ranks[at - 1] = rank((symbols[at - 1], whole), none)
                if at == len(ranks):
                    break
                ranks[at] = rank((whole, symbols[at + 1]), none)
                try:
                    at = ranks.index(best, at)
                except ValueError:
                    break
        return symbols

    def proper(self) -> bool:
        """Is every long side of a merge the result of an earlier one? Then replaying is exact."""
        made: set[str] = set()
        for a, b in self.merges:
            if any(len(x) > 1 and x != W.BPE_END and x not in made for x in (a, b)):
                return False
            made.add(a + b)
        return True

    def replay(self, word: Column) -> Column:
        """Subtokens of a word by replaying every merge in order, inside the JVM.

        For a few hundred merges; exact for proper merge lists. The delimiters must not
        occur in the word.
        """
        if not self.proper():
            raise ValueError("the merge list is not proper; use tokenize")
        wrapped = F.aggregate(W.bpe_symbols(word), F.lit(""), lambda acc, s: F.concat(acc, F.lit(OPEN), s, F.lit(SHUT)))
        steps = F.array(*[F.struct(F.lit(f"{OPEN}{a}{SHUT}{OPEN}{b}{SHUT}").alias("old"), F.lit(f"{OPEN}{a}{b}{SHUT}").alias("new")) for a, b in self.merges])
        merged = F.aggregate(steps, wrapped, lambda acc, m: F.replace(acc, m["old"], m["new"]))
        return F.filter(F.split(F.translate(merged, OPEN, ""), SHUT), lambda s: s != "")


@dataclass
class WordPiece(SubwordModel):
    """Word-piece model: the longest vocabulary entry first; the word starts with a mark."""

    vocabulary: list[str]
    longest_word: int = LONGEST_WORD

    def __post_init__(self) -> None:
        self.known = frozenset(self.vocabulary)
        by_start: dict[str, set[int]] = {}
        for token in self.known:
            by_start.setdefault(token[: STARTS[0] if len(token) >= STARTS[0] else STARTS[1]], set()).add(len(token))
        self.sizes = {start: sorted(sizes, reverse=True) for start, sizes in by_start.items()}

    @classmethod
    def fit(cls, words: DataFrame, merges: float = 0.35, special: dict[str, str] = SPECIAL, **kwargs) -> WordPiece:
        words = materialise(words)
        found = train_merges(words, merges, "piece", **kwargs)
        start = _start_vocabulary(words, W.PIECE_START, special)
        return cls(list(dict.fromkeys([*start, *(a + b for a, b in found)])))

    def split(self, word: str, draw: Callable[[], float] | None = None) -> list[str]:
        """A word that is too long or has a part outside the vocabulary is one unknown token."""
        unknown = self.vocabulary[0]
        if len(word) > self.longest_word:
            return [unknown]
        rest, at, out, sizes, (long, short) = W.PIECE_START + word, 0, [], self.sizes.get, STARTS
        while at < len(rest):
            for size in (*sizes(rest[at : at + long], ()), *sizes(rest[at : at + short], ()), 1):
                if size <= len(rest) - at and rest[at : at + size] in self.known:
                    out.append(rest[at : at + size])
                    at += size
                    break
            else:
                return [unknown]
        return out


def save(model: SubwordModel, spark: SparkSession, path: str) -> None:
    """Vocabulary and merges as parquet, the configuration as JSON text."""
    model.vocabulary_frame(spark).write.mode("overwrite").parquet(f"{path}/vocabulary")
    if isinstance(model, BPE):
        rows = [(k, a, b) for k, (a, b) in enumerate(model.merges)]
        spark.createDataFrame(rows, "rank int, left string, right string").write.mode("overwrite").parquet(f"{path}/merges")
    config = {"kind": type(model).__name__} | ({"longest_word": model.longest_word} if isinstance(model, WordPiece) else {})
    spark.createDataFrame([(json.dumps(config),)], "value string").write.mode("overwrite").text(f"{path}/config")


def load(spark: SparkSession, path: str) -> SubwordModel:
    config = json.loads(spark.read.text(f"{path}/config").first()[0])
    vocabulary = [r["token"] for r in spark.read.parquet(f"{path}/vocabulary").orderBy("id").collect()]
    if config["kind"] == "BPE":
        return BPE(vocabulary, [(r["left"], r["right"]) for r in spark.read.parquet(f"{path}/merges").orderBy("rank").collect()])
    if config["kind"] == "WordPiece":
        return WordPiece(vocabulary, config["longest_word"])
    raise ValueError(f"not a subword model: {config['kind']}")


class _Unbuilt(SubwordModel):
    """Named by the surface this engine covers, without behaviour there or here."""

    def split(self, word: str, draw: Callable[[], float] | None = None) -> list[str]:
        raise NotImplementedError(f"{type(self).__name__} has no defined behaviour")


class BoundlessBPE(_Unbuilt):
    pass


class SuperBPE(_Unbuilt):
    pass


class FastWordPiece(_Unbuilt):
    pass


class Unigram(_Unbuilt):
    pass
