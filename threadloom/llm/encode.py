"""Token ids of a public byte-level vocabulary for every text of a corpus."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("THREADLOOM_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"

#: Fixed value: the pattern that belongs to the rank file, given with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Texts above this many code points are encoded in pieces.
PIECE = 1 << 18

#: Places where every split of PATTERN ends: between a non-blank and a blank, and between a
#: letter and a sign other than the apostrophe, which might begin a contraction.
_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}\p{N}'])")


#: Name of the text inside the plan, so that a kept column may be called text as well.
_IN = "text to encode"


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    """The encoding of a local rank file, loaded once per process."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def rank_file(name: str = BYTE_BPE_50K, folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZER_DIR, name)


def pieces(text: str, size: int = PIECE) -> list[str]:
    """Cut a long text at safe boundaries, so that the ids of the pieces concatenate.

    A stretch without a safe boundary stays whole, however long it is.
    """
    out, start = [], 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None or cut.start() >= len(text):
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    out.append(text[start:])
    return out


def encode_text(enc: tiktoken.Encoding, text: str, size: int = PIECE) -> np.ndarray:
    if len(text) <= size:
        return enc.encode_to_numpy(text, disallowed_special=())
    return np.concatenate([enc.encode_to_numpy(p, disallowed_special=()) for p in pieces(text, size)])


def _ids(path: str, size: int, only_count: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                names = [c for c in part.schema.names if c != _IN]
                kept = [part[c] for c in names]
                texts = part[_IN].to_pylist()
                ids = [encode_text(enc, t, size) if t else None for t in texts]
                sizes = np.array([0 if x is None else len(x) for x in ids], np.int64)
                if only_count:
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes)], names=[*names, "n_tokens"])
                    continue
                offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
                flat = np.concatenate([x for x in ids if x is not None] or [np.empty(0)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*kept, lists], names=[*names, "ids"])

    return run


def encode_corpus(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, piece: int = PIECE) -> DataFrame:
    """``keep`` columns and ``ids``, the token ids of each text without special tokens.

    Markup of special tokens inside a text is ordinary text. An empty and a NULL text have
    the empty list of ids. Rows stay one to one, in the partitioning of the input;
    there is no shuffle. The rank file must exist at ``path`` on every worker.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    rows = docs.select(*keep, F.col(text).cast("string").alias(_IN))
    return rows.mapInArrow(_ids(path or rank_file(), piece, False), f"{schema}, ids array<int>")


def count_tokens(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, piece: int = PIECE) -> DataFrame:
    """``keep`` columns and ``n_tokens``: 0 for an empty text and for a NULL text."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    rows = docs.select(*keep, F.col(text).cast("string").alias(_IN))
    return rows.mapInArrow(_ids(path or rank_file(), piece, True), f"{schema}, n_tokens bigint")


def _text(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            raw = [None if x is None else enc.decode_bytes(x) for x in batch["ids"].to_pylist()]
            names = [c for c in batch.schema.names if c != "ids"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(raw, pa.binary())], names=[*names, "raw"])

    return run


def decode_corpus(encoded: DataFrame, keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """``keep`` columns and ``raw``, the bytes of each id list; any list decodes, cut ones too."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*keep).schema)
    return encoded.select(*keep, "ids").mapInArrow(_text(path or rank_file()), f"{schema}, raw binary")
