"""Compressed bitmaps of 64-bit identifiers, cut into blocks of 65,536.

A block is one byte string: ``A`` and the sorted low 16 bits while it holds at most 4,096
identifiers, ``B`` and 8 KiB of bits beyond. The block number is the identifier shifted
right by 16, so blocks of one set are disjoint and cardinalities add up. Union is
idempotent: an identifier that is put in twice counts once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

ARRAY_MAX = 4096
BITS = 1 << 16


def encode(low: np.ndarray) -> bytes:
    """Block of sorted, distinct low halves (uint16)."""
    if len(low) <= ARRAY_MAX:
        return b"A" + low.astype("<u2").tobytes()
    flags = np.zeros(BITS, dtype=np.uint8)
    flags[low] = 1
    return b"B" + np.packbits(flags, bitorder="little").tobytes()


def decode(block: bytes) -> np.ndarray:
    """Sorted low halves of a block."""
    if block[:1] == b"A":
        return np.frombuffer(block, dtype="<u2", offset=1)
    bits = np.unpackbits(np.frombuffer(block, dtype=np.uint8, offset=1), bitorder="little")
    return np.flatnonzero(bits).astype(np.uint16)


def cardinality(block: bytes) -> int:
    if block[:1] == b"A":
        return (len(block) - 1) // 2
    words = np.frombuffer(block, dtype="<u8", offset=1)
    return int(np.bitwise_count(words).sum())


def union(blocks: Iterable[bytes]) -> bytes:
    """Union of blocks with the same block number."""
    arrays, bits = [], None
    for b in blocks:
        if b[:1] == b"A":
            arrays.append(np.frombuffer(b, dtype="<u2", offset=1))
        else:
            words = np.frombuffer(b, dtype=np.uint8, offset=1)
            bits = words.copy() if bits is None else np.bitwise_or(bits, words, out=bits)
    if bits is None:
        return encode(np.unique(np.concatenate(arrays)) if arrays else np.empty(0, np.uint16))
    if arrays:
        flags = np.zeros(BITS, dtype=np.uint8)
        flags[np.concatenate(arrays)] = 1
        bits |= np.packbits(flags, bitorder="little")
    return b"B" + bits.tobytes()


def build_blocks(codes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Group identifiers by code: (code, block number, block, rows) for each code and block.

    ``rows`` counts input rows, repeated identifiers included. The last part is the order
    that sorts the input by code and identifier. At least one row is needed.
    """
    high = ids >> 16
    order = np.lexsort((ids, codes))
    codes, ids, high = codes[order], ids[order], high[order]
    new_group = np.r_[True, (codes[1:] != codes[:-1]) | (high[1:] != high[:-1])]
    new_id = new_group | np.r_[True, ids[1:] != ids[:-1]]
    starts = np.flatnonzero(new_group)
    rows = np.diff(np.r_[starts, len(codes)])
    low = (ids[new_id] & 0xFFFF).astype("<u2")
    edges = np.r_[np.searchsorted(np.flatnonzero(new_id), starts), len(low)]
    raw = low.tobytes()
    blocks = [
        b"A" + raw[2 * a : 2 * b] if b - a <= ARRAY_MAX else encode(low[a:b])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)
    ]
    return codes[starts], high[starts], blocks, rows, order


def merge_sorted(
    batches: Iterator[pa.RecordBatch],
    same: Callable[[pa.Table], np.ndarray],
    combine: Callable[[pa.Table, np.ndarray], pa.Table],
) -> Iterator[pa.RecordBatch]:
    """Stream a key-sorted partition and hand whole runs of equal keys to ``combine``.

    ``same(t)`` gives, for every row but the first, whether its key equals the row before;
    ``combine(t, starts)`` merges the runs that start at ``starts``. The last run of a
    batch is merged and carried over, so memory stays at one batch.
    """
    held: pa.Table | None = None
    for batch in batches:
        t = pa.table(batch.columns, schema=pa.schema([(f.name, f.type) for f in batch.schema]))
        if not t.num_rows:
            continue
        if held is not None:
            t = pa.concat_tables([held, t]).combine_chunks()
        starts = np.flatnonzero(np.r_[True, ~same(t)])
        merged = combine(t, starts)
        held = merged.slice(merged.num_rows - 1)
        yield from merged.slice(0, merged.num_rows - 1).to_batches()
    if held is not None:
        yield from held.to_batches()
