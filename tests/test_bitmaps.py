import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.functions import bitmaps

ids = st.lists(st.integers(0, 65535), max_size=6000)


@settings(max_examples=40, deadline=None)
@given(st.lists(ids, min_size=1, max_size=4))
def test_union_and_cardinality(sets):
    blocks = [bitmaps.encode(np.unique(np.array(s, np.uint16))) for s in sets]
    both = bitmaps.union(blocks)
    true = sorted(set().union(*map(set, sets)))
    assert bitmaps.decode(both).tolist() == true
    assert bitmaps.cardinality(both) == len(true)


def test_dense_blocks_become_bits():
    block = bitmaps.encode(np.arange(5000, dtype=np.uint16))
    assert block[:1] == b"B" and len(block) == 8193 and bitmaps.cardinality(block) == 5000
    assert bitmaps.cardinality(bitmaps.union([block, bitmaps.encode(np.array([4999, 60000], np.uint16))])) == 5001


def test_build_blocks_splits_by_identifier_block():
    codes = np.array([2, 1, 1, 1, 2])
    who = np.array([5, 70000, 3, 3, -1])
    c, high, blocks, rows, _ = bitmaps.build_blocks(codes, who)
    assert c.tolist() == [1, 1, 2, 2] and high.tolist() == [0, 1, -1, 0] and rows.tolist() == [2, 1, 1, 1]
    assert [bitmaps.cardinality(b) for b in blocks] == [1, 1, 1, 1]


def test_merge_sorted_carries_runs_over_batches():
    batches = [pa.RecordBatch.from_pydict({"k": k, "n": [1] * len(k)}) for k in ([1, 1], [1, 2], [], [2, 2, 3])]
    same = lambda t: t["k"].to_numpy()[1:] == t["k"].to_numpy()[:-1]
    combine = lambda t, s: pa.table({"k": t["k"].to_numpy()[s], "n": np.add.reduceat(t["n"].to_numpy(), s)})
    rows = [r for b in bitmaps.merge_sorted(iter(batches), same, combine) for r in b.to_pylist()]
    assert rows == [{"k": 1, "n": 3}, {"k": 2, "n": 3}, {"k": 3, "n": 1}]
