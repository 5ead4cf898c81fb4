import random

import numpy as np
import pytest

from threadloom.llm import encode

tokenizers = pytest.importorskip("tokenizers")
PIECES = ["The list", " don't", "'s", "  ", "\n\n", " ", "x" * 90, "中文。字", "ﬁ é", "é", "😀👩‍🔬", "<|endoftext|>", "1234", " -- ", "\t", " ", "\r\n", "a.b", "'"]


def texts(n=300):
    rng = random.Random(3)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_equals_the_json_vocabulary():
    t = tokenizers.Tokenizer.from_file(f"{encode.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    enc = encode.encoding(encode.rank_file())
    for text in texts():
        assert encode.encode_text(enc, text).tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("size", [1, 5, 20])
def test_pieces_do_not_change_the_ids(size):
    enc = encode.encoding(encode.rank_file())
    for text in texts():
        parts = encode.pieces(text, size)
        assert "".join(parts) == text
        if text:
            assert np.array_equal(encode.encode_text(enc, text, size), encode.encode_text(enc, text))


def test_frame_and_round_trip(spark):
    rows = [(1, "Hello world", 9), (2, "", 9), (3, None, 9), (1, "Hello world", 9), (4, "a b " * 400_000, 9), (5, "y" * 5000, 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = encode.encode_corpus(df, piece=1000).collect()
    by = {r["doc_id"]: r["ids"] for r in got}
    assert len(got) == 6 and by[2] == [] and by[3] == []
    assert {r["doc_id"]: r["n_tokens"] for r in encode.count_tokens(df).collect()} == {k: len(v) for k, v in by.items()}
    back = {r["doc_id"]: r["raw"] for r in encode.decode_corpus(encode.encode_corpus(df)).collect()}
    assert {k: bytes(v).decode() for k, v in back.items()} == {r[0]: r[1] or "" for r in rows}
    assert encode.encode_corpus(df.limit(0)).count() == 0
    assert encode.encode_corpus(df, keep=("doc_id", "text")).columns == ["doc_id", "text", "ids"]
