import random

import pytest
from tidelog.llm.token_count import ChunkedPieceCounter, count_tokens

tokenizers = pytest.importorskip("public_tokenizers")
MODEL = tokenizers.path("piece_bpe_32k.model")
ALPHABET = [" ", "  ", "a", "b", "hello", "\n", "é", "漢", "😀", "\t", "the", "ing", "▁", "<s>", "\x00", "aaaaaaa", "́"]


def test_chunks_equal_whole_texts():
    counter, rnd = ChunkedPieceCounter(MODEL, 64, 8), random.Random(1)
    assert counter.identity
    for k in range(400):
        text = "".join(rnd.choice(ALPHABET if k % 3 else ["a", "aa", "b"]) for _ in range(rnd.randint(0, 400)))
        assert counter.counts([text]) == [len(counter.whole.encode(text))]
    assert counter.widened  # texts without a stable boundary were met


def test_frame(spark, docs_of):
    rows = [(1, "hello world"), (2, None), (3, ""), (None, "x"), (4, "ab" * 40_000), (4, "ab" * 40_000), (5, "word é\n" * 9000)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs_of(rows).selectExpr("*", "1 as n_bytes"), MODEL).collect())
    whole = ChunkedPieceCounter(MODEL).whole
    want = sorted((i or 0, len((t or "").encode()), (n := len(whole.encode(t or ""))), n > 4096) for i, t in rows)
    assert got == want
    assert count_tokens(docs_of([]), MODEL).count() == 0
