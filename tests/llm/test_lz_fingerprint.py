import base64
import hashlib
import random

import numpy as np
from tidelog.llm.lz_fingerprint import Parsed, fingerprint, likeness


def phrases(text):
    known, phrase = set(), ""
    for c in text:
        phrase += c
        if phrase not in known:
            known.add(phrase)
            phrase = ""
    return known


def test_phrase_sets():
    rnd = random.Random(1)
    text = lambda n: "".join(rnd.choice("abcé \n漢") for _ in range(n))
    for n in [0, 1, 2, 3, 10, 101, 400]:
        a, b = text(n), text(n // 2 + 7)
        pa, pb = Parsed(a, 10**6), Parsed(b, 10**6)
        changed, signature = pa.edited(b)
        assert changed == a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        assert len(pa.signature) == len(phrases(a)) and len(signature) == len(phrases(changed))
        for x, sx, y, sy in ((a, pa.signature, b, pb.signature), (a, pa.signature, changed, signature)):
            px, py = phrases(x), phrases(y)
            want = len(px & py) / len(px | py) if px | py else 1.0
            assert abs(likeness(sx, sy, 10**6) - want) < 1e-9


def brute(docs):
    rows = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or ""))
    out = []
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, u = t or "", u or ""
        here = Parsed(t)
        changed, signature = here.edited(u)
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), base64.b64encode(here.signature.astype(">u4").tobytes()).decode(), round(likeness(here.signature, signature), 9), round(likeness(here.signature, Parsed(u).signature), 9)))
    return sorted(out, key=str)


def test_documents(spark, docs_of):
    rnd = random.Random(4)
    docs = [(rnd.choice([3, 10**12, -5]) * k, "".join(rnd.choice("ab cdé") for _ in range(rnd.choice([0, 1, 40, 3000])))) for k in range(60)]
    docs += [(None, "null one"), (None, None), (7, "same"), (7, "same"), (7, "other"), (8, None), (9, "")]
    for rows in (3, 4000):
        got = fingerprint(docs_of(docs).selectExpr("*", "1 as _part", "2 as _ahead"), rows_per_range=rows)
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got.collect()), key=str) == brute(docs)


def test_small_tables(spark, docs_of):
    assert fingerprint(docs_of([])).count() == 0
    (row,) = fingerprint(docs_of([(1, "abcdef")])).collect()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()


def test_long_text_and_equal_texts():
    text = "lorem ipsum dolor " * 20_000
    assert np.array_equal(Parsed(text).signature, Parsed(text).signature) and len(Parsed(text).signature) <= 128
