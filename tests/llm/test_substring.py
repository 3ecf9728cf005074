import hashlib
import random

import numpy as np
import pytest
from tidelog.llm.substring import _gone, _with_repeats, dedup_counts, internal_nodes, maximal_repeats, passage, remove_repeats, repeats


def brute(docs, window=13):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in docs]
    for i, w in split:
        for k in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def cases(seed):
    rnd = random.Random(seed)
    small = ["a", "b", "é", "x y", " "]
    large = [f"w{i}" for i in range(400)]
    make = lambda n, v: rnd.choice([" ", "\n", " \t "]).join(rnd.choice(v) for _ in range(n))
    docs = [(i, make(rnd.choice([0, 1, 12, 13, 14, 60]), large)) for i in range(30)]
    docs += [(40 + i, make(40, small)) for i in range(6)]
    passage = make(55, large)
    docs += [(100 - i, f"{make(rnd.randint(0, 40), large)} {passage if i % 2 else ' '.join(passage.split()[i:i + 20])} {make(rnd.randint(0, 30), large)}") for i in range(12)]
    docs += [(200, docs[5][1]), (201, docs[5][1]), (3, docs[5][1]), (202, "ha " * 500), (203, "ha " * 30), (204, None), (205, ""), (None, passage), (None, passage)]
    return docs + [(206, passage), (206, passage), (207, "q " * 5000 + passage)]


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, docs_of, seed):
    docs = cases(seed)
    assert sorted(map(tuple, dedup_counts(docs_of(docs)).collect()), key=str) == brute(docs)


def test_removal(spark, docs_of):
    p = " ".join(f"p{i}" for i in range(20))
    docs = [(1, f"x {p}"), (2, f"a\nb {p}\nc  d"), (3, p), (4, None), (5, ""), (6, "lone  text\n")]
    frame = docs_of(docs).selectExpr("*", "1 as shared", "'k' as starts", "true as whole")
    got = {r.doc_id: r for r in remove_repeats(frame).collect()}
    assert {k: r.text for k, r in got.items()} == {1: f"x {p}", 2: "a\nb c  d", 4: None, 5: "", 6: "lone  text\n"}
    assert got[2].n_chars == 8 and got[2].starts == "k"


def test_empty(spark, docs_of):
    assert dedup_counts(docs_of([])).count() == 0 and remove_repeats(docs_of([])).count() == 0


def plain_maximal(docs, window, depth):
    """Sequences of ``window`` to ``depth`` words in several documents whose places differ in the word before and after."""
    places = {}
    for i, t in docs:
        w = (t or "").split() if i is not None else []
        for k in range(len(w)):
            for n in range(window, min(depth, len(w) - k) + 1):
                places.setdefault(tuple(w[k : k + n]), []).append((i, w[k - 1] if k else None, w[k + n] if k + n < len(w) else None))
    out = set()
    for seq, at in places.items():
        before, after = {p[1] for p in at}, {p[2] for p in at}
        if len({p[0] for p in at}) > 1 and (len(before) > 1 or None in before) and (len(seq) == depth or len(after) > 1 or None in after):
            out.add((" ".join(seq), len(seq), len(at), min(p[0] for p in at), len(seq) == depth))
    return out


@pytest.mark.parametrize("group_suffixes", [3, 40, 131_072])
def test_maximal_repeats(spark, docs_of, group_suffixes):
    rnd = random.Random(5)
    make = lambda n, v: " ".join(rnd.choice(v) for _ in range(n))
    large, p, q = [f"w{i}" for i in range(300)], *(" ".join(f"{c}{i}" for i in range(n)) for c, n in (("p", 9), ("q", 30)))
    docs = [(i, make(rnd.randint(0, 12), large) + " " + rnd.choice([p, q, q[:60], p + " " + q[:40], "z"]) + " " + make(rnd.randint(0, 6), large)) for i in range(40)]
    docs += [(50 + i, make(14, ["a", "b"])) for i in range(4)] + [(60, None), (61, ""), (None, q), (62, q), (62, q)]
    got = [tuple(r) for r in maximal_repeats(docs_of(docs), window=6, gram=4, depth=20, group_suffixes=group_suffixes).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_maximal(docs, 6, 20)


@pytest.mark.parametrize("group_suffixes", [2, 50])
def test_prefixes_grow_where_groups_are_large(spark, docs_of, group_suffixes):
    docs = cases(3)
    got = _with_repeats(docs_of(docs), repeats(docs_of(docs), group_suffixes=group_suffixes)).selectExpr("doc_id", "text", "_rep_whole", "_rep_starts").collect()
    want = sorted((r[0], r[2]) for r in brute(docs) if r[2])
    assert sorted((r.doc_id, int(_gone(len(r.text.split()), r._rep_whole, np.array(r._rep_starts or [], dtype=np.int64), 13).sum())) for r in got if r._rep_whole or r._rep_starts) == want


def test_long_words_and_odd_bytes(spark, docs_of):
    words = ["a\x00b", "a", "a\x01", "\x00", "é" * 40, "x" * 5000, "x" * 4999 + "y", "\x1f", "b", "c", "d", "e", "f", "g"]
    docs = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(["pre", *words, "post"])), (4, " ".join(words[:6] + ["x" * 5000] + words[7:])), (5, "\n".join(words[:13]))]
    assert sorted(map(tuple, dedup_counts(docs_of(docs)).collect()), key=str) == brute(docs)


def test_tree_of_suffixes():
    suffixes = sorted(passage(s.encode().split()) for s in ("a b c d", "a b c e", "a b", "a", "x", "a b c d", "a\x01 b"))
    nodes = {(d, up, b"".join(suffixes[lo : lo + 1]).split(b"\x00")[0], hi - lo) for d, up, lo, hi in internal_nodes(suffixes)}
    assert nodes == {(1, 0, b"a", 5), (2, 1, b"a", 4), (3, 2, b"a", 3), (4, 3, b"a", 2)}
