import hashlib
import random
import re

import pytest
from tidelog.llm.decontam import decontaminate, remove_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item_id, item in items:
            q = words(item)
            n = min(window, len(q))
            grams = {tuple(q[i : i + n]) for i in range(len(q) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    ids.add(item_id)
        ids.discard(None)
        sha = hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(ids), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def cases():
    rnd = random.Random(3)
    vocabulary = ["a", "B", "cé", "É", "dd", "x1", "the"]
    text = lambda n: rnd.choice([" ", ", ", "\n"]).join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([0, 1, 2, 3, 5, 12, 13, 14, 30, 60, 60])] + [(77, None), (9, text(20)), (None, text(15))]
    items[1] = (1, "zz")
    items[2] = (2, "qq rr")
    docs = [(i, text(n)) for i, n in enumerate([0, 1, 5, 13, 40, 200, 200])]
    for k in range(40):
        item = words(items[k % len(items)][1])
        lo = rnd.randint(0, max(0, len(item) - 13))
        docs.append((100 + k, text(rnd.randint(0, 30)) + " " + " ".join(item[lo : lo + rnd.choice([12, 13, 20])]).upper().replace("É", "é" if k % 2 else "É") + "; " + text(rnd.randint(0, 300))))
    return docs + [(None, "zz zz"), (500, None), (501, ""), (502, "qq rr qq"), (502, "qq rr qq"), (503, "... zz")], items


@pytest.mark.parametrize("bound", [50_000, 3])
def test_brute_force(spark, docs_of, bound):
    docs, items = cases()
    got = decontaminate(docs_of(docs), spark.createDataFrame(items, "item_id long, text string"), max_broadcast=bound)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_empty_tables(spark, docs_of):
    items = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate(docs_of([(1, "a b")]), items).collect()] == [0]
    assert decontaminate(docs_of([]), items).count() == 0


def test_removal(spark, docs_of):
    item = " ".join(f"w{i}" for i in range(20))
    filler = "-- " + " ".join(f"f{i}" for i in range(700))
    docs = docs_of([(1, item), (2, f"{filler} {item}. tail"), (3, filler), (4, None), (None, f"{filler}")])
    docs = docs.selectExpr("*", "1 as hit_", "doc_id as _row_", "'k' as item_id")
    got = {r.doc_id: r for r in remove_contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(got) == {2, 3, 4, None}
    assert got[2].text == f"{filler} tail" and got[2].n_chars == len(got[2].text)
    assert got[3].text == filler and got[4].text is None and got[3].item_id == "k"


@pytest.mark.parametrize("bound", [50_000, 3])
def test_one_prompt_in_very_many_items(spark, docs_of, bound):
    """Items of one text are one text; documents meet its contexts, not the items."""
    prompt = " ".join(f"p{i}" for i in range(15))
    items = spark.range(100_000).selectExpr("id as item_id", f"'{prompt}' as text")
    docs = [(i, f"a{i} {prompt} b") for i in range(20)] + [(99, "clean " * 50)]
    got = {r.doc_id: r for r in decontaminate(docs_of(docs), items, max_broadcast=bound).collect()}
    sha = hashlib.sha256(",".join(sorted(map(str, range(100_000)))).encode()).hexdigest()
    assert all((got[i].n_hit, got[i].n_items, got[i].items_sha256) == (15, 100_000, sha) for i in range(20)) and got[99].n_items == 0


def test_long_text_and_clashing_columns(spark, docs_of):
    item = " ".join(f"w{i}" for i in range(20))
    docs = docs_of([(1, "x " * 300_000 + item), (2, item)]).selectExpr("*", "1 as _row", "2 as n_words", "'k' as hit", "3 as items")
    got = {r.doc_id: r for r in decontaminate(docs, spark.createDataFrame([(1, item), (1, item)], "item_id long, text string")).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].contaminated, got[2].contaminated) == (300_020, 20, False, True)
