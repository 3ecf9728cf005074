import random
import re
import zlib

import numpy as np
import pytest

from tidelog.llm import langid
from tidelog.llm.langid import identify, predict

SOUNDS = {"aa": ["ba", "lo", "mi", "tu"], "bb": ["str", "ing", "tion", "he"], "cc": ["é", "ñu", "ça", "ro"]}


def docs(n=240, seed=0):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lang = rnd.choice(sorted(SOUNDS))
        text = " ".join("".join(rnd.choice(SOUNDS[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(3, 80)))
        out.append((i, text.title() if i % 3 else text, lang if i % 7 else None, "s"))
    return out


def test_held_out_accuracy(spark, docs_of):
    rows = docs()
    got = {r.doc_id: r for r in identify(docs_of(rows)).collect()}
    assert len(got) == len(rows)
    for i, *_ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    test = [r for r in rows if got[r[0]].held_out and r[2]]
    assert sum(got[i].lang_pred == lang for i, _, lang, _ in test) >= 0.95 * len(test)
    assert all(0 <= r.score <= 1 and r.accepted for r in got.values())


def test_label_of_a_held_out_row_is_not_used(spark, docs_of):
    rows = docs()
    wrong = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s) for i, t, lang, s in rows]
    key = lambda frame: sorted((r.doc_id, r.lang_pred, r.score) for r in frame.collect())
    assert key(identify(docs_of(rows))) == key(identify(docs_of(wrong)))


def test_edges(spark, docs_of):
    rows = docs(60) + [(900, None), (901, ""), (902, "12 34 !!"), (None, "ba lo mi", "aa", "s"), (903, "ba lo", "aa", "s"), (903, "ba lo", "aa", "s"), (904, "Привет мир это совсем другой язык " * 10, None, None), (905, "ba" * 200_000)]
    got = identify(docs_of(rows).selectExpr("*", "'x' as lang_pred", "1 as score")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert {by[i].lang_pred for i in (900, 901, 902)} == {"und"} and by[900].score == 0 and not by[901].accepted
    assert by[None].held_out is False and by[903].lang_pred == "aa" and by[905].lang_pred == "aa" and not by[904].accepted
    assert [r.lang_pred for r in identify(docs_of([(1, "text without labels")])).collect()] == ["und"]
    assert identify(docs_of([])).count() == 0
    assert "extra" in predict(docs_of([(1, "x")]).selectExpr("*", "1 as extra"), [], __import__("numpy").zeros((0, 1024), dtype="float32")).columns


def plain_bundle(text, order=3):
    """Sum of products of rotated letter vectors, n-gram by n-gram."""
    spaced = "".join(c if c.isalpha() else " " for c in " " + text.lower() + " ")
    spaced = re.sub(" +", " ", spaced)
    out = np.zeros(langid.DIM, dtype=np.int64)
    for i in range(len(spaced) - order + 1):
        gram = np.ones(langid.DIM, dtype=np.int64)
        for k, c in enumerate(spaced[i : i + order]):
            gram *= np.roll(langid.letter_vectors(np.array([ord(c)]))[0].astype(np.int64), order - 1 - k)
        out += gram
    return out


def test_bundles_equal_plain_ones():
    texts = ["Straße, Öl & Brot", "a", "x y z", "Ünïcode 123 mixed-case TEXT " * 3]
    bundles, letters = langid.HyperEncoder().encode([*texts, None, "12"])
    for text, bundle, n in zip(texts, bundles, letters, strict=False):
        assert (bundle.astype(np.int64) == plain_bundle(text)).all() and n == sum(c.isalpha() for c in text.lower())
    assert not bundles[4:].any() and letters[4:].tolist() == [0, 0]


@pytest.mark.parametrize("piece", [3, 5, 17, 64])
def test_pieces_of_a_text_give_the_grams_of_the_whole(monkeypatch, piece):
    rnd = random.Random(piece)
    for _ in range(50):
        text = "".join(rnd.choice("ab é.1") for _ in range(rnd.randint(1, 120)))
        whole = langid.HyperEncoder().grams(text)
        with monkeypatch.context() as m:
            m.setattr(langid, "PIECE", piece)
            parts = langid.HyperEncoder().grams(text)
        assert whole[2] == parts[2] and (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_table_of_vectors_that_overflows(monkeypatch):
    text = "".join(chr(0x4E00 + (i * 7919) % 3000) for i in range(3000))
    want, _ = langid.HyperEncoder().encode([text])
    monkeypatch.setattr(langid, "KEPT", 300)
    monkeypatch.setattr(langid, "AT_ONCE", 200)
    got, _ = langid.HyperEncoder().encode([text])
    assert (want == got).all()


def test_equal_likeness_goes_to_the_first_language(docs_of):
    same = [(i, "same words in both", lang, None) for i, lang in ((0, "yy"), (1, "xx"))]
    assert {r.lang_pred for r in identify(docs_of(same)).collect()} == {"xx"}
