"""The whole pipeline on a small fixture against a plain-Python version of its stages."""

import random

import corpus_pipeline
import test_decontam
import test_simhash
from pyspark.sql import functions as F


def fixture():
    rnd = random.Random(11)
    sounds = {"en": ["the", "ing", "tion", "and", "er", "st"], "fr": ["eau", "ê", "oi", "ment", "que", "ré"]}
    word = lambda lang: "".join(rnd.choice(sounds[lang]) for _ in range(rnd.randint(1, 4)))
    text = lambda n, lang: " ".join(word(lang) for _ in range(n))
    items = [(i, text(40, "en")) for i in range(5)]
    docs = [(i, text(rnd.randint(60, 200), lang), lang, rnd.choice(["a", "a", "b", None])) for i in range(60) for lang in [rnd.choice(["en", "fr"])]]
    passage = text(55, "en")
    docs += [(100 + i, docs[i][1], docs[i][2], "a") for i in range(6)]  # exact copies
    docs += [(110 + i, docs[20 + i][1].replace("t", "T").replace("e", "E"), docs[20 + i][2], "b") for i in range(3)]  # copies but for case
    docs += [(120 + i, f"{text(80, 'en')} {passage} {text(50, 'en')}", "en", "b") for i in range(4)]
    docs += [(130, f"{text(30, 'en')} {items[0][1]} {text(10, 'en')}", "en", "a"), (131, f"{text(400, 'en')}; {' '.join(items[1][1].split()[:15])}. {text(30, 'en')}", "en", "a")]
    docs += [(140, "12345 -- 67", None, "a"), (141, None, None, "a"), (142, "", None, "b"), (143, passage, "en", "a"), (144, "Привет мир это совсем другой язык " * 8, None, "a")]
    return docs, items


def plain(docs, items):
    """doc_id -> words that stay, after stages 1 to 4."""
    kept = {i: t for i, t, *_ in docs if t and any(c.isalpha() for c in t) and "Привет" not in t}
    prints = {}
    for i, t in sorted(kept.items()):
        prints.setdefault(test_simhash.slow_print(t), i)
    root = test_simhash.slow_components(prints)
    kept = {i: t for i, t in kept.items() if root[test_simhash.slow_print(t)] == i}
    first, words = {}, {i: t.split() for i, t in kept.items()}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    for i, w in list(words.items()):
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        words[i] = [x for k, x in enumerate(w) if k not in gone]
    words = {i: w for i, w in words.items() if w}
    grams = {tuple(q[k : k + 13]) for _, t in items for q in [test_decontam.words(t)] for k in range(len(q) - 12)}
    out = {}
    for i, w in words.items():
        q = test_decontam.words(" ".join(w))
        hit = {k + j for k in range(len(q) - 12) if tuple(q[k : k + 13]) in grams for j in range(13)}
        if not hit or 20 * len(hit) < len(q):
            out[i] = [x for k, x in enumerate(q) if k not in hit]
    return out


def test_run(spark, tmp_path):
    docs, items = fixture()
    rows = [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("text_key", F.lit(1)).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: test_decontam.words(r.text) for r in got} == plain(docs, items)
    assert len({r.doc_id for r in got}) == len(got) == len({r.mix_pos for r in got})
    assert all(r.n_chars == len(r.text) and r.text_key == 1 for r in got)
    assert {100, 110, 130, 140, 141, 142, 143, 144}.isdisjoint(r.doc_id for r in got) and {0, 20, 120, 131} <= {r.doc_id for r in got}


def test_stages_return_documents(spark, tmp_path):
    docs, items = fixture()
    rows = [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in docs[:20]]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert len(corpus_pipeline.STAGES) == 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, frame.limit(0), str(tmp_path)).count() == 0
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == frame.columns or k == 4 and out.columns[:5] == frame.columns
        assert out.count() >= 19
