"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter n-gram is bound as the product of its
letters' vectors, each permuted (rotated) by its distance from the end, so order counts. A text is
the bundle (sum) of its n-gram vectors, a language the bundle of the unit vectors of its training
texts, and a text's language is that of the prototype with the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import frugal, slices

DIM = 1024
ORDER = 3
#: Training texts for each language: those with the smallest hash of doc_id, so a fixed sample of bounded size.
TRAIN_PER_LANG = 1_000
#: Up to so many languages the ids of the training texts (8 MB at most) are broadcast.
MAX_BROADCAST_LANGS = 1_000
UNDETERMINED = "und"
#: A text of so many letters that resembles no language beyond chance (cosine under NOISE standard deviations) is rejected.
SURE_LETTERS, NOISE = 64, 3.0
#: Vectors of n-grams that a task keeps (a byte an element); n-grams that are bound at once; characters of a text that are taken at once.
KEPT, AT_ONCE, PIECE = 16_384, 2_048, 1 << 20


def letter_vectors(points: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Random signs for code points, the same in every process: bits of a mixed counter."""
    x = (points.astype(np.uint64)[:, None] << np.uint64(32)) + np.arange(dim // 64, dtype=np.uint64)[None, :] + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    bits = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1)
    return bits.astype(np.int8) * 2 - 1


class HyperEncoder:
    """Texts to bundles of bound n-gram vectors. Keeps the vectors of n-grams it has seen in a table of fixed size."""

    def __init__(self, dim: int = DIM, order: int = ORDER) -> None:
        self.dim, self.order = dim, order
        #: 1 for letters, 0 for other code points, -1 where that is not known yet.
        self.letter = np.full(0x110000, -1, dtype=np.int8)
        self.codes, self.row = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        self.vectors = np.empty((KEPT, dim), dtype=np.int8)

    def _letters(self, points: np.ndarray) -> np.ndarray:
        known = self.letter[points]
        if (new := np.unique(points[known < 0])).size:
            self.letter[new] = [chr(c).isalpha() for c in new.tolist()]
            known = self.letter[points]
        return known.astype(bool)

    def _pieces(self, text: str) -> Iterator[tuple[np.ndarray, int]]:
        """Code points of a text, piece by piece, where runs of anything but letters are one space; and each piece's letters."""
        spaced = False
        for lo in range(0, len(text) + 2, PIECE):
            part = (" " if lo == 0 else "") + text[max(0, lo - 1) : lo - 1 + PIECE] + (" " if lo + PIECE >= len(text) + 2 else "")
            points = np.frombuffer(part.encode("utf-32-le", "replace"), dtype=np.uint32)
            letter = self._letters(points)
            points = np.where(letter, points, 32)[letter | np.r_[not spaced, letter[:-1]]].astype(np.uint64)
            spaced = not letter[-1]
            yield points, int(letter.sum())

    def grams(self, text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Distinct n-gram codes, their counts, and the number of letters."""
        n, before = 0, np.empty(0, dtype=np.uint64)
        codes, counts = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        for points, letters in self._pieces(text.lower()) if text else ():
            n += letters
            points = np.concatenate([before, points])
            before = points[-(self.order - 1) :] if self.order > 1 else before
            if len(points) < self.order:
                continue
            code = np.zeros(len(points) - self.order + 1, dtype=np.uint64)
            for k in range(self.order):
                code = (code << np.uint64(21)) | points[k : len(points) - self.order + 1 + k]
            here, times = np.unique(code, return_counts=True)
            if len(codes):
                here, at = np.unique(np.concatenate([codes, here]), return_inverse=True)
                times = np.bincount(at, np.concatenate([counts, times]), len(here)).astype(np.int64)
            codes, counts = here, times
        return (codes, counts, n) if n else (codes[:0], counts[:0], 0)

    def _bind(self, codes: np.ndarray) -> np.ndarray:
        out = np.ones((len(codes), self.dim), dtype=np.int8)
        for k in range(self.order):
            points, at = np.unique((codes >> np.uint64(21 * (self.order - 1 - k))) & np.uint64(0x1FFFFF), return_inverse=True)
            out *= np.roll(letter_vectors(points, self.dim), self.order - 1 - k, axis=1)[at]
        return out

    def lookup(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of at most AT_ONCE sorted distinct codes."""
        new = codes[~np.isin(codes, self.codes, assume_unique=True)]
        if len(self.codes) + len(new) > KEPT:
            self.codes, self.row, new = self.codes[:0], self.row[:0], codes
        if len(new):
            rows = np.arange(len(self.codes), len(self.codes) + len(new))
            self.vectors[rows] = self._bind(new)
            order = np.argsort(both := np.concatenate([self.codes, new]), kind="stable")
            self.codes, self.row = both[order], np.concatenate([self.row, rows])[order]
        return self.vectors[self.row[np.searchsorted(self.codes, codes)]].astype(np.float32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """One bundle for each text, and the numbers of letters."""
        rows = [self.grams(t) for t in texts]
        bundles = np.zeros((len(texts), self.dim), dtype=np.float32)
        if any(len(r[0]) for r in rows):
            codes, at = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
            owner = np.repeat(np.arange(len(texts)), [len(r[0]) for r in rows])
            counts = np.concatenate([r[1] for r in rows])
            order = np.argsort(at, kind="stable")
            at, owner, counts = at[order], owner[order], counts[order]
            for lo in range(0, len(codes), AT_ONCE):
                a, b = np.searchsorted(at, [lo, lo + AT_ONCE])
                part = codes[lo : lo + AT_ONCE]
                dense = np.zeros((len(texts), len(part)), dtype=np.float32)
                dense[owner[a:b], at[a:b] - lo] = counts[a:b]
                bundles += dense @ self.lookup(part)
        return bundles, np.array([r[2] for r in rows], dtype=np.int64)


def _units(bundles: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(bundles, axis=1, keepdims=True)
    return bundles / np.where(norms == 0, 1, norms)


def fit(docs: DataFrame, per_lang: int = TRAIN_PER_LANG, dim: int = DIM, order: int = ORDER) -> tuple[list[str], np.ndarray]:
    """Prototypes of the languages in ``docs`` (doc_id, text, lang): at most ``per_lang`` texts each.

    Rows with a null lang, text or doc_id teach nothing. What reaches the driver is one vector for each language.
    """
    known = docs.where("lang is not null and text is not null and doc_id is not null")
    # Only hashes below a language's cut are ranked: about twice the rows that are wanted, however many there are.
    hashed = known.select("lang", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2**40)).alias("h"))
    cuts = hashed.groupBy("lang").agg(F.count("*").alias("rows")).select(F.col("lang").alias("of"), (F.lit(2.0**40) * (2 * per_lang + 100) / F.col("rows")).alias("cut"))
    # The cuts have a row for each language and the choice at most per_lang of them, so both are small where languages are few.
    small = F.broadcast if per_lang <= TRAIN_PER_LANG and known.select("lang").distinct().limit(MAX_BROADCAST_LANGS + 1).count() <= MAX_BROADCAST_LANGS else (lambda df: df)
    few = hashed.join(small(cuts), F.col("lang") == F.col("of")).where("h < cut").select("lang", "doc_id", "h")
    first = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = few.withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_lang).select("doc_id").distinct()
    sample = known.select("doc_id", "lang", "text").join(small(chosen), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = HyperEncoder(dim, order), {}
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                bundles, _ = encoder.encode(part.column("text").to_pylist())
                for lang, unit in zip(part.column("lang").to_pylist(), _units(bundles), strict=True):
                    # Whole numbers: their sum does not hang on the order of texts or tasks.
                    sums[lang] = sums.get(lang, 0) + np.rint(unit.astype(np.float64) * 2**24).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "bundle"])

    parts = sample.select("lang", "text").mapInArrow(frugal(run), "lang string, bundle array<long>")
    total = parts.select("lang", F.posexplode("bundle").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = total.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("lang").collect()
    return [r.lang for r in rows], _units(np.array([[p.x for p in r.v] for r in rows], dtype=np.float64).reshape(len(rows), dim)).astype(np.float32)


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray, dim: int = DIM, order: int = ORDER) -> DataFrame:
    """All columns of ``docs`` with lang_pred, score (cosine, at least 0) and accepted; columns of these names are replaced.

    A null text, one without letters, or any text where nothing was learned is ``und`` with score 0.
    Equal cosines go to the alphabetically first language. accepted is false for ``und`` and for
    texts of at least SURE_LETTERS letters whose cosine chance alone could give. Texts are read whole,
    however long, PIECE characters at a time. Null doc_ids and repeated rows are rows like any other; an empty
    table gives an empty result. Only the texts go to Python.
    """
    floor = NOISE / dim**0.5
    kinds = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = HyperEncoder(dim, order)
        for texts in columns:
            pred, score, accepted = [], [], []
            for lo, hi in slices(texts):
                bundles, letters = encoder.encode(texts[lo:hi].to_pylist())
                cosines = _units(bundles) @ prototypes.T if langs else np.zeros((len(bundles), 1), dtype=np.float32)
                best = cosines.argmax(axis=1)
                for k, n in enumerate(letters.tolist()):
                    sure = bool(langs) and n > 0
                    pred.append(langs[best[k]] if sure else UNDETERMINED)
                    value = float(min(1.0, max(0.0, cosines[k, best[k]]))) if sure else 0.0
                    score.append(value)
                    accepted.append(sure and (n < SURE_LETTERS or value >= floor))
            yield pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], fields=list(kinds))

    identified = frugal(run)
    identified.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # Marked as not deterministic, so that a filter on its result does not run it a second time.
    found = F.arrow_udf(identified, "lang_pred string, score double, accepted boolean").asNondeterministic()
    taken = [f"`{c}`" for c in docs.columns if c not in ("lang_pred", "score", "accepted")]
    return docs.withColumn("_lang_found", found("text")).select(*taken, "_lang_found.lang_pred", "_lang_found.score", "_lang_found.accepted")


def held_out(doc_id):
    """True where crc32 of doc_id as text leaves 2 by 4; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, per_lang: int = TRAIN_PER_LANG) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, accepted`` for every row; learns only from rows that are not held out.

    Other columns but text and lang are ignored, whatever their names. A null doc_id is not held out and teaches
    nothing. Repeated rows give repeated results. Null, empty and long texts, ties and empty tables: see ``predict``.
    """
    langs, prototypes = fit(docs.where(~held_out(F.col("doc_id"))), per_lang)
    found = predict(docs.select("doc_id", "text"), langs, prototypes)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
