"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into LZ78 phrases: each is the shortest run of characters not yet in the
dictionary. The set of its phrases is hashed and the smallest hashes are the signature. Two
signatures give an estimate of the Jaccard likeness of the phrase sets, which follows how well one
text compresses with the other's dictionary. Sets smaller than the signature are compared exactly.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .text import frugal

SIZE = 128
#: Rows of a range of doc_ids that one task walks through.
ROWS_PER_RANGE = 4_000
_R = 0x9E3779B97F4A7C15 | 1
_R_INVERSE = pow(_R, -1, 2**64)


class _Powers:
    """Powers of the hash base and of its inverse, modulo 2^64, as far as the longest text so far needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            step = lambda base: np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, dtype=np.uint64)], dtype=np.uint64)
            self.up, self.down = step(_R), step(_R_INVERSE)
        return self.up, self.down


_powers = _Powers()


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _parse(text: str, known: set[str], ends: list[int]) -> str:
    """LZ78: add phrases of ``text`` to ``known`` and the ends of new ones to ``ends``; the open rest is returned."""
    phrase, at, add, note = "", 0, known.add, ends.append
    for at, c in enumerate(text, 1):  # noqa: B007
        phrase += c
        if phrase not in known:
            add(phrase)
            note(at)
            phrase = ""
    return phrase


def _hashes(text: str, ends: list[int]) -> np.ndarray:
    """32-bit hashes of the phrases that end at ``ends`` and fill the text from its start; equal for equal phrases anywhere."""
    if not ends:
        return np.empty(0, dtype=np.uint32)
    stop = np.array(ends, dtype=np.int64)
    start = np.r_[0, stop[:-1]]
    points = np.frombuffer(text[: ends[-1]].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    up, down = _powers.get(len(points) + 1)
    sums = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum((points + np.uint64(1)) * up[: len(points)], out=sums[1:])
    return (_mixed((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)


class Parsed:
    """A text's phrase signature; remembers the parse at half, from which an edited text goes on."""

    def __init__(self, text: str, size: int = SIZE) -> None:
        self.text, self.size, self.keep = text, size, len(text) - len(text) // 2
        known: set[str] = set()
        ends: list[int] = []
        self.open = _parse(text[: self.keep], known, ends)
        self.half_known, self.half = set(known), _hashes(text, ends)
        self.signature = self._goes_on(known, text[self.keep :])

    def _goes_on(self, known: set[str], rest: str) -> np.ndarray:
        """The signature where ``rest`` follows the first half: its parse takes up the phrase that is open there."""
        ends: list[int] = []
        rest = self.open + rest
        _parse(rest, known, ends)  # a last phrase that stays open is in the set already
        return np.unique(np.concatenate([self.half, _hashes(rest, ends)]))[: self.size]

    def edited(self, following: str) -> tuple[str, np.ndarray]:
        """The text whose last half is replaced by as much of ``following``, and its signature."""
        rest = following[: len(self.text) // 2]
        return self.text[: self.keep] + rest, self._goes_on(self.half_known, rest)


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated Jaccard likeness of two phrase sets; two empty sets are alike."""
    both = np.concatenate([a, b])
    if not len(both):
        return 1.0
    both.sort()
    twice = np.append(both[1:] == both[:-1], False)
    first = np.append(True, ~twice[:-1])
    return float(twice[first][:size].mean())


def _string(signature: np.ndarray) -> str:
    return base64.b64encode(signature.astype(">u4").tobytes()).decode()


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk(batches: Iterator[pa.RecordBatch], kinds: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    before: tuple[int, int | None, Parsed] | None = None
    for batch in batches:
        out: dict[str, list] = {k: [] for k in kinds.names}
        for part, ahead, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("_part", "_ahead", "doc_id", "text")), strict=True):
            if ahead and (before is None or before[0] != part):
                continue  # a further copy of the row after the range
            here = Parsed(text or "", size)
            if before is not None and before[0] == part:
                text, signature = before[2].edited(here.text)
                row = (before[1], len(before[2].text), hashlib.sha256(text.encode()).hexdigest(), _string(before[2].signature), _string(signature), likeness(before[2].signature, signature, size), likeness(before[2].signature, here.signature, size))
                for k, v in zip(kinds.names, row, strict=True):
                    out[k].append(v)
            before = None if ahead else (part, doc_id, here)
        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in kinds], names=kinds.names)


def fingerprint(docs: DataFrame, size: int = SIZE, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text; others are ignored), of its edited text, and their likeness.

    Rows are ordered by doc_id, null first, then by text; the next row of the last is the first. Null
    texts are empty. Repeated rows are next to each other. Texts are cut into ranges of about
    ``rows_per_range`` rows by doc_id and shuffled once; each range also gets the first rows of the
    one after it, so a task only walks through its range and keeps one text.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("_key")
    keys = docs.select(key)
    n = keys.count()
    if not n:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    wanted = min(max(1, -(-n // rows_per_range)), 20_000)
    cuts = sorted(set(keys.selectExpr("double(_key) as k").approxQuantile("k", [i / wanted for i in range(1, wanted)], 0.2 / wanted))) if wanted > 1 else []
    bounds = np.array(cuts, dtype=np.float64)

    @F.pandas_udf("int")
    def part_of(k):
        return pd.Series(np.searchsorted(bounds, k.to_numpy(dtype=np.float64), side="right").astype(np.int32))

    # First key of each range that has rows: as many rows as ranges.
    firsts = sorted(keys.select(part_of("_key").alias("p"), "_key").groupBy("p").agg(F.min("_key").alias("k")).collect())
    starts = np.array([r.k for r in firsts], dtype=np.int64)

    @F.pandas_udf("array<int>")
    def parts_of(k):
        """Range of a key; and that of the range before it (the last for the first) where the key starts a range."""
        k = k.to_numpy(dtype=np.int64)
        at = np.searchsorted(starts, k, side="right") - 1
        return pd.Series([[int(i), int((i - 1) % len(starts))] if s else [int(i)] for i, s in zip(at, starts[at] == k, strict=True)])

    kinds = to_arrow_schema(StructType.fromDDL(SCHEMA))
    spread = docs.select("doc_id", "text", key).select("doc_id", "text", "_key", F.posexplode(parts_of("_key")).alias("_ahead", "_part"))
    spread = spread.repartitionById(len(starts), "_part").sortWithinPartitions("_part", "_ahead", "_key", "text")
    return spread.select("_part", "_ahead", "doc_id", "text").mapInArrow(frugal(lambda batches: _walk(batches, kinds, size)), SCHEMA)
