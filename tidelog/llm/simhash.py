"""SimHash near-duplicates with pigeonring filtering.

A fingerprint's 64 bits are ``m`` segments in a ring. With at most ``d`` differing bits, ``m - d``
segments are equal, so fingerprints that share a key (a choice of m - d segments and their bits) are
candidates; m grows with the number of fingerprints, which keeps buckets small at every size. Of a
candidate pair the pigeonring filter requires a chain: some segment from which on, for every length
l, the next l segments together differ in at most l * d / m bits. Only what passes it gets the full
Hamming check. A bucket gives the edges of a spanning forest of its links, never all its pairs; a
very large bucket is cut into blocks, and pairs of blocks are compared in tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .storage import remove, written
from .text import LOWER, frugal, map_rows, raw_texts

SHINGLE, MAX_DISTANCE, SEED = 4, 4, 42
#: Fingerprints in a bucket that one task compares at once; larger buckets are cut into blocks of this size.
BLOCK = 8_192


def fingerprint(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of lower-cased words; each shingle counts as often as it occurs. No words: zero."""
    import xxhash

    words = raw.translate(LOWER).split() if raw else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    end = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.r_[0, end[:-1] + 1][: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, end[shingle - 1 :].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[lo : lo + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def segments(m: int) -> list[int]:
    """Bit masks of ``m`` segments of 64 bits, as even as can be."""
    edges = [64 * i // m for i in range(m + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]


def pigeonring(differing: np.ndarray, masks: np.ndarray, d: int) -> np.ndarray:
    """Which XORs of pairs have a chain of segments whose sums of differing bits stay within their share of ``d``."""
    m = len(masks)
    bits = np.bitwise_count(differing[:, None] & masks[None, :]).astype(np.int64)
    ring = np.concatenate([bits, bits], axis=1)
    sums = np.zeros((len(differing), m), dtype=np.int64)
    viable = np.ones((len(differing), m), dtype=bool)
    for length in range(1, m + 1):
        sums += ring[:, length - 1 : length - 1 + m]
        viable &= sums * m <= length * d
    return viable.any(axis=1)


def forest(left: np.ndarray, right: np.ndarray | None, masks: np.ndarray, d: int) -> list[tuple[int, int]]:
    """Edges that join what links within ``left``, or between ``left`` and ``right``, as all links would."""
    rest = [left, right if right is not None else left[:0]]
    edges: list[tuple[int, int]] = []
    while len(rest[0]):
        queue = [(0, rest[0][0])]
        rest[0] = rest[0][1:]
        while queue:
            side, x = queue.pop()
            other = 1 - side if right is not None else 0
            pool = rest[other]
            if not len(pool):
                continue
            differing = pool ^ x
            near = np.flatnonzero(pigeonring(differing, masks, d))
            near = near[np.bitwise_count(differing[near]) <= d]
            if len(near):
                found = pool[near]
                edges += [(int(x), int(y)) for y in found]
                queue += [(other, y) for y in found]
                rest[other] = np.delete(pool, near)
    return edges


def _forests(rows: DataFrame, masks: np.ndarray, d: int) -> DataFrame:
    """Rows (c, k, i, j, side, fp) sorted by c, k, i, j: one forest for each of these groups, spread over batches as may be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def solved(group: np.ndarray) -> list[tuple[int, int]]:
            side = group[:, 4]
            fp = group[:, 5].view(np.uint64)
            return forest(fp[side == 0], fp[side == 1] if (side == 1).any() or group[0, 2] != group[0, 3] else None, masks, d)

        def out(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

        for batch in batches:
            table = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("c", "k", "i", "j", "side", "fp")], axis=1)
            if not len(table):
                continue
            cuts = np.flatnonzero((table[1:, :4] != table[:-1, :4]).any(axis=1)) + 1
            edges: list[tuple[int, int]] = []
            for part in np.split(table, cuts):
                if kept and (kept[-1][-1, :4] != part[0, :4]).any():
                    edges += solved(np.concatenate(kept))
                    kept = []
                kept.append(part)
            yield out(edges)
        if kept:
            yield out(solved(np.concatenate(kept)))

    return rows.mapInArrow(frugal(run), "a long, b long")


def links(prints: DataFrame, d: int = MAX_DISTANCE, block: int = BLOCK, m: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``a, b``: edges between the distinct values of ``prints.fp`` that connect whatever ``d`` or fewer bits link.

    6 segments give 15 keys of 21 bits, 7 give 35 of 27, 8 give 70 of 32: so many that a key of random
    fingerprints is shared by few. All choices give the same components. Also the table that the edges are read with.
    """
    n = prints.count()
    m = m or d + (2 if n <= 2**22 else 3 if n <= 2**28 else 4)
    masks = segments(m)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    choices = [signed(sum(masks[i] for i in chosen)) for chosen in combinations(range(m), m - d)]
    keys = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(x)) for x in choices])).alias("c", "k"))
    # Written, so that the join below has plain shuffles and a large bucket's rows can be split.
    shared = written(keys.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    rows = keys.join(shared, ["c", "k"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("long"))
    # A bucket of one block is the group (0, 0); of a larger one, block x meets every block, and itself.
    rows = rows.withColumn("x", F.when(F.col("blocks") > 1, F.expr("pmod(xxhash64(fp), blocks)")).otherwise(F.lit(0)))
    rows = rows.withColumn("y", F.explode(F.expr("sequence(0L, blocks - 1)")))
    rows = rows.select("c", "k", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), F.expr("if(x > y, 1, 0)").alias("side"), "fp")
    rows = rows.repartition("c", "k", "i", "j").sortWithinPartitions("c", "k", "i", "j", "side", "fp")
    return _forests(rows, np.array(masks, dtype=np.uint64), d).distinct(), shared


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` for every row; fp is the fingerprint as a signed long."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            prints = [fingerprint(raw, shingle) for raw in raw_texts(batch)]
            return {"doc_id": batch.column("doc_id").to_pylist(), "fp": np.array(prints, dtype=np.uint64).view(np.int64)}

        return step

    return map_rows(docs.select("doc_id", "text"), "doc_id long, fp long", make)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, d: int = MAX_DISTANCE, block: int = BLOCK, m: int | None = None) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs`` (doc_id, text; others are ignored).

    component_id is the smallest doc_id among all rows that links reach. Null and empty texts have
    fingerprint zero and link like any other. A null doc_id takes part, but gives no id to a component;
    a component of such rows alone has a null one. Repeated rows are copies: they share a
    fingerprint, and only distinct fingerprints are compared. Candidates have no cap. Texts are read whole, however long. An
    empty table gives an empty result.
    """
    prints = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    edges, buckets = links(distinct.select("fp"), d, block, m)
    roots = components(edges)
    remove(buckets)
    # Only fingerprints that link to another one need a lookup; the root of the rest is the fingerprint itself.
    least = written(roots.join(distinct, roots["node"] == distinct["fp"]).groupBy("root").agg(F.min("first").alias("least")), "roots")
    linked = roots.join(least, "root").select(F.col("node").alias("fp"), "least")
    ids = written(distinct.join(linked, "fp", "left").select("fp", F.when(F.col("least").isNotNull(), F.col("least")).otherwise(F.col("first")).alias("component_id")), "components")
    for table in (distinct, least, roots):
        remove(table)
    return prints.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, that with the smallest doc_id; its columns and their order stay.

    Of rows that share that doc_id one is kept; rows with a null doc_id stay, as nothing tells them apart.
    """
    found = near_duplicates(docs.select("doc_id", "text"))
    leaders = found.where("doc_id = component_id").select(F.col("doc_id").alias("_leader"))
    # Rows per leading doc_id: more than one only where doc_ids repeat.
    counted = written(leaders.groupBy("_leader").agg(F.count("*").alias("_copies")), "leaders")
    remove(found)
    kept = docs.join(counted, docs["doc_id"] == counted["_leader"]).select(*[docs[c] for c in docs.columns], "_copies")
    if counted.where("_copies > 1").limit(1).count():
        kept = kept.where("_copies = 1").unionByName(kept.where("_copies > 1").dropDuplicates(["doc_id"]))
    return kept.drop("_copies").unionByName(docs.where("doc_id is null"))
