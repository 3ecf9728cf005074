"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in a fixed shuffled order, are its blocks' contents. In the ideal, fluid mix every source flows at
a rate in proportion to its weight, and where one has run out the others flow faster in its place. Block j of a source is
released at the slot in which the fluid mix begins with it, and due by the end of that in which it ends; in each
slot the released block with the earliest deadline goes. So at any slot each source is less than one block away from its
exact share, however long the mix. Windows have a closed form, in whole numbers:
after ``v`` units of work a weight, the fluid mix has done ``T(v) = sum of min(blocks, weight * v)`` slots.

The driver walks the slots, at most about ``max_blocks`` of them: in a very large mix a block has more documents. Documents find
their slot by a join.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Documents of a block; blocks whose slots are one row of the plan.
BLOCK_DOCS, PERIOD = 16, 4_096
#: The driver plans about so many blocks at most (8 bytes each), or as many as there are sources. Beyond that blocks are larger.
MAX_BLOCKS = 1_000_000
#: Target weights where none are given: the size of a source to this power.
TEMPERATURE = 0.5
#: Rows of one source that one task numbers.
BUCKET_ROWS = 1_000
#: What is known of so many sources is 8 MB at most and is broadcast; of more it is joined as Spark chooses.
MAX_BROADCAST_SOURCES = 100_000


def exact_shares(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportion of positive weights."""
    exact = [Fraction(w) for w in weights]
    scale = lcm(*(e.denominator for e in exact))
    return [int(e * scale) for e in exact]


def schedule(blocks: list[int], weights: list[float]) -> Iterator[int]:
    """Source of each slot, until all blocks are placed. Of equal deadlines the first source's goes first."""
    active = [s for s in range(len(blocks)) if blocks[s]]
    shares = dict(zip(active, exact_shares([weights[s] for s in active]), strict=True))
    # Sources in the order in which the fluid mix runs out of them; slots and weight that the first ones make up.
    ends = sorted(active, key=lambda s: Fraction(blocks[s], shares[s]))
    limits = [blocks[s] / shares[s] for s in ends]
    gone, rate = [0], [sum(shares.values())]
    for s in ends:
        gone.append(gone[-1] + blocks[s])
        rate.append(rate[-1] - shares[s])

    def begun(s: int, j: int) -> int:
        """Slots that the fluid mix has done when it begins with block j of s, times the share of s."""
        k = min(bisect_right(limits, j / shares[s]), len(ends))
        while k and blocks[ends[k - 1]] * shares[s] > j * shares[ends[k - 1]]:
            k -= 1
        while k < len(ends) and blocks[ends[k]] * shares[s] <= j * shares[ends[k]]:
            k += 1
        return gone[k] * shares[s] + j * rate[k]

    waiting = [(0, s) for s in active]
    ready: list[tuple[int, int]] = []
    done = dict.fromkeys(active, 0)
    following = {s: begun(s, 1) for s in active}
    for slot in range(gone[-1]):
        while waiting and waiting[0][0] <= slot:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-following[s] // shares[s]), s))
        s = heapq.heappop(ready)[1]
        yield s
        done[s] += 1
        if done[s] < blocks[s]:
            heapq.heappush(waiting, (following[s] // shares[s], s))
            following[s] = begun(s, done[s] + 1)


def plan(blocks: list[int], weights: list[float], period: int = PERIOD) -> list[tuple[int, int, array]]:
    """Rows (source, group, slots): the slots of those blocks of a source that agree in ``block div period``."""
    rows: dict[tuple[int, int], array] = {}
    used = [0] * len(blocks)
    for slot, s in enumerate(schedule(blocks, weights)):
        if (key := (s, used[s] // period)) not in rows:
            rows[key] = array("q")
        rows[key].append(slot)
        used[s] += 1
    return [(s, group, slots) for (s, group), slots in rows.items()]


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_docs: int = BLOCK_DOCS, period: int = PERIOD, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """All rows and columns of ``docs`` with mix_block, mix_slot and mix_pos (ascending in training order).

    mix_block counts within the source, mix_slot over all; mix_pos = mix_slot * (documents of a block) + place in
    the block, unique and without gaps except after a source's last, shorter block. ``weights``
    maps sources to positive weights; a source it lacks gets the mean. The order within a source is that of a hash of the
    row and then of its columns, so only rows that are equal in all columns have no order between them. A null source is a source of
    its own. Null doc_ids, texts and repeated rows each get a place; an empty table gives an empty result. Texts are not looked
    into, whatever their length. Existing columns with these names are replaced. Sources are collected: one row each.
    """
    spark = docs.sparkSession
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c not in ("mix_block", "mix_slot", "mix_pos")])
    kinds = dict(docs.dtypes)
    own = [f"`{c}`" for c in docs.columns if not kinds[c].startswith(("map", "variant"))]
    sizes = sorted(docs.groupBy("source").agg(F.count("*").alias("n")).collect(), key=lambda r: (r[0] is not None, r[0] or ""))
    block_docs = max(block_docs, -(-sum(r[1] for r in sizes) // max_blocks))
    given = [(weights or {}).get(r[0]) for r in sizes] if weights else [r[1] ** TEMPERATURE for r in sizes]
    known = [w for w in given if w]
    chosen = [w or (sum(known) / len(known) if known else 1.0) for w in given]
    # A source's key is never null.
    names = ["" if r[0] is None else f"={r[0]}" for r in sizes]
    rows = plan([-(-r[1] // block_docs) for r in sizes], chosen, period)
    slots = spark.createDataFrame(pa.table({"_mix_key": pa.array([names[s] for s, _, _ in rows], pa.string()), "_mix_group": pa.array([g for _, g, _ in rows], pa.int64()), "_mix_slots": pa.array([x for _, _, x in rows], pa.list_(pa.int64()))}))
    buckets = spark.createDataFrame(pa.table({"_mix_key": pa.array(names, pa.string()), "_mix_buckets": pa.array([-(-r[1] // BUCKET_ROWS) for r in sizes], pa.int64())}))
    small = F.broadcast if len(sizes) <= MAX_BROADCAST_SOURCES else (lambda df: df)

    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_mix_key")
    placed = docs.select("*", key, F.xxhash64(*own).alias("_mix_hash")).join(small(buckets), "_mix_key").withColumn("_mix_bucket", F.expr("pmod(_mix_hash, _mix_buckets)")).drop("_mix_buckets")
    counts = placed.groupBy("_mix_key", "_mix_bucket").agg(F.count("*").alias("_mix_n"))
    before = Window.partitionBy("_mix_key").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_mix_key", "_mix_bucket", F.coalesce(F.sum("_mix_n").over(before), F.lit(0)).alias("_mix_offset"))
    inside = Window.partitionBy("_mix_key", "_mix_bucket").orderBy("_mix_hash", *own)
    ranked = placed.withColumn("_mix_n", F.row_number().over(inside)).join(offsets, ["_mix_key", "_mix_bucket"])
    ranked = ranked.withColumn("_mix_rank", F.expr("_mix_offset + _mix_n - 1")).withColumn("mix_block", F.expr(f"_mix_rank div {block_docs}"))
    met = ranked.withColumn("_mix_group", F.expr(f"mix_block div {period}")).join(small(slots), ["_mix_key", "_mix_group"])
    met = met.withColumn("mix_slot", F.expr(f"element_at(_mix_slots, cast(mix_block % {period} + 1 as int))"))
    met = met.withColumn("mix_pos", F.expr(f"mix_slot * {block_docs} + _mix_rank % {block_docs}"))
    return met.select(*[f"`{c}`" for c in docs.columns], "mix_block", "mix_slot", "mix_pos")
