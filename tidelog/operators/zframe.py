"""Weighted relations: a DataFrame with a ``w`` BIGINT column.

A row's weight says how often it is there; a retraction is the row with a negative weight. All
operators are linear in the weights, so they serve whole relations and changes alike. A relation is
consolidated when equal rows are one and none has weight zero.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

W = "w"
#: Changes may have the time of their transaction in this column. It goes along like the weight; what is made of several rows has their latest time.
T = "_t"


class ZFrame:
    """A weighted relation. ``unit`` promises that every weight is 1, which spares some aggregates."""

    def __init__(self, df: DataFrame, unit: bool = False) -> None:
        if W not in df.columns:
            df, unit = df.withColumn(W, F.lit(1).cast("long")), True
        self.df, self.unit = df, unit

    @classmethod
    def of(cls, spark: SparkSession, rows: list[tuple], schema: str) -> ZFrame:
        """From tuples that end with their weight; ``schema`` is DDL without the weight."""
        return cls(spark.createDataFrame(rows, f"{schema}, {W} long"))

    @classmethod
    def from_changes(cls, df: DataFrame, added: str = "added") -> ZFrame:
        """A boolean column to weights 1 and -1; a null is an error when the plan runs."""
        weight = F.when(F.col(added), 1).when(~F.col(added), -1).otherwise(F.raise_error(F.lit(f"{added} is neither true nor false")).cast("int"))
        return cls(df.withColumn(W, weight.cast("long")).drop(added))

    @property
    def columns(self) -> list[str]:
        """Without the weight and the time."""
        return [c for c in self.df.columns if c not in (W, T)]

    def _time(self) -> list[str]:
        return [T] if T in self.df.columns else []

    def _cols(self) -> list[Column]:
        return [F.col(f"`{c}`") for c in [*self.columns, *self._time()]]

    # Z-set algebra

    def consolidate(self) -> ZFrame:
        """Equal rows added up, without those of weight zero; of a relation without columns one row with the total, if any."""
        return ZFrame(self.df.groupBy(*self._cols()).agg(F.sum(W).alias(W)).where(F.col(W) != 0))

    def plus(self, *others: ZFrame) -> ZFrame:
        return self.union(*others).consolidate()

    def union(self, *others: ZFrame) -> ZFrame:
        """Bag union, not consolidated."""
        return ZFrame(reduce(lambda a, b: a.unionByName(b.df), others, self.df), self.unit and all(o.unit for o in others))

    def negate(self) -> ZFrame:
        return ZFrame(self.df.withColumn(W, -F.col(W)))

    def minus(self, other: ZFrame) -> ZFrame:
        return self.plus(other.negate())

    def positive(self) -> ZFrame:
        """Consolidated, and without what has been retracted more often than asserted."""
        return ZFrame(self.consolidate().df.where(F.col(W) > 0))

    def pos_plus(self, *others: ZFrame) -> ZFrame:
        return self.union(*others).positive()

    def plus_mapped(self, other: ZFrame, change: Callable[[ZFrame], ZFrame]) -> ZFrame:
        return self.plus(change(other))

    def times(self, other: ZFrame) -> ZFrame:
        """All pairs, weights multiplied: a cartesian product, for relations without a common variable."""
        return self._paired(self.df.crossJoin(other._other()), other)

    def join(self, other: ZFrame, on: list[str]) -> ZFrame:
        """Pairs that agree in ``on``, weights multiplied; null agrees with nothing."""
        return self._paired(self.df.join(other._other(), on), other) if on else self.times(other)

    def _other(self) -> DataFrame:
        return self.df.withColumnsRenamed({W: "_w", T: "_t2"})

    def _paired(self, both: DataFrame, other: ZFrame) -> ZFrame:
        names = [F.col(f"`{c}`") for c in both.columns if c not in (W, "_w", T, "_t2")]
        times = [F.col(c) for c in (T, "_t2") if c in both.columns]
        time = [(F.greatest(*times) if len(times) > 1 else times[0]).alias(T)] if times else []
        return ZFrame(both.select(*names, *time, (F.col(W) * F.col("_w")).alias(W)), self.unit and other.unit)

    def support(self) -> ZFrame:
        """Of a relation whose weights are all 1: each row once."""
        return ZFrame(self.df.drop(W).distinct()) if self.columns else self.consolidate()

    def distinct_set(self) -> DataFrame:
        """The set of rows with positive weight, without weights."""
        return self.df.drop(W).distinct() if self.unit else self.positive().df.drop(W)

    # Selection and projection keep weights

    def where(self, condition: Column | str) -> ZFrame:
        return ZFrame(self.df.where(condition), self.unit)

    def select(self, *cols: Column | str) -> ZFrame:
        return ZFrame(self.df.select(*cols, *self._time(), W), self.unit)

    def transform(self, change: Callable[[DataFrame], DataFrame]) -> ZFrame:
        return ZFrame(change(self.df), self.unit)

    def route(self, *cases: tuple[Column | None, Callable[[ZFrame], ZFrame]]) -> ZFrame:
        """Each row goes the way of the first condition that holds (None: of all that are left); the ways are united."""
        rest, parts = F.lit(True), []
        for condition, way in cases:
            holds = F.coalesce(condition, F.lit(False)) if condition is not None else F.lit(True)
            parts.append(way(self.where(rest & holds)))
            rest = rest & ~holds
        return parts[0].union(*parts[1:])

    # Indexed Z-sets: grouping by a key

    def index(self, *keys: str) -> ZFrame:
        """Rows that have a key; those with a null in it are in no group and go. Where rows of a key meet is left to what follows, so a hot key is no task of its own."""
        return ZFrame(self.df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])), self.unit)

    def indexed_plus(self, other: ZFrame) -> ZFrame:
        return self.plus(other)

    def indexed_pos_plus(self, other: ZFrame) -> ZFrame:
        return self.pos_plus(other)

    def indexed_times(self, other: ZFrame, keys: list[str]) -> ZFrame:
        """Products within equal keys, over all of the key's rows on both sides."""
        return self.join(other, keys)

    # Aggregates: linear, so changes can be aggregated and added

    def aggregate(self, keys: list[str], sums: dict[str, Column | str] | None = None, counts: list[str] | None = None, hidden: str = "_cnt") -> DataFrame:
        """Weighted sums and counts by ``keys`` with the hidden row count; groups may have a count of zero."""
        weighted = [F.sum((F.col(c) if isinstance(c, str) else c) * F.col(W)).alias(name) for name, c in (sums or {}).items()]
        return self.df.groupBy(*[F.col(f"`{k}`") for k in [*keys, *self._time()]]).agg(*weighted, *[F.sum(W).alias(n) for n in counts or []], F.sum(W).alias(hidden))

    def group(self, keys: list[str], sums: dict[str, Column | str] | None = None, counts: list[str] | None = None) -> DataFrame:
        """As ``aggregate``, read out: a group is there while it has rows, whatever its sums are."""
        return self.aggregate(keys, sums, counts).where("_cnt <> 0").drop("_cnt")

    def total_weight(self) -> DataFrame:
        return self.df.agg(F.coalesce(F.sum(W), F.lit(0)).alias("total"))
