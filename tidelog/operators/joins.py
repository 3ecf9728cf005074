"""Joins beyond the plain grammar, in weighted form, and set operations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .zframe import W, ZFrame


def left_outer(left: ZFrame, right: ZFrame, on: list[str]) -> ZFrame:
    """Pairs, and rows of ``left`` without a partner with nulls; the partners are those of positive weight."""
    right = right.consolidate()
    joined = left.df.join(right.df.withColumnRenamed(W, "_w").where("_w > 0"), on, "left")
    names = [F.col(f"`{c}`") for c in joined.columns if c not in (W, "_w")]
    return ZFrame(joined.select(*names, (F.col(W) * F.coalesce("_w", F.lit(1))).alias(W)))


def anti(left: ZFrame, right: ZFrame, on: list[str]) -> ZFrame:
    """Rows of ``left`` whose key no row of positive weight in ``right`` has."""
    return ZFrame(left.df.join(right.select(*on).positive().df.drop(W), on, "left_anti"), left.unit)


def semi(left: ZFrame, right: ZFrame, on: list[str]) -> ZFrame:
    return ZFrame(left.df.join(right.select(*on).positive().df.drop(W), on, "left_semi"), left.unit)


def theta(left: ZFrame, right: ZFrame, condition: Column) -> ZFrame:
    """Pairs that satisfy any condition, as a filter over the product, which Spark runs as one join."""
    return left.times(right).where(condition)


def union(*parts: ZFrame) -> ZFrame:
    """Bag union: weights add."""
    return parts[0].plus(*parts[1:])


def difference(left: ZFrame, right: ZFrame) -> ZFrame:
    """Bag difference: weights subtract; may be negative."""
    return left.minus(right)


def set_union(left: ZFrame, right: ZFrame) -> ZFrame:
    return ZFrame(left.distinct_set().union(right.distinct_set()).distinct())


def set_difference(left: ZFrame, right: ZFrame) -> ZFrame:
    return ZFrame(left.distinct_set().subtract(right.distinct_set()))


def intersection(left: ZFrame, right: ZFrame) -> ZFrame:
    """Set intersection of the rows with positive weight."""
    return ZFrame(left.distinct_set().intersect(right.distinct_set()))
