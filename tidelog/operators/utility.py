"""Small relational helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import delete_at_exit, shared_dir


#: Rows that one task sorts and numbers.
ROWS_A_TASK = 1_000_000


def numbered(df: DataFrame, *order_by: str, name: str = "n", rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """``df`` with a long column: 0, 1, … in the order of ``order_by``, nulls first; ties are numbered as they come.

    A range-partitioned sort is written to the shared folder, each row with its place in its part; the parts' sizes, one row
    for each ``rows_a_task`` rows, give the rest. So the parts grow in number with the rows, and no task sees all of them.
    """
    spark = df.sparkSession
    path = shared_dir(spark, "numbered")
    delete_at_exit(spark, path)
    parts = max(1, -(-df.count() // rows_a_task))
    placed = df.repartitionByRange(parts, *order_by).sortWithinPartitions(*order_by).withColumn("_at", F.monotonically_increasing_id())
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path).withColumn("_part", F.shiftright("_at", 33))
    sizes = sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect())
    before, offsets = 0, []
    for part, size in sizes:
        offsets.append((part, before))
        before += size
    offsets = spark.createDataFrame(offsets, "_part long, _before long")
    return placed.join(offsets, "_part").withColumn(name, F.expr("_before + (_at & 8589934591)")).drop("_part", "_at", "_before")


def keep_every_nth(df: DataFrame, n: int, order_by: str) -> DataFrame:
    """Rows 0, n, 2n, … in the order of the unique column ``order_by``."""
    return numbered(df, order_by, name="_n").where(F.col("_n") % n == 0).drop("_n")


def take_last(df: DataFrame, n: int, order_by: str) -> DataFrame:
    """The last ``n`` rows by ``order_by``: each task keeps n."""
    return df.orderBy(F.desc(order_by)).limit(n)


def group_and_map(df: DataFrame, keys: list[str], value: Column | str, name: str = "values") -> DataFrame:
    """Mapped values of each group as a sorted array."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(name))


def map_filter_values(df: DataFrame, column: str, change: Callable[[Column], Column], keep: Callable[[Column], Column]) -> DataFrame:
    """Change a column, then keep the rows whose new value passes."""
    return df.withColumn(column, change(F.col(column))).where(keep(F.col(column)))


def map_when(df: DataFrame, condition: Column, column: str, change: Callable[[Column], Column]) -> DataFrame:
    return df.withColumn(column, F.when(condition, change(F.col(column))).otherwise(F.col(column)))


def cat_when(df: DataFrame, condition: Column, column: str, items: Column) -> DataFrame:
    """Rows that pass are replaced by one for each of ``items``; the others stay."""
    return df.withColumn(column, F.explode(F.when(condition, items).otherwise(F.array(F.col(column)))))


def key_intersection(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).distinct().join(right.select(key), key, "left_semi")
