"""Files and databases as datoms, and datoms as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .datoms import SCHEMA, unpivot


def read_table(spark: SparkSession, path: str, format: str, schema: str, entity: str, columns: dict[str, str], tx: str | None = None, **options: str) -> DataFrame:
    """CSV, JSON lines, ORC, Parquet or text of a stated schema as datoms; nothing is inferred, so one pass reads it."""
    return unpivot(spark.read.format(format).schema(schema).options(**options).load(path), entity, columns, tx)


def read_jdbc(spark: SparkSession, url: str, table: str, entity: str, columns: dict[str, str], bounds: tuple[int, int, int] | None = None, **properties: str) -> DataFrame:
    """A database table as datoms; ``bounds`` (lowest, highest entity, parts) reads it in parallel ranges of the entity column."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **properties)
    if bounds:
        low, high, parts = bounds
        reader = reader.options(partitionColumn=entity, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return unpivot(reader.load(), entity, columns)


def write_datoms(datoms: DataFrame, path: str, mode: str = "append") -> None:
    """A datom log as Parquet, a folder for each attribute and transaction, so reads of some of them skip the rest.

    An attribute's rows of a transaction are spread over as many files as adaptive execution finds fit.
    """
    rows = datoms.select("tx", "e", "a", "v", "w").withColumns({"attr": F.col("a"), "t": F.col("tx")})
    rows.hint("rebalance", F.col("attr"), F.col("t")).write.mode(mode).partitionBy("attr", "t").parquet(path)


def read_datoms(spark: SparkSession, path: str, attributes: list[str] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """What ``write_datoms`` wrote, or some attributes and the transactions from ``start`` up to ``end`` of it."""
    df = spark.read.schema(f"{SCHEMA}, attr string, t long").parquet(path)
    if attributes is not None:
        df = df.where(F.col("attr").isin(attributes))
    if start is not None:
        df = df.where(F.col("t") >= start)
    if end is not None:
        df = df.where(F.col("t") < end)
    return df.drop("attr", "t")
