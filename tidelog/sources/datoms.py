"""Transactions as datoms: rows (tx, e, a, v as text, w) with w = 1 for an assertion and -1 for a retraction."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .edn import Keyword, read_all

SCHEMA = "tx long, e long, a string, v string, w long"
Datom = tuple[int, str, object, bool] | tuple[int, str, object]


def as_text(value: object) -> str:
    """The text that a cast of the column to STRING would give."""
    if isinstance(value, bool):
        return str(value).lower()
    return value.isoformat(sep=" ") if isinstance(value, dt.datetime | dt.date) else str(value)


def datoms(spark: SparkSession, transactions: Iterable[tuple[int, Iterable[Datom]]]) -> DataFrame:
    """From ``(tx, [(e, a, v), (e, a, v, added), …])``; attributes have no colon, nulls are left out."""
    rows = [(tx, d[0], d[1], as_text(d[2]), -1 if len(d) > 3 and not d[3] else 1) for tx, items in transactions for d in items if d[2] is not None]
    return spark.createDataFrame(rows, SCHEMA)


def _rows(text: str) -> list[tuple]:
    """Datoms of the forms in a text."""
    rows: list[tuple] = []

    def walk(form: object) -> None:
        if isinstance(form, dict):
            e = form[Keyword("db/id")]
            for a, v in form.items():
                if a != "db/id" and v is not None:
                    rows.extend((1, e, str(a), as_text(x), 1) for x in (v if isinstance(v, list | frozenset) else [v]))
        elif isinstance(form, list) and len(form) == 5 and not isinstance(form[0], dict | list):
            e, a, v, tx, added = form
            rows.append((tx, e, str(a), as_text(v), 1 if added else -1))
        elif isinstance(form, list):
            for x in form:
                walk(x)

    for form in read_all(text):
        walk(form)
    return rows


def read_edn(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Entity maps ``{:db/id e, :attr v-or-many}`` and datom vectors ``[e a v tx added]`` of EDN files.

    Maps are one transaction (tx 1). A vector or set value is one datom for each item. A form may span lines, so
    a file is read whole, one file a task at a time; with ``lines`` every line holds whole forms and files of any size are split.
    """
    text = spark.read.text(path, wholetext=not lines)

    def run(batches):
        import pandas as pd

        for batch in batches:
            for value in batch["value"]:
                yield pd.DataFrame(_rows(value), columns=["tx", "e", "a", "v", "w"])

    return text.mapInPandas(run, SCHEMA)


def unpivot(df: DataFrame, entity: str, columns: dict[str, str], tx: str | None = None) -> DataFrame:
    """A wide table (JSON lines, CSV, JDBC, Parquet) as datoms: ``columns`` maps columns to attributes; nulls are absent, arrays give many."""
    def values(attr: str):
        return lambda x: F.struct(F.lit(attr).alias("a"), x.cast("string").alias("v"))

    items = []
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for column, attr in columns.items():
        items.append(F.transform(F.col(column) if isinstance(kinds[column], T.ArrayType) else F.array(F.col(column)), values(attr)))
    exploded = df.select((F.col(tx) if tx else F.lit(1)).cast("long").alias("tx"), F.col(entity).cast("long").alias("e"), F.explode(F.flatten(F.array(*[F.coalesce(i, F.array().cast("array<struct<a:string,v:string>>")) for i in items]))).alias("d"))
    return exploded.select("tx", "e", "d.a", "d.v", F.lit(1).cast("long").alias("w")).where("v is not null")


def attribute(changes: DataFrame, name: str, kind: str) -> DataFrame:
    """Changes of one attribute as (tx, e, v of ``kind``, w)."""
    return changes.where(F.col("a") == name).select("tx", "e", F.col("v").cast(kind).alias("v"), "w")


def log_range(changes: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Transactions from ``start`` up to but not including ``end``."""
    out = changes if start is None else changes.where(F.col("tx") >= start)
    return out if end is None else out.where(F.col("tx") < end)


def all_transactions(changes: DataFrame) -> DataFrame:
    return changes.select("tx").distinct().orderBy("tx")


def last_datoms(changes: DataFrame, n: int) -> DataFrame:
    """The n datoms with the highest entities, then attributes and values."""
    return changes.orderBy(F.desc("e"), F.desc("a"), F.desc("v")).limit(n)


def overwrite(current: DataFrame, new: DataFrame) -> DataFrame:
    """Changes (e, v, w) by which cardinality-one values of ``new`` (e, v) replace those of ``current`` (e, v)."""
    both = current.select("e", F.col("v").alias("old")).join(new.select("e", F.col("v").alias("new")), "e", "right").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select("e", F.inline(F.array(F.struct(F.col("old").alias("v"), F.lit(-1).cast("long").alias("w")), F.struct(F.col("new").alias("v"), F.lit(1).cast("long").alias("w"))))).where("v is not null")
