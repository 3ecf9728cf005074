"""Maintained query results.

A View keeps, as Parquet in a shared folder, a change log for each attribute and one for its result. Every row has
the time of its transaction. Changes are applied in batches of one transaction or many, and the change of the result
comes from theirs alone

    d(R1 ⋈ … ⋈ Rn) = Σ i  (R1 … Ri-1 after) ⋈ dRi ⋈ (Ri+1 … Rn before)

where a row made of several has the latest of their times. So a whole log is one join, whatever the number of its
transactions, and the result at any time is a sum of weights: history and as-of reads need no copies, and order within a
batch is immaterial. Weights are only cut off at zero when a result is read.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import UnsupportedQueryError
from ..operators.zframe import T, W, ZFrame
from ..plans.ast import Attr, Pattern, Predicate, Query, Var
from ..plans.compiler import aggregate_delta, compile_query, read_out
from ..plans.parser import parse_query
from ..sources.catalog import AttributeCatalog
from ..sources.datoms import SCHEMA, Datom, datoms
from ..storage import delete, names, read_text, shared_dir, write_text


#: A task of a batch adds up so many changes, on average.
ROWS_PER_TASK = 2**18


class UnknownTransactionError(LookupError):
    """An as-of time that is not the time of any transaction."""


@dataclass(frozen=True)
class _Batch:
    times: list[int]
    streams: list[str]
    touched: list[int]


class View:
    """The result of one query over datoms, kept up to date.

    ``schema`` maps attributes (without colon) to Spark types. ``path`` may be that of an earlier View of the same query, which
    then goes on. ``keep_history`` allows as-of reads. ``validate`` refuses retractions of what is not there.
    """

    def __init__(self, spark: SparkSession, query: str | list | Query, schema: dict[str, str], path: str | None = None, keep_history: bool = True, validate: bool = False) -> None:
        self.spark, self.schema = spark, dict(schema)
        self.query = query if isinstance(query, Query) else parse_query(query)
        self.patterns = [c for c in self.query.where if isinstance(c, Pattern)]
        if any(not isinstance(c, Pattern | Predicate) for c in self.query.where) or any(a.fn not in ("sum", "count") for a in self.query.aggregates) or self.query.inputs or self.query.with_vars:
            raise UnsupportedQueryError("view", self.query, "a maintained query is linear: patterns, predicates, sum and count")
        if any(not isinstance(p.attribute, Attr) for p in self.patterns):
            raise UnsupportedQueryError("view", self.query, "a maintained query names its attributes")
        self.path, self.keep_history, self.validate = path or shared_dir(spark, "view"), keep_history, validate
        self.used = sorted({p.attribute.name for p in self.patterns})
        for name in self.used:
            if name not in self.schema:
                raise UnsupportedQueryError("schema", name, "an attribute without a type")
        self.stats: dict[str, object] = {"transactions": 0}
        self._markers: dict[str, _Batch] = {}
        empty = {n: self.spark.createDataFrame([], self._ddl(n)) for n in self.used}
        self._result_schema = self._delta(empty, empty).schema

    # State: <path>/g<generation>/log/<batch>/i=<attribute> and …/result/<batch>. A file …/done/<batch>, with the batch's transaction
    # times, stream batches and attributes, ends a batch. A generation holds once <path>/published/<generation> is there, the first one from the start.

    def _ddl(self, name: str) -> str:
        return f"e long, v {self.schema[name]}, w long, {T} long"

    def _generation(self) -> int:
        return max((int(n) for n in names(self.spark, f"{self.path}/published") if n.isdigit()), default=0)

    def _root(self) -> str:
        return f"{self.path}/g{self._generation()}"

    def _done(self, root: str) -> dict[str, _Batch]:
        """Applied batches by their first time. Each marker is read once."""
        out = {}
        for batch in names(self.spark, f"{root}/done"):
            if not batch.startswith("_"):
                if (path := f"{root}/done/{batch}") not in self._markers:
                    times, streams, touched = (line.split(",") if line else [] for line in read_text(self.spark, path).split("\n"))
                    self._markers[path] = _Batch([int(t) for t in times], streams, [int(i) for i in touched])
                out[batch] = self._markers[path]
        return out

    def _rows(self, root: str, name: str, batches: Iterable[str]) -> DataFrame:
        """(e, v, w, time) of an attribute; values are stored as text."""
        if not (paths := [f"{root}/log/{b}/i={self.used.index(name)}" for b in batches]):
            return self.spark.createDataFrame([], self._ddl(name))
        rows = self.spark.read.schema(f"e long, v string, w long, {T} long").parquet(*paths)
        return rows.select("e", F.col("v").cast(self.schema[name]).alias("v"), W, T).where("v is not null")

    def _log(self, root: str, name: str, done: dict[str, _Batch]) -> DataFrame:
        return self._rows(root, name, [b for b, x in sorted(done.items()) if self.used.index(name) in x.touched])

    def _results(self, root: str, done: dict[str, _Batch], upto: int | None = None) -> DataFrame:
        """The result's rows, up to a time: batches that began later are not read."""
        paths = [f"{root}/result/{b}" for b, x in sorted(done.items()) if x.touched and (upto is None or min(x.times) <= upto)]
        if not paths:
            return self.spark.createDataFrame([], self._result_schema)
        rows = self.spark.read.schema(self._result_schema).parquet(*paths)
        return rows if upto is None else rows.where(F.col(T) <= upto)

    def attribute(self, name: str) -> DataFrame:
        """(e, v, w, time) of an attribute from all transactions, not consolidated."""
        root = self._root()
        return self._log(root, name, self._done(root))

    def history_index(self) -> list[int]:
        """Times of all applied transactions, ascending."""
        return sorted({t for x in self._done(self._root()).values() for t in x.times})

    def _delta(self, changes: dict[str, DataFrame], before: dict[str, DataFrame]) -> DataFrame:
        """The change of the result that ``changes`` of attributes make, given all their rows ``before``."""
        parts: list[DataFrame] = []
        for k, p in enumerate(self.patterns):
            if p.attribute.name not in changes:
                continue

            def state(i: int, q: Pattern, k: int = k) -> ZFrame:
                name = q.attribute.name
                if i == k:
                    df = changes[name]
                else:
                    df = before[name].unionByName(changes[name]) if i < k and name in changes else before[name]
                return ZFrame(df.select("e", F.col("v").alias("v0"), T, W))

            frame = compile_query(self.query, AttributeCatalog(), override=state)
            parts.append(aggregate_delta(self.query, frame) if self.query.aggregates else frame.df)
        total = parts[0]
        for part in parts[1:]:
            total = total.unionByName(part)
        return self._merged(total)

    def _merged(self, rows: DataFrame) -> DataFrame:
        """Rows of several changes added up, by time where they have one; what cancels out goes."""
        if not self.query.aggregates:
            return ZFrame(rows).consolidate().df
        keys = [*dict.fromkeys(self.query.plain), *([T] if T in rows.columns else [])]
        values = [c for c in rows.columns if c not in keys]
        summed = rows.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*[F.sum(F.col(f"`{v}`")).alias(v) for v in values])
        return summed.where(" or ".join(f"`{v}` <> 0" for v in values))

    def apply(self, changes: DataFrame | Iterable[Datom], tx: int | None = None) -> dict[str, object]:
        """Apply one transaction; ``changes`` are datoms (e, a, v, added) or a DataFrame (e, a, v as text, w).

        A transaction that was applied before is skipped, so a repeated delivery does no harm. Returns its statistics.
        """
        known = self.history_index()
        tx = (known[-1] + 1 if known else 1) if tx is None else tx
        if tx in known:
            return {"tx": tx, "skipped": True}
        if known and tx < known[-1]:
            raise ValueError(f"transaction {tx} comes after {known[-1]}")
        if not isinstance(changes, DataFrame):
            changes = datoms(self.spark, [(tx, changes)])
        return self._applied(changes.withColumn("tx", F.lit(tx).cast("long")), f"t{tx}", [tx], None, changes.count())

    def replay(self, changes: DataFrame, start: int | None = None, end: int | None = None) -> dict[str, object]:
        """Apply all transactions of a datom log (tx, e, a, v, w) from ``start`` up to ``end``, as one batch; applied ones are skipped."""
        known = self.history_index()
        wanted = changes if start is None else changes.where(F.col("tx") >= start)
        wanted = wanted if end is None else wanted.where(F.col("tx") < end)
        sizes = {r.tx: r.n for r in wanted.groupBy("tx").agg(F.count("*").alias("n")).collect()}
        times = sorted(set(sizes) - set(known))
        if not times:
            return {"tx": known[-1] if known else None, "skipped": True}
        if known and times[0] < known[-1]:
            raise ValueError(f"transaction {times[0]} comes after {known[-1]}")
        return self._applied(wanted.where(F.col("tx") > known[-1]) if known else wanted, f"t{times[-1]}", times, None, sum(sizes.values()))

    def apply_batch(self, changes: DataFrame, batch: int) -> dict[str, object]:
        """Apply a stream's micro-batch: rows with a ``tx`` keep it, the others are transaction ``batch + 1``.

        A batch that was applied before is skipped. A transaction may be spread over batches, and late rows amend history at their time.
        """
        if any(f"s{batch}" in x.streams for x in self._done(self._root()).values()):
            return {"tx": None, "skipped": True}
        own = F.lit(batch + 1).cast("long")
        changes = changes.withColumn("tx", F.coalesce(F.col("tx").cast("long"), own) if "tx" in changes.columns else own).persist()
        try:
            sizes = {r.tx: r.n for r in changes.groupBy("tx").agg(F.count("*").alias("n")).collect()}
            return self._applied(changes, f"s{batch}", sorted(sizes) or [batch + 1], batch, sum(sizes.values()))
        finally:
            changes.unpersist()

    def _applied(self, changes: DataFrame, batch: str, times: list[int], stream: int | None, size: int) -> dict[str, object]:
        """``size``: the number of changes. Changes are mostly distinct, so they meet before they are added up, in as many tasks as there are many."""
        began, root = time.time(), self._root()
        done = self._done(root)
        # One pass writes the changes by attribute; what is left of a batch that did not end is overwritten.
        rows = changes.where(F.col("a").isin(self.used) & F.col("v").isNotNull()).repartition(size // ROWS_PER_TASK + 1, "e", "v").groupBy("a", "e", "v", "tx").agg(F.sum("w").alias(W)).where(f"{W} <> 0")
        position = F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(self.used) for x in (n, i)]), F.col("a"))
        rows.select("e", "v", W, F.col("tx").alias(T), position.alias("i")).write.mode("overwrite").partitionBy("i").parquet(f"{root}/log/{batch}")
        there = names(self.spark, f"{root}/log/{batch}")
        touched = {n: self._rows(root, n, [batch]) for i, n in enumerate(self.used) if f"i={i}" in there}
        before = {n: self._log(root, n, done) for n in self.used} if touched else {}
        if self.validate:
            for name, part in touched.items():
                self._check(name, before[name].unionByName(part), f"{root}/log/{batch}")
        if touched:
            self._delta(touched, before).write.mode("overwrite").parquet(f"{root}/result/{batch}")
        marks = times, [] if stream is None else [f"s{stream}"], [self.used.index(n) for n in touched]
        write_text(self.spark, f"{root}/done/{batch}", "\n".join(",".join(map(str, m)) for m in marks))
        if not self.keep_history and len(done) >= 16:
            self.compact()
        self.stats = {"transactions": int(self.stats["transactions"]) + len(times), "last_tx": times[-1], "last_ms": round(1000 * (time.time() - began)), "attributes": sorted(touched)}
        return {"tx": times[-1], "skipped": False, "ms": self.stats["last_ms"]}

    def _check(self, name: str, rows: DataFrame, batch: str) -> None:
        """Refuse a batch after any of whose transactions some (e, v) is there less than not at all."""
        upto = Window.partitionBy("e", "v").orderBy(T)
        if rows.withColumn("_sum", F.sum(W).over(upto)).where("_sum < 0").limit(1).count():
            delete(self.spark, batch)
            raise ValueError(f"{batch} retracts what :{name} does not hold")

    def changes(self, upto: int | None = None) -> DataFrame:
        """The result's change log as rows with weights (or sums) and times, not added up."""
        root = self._root()
        return self._results(root, self._done(root), upto)

    def _read(self, rows: DataFrame) -> DataFrame:
        rows = rows.drop(T)
        if not self.query.aggregates:
            return read_out(self.query, ZFrame(rows))
        named = [f.name if isinstance(f, Var) else c for f, c in zip(self.query.find, self.query.columns(), strict=True)]
        merged = self._merged(rows).where("_cnt <> 0")
        return merged.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(named, self.query.columns(), strict=True)])

    def result(self) -> DataFrame:
        return self._read(self.changes())

    def as_of(self, tx: int, exact: bool = True) -> DataFrame:
        """The result right after transaction ``tx``; with ``exact=False`` after the last one up to it."""
        if not self.keep_history:
            raise UnknownTransactionError("this view keeps no history")
        if exact and tx not in self.history_index():
            raise UnknownTransactionError(f"no transaction {tx}")
        return self._read(self.changes(tx))

    def compact(self) -> None:
        """Merge all logs into their last transaction: less to read, but no history before it.

        The merged logs are a new generation. It holds from the moment it is published, so a crash before that changes nothing and
        one after it leaves only folders that nobody reads, which the next call removes.
        """
        now = self._generation()
        root, new = f"{self.path}/g{now}", f"{self.path}/g{now + 1}"
        done = self._done(root)
        for old in names(self.spark, self.path):
            if old.startswith("g") and old[1:].isdigit() and int(old[1:]) != now:
                delete(self.spark, f"{self.path}/{old}")
        if len(done) < 2:
            return
        last = max(t for x in done.values() for t in x.times)
        streams = sorted({s for x in done.values() for s in x.streams}, key=lambda x: int(x[1:]))[-1:]
        touched, time = sorted({i for x in done.values() for i in x.touched}), F.lit(last).cast("long").alias(T)
        for i in touched:
            rows = ZFrame(self._log(root, self.used[i], done).drop(T)).consolidate().df
            rows.select("e", F.col("v").cast("string").alias("v"), W, time).write.mode("overwrite").parquet(f"{new}/log/m{last}/i={i}")
        merged = self._merged(self._results(root, done).drop(T))
        merged.withColumn(T, time).select(*[f"`{c}`" for c in self._result_schema.names]).write.mode("overwrite").parquet(f"{new}/result/m{last}")
        write_text(self.spark, f"{new}/done/m{last}", "\n".join([str(last), ",".join(streams), ",".join(map(str, touched))]))
        write_text(self.spark, f"{self.path}/published/{now + 1}", "")
        delete(self.spark, root)

    def progress(self) -> str:
        return json.dumps(self.stats)


DATOM_SCHEMA = SCHEMA
