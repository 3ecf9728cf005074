"""Structured Streaming: maintained views over datom streams, and streaming joins and windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.zframe import W
from ..sources.datoms import SCHEMA
from .view import View


def read_datoms(spark: SparkSession, path: str, format: str = "parquet", schema: str = SCHEMA, files_per_batch: int | None = None) -> DataFrame:
    """A folder of datom files as a stream."""
    reader = spark.readStream.format(format).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def maintain(view: View, stream: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Apply each micro-batch to ``view``; rows with a ``tx`` keep it, so as-of reads work by transaction. A batch that is delivered again changes nothing.

    Without ``every`` (such as "5 seconds") the query takes what there is and ends.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        view.apply_batch(batch, batch_id)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def delta_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of two change streams, weights multiplied: emits each pair once, when its later side arrives.

    Spark keeps both sides as state for ever unless the streams have watermarks.
    """
    both = left.join(right.withColumnRenamed(W, "_w"), on)
    names = [F.col(f"`{c}`") for c in both.columns if c not in (W, "_w")]
    return both.select(*names, (F.col(W) * F.col("_w")).alias(W))


def intake(events: DataFrame, ts: str = "ts", n: str | None = None, length: str = "1 second", late: str | None = None) -> DataFrame:
    """Events, or the sum of column ``n``, in windows of ``length``; on a stream ``late`` is the watermark."""
    source = events.withWatermark(ts, late) if late else events
    total = F.count("*") if n is None else F.sum(n)
    return source.groupBy(F.window(ts, length).alias("_window")).agg(total.alias("n")).select(F.col("_window.start").alias("start"), "n")


def sliding_intake(events: DataFrame, seconds: int = 1, ts: str = "ts") -> DataFrame:
    """For each event the number of events in the ``seconds`` up to and including it, over hourly parts of the time axis.

    An hour also gets the last ``seconds`` of the hour before, so no task needs the whole axis.
    """
    from pyspark.sql import Window

    at = F.unix_micros(F.col(ts).cast("timestamp"))
    span = max(3600, seconds) * 10**6
    rows = events.withColumn("_at", at).withColumn("_hour", F.expr(f"_at div {span}L"))
    own = rows.withColumn("_own", F.lit(True))
    before = rows.where(F.expr(f"_at % {span}L >= {span - seconds * 10**6}L")).withColumn("_hour", F.col("_hour") + 1).withColumn("_own", F.lit(False))
    last = Window.partitionBy("_hour").orderBy("_at").rangeBetween(-(seconds * 10**6 - 1), 0)
    return own.unionByName(before).withColumn("n", F.count("*").over(last)).where("_own").drop("_at", "_hour", "_own")


class Registry:
    """Named views and streaming queries."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.views: dict[str, View] = {}
        self.running: dict[str, StreamingQuery] = {}

    def sync(self, name: str, view: View, stream: DataFrame | None = None, checkpoint: str | None = None, every: str | None = None) -> View:
        self.views[name] = view
        if stream is not None:
            self.running[name] = maintain(view, stream, checkpoint or f"{view.path}/checkpoint", every)
        return view

    def result(self, name: str) -> DataFrame:
        return self.views[name].result()

    def serve(self, name: str) -> None:
        """Make the result readable in SQL under ``name``."""
        self.result(name).createOrReplaceTempView(name)

    def status(self) -> dict[str, dict]:
        return {n: v.stats | {"active": n in self.running and self.running[n].isActive, "progress": (self.running[n].lastProgress or {}) if n in self.running else {}} for n, v in self.views.items()}

    def stop(self, name: str | None = None) -> None:
        for n in [name] if name else list(self.running):
            self.running.pop(n).stop()


def on_progress(spark: SparkSession, callback: Callable[[dict], None]) -> object:
    """Call ``callback`` with each batch's progress (durations, rows); returns the listener, for ``spark.streams.removeListener``."""
    import json

    from pyspark.sql.streaming.listener import StreamingQueryListener

    class _Listener(StreamingQueryListener):
        def onQueryStarted(self, event) -> None:  # noqa: N802
            pass

        def onQueryProgress(self, event) -> None:  # noqa: N802
            callback(json.loads(event.progress.json))

        def onQueryTerminated(self, event) -> None:  # noqa: N802
            pass

    listener = _Listener()
    spark.streams.addListener(listener)
    return listener
