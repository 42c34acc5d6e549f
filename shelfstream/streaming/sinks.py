"""Streaming sinks. Each is restartable from its checkpoint."""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from shelfstream.functions import scalars as S
from shelfstream.operators.sessions import last_per_key
from shelfstream.sources.schemas import INTERACTION_COLUMNS


def as_bronze(messages: DataFrame) -> DataFrame:
    """Messages in the bronze shape; consent is carried along."""
    return messages.withColumns(
        {
            "session_id": S.blank_if_null(F.col("session_id")),
            "order_id": S.blank_if_null(F.col("order_id")),
            "return_reason": S.blank_if_null(F.col("return_reason")),
            "quantity": F.coalesce("quantity", F.lit(1)),
            "event_date": F.to_date("event_ts"),
        }
    ).select(*INTERACTION_COLUMNS, "event_date")


def bronze_stream(messages: DataFrame, lateness: str = "1 day") -> DataFrame:
    """One row per event id among events that arrive within ``lateness``.

    Copies that arrive later pass and are removed by the silver step, so the
    whole path is at-least-once in and once out. ``received`` and ``written``
    are observed on the way.
    """
    received = messages.observe("received", F.count(F.lit(1)).alias("n"))
    once = received.withWatermark("event_ts", lateness).dropDuplicatesWithinWatermark(["event_id"])
    return as_bronze(once).observe("written", F.count(F.lit(1)).alias("n"))


def append_stream(
    df: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = (), **trigger
):
    """Append to Parquet; the file sink's log makes a retried batch harmless."""
    watch(df.sparkSession)
    writer = df.writeStream.format("parquet").outputMode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return (
        writer.option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def write_versions(df: DataFrame, path: str, checkpoint: str, mode: str = "update", **trigger):
    """Write each batch's changed rows to its own folder; a retried batch replaces it."""

    watch(df.sparkSession)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        df.writeStream.outputMode(mode)
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def current_rows(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest version per key of a table made by :func:`write_versions`."""
    return last_per_key(spark.read.parquet(path), list(keys), "batch").drop("batch")


def finish(query, patience: float = 60.0) -> dict[str, int]:
    """Wait for a bounded run started here and add up what all its batches observed.

    A query itself remembers its last batches only; the session's listener
    hears of every one.
    """
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return _RUNS.totals(str(query.runId), patience)


def observed(progress) -> dict[str, int]:
    """Sum of observed metrics over progress reports, as ``name.metric``."""
    total: dict[str, int] = {}
    for report in progress:
        for name, row in (report.observedMetrics or {}).items():
            for metric, value in row.asDict().items():
                total[f"{name}.{metric}"] = total.get(f"{name}.{metric}", 0) + (value or 0)
    return total


class _Runs(StreamingQueryListener):
    """Totals of observed metrics per run, complete once the run has ended."""

    def __init__(self):
        self._runs: dict[str, dict[str, int]] = {}
        self._ended: set[str] = set()
        self._news = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self._news:
            run = self._runs.setdefault(str(event.progress.runId), {})
            for key, value in observed([event.progress]).items():
                run[key] = run.get(key, 0) + value

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._news:
            self._ended.add(str(event.runId))
            self._news.notify_all()

    def totals(self, run: str, patience: float) -> dict[str, int]:
        with self._news:
            if not self._news.wait_for(lambda: run in self._ended, patience):
                raise TimeoutError(f"no report that run {run} has ended")
            self._ended.discard(run)
            return self._runs.pop(run, {})


_RUNS = _Runs()
_WATCHED: set[str] = set()


def watch(spark: SparkSession) -> None:
    """Attach the listener once per application."""
    application = spark.sparkContext.applicationId
    if application not in _WATCHED:
        _WATCHED.add(application)
        spark.streams.addListener(_RUNS)


class Counters(StreamingQueryListener):
    """Running totals of observed metrics of all queries of a session."""

    def __init__(self, on_change: Callable[[dict[str, int]], None] | None = None):
        self.totals: dict[str, int] = {}
        self._on_change = on_change

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for key, value in observed([event.progress]).items():
            self.totals[key] = self.totals.get(key, 0) + value
        if self._on_change:
            self._on_change(dict(self.totals))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
