"""Tails against a catalogue that changes while the stream runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfstream.functions.tokens import TokenRules
from shelfstream.scale import cut
from shelfstream.streaming import merged, sinks, state


def live_tails(
    events: DataFrame,
    catalog_path: str,
    rules: TokenRules,
    out: str,
    checkpoint: str,
    n: int = 50,
    first: Callable[[DataFrame, int], DataFrame] | None = None,
    **trigger,
):
    """Newest ``n`` events per user, as a merged table; each batch reads the newest catalogue.

    A join with a frame that was read before the start would know no item added
    later. Here a batch is resolved once, and merged with the stored tails of its
    users by ordinary joins and one window, which Spark cuts to ``n`` rows per
    user before the shuffle. Catalogue and tails are merged tables (see
    :mod:`.merged`): what a batch reads follows its own users, not the number of
    batches, and a batch that runs again starts from what was there before it.
    ``first`` may shape each batch, or refresh the catalogue, before it is resolved.
    """
    spark = events.sparkSession
    entry = ("event_us", "event_id", "sku", "token", "action", "session_id")

    def save(batch: DataFrame, number: int) -> None:
        usable = (batch if first is None else first(batch, number)).where("user_id is not null and event_ts is not null")
        catalog = merged.current(spark, catalog_path)
        new = cut(
            state.resolved(usable, catalog, rules).select(
                "user_id",
                F.unix_micros(F.col("event_ts").cast("timestamp")).alias("event_us"),
                "event_id", "sku", "token",
                F.col("event_type").alias("action"),
                F.coalesce("session_id", F.lit("")).alias("session_id"),
            )
        )
        stored = merged.before_batch(spark, out, new.select("user_id"), ["user_id"], number)
        rows = new if stored is None else new.unionByName(stored.select("user_id", F.inline("tail")))
        order = Window.partitionBy("user_id").orderBy(F.desc("event_us"), F.desc("event_id"))
        newest = rows.dropDuplicates(["user_id", "event_us", "event_id"]).withColumn(
            "_n", F.row_number().over(order)
        ).where(F.col("_n") <= n)
        tails = newest.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(*entry))).alias("tail"))
        merged.merge_batch(tails, out, ["user_id"], number)

    sinks.watch(spark)
    return (
        events.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
