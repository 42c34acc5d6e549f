"""Fill all state from topics, dimension topics before interactions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from shelfstream.functions.tokens import TokenRules
from shelfstream.operators.cleaning import split_valid
from shelfstream.scale import cut
from shelfstream.streaming import merged, sinks, state
from shelfstream.streaming.topics import read_topic


def bootstrap(
    spark: SparkSession,
    topics: Mapping[str, str],
    out: str,
    rules: TokenRules,
    tail_length: int = 50,
    fmt: str = "json",
    any_type: bool = False,
) -> dict[str, int]:
    """Run catalogue, price and stock to completion, then the interactions.

    ``topics`` maps topic names to paths. Results are merged tables (one row per key) below
    ``out``: catalog, prices, stock, tails; messages that break the topic
    rules go to ``rejected`` with their reasons. With ``any_type`` tails take
    event types outside the vocabulary of actions too, as :func:`state.user_tails`
    does by itself. Returns what was observed.
    """
    totals: dict[str, int] = {}
    dimensions = (
        ("catalog", "catalog.cdc.v1", lambda d: state.latest(d, ["sku"])),
        ("prices", "pricing.cdc.v1", state.prices),
        ("stock", "inventory.v1", state.stock_levels),
    )
    for name, topic, shape in dimensions:
        stream = shape(read_topic(spark, topic, topics[topic], fmt))
        keys = ["sku", "location"] if name == "stock" else ["sku"]
        query = merged.write_merged(stream, f"{out}/{name}", f"{out}/_checkpoints/{name}", keys)
        totals.update(sinks.finish(query))
    catalog = merged.current(spark, f"{out}/catalog")
    events = read_topic(spark, "interactions.v1", topics["interactions.v1"], fmt)
    events, rejected = split_valid(events, any_type=any_type)
    query = sinks.append_stream(rejected, f"{out}/rejected", f"{out}/_checkpoints/rejected")
    totals.update(sinks.finish(query))
    tails = state.user_tails(state.resolved(events, catalog, rules), tail_length)
    query = merged.write_merged(tails, f"{out}/tails", f"{out}/_checkpoints/tails", ["user_id"])
    totals.update(sinks.finish(query))
    return totals


def seeded_tails(
    history: DataFrame, messages: DataFrame, out: str, checkpoint: str, n: int = 50, buckets: int = merged.BUCKETS, **trigger
):
    """Tails of a stream that starts from a table: both hold resolved messages.

    The history becomes the stream's initial state and batch -1 of the merged
    table ``out``, by one batch query; only what came since is streamed. A
    restart goes on from the checkpoint and needs no history.
    """
    initial = cut(state.initial_tails(history, n))
    if not merged.exists(history.sparkSession, out):
        merged.merge_batch(state.tail_rows(initial), out, ["user_id"], -1, buckets)
    return merged.write_merged(
        state.user_tails(messages, n, initial=initial), out, checkpoint, ["user_id"], buckets=buckets, **trigger
    )
