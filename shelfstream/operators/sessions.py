"""Per-user ordering and inactivity sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfstream.scale import pieces, ranked_rows, running_totals


def event_rank(
    events: DataFrame, order: tuple[str, ...] = ("event_ts", "event_id"), out: str = "event_rank"
) -> DataFrame:
    """Position of each event in its user's history, for users of any size.

    A user with a large share of all rows is numbered in pieces of about equal
    size. Where a cap on events per user has been applied, a plain
    ``row_number`` is enough (see the silver plan).
    """
    ranked = ranked_rows(events, ["user_id"], order, out)
    return ranked.withColumn(out, F.col(out).cast("int"))


def sessionise(events: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """Add ``session_id``: a gap longer than ``gap_seconds`` starts a new session.

    Needs user_id, event_ts_unix and event_id. The predecessor of the first
    event of a piece comes from the newest time of the user's previous piece.
    """
    piece = pieces(events, ["user_id", "event_ts_unix", "event_id"]).drop("_position")
    newest = piece.groupBy("user_id", "_piece").agg(F.max("event_ts_unix").alias("_newest"))
    chain = Window.partitionBy("user_id").orderBy("_piece")
    before = newest.select("user_id", "_piece", F.lag("_newest").over(chain).alias("_before"))
    inside = Window.partitionBy("user_id", "_piece").orderBy("event_ts_unix", "event_id")
    marked = (
        piece.withColumn("_previous", F.lag("event_ts_unix").over(inside))
        .join(before, ["user_id", "_piece"])
        .withColumn("_previous", F.coalesce("_previous", "_before"))
        .withColumn(
            "_starts",
            F.when(
                F.col("_previous").isNull()
                | (F.col("event_ts_unix") - F.col("_previous") > gap_seconds),
                1,
            ).otherwise(0),
        )
    )
    numbered = running_totals(
        marked.drop("_piece"), ["user_id"], ["event_ts_unix", "event_id"], {"_session": "_starts"}
    )
    return numbered.withColumn("session_id", F.concat_ws("#", "user_id", "_session")).drop(
        "_previous", "_before", "_starts", "_session"
    )


def session_table(events: DataFrame, gap_seconds: int = 1800, lateness: str | None = None) -> DataFrame:
    """(user_id, started, ended, events) per session; an event exactly at the gap still belongs to it.

    The same on a table and on a stream. On a stream ``lateness`` sets the
    watermark on event_ts: a session is emitted once the watermark has passed
    its last event by the gap, and later rows of that session are dropped.
    Rows are merged into sessions before the shuffle as well as after it, so a
    busy user sends few.
    """
    if lateness is not None:
        events = events.withWatermark("event_ts", lateness)
    window = F.session_window("event_ts", f"{gap_seconds} seconds")
    return events.groupBy("user_id", window.alias("w")).agg(F.count("*").alias("events")).select(
        "user_id",
        F.col("w.start").alias("started"),
        (F.col("w.end") - F.expr(f"INTERVAL {gap_seconds} SECONDS")).alias("ended"),
        "events",
    )


def last_per_key(changes: DataFrame, keys: list[str], order: str = "change_ts") -> DataFrame:
    """Newest row per key, as one map-side combined aggregate."""
    rest = [c for c in changes.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order]))
    if any("map" in t for _, t in changes.dtypes):
        # Maps have no order, so ties on the time are broken by the other columns.
        plain = [c for c, t in changes.dtypes if c in rest and "map" not in t and c != order]
        newest = F.max_by(F.struct(*rest), F.struct(order, *plain))
    return changes.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*")
