"""Service health as aggregates over the request and exposure logs.

A log row has request_id, served_ts, served_from, ranker_used, latency_ms,
n_items, model_version and exposure_outcome. All aggregates combine before the
shuffle, so one dominant label is no problem, and the windowed ones also run
on a stream with a watermark on served_ts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfstream.scale import order_statistics

# Upper bounds of the latency buckets in milliseconds; 100 is the objective.
LATENCY_BOUNDS_MS = (1.0, 2.5, 5.0, 10.0, 25.0, 35.0, 50.0, 100.0, 250.0, 500.0, 1000.0)
# Upper bounds of the list-length buckets.
ITEM_BOUNDS = (0, 1, 5, 10, 20, 50, 100)
OBJECTIVE_MS = 100.0
ERROR_BUDGET = 0.01


def requests(log: DataFrame, every: str = "1 hour") -> DataFrame:
    w = F.window("served_ts", every)
    return log.groupBy(w.alias("w"), "served_from", "ranker_used").agg(
        F.count("*").alias("requests")
    )


def cumulative_histogram(
    log: DataFrame, value: str, bounds: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Cumulative bucket counts with sum and count, one row per bound."""
    x = F.col(value)
    cells = [F.count_if(x <= b).alias(f"_{i}") for i, b in enumerate(bounds)]
    wide = log.groupBy(*by).agg(*cells, F.sum(x).alias("total"), F.count(x).alias("n"))
    rows = [
        F.struct(F.lit(float(b)).alias("le"), F.col(f"_{i}").alias("bucket_count"))
        for i, b in enumerate(bounds)
    ]
    rows.append(F.struct(F.lit(float("inf")).alias("le"), F.col("n").alias("bucket_count")))
    return wide.select(*by, F.inline(F.array(*rows)), "total", "n")


def failure_ratio(log: DataFrame, length: str, slide: str = "1 minute") -> DataFrame:
    """Share of requests slower than the objective per sliding window, keyed by its end."""
    w = F.window("served_ts", length, slide)
    slow = F.count_if(F.col("latency_ms") > OBJECTIVE_MS) / F.count("*")
    return log.groupBy(w.alias("w")).agg(slow.alias("ratio"), F.count("*").alias("n")).select(
        F.col("w.end").alias("at"), "ratio", "n"
    )


def per_slide(log: DataFrame, slide_seconds: int = 60) -> DataFrame:
    """Slow and total requests per slide, keyed by the slide's number since the epoch."""
    tick = F.floor(F.unix_timestamp("served_ts") / slide_seconds)
    return log.groupBy(tick.alias("tick")).agg(
        F.count_if(F.col("latency_ms") > OBJECTIVE_MS).alias("slow"), F.count("*").alias("n")
    )


def sliding_ratios(
    log: DataFrame, lengths: dict[str, int], slide_seconds: int = 60
) -> DataFrame:
    """Failure ratios of several window lengths at every slide that saw traffic.

    Batch form of :func:`failure_ratio`: each row is counted once into its slide
    and the windows are sums over slides, instead of copying every row into
    every window it belongs to (360 copies for 6 h by the minute). A long log is
    cut by day for the range frame, with the longest window's slides repeated
    at the day start.
    """
    day = 86400 // slide_seconds
    reach = max(lengths.values()) // slide_seconds
    ticks = per_slide(log, slide_seconds)
    own = F.floor(F.col("tick") / day)
    spread = ticks.withColumn(
        "_part",
        F.explode(F.array_distinct(F.array(own, F.floor((F.col("tick") + reach - 1) / day)))),
    )
    out = spread
    for name, seconds in lengths.items():
        frame = (
            Window.partitionBy("_part")
            .orderBy("tick")
            .rangeBetween(-(seconds // slide_seconds) + 1, 0)
        )
        out = out.withColumn(name, F.sum("slow").over(frame) / F.sum("n").over(frame))
    mine = out.filter(F.col("_part") == own)
    return mine.select(((F.col("tick") + 1) * slide_seconds).alias("at_unix"), *lengths)


def burn_alerts(
    ratios: DataFrame, short: str, long: str, slow: str | None = None, fast=14.4, slow_rate=6.0
) -> DataFrame:
    """Fast burn needs both windows over the limit; slow burn one long window."""
    quick = (F.col(short) > fast * ERROR_BUDGET) & (F.col(long) > fast * ERROR_BUDGET)
    out = ratios.withColumn("fast_burn", quick)
    if slow:
        out = out.withColumn("slow_burn", F.col(slow) > slow_rate * ERROR_BUDGET)
    return out


def health_ratios(log: DataFrame, every: str = "10 minutes") -> DataFrame:
    """Fallback, empty-list and exposure-failure shares per window with their alerts."""

    def share(condition: Column) -> Column:
        return F.count_if(condition) / F.count("*")

    table = log.groupBy(F.window("served_ts", every).alias("w")).agg(
        F.count("*").alias("requests"),
        share(F.col("served_from") != "model").alias("fallback_share"),
        share(F.col("n_items") == 0).alias("empty_share"),
        share(F.col("exposure_outcome") == "failed").alias("exposure_failed_share"),
    )
    return table.select(
        F.unix_timestamp("w.start").alias("start_unix"),
        "requests",
        "fallback_share",
        "empty_share",
        "exposure_failed_share",
        (F.col("fallback_share") > 0.05).alias("fallback_alert"),
        (F.col("empty_share") > 0.01).alias("empty_alert"),
        (F.col("exposure_failed_share") > 0.05).alias("exposure_alert"),
    )


def drop_dominance(drops: DataFrame, by: Sequence[str] = (), limit: float = 0.9) -> DataFrame:
    """Share of each reason among dropped candidates, from (reason, n) rows."""
    per = drops.groupBy(*by, "reason").agg(F.sum("n").alias("n"))
    total = drops.groupBy(*by).agg(F.sum("n").alias("total"))
    keyed = per.withColumn("_k", F.lit(1)).join(
        total.withColumn("_k", F.lit(1)), ["_k", *by]
    ).drop("_k")
    share = F.col("n") / F.greatest(F.col("total"), F.lit(1))
    return keyed.select(*by, "reason", "n", share.alias("share"), (share > limit).alias("alert"))


def staleness(builds: DataFrame, now_unix: int | Column, limit_days: int = 7) -> DataFrame:
    now = F.lit(now_unix) if isinstance(now_unix, int) else now_unix
    age = now - F.max(F.unix_timestamp("created_ts"))
    return builds.agg(age.alias("age_seconds")).withColumn(
        "stale", F.col("age_seconds") > limit_days * 86400
    )


def nearest_rank(
    log: DataFrame, value: str, fractions: dict[str, float], by: str
) -> DataFrame:
    """Nearest-rank percentiles per stage: every reported value really occurred.

    Built on exact order statistics, so a stage of any size is handled without
    gathering its values.
    """
    def index(fraction: float, n: int) -> int:
        return min(n - 1, max(0, round(fraction * n + 0.5) - 1))

    found = order_statistics(
        log, value, lambda n: {index(f, n) for f in fractions.values()}, by
    )
    rows = [
        (stage, *[at[index(f, n)] for f in fractions.values()], n)
        for stage, (n, at) in found.items()
    ]
    schema = ", ".join([f"`{by}` string", *[f"{f} double" for f in fractions], "n long"])
    return log.sparkSession.createDataFrame(rows, schema)


def version_skew(log: DataFrame, every: str = "30 minutes") -> DataFrame:
    """Versions and retrieval errors seen per window."""
    table = log.groupBy(F.window("served_ts", every).alias("w")).agg(
        F.count_distinct("model_version").alias("versions"),
        F.count_if(F.col("served_from") == "retrieval_error").alias("retrieval_errors"),
    )
    return table.select(
        F.unix_timestamp("w.start").alias("start_unix"),
        "versions",
        "retrieval_errors",
        (F.col("versions") > 1).alias("skew_alert"),
        (F.col("retrieval_errors") > 0).alias("retrieval_alert"),
    )


# 2^12 registers of a sketch: 1.6 % standard error, 4 KB at most for a period and group.
SKETCH_BITS = 12


def distinct_sketches(
    log: DataFrame, column: str, every: str = "1 day", by: Sequence[str] = (), bits: int = SKETCH_BITS
) -> DataFrame:
    """(start_unix, *by, sketch, rows): a mergeable count of distinct values per period.

    Kept as a table, one period's rows are read once; longer periods come from
    :func:`distinct_over`. Nulls count for nothing.
    """
    table = log.groupBy(F.window("served_ts", every).alias("w"), *by).agg(
        F.hll_sketch_agg(column, bits).alias("sketch"), F.count(column).alias("rows")
    )
    return table.select(F.unix_timestamp("w.start").alias("start_unix"), *by, "sketch", "rows")


def distinct_over(sketches: DataFrame, seconds: int, by: Sequence[str] = ()) -> DataFrame:
    """(start_unix, *by, distinct, rows) of periods of ``seconds``, from sketches of shorter ones.

    Values seen in several of them count once, which sums of counts cannot do.
    """
    start = F.floor(F.col("start_unix") / seconds) * seconds
    return sketches.groupBy(start.alias("start_unix"), *by).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"), F.sum("rows").alias("rows")
    )


def silent_windows(log: DataFrame, seconds: int = 600) -> DataFrame:
    """Windows between the first and the last request without any traffic.

    Generated from the gaps between consecutive busy windows: a ratio cannot
    see rows that do not exist, and no full series is built in one task.
    """
    slot = F.floor(F.unix_timestamp("served_ts") / seconds).cast("long")
    busy = log.select(slot.alias("slot")).distinct()
    day = 86400 // seconds
    parted = busy.withColumn("_d", F.floor(F.col("slot") / day))
    inside = Window.partitionBy("_d").orderBy("slot")
    edges = parted.groupBy("_d").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    # Days are few; the previous day's last busy slot closes the gap between days.
    before = edges.select("_d", F.lag("hi").over(Window.orderBy("_d")).alias("_last"))
    gaps = parted.join(before, "_d").withColumn(
        "_previous", F.coalesce(F.lag("slot").over(inside), "_last")
    )
    quiet = gaps.filter(F.col("slot") - F.col("_previous") > 1).select(
        F.explode(F.sequence(F.col("_previous") + 1, F.col("slot") - 1)).alias("slot")
    )
    return quiet.select((F.col("slot") * seconds).alias("start_unix"))
