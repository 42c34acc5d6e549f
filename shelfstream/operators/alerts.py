"""Alert rules that wait: pending, firing, resolved.

A rule asks at every tick of its evaluation whether conditions over sliding
windows hold. It is pending from the first tick they do, fires once they have
held for its waiting time without a break, and resolves at the first tick they
do not. Without traffic in its windows a ratio is unknown and does not hold.

The log is counted into ticks first; everything after that is bounded by time
(a year at 30 s is a million ticks), not by requests.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfstream.operators.monitoring import ERROR_BUDGET, OBJECTIVE_MS


@dataclass(frozen=True)
class Condition:
    """``counter`` over ``total`` (or alone) in the last ``seconds`` lies above ``limit``.

    With ``none`` the condition is that the counter did not move at all.
    """

    counter: str
    seconds: int
    limit: float = 0.0
    total: str | None = "requests"
    none: bool = False

    def holds(self, counter: float | None, total: float | None) -> bool:
        if self.none:
            return not counter
        if self.total is None:
            return (counter or 0) > self.limit
        return bool(total) and counter / total > self.limit


@dataclass(frozen=True)
class Rule:
    name: str
    conditions: tuple[Condition, ...]
    wait: int
    severity: str


def counters() -> dict[str, Column]:
    """What a log row counts as; a null condition does not count."""
    return {
        "requests": F.lit(True),
        "slow": F.col("latency_ms") > OBJECTIVE_MS,
        "fallbacks": F.col("served_from") != "model",
        "retrieval_errors": F.col("served_from") == "retrieval_error",
        "empty": F.col("n_items") == 0,
        "exposures": F.col("exposure_outcome").isNotNull(),
        "exposures_failed": F.col("exposure_outcome") == "failed",
    }


NAMES = ("requests", "slow", "fallbacks", "retrieval_errors", "empty", "exposures", "exposures_failed")

# Windows, limits and waiting times of the service's rules, in seconds.
RULES = (
    Rule("latency_burning_fast", (Condition("slow", 300, 14.4 * ERROR_BUDGET), Condition("slow", 3600, 14.4 * ERROR_BUDGET)), 120, "page"),
    Rule("latency_burning_slow", (Condition("slow", 21600, 6 * ERROR_BUDGET),), 900, "ticket"),
    Rule("serving_fallbacks", (Condition("fallbacks", 600, 0.05),), 600, "page"),
    Rule("retrieval_errors", (Condition("retrieval_errors", 300, total=None),), 300, "page"),
    Rule("empty_responses", (Condition("empty", 600, 0.01),), 600, "ticket"),
    Rule("exposure_log_failing", (Condition("exposures_failed", 900, 0.05, "exposures"),), 900, "ticket"),
    Rule("no_traffic", (Condition("requests", 600, none=True),), 600, "page"),
)


def tick_counts(log: DataFrame, every: int = 30) -> DataFrame:
    """(tick, one column per counter): requests per evaluation interval, numbered since the epoch."""
    tick = F.floor(F.unix_timestamp("served_ts") / every).cast("long")
    return log.groupBy(tick.alias("tick")).agg(*[F.count_if(c).alias(n) for n, c in counters().items()])


def evaluations(
    ticks: DataFrame, rules: Sequence[Rule] = RULES, every: int = 30, until_unix: int | None = None
) -> DataFrame:
    """(rule, at_unix, holds) at every tick from the first request to the last, or to ``until_unix``.

    Ticks without traffic are evaluated too. Windows are sums over ticks; the
    range frames run per day, with the ticks a window reaches back to repeated
    at each day's start.
    """
    spark = ticks.sparkSession
    first, last = ticks.agg(F.min("tick"), F.max("tick")).first()
    if first is None:
        return spark.createDataFrame([], "rule string, at_unix long, holds boolean")
    last = until_unix // every - 1 if until_unix is not None else last
    day, reach = max(1, 86400 // every), max(c.seconds for r in rules for c in r.conditions) // every
    dense = spark.range(first, last + 1).withColumnRenamed("id", "tick").join(ticks, "tick", "left")
    own = F.floor(F.col("tick") / day)
    spread = dense.withColumn("_part", F.explode(F.sequence(own, F.floor((F.col("tick") + reach - 1) / day))))
    sums = {
        (name, c.seconds)
        for r in rules for c in r.conditions for name in (c.counter, c.total) if name is not None
    }
    frames = {
        s: Window.partitionBy("_part").orderBy("tick").rangeBetween(1 - s // every, 0) for _, s in sums
    }
    wide = spread.select(
        "tick", "_part", *[F.sum(n).over(frames[s]).alias(f"{n}_{s}") for n, s in sorted(sums)]
    ).filter(F.col("_part") == own)

    def holds(c: Condition) -> Column:
        value = F.coalesce(F.col(f"{c.counter}_{c.seconds}"), F.lit(0))
        if c.none:
            return value == 0
        if c.total is None:
            return value > c.limit
        whole = F.col(f"{c.total}_{c.seconds}")
        return F.coalesce(F.when(whole > 0, value / whole > c.limit), F.lit(False))

    cells = []
    for rule in rules:
        both = holds(rule.conditions[0])
        for c in rule.conditions[1:]:
            both = both & holds(c)
        cells.append(F.struct(F.lit(rule.name).alias("rule"), both.alias("holds")))
    at = ((F.col("tick") + 1) * every).alias("at_unix")
    return wide.select(at, F.inline(F.array(*cells))).select("rule", "at_unix", "holds")


def episodes(
    evaluated: DataFrame, rules: Sequence[Rule] = RULES, every: int = 30
) -> DataFrame:
    """(rule, pending_at, firing_at, ended_at, state) of every unbroken run of ticks at which a rule held.

    ``state`` is resolved (it fired and ended), cleared (it ended before it
    fired), firing or pending (it lasts to the last tick; ``ended_at`` is null).
    """
    waits = evaluated.sparkSession.createDataFrame([(r.name, r.wait) for r in rules], "rule string, wait long")
    last = evaluated.groupBy("rule").agg(F.max("at_unix").alias("last"))
    held = evaluated.filter("holds")
    place = F.row_number().over(Window.partitionBy("rule").orderBy("at_unix"))
    runs = held.withColumn("_run", F.col("at_unix") / every - place).groupBy("rule", "_run").agg(
        F.min("at_unix").alias("pending_at"), F.max("at_unix").alias("_to")
    )
    # The first tick at which the rule has held for its waiting time.
    fires = F.col("pending_at") + F.ceil(F.col("wait") / every) * every
    timed = runs.join(waits, "rule").join(last, "rule").select(
        "rule", "pending_at",
        F.when(fires <= F.col("_to"), fires).cast("long").alias("firing_at"),
        F.when(F.col("_to") < F.col("last"), F.col("_to") + every).alias("ended_at"),
    )
    fired, over = F.col("firing_at").isNotNull(), F.col("ended_at").isNotNull()
    state = F.when(fired & over, "resolved").when(fired, "firing").when(over, "cleared").otherwise("pending")
    return timed.withColumn("state", state)


def transitions(found: DataFrame) -> DataFrame:
    """(rule, at_unix, state): when each episode became pending, firing, and resolved or cleared."""
    pending = F.when(
        F.col("firing_at").isNull() | (F.col("firing_at") > F.col("pending_at")),
        F.struct(F.col("pending_at").alias("at_unix"), F.lit("pending").alias("state")),
    )
    firing = F.when(
        F.col("firing_at").isNotNull(), F.struct(F.col("firing_at").alias("at_unix"), F.lit("firing").alias("state"))
    )
    ended = F.when(
        F.col("ended_at").isNotNull(), F.struct(F.col("ended_at").alias("at_unix"), F.col("state").alias("state"))
    )
    return found.select("rule", F.inline(F.array_compact(F.array(pending, firing, ended))))


def overdue(marks: DataFrame, every: int, limit_seconds: int, rule: str = "stale", until_unix: int | None = None) -> DataFrame:
    """(rule, at_unix, holds): whether the newest of ``marks`` (column ``created_ts``) is too old at each tick.

    For builds, feeds and other things that must be renewed; goes into :func:`episodes`.
    """
    spark = marks.sparkSession
    renewed = marks.groupBy(F.floor(F.unix_timestamp("created_ts") / every).cast("long").alias("tick")).agg(
        F.max(F.unix_timestamp("created_ts")).alias("mark")
    )
    first, last = renewed.agg(F.min("tick"), F.max("tick")).first()
    if first is None:
        return spark.createDataFrame([], "rule string, at_unix long, holds boolean")
    last = until_unix // every - 1 if until_unix is not None else last
    dense = spark.range(first, last + 1).withColumnRenamed("id", "tick").join(renewed, "tick", "left")
    at = (F.col("tick") + 1) * every
    newest = F.max("mark").over(Window.orderBy("tick"))
    # One row per tick of the period: bounded by time.
    return dense.select(F.lit(rule).alias("rule"), at.alias("at_unix"), (at - newest > limit_seconds).alias("holds"))
