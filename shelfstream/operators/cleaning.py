"""Row filters of the silver layer and of the topic boundary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfstream.functions.actions import ACTION_ID
from shelfstream.functions.privacy import permits, pseudonym
from shelfstream.sources.schemas import MESSAGE_COLUMNS, MESSAGE_REQUIRED


class ConsentMissing(ValueError):
    """Consent is enforced but the data carries none."""


def require_consent(events: DataFrame) -> None:
    """Refuse data without any consent value instead of guessing."""
    if "consent" not in events.columns:
        raise ConsentMissing("consent is enforced but the table has no consent column")
    if not events.filter(F.col("consent").isNotNull()).limit(1).count():
        raise ConsentMissing("consent is enforced but every consent value is null")


def consented(events: DataFrame, consumer: str = "analytics") -> DataFrame:
    return events.filter(permits(consumer))


def consent_counts(events: DataFrame, consumer: str) -> DataFrame:
    """Rows before, after and dropped, in one aggregate."""
    kept = F.count_if(permits(consumer))
    return events.agg(
        F.count("*").alias("before"),
        kept.alias("after_consent"),
        (F.count("*") - kept).alias("consent_dropped_events"),
    )


def deduplicated(
    df: DataFrame, keys: Sequence[str], prefer: Sequence | None = None
) -> DataFrame:
    """One row per key; ``prefer`` orders the copies when they can differ.

    Both forms drop copies before the shuffle (partial aggregate, or the
    row-number limit Spark pushes below it), so many copies of one row are cheap.
    """
    if prefer is None:
        return df.dropDuplicates(list(keys))
    order = Window.partitionBy(*keys).orderBy(*prefer)
    return df.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def without_types(events: DataFrame, types: Sequence[str]) -> DataFrame:
    return events.filter(~F.col("event_type").isin(list(types))) if types else events


def with_types(events: DataFrame, types: Sequence[str]) -> DataFrame:
    """Only these event types; an empty list keeps all."""
    return events.filter(F.col("event_type").isin(list(types))) if types else events


def in_window(events: DataFrame, start=None, end=None, column: str = "event_ts_unix") -> DataFrame:
    """Half-open [start, end); None leaves a side open."""
    if start is not None:
        events = events.filter(F.col(column) >= F.lit(start))
    if end is not None:
        events = events.filter(F.col(column) < F.lit(end))
    return events


def known_skus(events: DataFrame, hierarchy: DataFrame) -> DataFrame:
    return events.join(hierarchy.select("sku"), "sku", "left_semi")


def user_days(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", "event_date").agg(F.count("*").alias("n"))


def bot_users(events: DataFrame, per_day: int) -> DataFrame:
    return user_days(events).filter(F.col("n") > per_day).select("user_id").distinct()


def without_users(events: DataFrame, users: DataFrame) -> DataFrame:
    return events.join(users.select("user_id"), "user_id", "left_anti")


def users_between(events: DataFrame, low: int, high: int) -> DataFrame:
    """Users with low <= events <= high."""
    counts = events.groupBy("user_id").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n").between(low, high)).select("user_id")


def only_users(events: DataFrame, users: DataFrame) -> DataFrame:
    return events.join(users.select("user_id"), "user_id", "left_semi")


def eligible_users(events: DataFrame, bot_per_day: int, low: int, high: int) -> DataFrame:
    """Users that pass both the bot rule and the length rule.

    Both rules remove whole users, so one two-level count answers both and the
    event table is joined once instead of twice.
    """
    per_user = (
        user_days(events)
        .groupBy("user_id")
        .agg(F.max("n").alias("busiest"), F.sum("n").alias("total"))
    )
    return per_user.filter(
        (F.col("busiest") <= bot_per_day) & F.col("total").between(low, high)
    ).select("user_id", "busiest", "total")


def pseudonymised(events: DataFrame, key: bytes, length: int = 32) -> DataFrame:
    return events.withColumn("user_id", pseudonym("user_id", key, length))


def violations(messages: DataFrame, any_type: bool = False) -> DataFrame:
    """Add ``reasons``: every rule of the interaction topic a message breaks.

    ``any_type``: event types outside the vocabulary of actions break none.
    """
    extra = [c for c in messages.columns if c not in MESSAGE_COLUMNS]

    def blank(name):
        if name not in messages.columns:
            return F.lit(True)
        return F.col(name).isNull() | (F.col(name).cast("string") == "")

    def below_zero(name):
        return F.col(name) < 0 if name in messages.columns else F.lit(False)

    rules = [(blank(name), f"missing {name}") for name in MESSAGE_REQUIRED]
    rules += [(F.col(name).isNotNull(), f"unknown field {name}") for name in sorted(extra)]
    if not any_type:
        rules.append((~F.col("event_type").isin(*ACTION_ID), "unknown event_type"))
    rules += [
        (below_zero("quantity"), "negative quantity"),
        (below_zero("price"), "negative price"),
        ((F.col("event_type") == "return") & blank("order_id"), "return without order_id"),
    ]
    return messages.withColumn(
        "reasons", F.array_compact(F.array(*[F.when(rule, F.lit(text)) for rule, text in rules]))
    )


class InvalidMessage(ValueError):
    """A message breaks the topic rules and skipping was not allowed."""


def split_valid(
    messages: DataFrame, skip_invalid: bool = True, any_type: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with reasons); without ``skip_invalid`` one bad row raises."""
    checked = violations(messages, any_type)
    rejected = checked.filter(F.size("reasons") > 0)
    if not skip_invalid:
        first = rejected.select("reasons").first()
        if first is not None:
            raise InvalidMessage(f"message rejected: {first['reasons']}")
    return checked.filter(F.size("reasons") == 0).drop("reasons"), rejected
