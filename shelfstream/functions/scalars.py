"""Small numeric, time and array expressions shared across the library."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: probabilities are clipped to this distance from 0 and 1.
EPSILON = 1e-7


def logit(p: Column) -> Column:
    clipped = F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))
    return F.log(clipped / (1 - clipped))


def sigmoid(x: Column) -> Column:
    """Logistic function that never exponentiates a large positive number."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))


def rank_discount(position: Column) -> Column:
    """Gain of a hit at 0-based ``position``."""
    return 1 / F.log2(position.cast("double") + 2)


def decay(age: Column, half_life: float) -> Column:
    return F.pow(F.lit(2.0), -age.cast("double") / F.lit(float(half_life)))


def unix_seconds(ts: Column) -> Column:
    """Seconds since the epoch of a timestamp with or without a time zone."""
    return F.unix_timestamp(ts).cast("long")


def parse_unix(text: Column) -> Column:
    """ISO timestamp text to unix seconds; anything unreadable becomes 0."""
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(text)), F.lit(0)).cast("long")


# Fixed values of the time-gap buckets.
GAP_DIVISOR = 0.301
GAP_BUCKETS = 128


def gap_bucket(gap: Column) -> Column:
    """Logarithmic bucket of a time gap in seconds."""
    size = F.log(F.greatest(F.abs(gap).cast("double"), F.lit(1.0))) / F.lit(GAP_DIVISOR)
    return F.least(F.greatest(F.floor(size), F.lit(0)), F.lit(GAP_BUCKETS)).cast("int")


def time_gap_buckets(times: Column) -> Column:
    """Bucket of the gap to the next event; the newest event has gap 0."""
    return F.transform(
        times,
        lambda t, i: gap_bucket(F.coalesce(F.get(times, i + 1), t) - t),
    )


def last_n(values: Column, n: int) -> Column:
    """The newest ``n`` elements of an array in old-to-new order."""
    return F.slice(values, F.greatest(F.size(values) - (n - 1), F.lit(1)), n)


def left_pad(values: Column, n: int, filler: Column) -> Column:
    """``values`` with ``filler`` in front so that the array has length ``n``."""
    missing = F.greatest(F.lit(n) - F.size(values), F.lit(0))
    return F.concat(F.array_repeat(filler, missing), values)


def null_if_blank(value: Column) -> Column:
    return F.nullif(value.cast("string"), F.lit(""))


def blank_if_null(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def natural_key(*values: Column | str) -> Column:
    """Event id for sources without one: sha-256 of the joined natural key."""
    return F.sha2(F.concat_ws("|", *values), 256)


def attribute_map(**values: Column) -> Column:
    """map<string,string> of the non-blank values."""
    if not values:
        return F.create_map().cast("map<string,string>")
    pairs = [x for name, v in values.items() for x in (F.lit(name), v.cast("string"))]
    return F.map_filter(
        F.create_map(*pairs), lambda _, v: v.isNotNull() & (F.trim(v) != "")
    )
