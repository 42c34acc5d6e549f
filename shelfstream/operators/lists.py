"""Scores and ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfstream.functions import scalars as S


def popularity(rows: DataFrame, half_life: float = 0.0) -> DataFrame:
    """Score per token: occurrences in the histories, optionally decayed.

    ``half_life`` counts events back from the end of each history. The sum is
    combined before the shuffle, so a token in every history costs one row per
    input partition.
    """
    n = F.size("input_tokens")
    events = rows.select(n.alias("n"), F.posexplode("input_tokens").alias("at", "token_id"))
    weight = S.decay(F.col("n") - 1 - F.col("at"), half_life) if half_life > 0 else F.lit(1.0)
    return events.filter("token_id > 0").groupBy("token_id").agg(F.sum(weight).alias("score"))


def most_popular(scores: DataFrame, n: int) -> DataFrame:
    """Top ``n`` tokens, ties by id. This is also the cold-start list."""
    return scores.orderBy(F.desc("score"), F.asc("token_id")).limit(n)


def popular_ids(scores: DataFrame, n: int) -> list[int]:
    """At most ``n`` ids on the driver; callers pass a list length, never a table size."""
    return [row["token_id"] for row in most_popular(scores, n).select("token_id").collect()]


def unseen_in_order(ranking: list[int], k: int, seen: Column | None) -> Column:
    """First ``k`` of a shared ranking that are not in ``seen``.

    Exact when ``ranking`` is at least k + size(seen) long: no user can have
    seen more than that many of its entries. No user × item product is formed.
    """
    order = F.lit(ranking) if ranking else F.array().cast("array<int>")
    return F.slice(order if seen is None else F.array_except(order, seen), 1, k)


def popular_lists(
    rows: DataFrame, scores: DataFrame, k: int, max_len: int, exclude_seen: bool = True
) -> DataFrame:
    """Add ``ranked``: each user's top-k popular tokens without those in the history."""
    ranking = popular_ids(scores, k + (max_len if exclude_seen else 0))
    seen = F.col("input_tokens") if exclude_seen else None
    return rows.withColumn("ranked", unseen_in_order(ranking, k, seen))


def top_k(scores: DataFrame, k: int, seen: DataFrame | None = None) -> DataFrame:
    """Best ``k`` tokens per user from (user_id, token_id, score), padding excluded.

    Any scorer can produce the frame. The limit is applied per input partition
    before the shuffle.
    """
    if seen is not None:
        scores = scores.join(seen.select("user_id", "token_id"), ["user_id", "token_id"], "left_anti")
    best = Window.partitionBy("user_id").orderBy(F.desc("score"), F.asc("token_id"))
    ranked = scores.filter("token_id > 0").withColumn("position", F.row_number().over(best))
    return ranked.filter(F.col("position") <= k)


def as_lists(ranked: DataFrame) -> DataFrame:
    """(user_id, ranked) from rows with a position; lists have at most k entries."""
    pairs = F.array_sort(F.collect_list(F.struct("position", "token_id")))
    return ranked.groupBy("user_id").agg(pairs.alias("p")).select(
        "user_id", F.col("p.token_id").alias("ranked")
    )


def from_scorer(rows: DataFrame, scorer, schema: str = "user_id string, token_id int, score double"):
    """Run user code over histories: ``scorer`` maps pandas batches to score batches."""
    return rows.mapInPandas(scorer, schema)


def dominant_category(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """Most frequent category of each history; the one seen first wins a tie."""
    events = rows.select("user_id", F.posexplode("input_tokens").alias("at", "token_id")).join(
        vocab.select("token_id", "category").filter("category <> ''"), "token_id"
    )
    counts = events.groupBy("user_id", "category").agg(
        F.count("*").alias("n"), F.min("at").alias("first_at")
    )
    best = F.max_by("category", F.struct("n", -F.col("first_at")))
    named = counts.groupBy("user_id").agg(best.alias("category"))
    return rows.select("user_id").distinct().join(named, "user_id", "left").select(
        "user_id", F.coalesce("category", F.lit("unknown")).alias("category")
    )
