"""Recommendation lists for every user in one batch plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfstream.operators import lists as L
from shelfstream.operators import policy as P
from shelfstream.scale import cut


def user_tails(events: DataFrame, n: int = 50) -> DataFrame:
    """Last ``n`` (sku, token, action, ts, session) per user, oldest first."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("event_ts"), F.desc("event_id"))
    recent = events.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= n)
    entry = F.struct(
        (-F.col("_n")).alias("o"),
        "sku",
        "token",
        F.col("event_type").alias("action"),
        F.unix_timestamp("event_ts").alias("event_ts"),
        F.coalesce("session_id", F.lit("")).alias("session_id"),
    )
    return recent.groupBy("user_id").agg(F.array_sort(F.collect_list(entry)).alias("tail")).select(
        "user_id", F.transform("tail", lambda e: e.dropFields("o")).alias("tail")
    )


def tail_histories(tails: DataFrame, vocab: DataFrame) -> DataFrame:
    """Token ids the encoder can read, plus every SKU of the tail.

    A token outside the vocabulary cannot be encoded but its SKU still counts
    as seen.
    """
    events = tails.select("user_id", F.posexplode("tail").alias("at", "e"))
    ids = events.select(
        "user_id", "at", F.col("e.token").alias("token"), F.col("e.sku").alias("sku")
    ).join(vocab.select("token", "token_id"), "token", "left")
    known = F.array_sort(
        F.collect_list(F.when(F.col("token_id").isNotNull(), F.struct("at", "token_id")))
    )
    return ids.groupBy("user_id").agg(
        known.getField("token_id").alias("input_tokens"), F.collect_set("sku").alias("tail_skus")
    )


def candidates(
    ranked: DataFrame, vocab: DataFrame, products: DataFrame, rank_k: int
) -> DataFrame:
    """Ranked lists (user_id, token_id, rank, model_score) to policy candidates.

    ``products`` has (token, product_id). A candidate names its token; the token's SKUs stay in a
    table of their own (see :func:`shelfstream.operators.policy.filtered_by_rows`).
    """
    tokens = vocab.select("token_id", "token", "category").join(
        products.select("token", "product_id"), "token", "left"
    ).withColumn("product_id", F.coalesce("product_id", "token"))
    return ranked.filter(F.col("rank") <= rank_k).join(tokens, "token_id")


def popular_candidates(
    histories: DataFrame, scores: DataFrame, retrieval_k: int, max_history: int
) -> DataFrame:
    """(user_id, token_id, rank, model_score) from the popularity scorer.

    ``histories`` may carry ``hide_seen`` (per surface); where it is false the
    history is not removed. The shared ranking is a bounded list, so users are
    never multiplied by items.
    """
    top = L.most_popular(scores, retrieval_k + max_history).collect()
    ranking = [r["token_id"] for r in top]
    # A short list of known size, hashed once instead of searched for every candidate.
    values = histories.sparkSession.createDataFrame(
        [(r["token_id"], float(r["score"])) for r in top], "token_id int, model_score double"
    )
    seen = F.col("input_tokens")
    if "hide_seen" in histories.columns:
        seen = F.when(F.col("hide_seen"), seen).otherwise(F.array().cast("array<int>"))
    rows = histories.withColumn("ranked", L.unseen_in_order(ranking, retrieval_k, seen))
    return rows.select(
        *[c for c in rows.columns if c not in ("input_tokens", "ranked")],
        F.posexplode("ranked").alias("_p", "token_id"),
    ).withColumn("rank", F.col("_p") + 1).drop("_p").join(values, "token_id")


def recommend(
    users: DataFrame,
    histories: DataFrame,
    scored: DataFrame,
    vocab: DataFrame,
    products: DataFrame,
    skus: DataFrame,
    owned: DataFrame,
    fallback: list[str],
    policy: P.Policy = P.Policy(),
    rank_k: int = 300,
    limit: int = 10,
    model_version: str = "popularity",
) -> tuple[DataFrame, DataFrame]:
    """(shown items, decided candidates) for ``users``.

    ``scored`` holds (user_id, token_id, rank, model_score) from any retrieval
    step, plus user context columns; ``products`` and ``skus`` are the catalogue
    by token (:func:`shelfstream.operators.policy.token_skus`), ``owned`` the
    (user_id, sku) bought before. A user without an encodable history gets
    the fallback list with reason ``cold_start``; one whose list the policy
    emptied gets it with ``policy_emptied``.
    """
    # The served users and the shown rows both read it.
    decided = cut(P.applied(candidates(scored, vocab, products, rank_k), policy, limit, skus, owned))
    shown = decided.filter("position is not null").select(
        "user_id",
        "position",
        "product_id",
        F.col("suggested.sku").alias("suggested_sku"),
        F.col("final_score").alias("score"),
        "reason_code",
        F.lit("model").alias("served_from"),
        F.lit(model_version).alias("model_version"),
    )
    warm = histories.filter(F.size("input_tokens") > 0).select("user_id", F.lit(1).alias("_w"))
    served = shown.select("user_id").distinct().withColumn("_s", F.lit(1))
    empty = users.select("user_id").join(warm, "user_id", "left").join(served, "user_id", "left")
    reason = F.when(F.col("_w").isNull(), "cold_start").otherwise("policy_emptied")
    items = F.lit(fallback[:limit]) if fallback else F.array().cast("array<string>")
    spare = empty.filter("_s is null").select(
        "user_id", reason.alias("served_from"), F.posexplode(items).alias("position", "product_id")
    )
    spare = spare.select(
        "user_id",
        F.col("position").cast("int").alias("position"),
        "product_id",
        F.lit(None).cast("string").alias("suggested_sku"),
        F.lit(0.0).alias("score"),
        F.col("served_from").alias("reason_code"),
        "served_from",
        F.lit(f"{model_version}+fallback").alias("model_version"),
    )
    return shown.unionByName(spare), decided


def exposure_rows(
    shown: DataFrame, request_id: Column, surface: str, served_ts: Column
) -> DataFrame:
    """One row per served list with its items as an ordered array."""
    item = F.struct("position", "product_id", "suggested_sku", "score", "reason_code")
    grouped = shown.groupBy("user_id", "model_version").agg(
        F.array_sort(F.collect_list(item)).alias("items")
    )
    return grouped.select(
        request_id.alias("request_id"),
        "user_id",
        F.lit(None).cast("string").alias("session_id"),
        F.lit(surface).alias("surface"),
        "model_version",
        served_ts.cast("timestamp").alias("served_ts"),
        F.lit(None).cast("double").alias("latency_ms"),
        "items",
    )
