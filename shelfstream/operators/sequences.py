"""From silver events to per-user sequences, targets and vocabulary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfstream.functions import actions as A
from shelfstream.functions import scalars as S
from shelfstream.functions.tokens import TokenRules, token
from shelfstream.operators.cleaning import in_window, with_types
from shelfstream.scale import cut, exact_quantiles, global_row_number

SEQUENCE_COLUMNS = (
    "user_id",
    "input_tokens",
    "input_actions",
    "input_ts",
    "input_returned",
    "target_tokens",
    "target_actions",
    "split",
)


def with_tokens(events: DataFrame, hierarchy: DataFrame, rules: TokenRules) -> DataFrame:
    """Attach category and token of each event's SKU.

    The token is resolved on the catalogue side, once per SKU and not per event.
    """
    resolved = hierarchy.select("sku", "category", "product_id", token(rules).alias("token"))
    return events.join(resolved, "sku").withColumn(
        "event_ts_unix", S.unix_seconds(F.col("event_ts"))
    )


def with_return_evidence(events: DataFrame) -> DataFrame:
    """Add ``_back``: true for a purchase whose order and SKU came back, else null.

    Only purchases that name an order can match, so all other rows get a null
    key and never meet a return.
    """
    keys = ["_user", "_order", "_sku"]
    returns = (
        events.filter((F.col("event_type") == "return") & (F.col("order_id") != ""))
        .select(
            F.col("user_id").alias("_user"),
            F.col("order_id").alias("_order"),
            F.col("sku").alias("_sku"),
        )
        .dropDuplicates(keys)
        .withColumn("_back", F.lit(True))
    )
    bought = F.col("event_type") == "purchase"
    probe = events.withColumn("_key", F.when(bought & (F.col("order_id") != ""), F.col("order_id")))
    return probe.join(
        returns,
        (F.col("user_id") == F.col("_user"))
        & (F.col("_key") == F.col("_order"))
        & (F.col("sku") == F.col("_sku")),
        "left",
    ).drop("_key", *keys)


def label_returns(events: DataFrame, window_days: int, newest: int) -> DataFrame:
    """``_back`` of :func:`with_return_evidence` to ``returned``, the label; local to a row."""
    bought = F.col("event_type") == "purchase"
    matured_before = newest - window_days * 86400
    label = (
        F.when(~bought, A.NOT_A_PURCHASE)
        .when(F.col("_back"), A.RETURNED)
        .when(S.unix_seconds(F.col("event_ts")) > matured_before, A.IMMATURE)
        .otherwise(A.KEPT)
    )
    return events.withColumn("returned", label).drop("_back")


def with_return_labels(events: DataFrame, window_days: int, newest: int) -> DataFrame:
    """Label purchases as returned, kept or too recent to tell.

    Evidence after the training cutoff counts on purpose: the label is about
    the purchase.
    """
    return label_returns(with_return_evidence(events), window_days, newest)


class DegenerateSplit(ValueError):
    """The time cutoffs do not leave three non-empty windows."""


def time_cutoffs(
    events: DataFrame,
    train: float = 0.8,
    val: float = 0.1,
    approximate: float = 0.0,
    column: str = "event_ts_unix",
) -> tuple[int, int, int]:
    """Global cutoffs (t1, t2) at exact percentiles of event time, and the newest time.

    ``approximate`` > 0 trades exactness (and independence from file layout)
    for a single sketch aggregate with that relative error.
    """
    probabilities = [train, train + val]
    if approximate > 0:
        row = events.agg(
            F.min(column).alias("low"),
            F.max(column).alias("high"),
            F.percentile_approx(column, probabilities, max(int(1 / approximate), 1)).alias("q"),
        ).first()
        low, high, found = row["low"], row["high"], row["q"]
    else:
        low, *found, high = exact_quantiles(events, column, [0.0, *probabilities, 1.0]).get(
            None, [0, 0, 0, 0]
        )
    t1, t2 = int(found[0]), int(found[1])
    if not low < t1 < t2 <= high:
        raise DegenerateSplit(f"cutoffs {t1}, {t2} do not split [{low}, {high}]")
    return t1, t2, int(high)


def vocabulary(train_events: DataFrame) -> DataFrame:
    """token_id (1 = most frequent), token, category, train_events."""
    counts = train_events.groupBy("token").agg(
        F.count("*").alias("train_events"), F.min("category").alias("category")
    )
    numbered = global_row_number(counts, [F.desc("train_events"), F.asc("token")], "token_id")
    return numbered.select(
        F.col("token_id").cast("int").alias("token_id"), "token", "category", "train_events"
    )


def with_ids(events: DataFrame, vocab: DataFrame) -> DataFrame:
    """Attach token ids; events outside the vocabulary disappear."""
    return events.join(vocab.select("token", "token_id"), "token")


def event_arrays(events: DataFrame, max_len: int) -> DataFrame:
    """One row per user with parallel arrays of the newest ``max_len`` events.

    The row-number limit runs before the shuffle, so at most ``max_len`` rows
    per user and input partition move and a collected list is never longer.
    """
    newest_first = Window.partitionBy("user_id").orderBy(F.desc("event_rank"))
    recent = events.withColumn("_n", F.row_number().over(newest_first)).filter(
        F.col("_n") <= max_len
    )
    packed = recent.groupBy("user_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "event_rank",
                    "token_id",
                    "event_type",
                    S.unix_seconds(F.col("event_ts")).alias("ts"),
                    "returned",
                )
            )
        ).alias("e")
    )
    return packed.select(
        "user_id",
        F.col("e.token_id").alias("input_tokens"),
        F.col("e.event_type").alias("input_actions"),
        F.col("e.ts").alias("input_ts"),
        F.col("e.returned").alias("input_returned"),
    )


def strongest_actions(events: DataFrame) -> DataFrame:
    """Most committed action per (user, token)."""
    best = events.groupBy("user_id", "token_id").agg(
        F.max(A.commitment(F.col("event_type"))).alias("commitment")
    )
    return best.withColumn("action_id", A.action_of_commitment(F.col("commitment")))


def targets(events: DataFrame, types: Sequence[str] = ()) -> DataFrame:
    """Aligned target arrays per user, sorted by token id."""
    pairs = F.array_sort(F.collect_list(F.struct("token_id", "action_id")))
    packed = strongest_actions(with_types(events, types)).groupBy("user_id").agg(pairs.alias("p"))
    return packed.select(
        "user_id",
        F.col("p.token_id").alias("target_tokens"),
        F.col("p.action_id").alias("target_actions"),
    )


def long_enough(rows: DataFrame, least: int) -> DataFrame:
    return rows.filter(F.size("input_tokens") >= least)


def sequence_rows(
    events: DataFrame,
    vocab: DataFrame,
    t1: int,
    t2: int,
    max_len: int = 200,
    min_input: int = 3,
    target_types: Sequence[str] = (),
) -> DataFrame:
    """train / val / test rows: history before the cutoff, targets after it."""
    # What the five windows below read of an event, joined with the vocabulary once and not for each.
    columns = ["user_id", "token", "event_rank", "event_type", "event_ts", "event_ts_unix", "returned"]
    known = cut(with_ids(events.select(*columns), vocab).drop("token"))
    # The train and the val rows read it.
    train = cut(long_enough(event_arrays(in_window(known, None, t1), max_len), min_input))
    test = long_enough(event_arrays(in_window(known, None, t2), max_len), min_input)
    none = F.array().cast("array<int>")
    parts = [
        train.withColumn("target_tokens", none).withColumn("target_actions", none),
        train.join(targets(in_window(known, t1, t2), target_types), "user_id"),
        test.join(targets(in_window(known, t2, None), target_types), "user_id"),
    ]
    named = [
        part.withColumn("split", F.lit(name)).select(*SEQUENCE_COLUMNS)
        for part, name in zip(parts, ("train", "val", "test"), strict=True)
    ]
    return named[0].unionByName(named[1]).unionByName(named[2])


def sparsity(events: DataFrame, vocab: DataFrame, t1: int, rare: int = 5) -> DataFrame:
    """One row: vocabulary density and what the return label has to learn from.

    ``events`` carry tokens and return labels; purchases are those before ``t1``
    that are in the vocabulary.
    """
    words = vocab.agg(
        F.count("*").alias("vocab_size"),
        F.count_if(F.col("train_events") < rare).alias("tokens_under_5_events"),
    )
    skus = events.agg(F.count_distinct("sku").alias("distinct_skus"))
    bought = with_ids(in_window(events, None, t1), vocab).filter("event_type = 'purchase'")
    labels = bought.agg(
        F.count("*").alias("train_purchases"),
        F.count_if(F.col("returned").isin(A.KEPT, A.RETURNED)).alias("purchases_matured"),
        F.count_if(F.col("returned") == A.RETURNED).alias("purchases_returned"),
        F.count_if(F.col("returned") == A.IMMATURE).alias("purchases_immature"),
    )
    # Three one-row aggregates, joined on a constant.
    one = [d.withColumn("_k", F.lit(1)) for d in (words, skus, labels)]
    row = one[0].join(one[1], "_k").join(one[2], "_k").drop("_k")
    return row.select(
        "*",
        F.round(F.try_divide("distinct_skus", "vocab_size"), 3).alias("compression_vs_sku"),
        F.round(F.try_divide("tokens_under_5_events", "vocab_size"), 4).alias(
            "sparse_token_share"
        ),
        F.round(F.try_divide("purchases_returned", "purchases_matured"), 4).alias("return_rate"),
    )


def users_per_split(sequences: DataFrame) -> DataFrame:
    return sequences.groupBy("split").agg(F.count("*").alias("users"))
