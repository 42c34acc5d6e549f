"""Ranking evaluation. Per-user metrics are computed inside one row."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfstream.functions import actions as A
from shelfstream.functions import scalars as S
from shelfstream.operators.lists import dominant_category
from shelfstream.scale import hash_uint32, order_statistics, running_totals

METRICS = ("recall", "ndcg", "hit_rate")


def usable_ks(ks: Sequence[int], vocab_size: int) -> tuple[list[int], list[int]]:
    """(kept, dropped): a k that covers the whole vocabulary measures nothing."""
    kept = [k for k in ks if k < vocab_size]
    dropped = [k for k in ks if k >= vocab_size]
    return kept or [max(1, vocab_size // 10)], dropped


def _defined(value: Column, wanted: Column) -> Column:
    """No targets means undefined, never zero."""
    return F.when(F.size(wanted) > 0, value)


def recall(ranked: Column, wanted: Column, k: int) -> Column:
    hits = F.size(F.array_intersect(F.slice(ranked, 1, k), wanted))
    return _defined(hits / F.least(F.size(wanted), F.lit(k)), wanted)


def ndcg(ranked: Column, wanted: Column, k: int) -> Column:
    gains = F.transform(
        F.slice(ranked, 1, k),
        lambda x, i: F.when(F.array_contains(wanted, x), S.rank_discount(i)).otherwise(F.lit(0.0)),
    )
    gain = F.aggregate(gains, F.lit(0.0), lambda total, g: total + g)
    best, ideal = 0.0, []
    for position in range(k):
        best += 1 / math.log2(position + 2)
        ideal.append(best)
    return _defined(gain / F.get(F.lit(ideal), F.least(F.size(wanted), F.lit(k)) - 1), wanted)


def hit_rate(ranked: Column, wanted: Column, k: int) -> Column:
    return _defined(F.arrays_overlap(F.slice(ranked, 1, k), wanted).cast("double"), wanted)


def with_metrics(
    lists: DataFrame, ks: Sequence[int], ranked: str = "ranked", wanted: str = "target_tokens"
) -> DataFrame:
    """Add recall_k, ndcg_k and hit_rate_k for every k; no shuffle."""
    r, w = F.col(ranked), F.array_distinct(wanted)
    made = {"recall": recall, "ndcg": ndcg, "hit_rate": hit_rate}
    return lists.withColumns({f"{m}_{k}": made[m](r, w, k) for k in ks for m in METRICS})


def coverage(lists: DataFrame, k: int, vocab_size: int, ranked: str = "ranked") -> DataFrame:
    """Distinct recommended tokens over the vocabulary including the padding id."""
    shown = lists.select(F.explode(F.slice(ranked, 1, k)).alias("token_id"))
    return shown.agg(
        (F.count_distinct("token_id") / F.lit(vocab_size + 1)).alias(f"coverage_{k}")
    )


def means(per_user: DataFrame, ks: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    cells = [F.avg(f"{m}_{k}").alias(f"{m}_{k}") for k in ks for m in METRICS]
    return per_user.groupBy(*by).agg(F.count("*").alias("eval_users"), *cells)


def evaluate(lists: DataFrame, vocab: DataFrame, ks: Sequence[int], vocab_size: int) -> DataFrame:
    """Long form (scope, metric, value): overall, per dominant category, coverage."""
    scored = with_metrics(lists.filter(F.size("target_tokens") > 0), ks)
    labelled = scored.join(dominant_category(scored, vocab), "user_id")
    names = [f"{m}_{k}" for k in ks for m in METRICS] + ["eval_users"]
    grouped = labelled.withColumn("scope", F.explode(F.array(F.lit("overall"), "category")))
    table = means(grouped, ks, ["scope"])
    table = table.withColumn("eval_users", F.col("eval_users").cast("double"))
    out = table.unpivot(["scope"], names, "metric", "value")
    for k in ks:
        name = f"coverage_{k}"
        one = coverage(scored, k, vocab_size).select(
            F.lit("overall").alias("scope"), F.lit(name).alias("metric"), F.col(name).alias("value")
        )
        out = out.unionByName(one)
    return out


def auc(df: DataFrame, score: str, label: str, groups: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve per group, ties averaged, null with one class.

    Equal scores are merged first; the cumulative count then runs over pieces
    of the score range, so one huge group is no obstacle.
    """
    groups = list(groups)
    distinct = df.groupBy(*groups, F.col(score).cast("double").alias("_s")).agg(
        F.sum((F.col(label) > 0).cast("long")).alias("_p"),
        F.sum((F.col(label) <= 0).cast("long")).alias("_q"),
    )
    run = running_totals(distinct, groups, ["_s"], {"_below": "_q"})
    won = F.sum(F.col("_p") * (F.col("_below") - F.col("_q") + F.col("_q") / 2))
    table = run.groupBy(*groups).agg(
        won.alias("_won"), F.sum("_p").alias("positives"), F.sum("_q").alias("negatives")
    )
    return table.select(
        *groups,
        F.try_divide(F.col("_won"), F.col("positives") * F.col("negatives")).alias("auc"),
        "positives",
        "negatives",
    )


def head_quality(labelled: DataFrame, score: str = "score") -> DataFrame:
    """AUC, positions and positive rate per head from (head, label, score) rows."""
    table = auc(labelled, score, "label", ["head"])
    n = F.col("positives") + F.col("negatives")
    return table.select(
        "head", "auc", n.alias("positions"), (F.col("positives") / n).alias("positive_rate")
    )


def discrimination(rows: DataFrame, scores: DataFrame, signals: Sequence[str]) -> DataFrame:
    """Rank of the true item among sampled negatives, per user and signal.

    ``rows`` come from ``training.negatives``; ``scores`` has token_id and one
    column per signal. A token without a score counts as 0.
    """
    pool = rows.select(
        "user_id",
        "positive",
        F.explode(
            F.concat(
                F.array("positive"),
                F.filter("negatives", lambda x: x != F.col("positive")),
            )
        ).alias("token_id"),
    )
    scored = pool.join(scores, "token_id", "left").fillna(0.0, subset=list(signals))
    own = Window.partitionBy("user_id")
    beaten = []
    for s in signals:
        true_score = F.max(F.when(F.col("token_id") == F.col("positive"), F.col(s))).over(own)
        beaten.append((F.col(s) > true_score).cast("int").alias(f"_{s}"))
    marked = scored.select("user_id", *beaten)
    ranks = marked.groupBy("user_id").agg(*[(F.sum(f"_{s}") + 1).alias(s) for s in signals])
    return ranks.unpivot(["user_id"], list(signals), "signal", "rank").withColumn(
        "reciprocal_rank", 1 / F.col("rank")
    )


def discrimination_summary(ranks: DataFrame, pool_size: int) -> DataFrame:
    """hit@1, hit@10, MRR and median rank per signal, with the random baseline."""
    by_chance = sum(1 / r for r in range(1, pool_size + 1)) / pool_size
    return ranks.groupBy("signal").agg(
        F.count("*").alias("users"),
        F.avg((F.col("rank") == 1).cast("double")).alias("hit_at_1"),
        F.avg((F.col("rank") <= 10).cast("double")).alias("hit_at_10"),
        F.avg("reciprocal_rank").alias("mrr"),
        # Ranks are at most the pool size, so the distinct values are few.
        F.percentile("rank", 0.5).alias("median_rank"),
        F.lit(1 / pool_size).alias("random_hit_at_1"),
        F.lit(by_chance).alias("random_mrr"),
    )


def slates(lists: DataFrame) -> DataFrame:
    """One row per shown candidate with the action its user later took on it.

    Positives are not forced in. ``action`` is null where the candidate is not
    a target; a target without a known action has 0. Positions start at 0.
    """
    shown = lists.select(
        "user_id",
        "target_tokens",
        "target_actions",
        F.posexplode("ranked").alias("position", "token_id"),
    )
    at = F.array_position("target_tokens", F.col("token_id")).cast("int")
    action = F.when(at > 0, F.coalesce(F.get("target_actions", at - 1), F.lit(A.PADDING_ACTION)))
    return shown.select("user_id", "position", "token_id", action.alias("action"))


def slate_labels(slate: DataFrame) -> DataFrame:
    """Long form with a 0/1 label per head, plus ``any``."""
    cells = [
        F.struct(
            F.lit(head).alias("head"),
            F.coalesce(F.col("action").isin(*A.head_action_ids(head)), F.lit(False))
            .cast("int")
            .alias("label"),
        )
        for head in A.HEAD_ACTIONS
    ]
    cells.append(
        F.struct(F.lit("any").alias("head"), F.col("action").isNotNull().cast("int").alias("label"))
    )
    return slate.select("*", F.inline(F.array(*cells)))


def order_quality(labelled: DataFrame) -> DataFrame:
    """AUC of the slate order itself, per head: the control for any re-ranker."""
    return auc(labelled.withColumn("_order", -F.col("position")), "_order", "label", ["head"])


def reranked(lists: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """Same candidates in their own and in a second order, with metrics for both.

    ``scores`` has (user_id, token_id, score) or (token_id, score). Lists are
    bounded by the slate length, so reordering collects no more than that.
    """
    on = [c for c in ("user_id", "token_id") if c in scores.columns]
    shown = lists.select("user_id", F.posexplode("ranked").alias("position", "token_id"))
    pairs = shown.join(scores.select(*on, "score"), on, "left").fillna(0.0, ["score"])
    order = F.array_sort(
        F.collect_list(F.struct((-F.col("score")).alias("s"), "position", "token_id"))
    )
    second = pairs.groupBy("user_id").agg(order.alias("o")).select(
        "user_id", F.col("o.token_id").alias("reordered")
    )
    both = lists.join(second, "user_id")
    before = with_metrics(both, [k], "ranked").withColumnsRenamed(
        {f"{m}_{k}": f"retrieval_{m}_{k}" for m in METRICS}
    )
    after = with_metrics(before, [k], "reordered").withColumnsRenamed(
        {f"{m}_{k}": f"reranked_{m}_{k}" for m in METRICS}
    )
    changed = F.get("ranked", F.lit(0)) != F.get("reordered", F.lit(0))
    return after.withColumn("top1_changed", changed.cast("double"))


def rerank_uplift(rows: DataFrame, k: int) -> DataFrame:
    cells = [
        F.avg(f"{side}_{m}_{k}").alias(f"{side}_{m}_{k}")
        for side in ("retrieval", "reranked")
        for m in ("ndcg", "recall")
    ]
    table = rows.agg(
        F.count("*").alias("users"), *cells, F.avg("top1_changed").alias("top1_changed_share")
    )
    a, b = F.col(f"retrieval_ndcg_{k}"), F.col(f"reranked_ndcg_{k}")
    return table.withColumn("ndcg_delta_pct", F.try_divide((b - a) * 100, a))


def arms_table(runs: DataFrame, control: str = "control") -> DataFrame:
    """Summary per (arm, head) of runs (arm, head, seed, auc) against the control arm."""
    summary = runs.groupBy("arm", "head").agg(
        F.count("*").alias("runs"),
        F.avg("auc").alias("auc_mean"),
        F.coalesce(F.stddev_samp("auc"), F.lit(0.0)).alias("auc_std"),
    )
    base = summary.filter(F.col("arm") == control).select(
        "head", F.col("auc_mean").alias("_m"), F.col("auc_std").alias("_s")
    )
    over, base_over = F.col("auc_mean") - 0.5, F.col("_m") - 0.5
    return summary.join(base, "head", "left").select(
        "arm",
        "head",
        "runs",
        "auc_mean",
        "auc_std",
        over.alias("over_chance"),
        base_over.alias("control_over_chance"),
        F.when(F.abs(base_over) > 1e-9, over / base_over).alias("vs_control"),
        (
            (F.col("_s") > 0) & (F.abs(F.col("auc_mean") - F.col("_m")) > 2 * F.col("_s"))
        ).alias("beyond_seed_noise"),
    )


def release_gate(
    ordering: DataFrame,
    bias: DataFrame | None = None,
    min_relative_mrr: float = 1.0,
    max_bias_ratio: float = 4.0,
    heads: Sequence[str] = ("purchase", "cart", "click", "return"),
) -> DataFrame:
    """One row: may the second stage go live? What cannot be measured blocks.

    ``ordering`` is one row with ranker_mrr, retrieval_mrr and the paired
    interval of the difference (ci_low, ci_high, nullable); ``bias`` has
    (head, bias_ratio) measured on slates.
    """
    ratio = F.try_divide("ranker_mrr", "retrieval_mrr")
    regression = F.coalesce(F.col("ci_high") < 0, F.lit(False))
    measured = F.col("ranker_mrr").isNotNull() & F.col("retrieval_mrr").isNotNull()
    infinite = F.col("retrieval_mrr") == 0
    row = ordering.select(
        "*",
        F.round(ratio, 4).alias("relative_mrr"),
        (
            measured & (F.coalesce(ratio >= min_relative_mrr, F.lit(False)) | infinite) & ~regression
        ).alias("ordering_passed"),
    )
    if bias is None:
        return row.withColumn("calibration_passed", F.lit(None).cast("boolean")).withColumn(
            "passed", F.col("ordering_passed")
        ).withColumn("reason", F.when(F.col("passed"), "ordering holds").otherwise("ordering"))
    known = bias.filter(F.col("head").isin(*heads) & (F.col("bias_ratio") > 0))
    distance = F.greatest("bias_ratio", 1 / F.col("bias_ratio"))
    worst = known.agg(
        F.count_distinct("head").alias("measured_heads"),
        F.max(distance).alias("worst_bias_ratio"),
        F.max_by("head", F.struct(distance, "head")).alias("worst_head"),
    )
    all_measured = F.col("measured_heads") == len(heads)
    scale_ok = all_measured & (F.col("worst_bias_ratio") <= max_bias_ratio)
    joined = row.withColumn("_k", F.lit(1)).join(worst.withColumn("_k", F.lit(1)), "_k").drop("_k")
    calibration = F.coalesce(scale_ok, F.lit(False))
    reasons = F.concat_ws(
        "; ",
        F.when(~measured, "ordering not measured"),
        F.when(measured & ~F.col("ordering_passed"), "ordering is worse than retrieval"),
        F.when(~all_measured, "a head is not measured on slates"),
        F.when(all_measured & ~calibration, "a head is too far from its true rate"),
    )
    return joined.select(
        "*",
        calibration.alias("calibration_passed"),
        (F.col("ordering_passed") & calibration).alias("passed"),
        F.when(reasons == "", "ordering and scale hold").otherwise(reasons).alias("reason"),
    )


def keep_users(
    rows: DataFrame, share: float, seed: int = 0, least_active: bool = False
) -> DataFrame:
    """A share of whole users: hash order, or the least active ones first.

    The cut is a quantile of the order key found without sorting all users in
    one task; users on the boundary are resolved by their id.
    """
    if share >= 1:
        return rows
    key = F.size("input_tokens").cast("double") if least_active else F.lit(0.0)
    keyed = rows.withColumn("_a", key).withColumn("_h", hash_uint32("user_id", seed=seed))
    wanted = max(1, round(rows.count() * share))
    # Both keys are whole numbers, so one exact double orders by (activity, hash).
    keyed = keyed.withColumn("_o", F.col("_a") * 4294967296.0 + F.col("_h"))
    return _first_by(keyed, "_o", "user_id", wanted).drop("_a", "_h", "_o")


def _first_by(df: DataFrame, key: str, tie: str, n: int) -> DataFrame:
    """The ``n`` rows smallest by (key, tie), cut at an exact order statistic."""
    found = order_statistics(df, key, lambda total: {min(n, total) - 1})
    if None not in found or n >= found[None][0]:
        return df
    (at,) = found[None][1].values()
    below = df.filter(F.col(key) < at).count()
    on_edge = df.filter(F.col(key) == at).orderBy(tie).limit(n - below)
    return df.filter(F.col(key) < at).unionByName(on_edge)


def consent_cost(points: DataFrame) -> DataFrame:
    """Relative metric per opt-in rate from runs (rate, seed, value); rate 1 is the control."""
    table = points.groupBy("rate").agg(
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
    )
    control = table.filter("rate = 1").select(
        F.lit(1).alias("_k"), F.col("mean").alias("_m"), F.col("std").alias("_s")
    )
    joined = table.withColumn("_k", F.lit(1)).join(control, "_k", "left")
    return joined.select(
        "rate",
        "mean",
        "std",
        F.try_divide("mean", "_m").alias("relative"),
        ((F.col("_s") > 0) & (F.col("_m") - F.col("mean") > 2 * F.col("_s"))).alias(
            "beyond_seed_noise"
        ),
    )


def pooled_over_seeds(runs: DataFrame, mark: bool = False) -> DataFrame:
    """Mean per (arm, user) over seeds; a user missing from a run is an error.

    ``runs`` has arm, seed, user_id, value. The check compares each user's runs
    with the number of seeds of the arm. With ``mark`` such users are no error:
    all stay, and ``complete`` tells them apart.
    """
    pooled = runs.groupBy("arm", "user_id").agg(
        F.avg("value").alias("value"), F.count("*").alias("_runs")
    )
    seeds = runs.groupBy("arm").agg(F.count_distinct("seed").alias("_seeds"))
    checked = pooled.join(seeds, "arm")
    if mark:
        return checked.select("arm", "user_id", "value", (F.col("_runs") == F.col("_seeds")).alias("complete"))
    aligned = F.when(
        F.col("_runs") != F.col("_seeds"),
        F.raise_error(F.lit("test users are not aligned across runs")),
    ).otherwise(F.lit(True))
    return checked.filter(aligned).select("arm", "user_id", "value")
