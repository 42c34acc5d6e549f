"""Resampling statistics over per-user values.

A resample is defined by a weight that is a pure function of (user, resample),
so any partitioning gives the same numbers. Each task keeps one pair of sums
per resample; rows are never multiplied by resamples.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfstream.scale import hash_uint32

# Modulus of the mixing function: x -> x**5 permutes the residues of this prime.
PRIME = 2147483647
STEP = 1640531527
FLIP = 97531
# A Poisson(1) draw is the number of these limits at or below a uniform residue.
POISSON_LIMITS = [
    math.floor(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * PRIME)
    for k in range(10)
]
CHUNK = 2000


def mix(x: np.ndarray) -> np.ndarray:
    x = x % PRIME
    square = x * x % PRIME
    return square * square % PRIME * x % PRIME


def _partial_sums(resamples: int, flips: bool, group: str):
    steps = np.arange(resamples, dtype=np.int64) * STEP % PRIME
    limits = np.array(POISSON_LIMITS, dtype=np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, part in batch.groupby(group, sort=False):
                total = sums.setdefault(name, np.zeros((3, resamples)))
                keys = part["_key"].to_numpy(dtype=np.int64)
                values = part["_value"].to_numpy(dtype=np.float64)
                for at in range(0, len(part), CHUNK):
                    k, v = keys[at : at + CHUNK, None], values[at : at + CHUNK]
                    weight = np.searchsorted(limits, mix(k + steps), side="right")
                    total[0] += weight.sum(axis=0)
                    total[1] += v @ weight
                    if flips:
                        total[2] += v @ (1 - 2 * (mix(k + steps + FLIP) & 1))
        for name, total in sums.items():
            yield pd.DataFrame(
                {
                    group: name,
                    "resample": np.arange(resamples),
                    "w": total[0],
                    "wx": total[1],
                    "sx": total[2],
                }
            )

    return run


def _resampled(
    df: DataFrame, value: str, unit: str, group: str, resamples: int, seed: int, flips: bool
) -> DataFrame:
    usable = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(
        F.col(group).cast("string").alias(group),
        F.pmod(hash_uint32(unit, seed=seed), F.lit(PRIME)).alias("_key"),
        F.col(value).cast("double").alias("_value"),
    )
    partial = usable.mapInPandas(
        _partial_sums(resamples, flips, group),
        f"`{group}` string, resample long, w double, wx double, sx double",
    )
    return partial.groupBy(group, "resample").agg(
        F.sum("w").alias("w"), F.sum("wx").alias("wx"), F.sum("sx").alias("sx")
    )


def bootstrap_ci(
    df: DataFrame,
    value: str,
    unit: str = "user_id",
    group: str = "metric",
    resamples: int = 2000,
    confidence: float = 0.95,
    seed: int = 0,
) -> DataFrame:
    """Percentile bootstrap interval of the mean per group; undefined values are dropped."""
    tail = (1 - confidence) / 2
    draws = _resampled(df, value, unit, group, resamples, seed, False).filter("w > 0")
    # One value per resample, so the exact percentile works on a bounded set.
    limits = draws.groupBy(group).agg(
        F.percentile(F.col("wx") / F.col("w"), [tail, 1 - tail]).alias("q")
    )
    usable = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    point = (
        df.filter(usable)
        .groupBy(F.col(group).cast("string").alias(group))
        .agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    )
    single = F.col("n") == 1
    return point.join(limits, group, "left").select(
        group,
        "mean",
        F.when(single, F.col("mean")).otherwise(F.col("q")[0]).alias("ci_low"),
        F.when(single, F.col("mean")).otherwise(F.col("q")[1]).alias("ci_high"),
        "n",
    )


class Misaligned(ValueError):
    """Two models were not measured on the same users."""


def paired(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Join two models' values on identical users; a user missing on a side is an error."""
    left = a.select(*keys, F.col(value).alias("a"), F.lit(1).alias("_a"))
    right = b.select(*keys, F.col(value).alias("b"), F.lit(1).alias("_b"))
    joined = left.join(right, list(keys), "full_outer")
    aligned = F.when(
        F.col("_a").isNull() | F.col("_b").isNull(),
        F.raise_error(F.lit("evaluation users are not aligned")),
    ).otherwise(F.lit(True))
    return joined.filter(aligned).select(*keys, "a", "b")


def paired_comparison(
    pairs: DataFrame,
    unit: str = "user_id",
    group: str = "metric",
    resamples: int = 2000,
    confidence: float = 0.95,
    seed: int = 0,
) -> DataFrame:
    """Bootstrap interval and sign-flip p-value of mean(a - b) per group.

    Rows where either side is undefined are left out. The +1 in the p-value
    keeps a finite number of resamples from claiming zero.
    """
    tail = (1 - confidence) / 2
    usable = pairs
    for side in ("a", "b"):
        usable = usable.filter(F.col(side).isNotNull() & ~F.isnan(F.col(side).cast("double")))
    usable = usable.withColumn("_d", F.col("a") - F.col("b"))
    point = usable.groupBy(F.col(group).cast("string").alias(group)).agg(
        F.avg("a").alias("mean_a"),
        F.avg("b").alias("mean_b"),
        F.avg("_d").alias("mean_difference"),
        F.count("*").alias("n"),
    )
    draws = _resampled(usable, "_d", unit, group, resamples, seed, True)
    shifted = draws.join(point.select(group, "mean_difference", "n"), group)
    # Resamples that reproduce the observed mean up to rounding count as reaching it.
    reached = F.abs(F.col("sx") / F.col("n")) >= F.abs("mean_difference") - 1e-12
    tested = shifted.groupBy(group).agg(
        F.percentile(F.try_divide("wx", "w"), [tail, 1 - tail]).alias("q"),
        ((F.count_if(reached) + 1) / F.lit(resamples + 1)).alias("p"),
    )
    single = F.col("n") == 1
    d = F.col("mean_difference")
    table = point.join(tested, group).select(
        group,
        "mean_a",
        "mean_b",
        "mean_difference",
        F.when(single, d).otherwise(F.col("q")[0]).alias("ci_low"),
        F.when(single, d).otherwise(F.col("q")[1]).alias("ci_high"),
        F.when(single, F.lit(1.0)).otherwise(F.col("p")).alias("p_value"),
        "n",
    )
    return table.withColumn("verdict", verdict())


def verdict(
    difference: str = "mean_difference", base: str = "mean_b", low: str = "ci_low", high: str = "ci_high"
) -> Column:
    """Direction and size when the interval excludes zero."""
    clear = (F.col(low) > 0) | (F.col(high) < 0)
    direction = F.when(F.col(difference) > 0, "better").otherwise("worse")
    share = F.try_divide(F.abs(F.col(difference) * 100), F.abs(F.col(base)))
    size = F.when(share.isNull(), "-").otherwise(F.format_string("%.1f%%", share))
    return F.when(clear, F.concat_ws(" ", size, direction)).otherwise("no difference detected")


def seed_spread(runs: DataFrame, value: str, groups: Sequence[str]) -> DataFrame:
    usable = runs.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return usable.groupBy(*groups).agg(
        F.count("*").alias("seeds"),
        F.avg(value).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
    )


def holm(tests: DataFrame, family: Sequence[str], name: str = "name", alpha: float = 0.05):
    """Holm-Bonferroni adjusted p-values within each family of tests.

    A family is the set of comparisons in one report, so it is small.
    """
    size = Window.partitionBy(*family)
    order = size.orderBy("p_value", name)
    scaled = tests.withColumn(
        "_s",
        F.least(
            F.lit(1.0),
            (F.count("*").over(size) - F.row_number().over(order) + 1) * F.col("p_value"),
        ),
    )
    steps = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return scaled.withColumn("p_adjusted", F.max("_s").over(steps)).drop("_s").withColumn(
        "significant", F.col("p_adjusted") <= alpha
    )


def compare_models(
    per_user: DataFrame,
    reference: str,
    metrics: Sequence[str],
    resamples: int = 2000,
    seed: int = 0,
) -> DataFrame:
    """Every model against ``reference`` on every metric, Holm-adjusted per model.

    ``per_user`` has model, user_id and one column per metric.
    """
    long = per_user.select("model", "user_id", *metrics).unpivot(
        ["model", "user_id"], list(metrics), "metric", "value"
    )
    base = long.filter(F.col("model") == reference)
    names = [
        r["model"]
        for r in per_user.select("model").distinct().filter(F.col("model") != reference).collect()
    ]
    tables = []
    for model in sorted(names):
        pairs = paired(
            long.filter(F.col("model") == model), base, ["user_id", "metric"]
        )
        result = paired_comparison(pairs, resamples=resamples, seed=seed)
        tables.append(result.withColumn("model", F.lit(model)))
    table = tables[0]
    for other in tables[1:]:
        table = table.unionByName(other)
    return holm(table, ["model"], "metric")


def pooled_comparison(
    pooled: DataFrame,
    tests: Sequence[tuple[str, str, str]],
    resamples: int = 2000,
    confidence: float = 0.95,
    seed: int = 0,
    alpha: float = 0.05,
) -> DataFrame:
    """Paired tests between arms on values pooled per user, Holm-adjusted as one family.

    ``pooled`` has arm, user_id, value (one row per arm and user, see
    ``evaluation.pooled_over_seeds``), ``tests`` the (test, arm, arm compared
    with) triples of a report. The user is the unit: pooling over seeds first
    keeps repeated runs from passing as more users. All tests share one
    shuffle on (test, user); a user who is missing on a side, or there twice,
    is an error, users with an undefined value on a side are left out.
    """
    sides = [F.struct(F.lit(t).alias("test"), F.lit(arm).alias("of"), F.lit(side).alias("side"))
             for t, a, b in tests for side, arm in (("a", a), ("b", b))]
    roles = F.filter(F.array(*sides), lambda s: s["of"] == F.col("arm"))
    rows = pooled.select("user_id", "value", F.explode(roles).alias("_r"))
    value = {side: F.when(F.col("_r.side") == side, F.col("value")) for side in ("a", "b")}
    both = rows.groupBy(F.col("_r.test").alias("test"), "user_id").agg(
        F.max(value["a"]).alias("a"), F.max(value["b"]).alias("b"),
        F.count_if(F.col("_r.side") == "a").alias("_a"), F.count_if(F.col("_r.side") == "b").alias("_b"),
    )
    aligned = F.when(
        (F.col("_a") != 1) | (F.col("_b") != 1), F.raise_error(F.lit("evaluation users are not aligned"))
    ).otherwise(F.lit(True))
    pairs = both.filter(aligned).select("test", "user_id", "a", "b")
    table = paired_comparison(pairs, group="test", resamples=resamples, confidence=confidence, seed=seed)
    family = table.withColumn("_family", F.lit(0))
    return holm(family, ["_family"], "test", alpha).drop("_family")
