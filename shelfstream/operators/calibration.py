"""Do probabilities mean what they say, and can they be corrected?

All functions take rows of (head, label, p) where ``head`` has few values, and
answer for every head in one pass. Fits run on rows merged by distinct
probability, so an iteration is one aggregate over a far smaller table.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfstream.functions import scalars as S
from shelfstream.operators import isotonic
from shelfstream.scale import bin_index, cut, exact_quantiles, hash_unit


def usable(df: DataFrame, label: str = "label", p: str = "p") -> DataFrame:
    """Finite rows with the probability clipped to [0, 1]."""
    y, x = F.col(label).cast("double"), F.col(p).cast("double")
    finite = y.isNotNull() & x.isNotNull() & ~F.isnan(y) & ~F.isnan(x)
    return df.filter(finite).select(
        "head", y.alias("label"), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)).alias("p")
    )


def brier(df: DataFrame) -> DataFrame:
    gap = F.col("p") - F.col("label")
    return usable(df).groupBy("head").agg(F.avg(gap * gap).alias("brier"))


def bin_edges(df: DataFrame, bins: int = 10, strategy: str = "quantile") -> dict[str, list[float]]:
    """Distinct edges per head: equal mass (default) or equal width."""
    bins = max(1, int(bins))
    if strategy == "uniform":
        heads = [r["head"] for r in df.select("head").distinct().collect()]
        return {h: [i / bins for i in range(bins + 1)] for h in heads}
    if strategy != "quantile":
        raise ValueError(f"unknown binning strategy {strategy!r}")
    found = exact_quantiles(df, "p", [i / bins for i in range(bins + 1)], by="head")
    edges = {h: sorted(set(q)) for h, q in found.items()}
    return {h: e if len(e) > 1 else [e[0], e[0] + S.EPSILON] for h, e in edges.items()}


def reliability_bins(df: DataFrame, bins: int = 10, strategy: str = "quantile") -> DataFrame:
    """Promise against outcome per (head, bin); empty bins do not appear."""
    data = usable(df)
    edges = bin_edges(data, bins, strategy)
    index = F.coalesce(
        *[
            F.when(F.col("head") == head, bin_index(F.col("p"), e[1:-1]))
            for head, e in edges.items()
        ],
        F.lit(0),
    )
    gap = F.col("p") - F.col("label")
    table = (
        data.withColumn("bin", index)
        .groupBy("head", "bin")
        .agg(
            F.count("*").alias("n"),
            F.avg("p").alias("mean_predicted"),
            F.avg("label").alias("observed_rate"),
            F.sum("label").alias("positives"),
            F.sum(gap * gap).alias("squared_error"),
        )
    )
    bounds = F.create_map(
        *[x for h, e in edges.items() for x in (F.lit(h), F.lit([float(v) for v in e]))]
    )[F.col("head")]
    return table.select(
        "head",
        "bin",
        F.get(bounds, F.col("bin")).alias("lower"),
        F.get(bounds, F.col("bin") + 1).alias("upper"),
        "n",
        "mean_predicted",
        "observed_rate",
        (F.col("mean_predicted") - F.col("observed_rate")).alias("gap"),
        "positives",
        "squared_error",
    )


def report(bins: DataFrame) -> DataFrame:
    """One row per head from the reliability table."""
    n = F.sum("n")
    base = (F.sum("positives") / n).alias("base_rate")
    totals = Window.partitionBy("head")
    rate = F.sum("positives").over(totals) / F.sum("n").over(totals)
    rows = bins.withColumn("_base", rate)

    def weighted(value):
        return F.sum(F.col("n") * value) / n

    table = rows.groupBy("head").agg(
        n.alias("n"),
        F.sum("positives").alias("positives"),
        base,
        weighted(F.col("mean_predicted")).alias("mean_predicted"),
        (F.sum("squared_error") / n).alias("brier"),
        weighted(F.abs("gap")).alias("ece"),
        F.max(F.abs("gap")).alias("mce"),
        weighted(F.pow("gap", F.lit(2))).alias("reliability"),
        weighted(F.pow(F.col("observed_rate") - F.col("_base"), F.lit(2))).alias("resolution"),
    )
    table = table.withColumn("uncertainty", F.col("base_rate") * (1 - F.col("base_rate")))
    table = table.withColumn(
        "binned_brier", F.col("reliability") - F.col("resolution") + F.col("uncertainty")
    )
    derived = table.select(
        "*",
        (1 - F.try_divide("brier", "uncertainty")).alias("brier_skill"),
        F.try_divide("mean_predicted", "base_rate").alias("bias_ratio"),
        F.try_divide("ece", "base_rate").alias("ece_relative"),
        F.try_divide("resolution", "uncertainty").alias("resolution_share"),
        (F.col("brier") - F.col("binned_brier")).alias("overdispersion"),
    )
    return derived.withColumn("verdict", verdict())


def calibration_report(df: DataFrame, bins: int = 10, strategy: str = "quantile") -> DataFrame:
    return report(reliability_bins(df, bins, strategy))


def verdict() -> Column:
    """A phrase for the report row; calibrated and informative are separate questions."""
    ratio = F.col("bias_ratio")
    informative = F.coalesce(F.col("resolution_share") >= 0.01, F.lit(False))
    good = ratio.between(0.8, 1.25) & (F.col("ece_relative") < 0.25)
    side = F.when(ratio > 1, "over").otherwise("under")
    factor = F.when(ratio > 1, ratio).otherwise(F.try_divide(F.lit(1.0), ratio))
    tail = F.when(informative, "").otherwise(", and uninformative")
    off = F.concat(side, F.lit("-confident by "), F.format_string("%.1fx", factor), tail)
    return (
        F.when((F.col("n") < 50) | (F.col("positives") < 5), "too few outcomes to judge")
        .when(ratio.isNull(), "no positives, calibration undefined")
        .when(good & informative, "calibrated")
        .when(good, "calibrated but uninformative")
        .otherwise(F.coalesce(off, F.concat(side, F.lit("-confident by infx"), tail)))
    )


def merged(df: DataFrame) -> DataFrame:
    """(head, p, n, positives): rows with equal probability as one."""
    return usable(df).groupBy("head", "p").agg(
        F.count("*").alias("n"), F.sum("label").alias("positives")
    )


def _of_head(values: Mapping[str, float]) -> Column:
    pairs = [x for h, v in values.items() for x in (F.lit(h), F.lit(float(v)))]
    return F.create_map(*pairs)[F.col("head")]


def fit_platt(
    df: DataFrame, iterations: int = 100, ridge: float = 1e-10, halvings: int = 40
) -> dict[str, tuple[float, float]]:
    """Slope and intercept on the logit per head, by damped Newton steps.

    Targets are smoothed so that near-separable classes do not drive the slope
    to infinity. One aggregate for all heads together gives the loss and the
    derivatives at the trial point, so an accepted step costs one job.
    """
    rows = cut(merged(df).withColumn("z", S.logit(F.col("p"))))
    totals = rows.groupBy("head").agg(
        F.sum("n").alias("n"),
        F.sum("positives").alias("pos"),
        (F.sum(F.col("n") * F.col("z")) / F.sum("n")).alias("z"),
    )
    high, low, trial = {}, {}, {}
    for r in totals.collect():
        head = r["head"]
        high[head] = (r["pos"] + 1) / (r["pos"] + 2)
        low[head] = 1 / (r["n"] - r["pos"] + 2)
        mean = (r["pos"] * high[head] + (r["n"] - r["pos"]) * low[head]) / r["n"]
        trial[head] = (1.0, math.log(mean / (1 - mean)) - r["z"])
    if not trial:
        return {}
    z, n = F.col("z"), F.col("n")
    t = F.col("positives") * _of_head(high) + (n - F.col("positives")) * _of_head(low)

    def measure(points: Mapping[str, tuple[float, float]]) -> dict:
        a = _of_head({h: v[0] for h, v in points.items()})
        b = _of_head({h: v[1] for h, v in points.items()})
        s = a * z + b
        q = S.sigmoid(s)
        r, w = n * q - t, n * q * (1 - q)
        sums = {"loss": n * S.softplus(-s) + (n - t) * s, "ga": r * z, "gb": r, "aa": w * z * z,
                "ab": w * z, "bb": w}
        chosen = rows.filter(F.col("head").isin(*sorted(points)))
        table = chosen.groupBy("head").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
        return {row["head"]: row for row in table.collect()}

    best = dict(trial)
    at = measure(trial)
    steps: dict[str, tuple[float, float, int]] = {}

    def plan(head: str) -> bool:
        """Next full step from the derivatives at the best point, if one is worth it."""
        g = at[head]
        aa, bb = g["aa"] + ridge, g["bb"] + ridge
        det = aa * bb - g["ab"] ** 2
        if max(abs(g["ga"]), abs(g["gb"])) < 1e-9 or not math.isfinite(det) or abs(det) < 1e-300:
            return False
        sa = (bb * g["ga"] - g["ab"] * g["gb"]) / det
        sb = (aa * g["gb"] - g["ab"] * g["ga"]) / det
        # Half the directional derivative is the drop Newton's model predicts. Once
        # it is below what the summed loss can resolve, the step is the last one.
        if (g["ga"] * sa + g["gb"] * sb) / 2 < 1e-12 * (1 + abs(g["loss"])):
            best[head] = (best[head][0] - sa, best[head][1] - sb)
            return False
        steps[head] = (sa, sb, 0)
        return True

    active = {h for h in trial if plan(h)}
    done = dict.fromkeys(trial, 0)
    while active:
        trial = {
            h: (best[h][0] - steps[h][0] * 0.5 ** steps[h][2],
                best[h][1] - steps[h][1] * 0.5 ** steps[h][2])
            for h in active
        }
        for head, row in measure(trial).items():
            if math.isfinite(row["loss"]) and row["loss"] < at[head]["loss"] - 1e-12:
                best[head], at[head] = trial[head], row
                done[head] += 1
                if done[head] >= iterations or not plan(head):
                    active.discard(head)
            elif steps[head][2] + 1 < halvings:
                steps[head] = (*steps[head][:2], steps[head][2] + 1)
            else:
                active.discard(head)
    return best


def fit_isotonic_heads(df: DataFrame) -> DataFrame:
    """Block lists (head, lo, hi, n, positives, value) of all heads in one plan (see :mod:`.isotonic`)."""
    return isotonic.fit_blocks(merged(df))


def fit_isotonic(df: DataFrame, head: str) -> DataFrame:
    """The block list of one head."""
    return fit_isotonic_heads(df.filter(F.col("head") == head))


def apply_isotonic(blocks: DataFrame, df: DataFrame, p: str = "p", out: str = "calibrated") -> DataFrame:
    """``df`` with its head's monotone fit at ``p``; without a column ``head``, that of the only head."""
    if "head" in df.columns:
        return isotonic.interpolated(blocks, df, p, out)
    alone = blocks.withColumn("head", F.lit(""))
    return isotonic.interpolated(alone, df.withColumn("head", F.lit("")), p, out).drop("head")


@dataclass(frozen=True)
class Calibrator:
    """What was decided for one head: identity, platt (a, b) or isotonic (its block list)."""

    kind: str = "identity"
    a: float = 1.0
    b: float = 0.0
    model: DataFrame | None = None
    source: str = "none"

    def column(self, p: Column) -> Column:
        if self.kind == "platt":
            return S.sigmoid(F.lit(self.a) * S.logit(p) + F.lit(self.b))
        return p


def calibrated(df: DataFrame, calibrators: Mapping[str, Calibrator], p: str = "p") -> DataFrame:
    """Replace ``p`` by its head's calibrated value; unknown heads stay as they are."""
    value = F.col(p)
    for head, c in calibrators.items():
        if c.kind == "platt":
            value = F.when(F.col("head") == head, c.column(F.col(p))).otherwise(value)
    out = df.withColumn(p, value)
    models = [c.model.filter(F.col("head") == h) for h, c in calibrators.items() if c.kind == "isotonic"]
    if models:
        fitted = apply_isotonic(isotonic.union(models), out, p, "_fitted")
        out = fitted.withColumn(p, F.coalesce("_fitted", F.col(p))).drop("_fitted")
    return out


def keeps_order(rows: DataFrame, calibrators: Mapping[str, Calibrator]) -> set[str]:
    """Heads whose calibrated values are finite, not all equal and never fall.

    Neighbours are compared inside pieces of the probability range, and piece
    borders on the piece extremes, so no head is sorted in one task.
    """
    from shelfstream.scale import pieces

    points = rows.select("head", "p").distinct()
    mapped = calibrated(points.withColumn("x", F.col("p")), calibrators)
    piece = mapped.withColumnsRenamed({"p": "y", "x": "p"})
    piece = pieces(piece, ["head", "p"], "_b").drop("_position")
    inside = Window.partitionBy("head", "_b").orderBy("p")
    steps = piece.withColumn("_d", F.col("y") - F.lag("y").over(inside))
    pieces = steps.groupBy("head", "_b").agg(
        F.min("_d").alias("down"),
        F.min("y").alias("lo"),
        F.max("y").alias("hi"),
        F.count_if(F.isnan("y") | F.col("y").isNull()).alias("bad"),
        F.count("*").alias("points"),
    )
    along = Window.partitionBy("head").orderBy("_b")
    joined = pieces.withColumn("_j", F.col("lo") - F.lag("hi").over(along))
    good = joined.groupBy("head").agg(
        F.min(F.least(F.coalesce("down", F.lit(0.0)), F.coalesce("_j", F.lit(0.0)))).alias("down"),
        (F.max("hi") - F.min("lo")).alias("spread"),
        F.sum("bad").alias("bad"),
        F.sum("points").alias("points"),
    )
    kept = good.filter(
        (F.col("points") < 2)
        | ((F.col("bad") == 0) & (F.col("spread") > 0) & (F.col("down") >= -1e-12))
    )
    return {r["head"] for r in kept.select("head").collect()}


def fit_or_decline(
    df: DataFrame,
    unit: Column | str,
    kind: str = "platt",
    min_positives: int = 10,
    bins: int = 10,
    min_improvement: float = 0.1,
    seed: int = 0,
) -> dict[str, Calibrator]:
    """A calibrator per head, or the identity where a correction is not earned.

    ``unit`` identifies a row for the repeatable 70/30 split. A head is declined
    for too few outcomes, for less than ``min_improvement`` out-of-sample gain in
    expected calibration error, or when the fit would change the order.
    """
    rows = cut(
        df.select(
            "head",
            F.col("label").cast("double").alias("label"),
            F.col("p").cast("double").alias("p"),
            (hash_unit(unit, seed=seed) < 0.7).alias("_in"),
        )
    )
    counts = {
        r["head"]: r
        for r in rows.groupBy("head")
        .agg(
            F.sum("label").alias("pos"),
            F.sum(1 - F.col("label")).alias("neg"),
            F.sum(F.when(F.col("_in"), F.col("label")).otherwise(0)).alias("pos_in"),
            F.sum(F.when(~F.col("_in"), F.col("label")).otherwise(0)).alias("pos_out"),
        )
        .collect()
    }
    out = {head: Calibrator() for head in counts}
    fit = {
        h for h, r in counts.items() if min(r["pos"], r["neg"]) >= min_positives
    }
    if kind == "identity" or not fit:
        return out

    def build(part: DataFrame, heads: set[str], positives: str) -> dict[str, Calibrator]:
        flexible = {
            h for h in heads if kind == "isotonic" and counts[h][positives] >= 10 * min_positives
        }
        plain = heads - flexible
        made = {}
        if flexible:
            blocks = fit_isotonic_heads(part.filter(F.col("head").isin(*sorted(flexible))))
            made = {h: Calibrator("isotonic", model=blocks) for h in flexible}
        if plain:
            params = fit_platt(part.filter(F.col("head").isin(*sorted(plain))))
            made.update({h: Calibrator("platt", *params[h]) for h in plain})
        return made

    probed = {
        h for h in fit if min(counts[h]["pos_in"], counts[h]["pos_out"]) >= min_positives
    }
    if probed:
        inner, outer = rows.filter("_in"), rows.filter("not _in")
        probe = build(inner, probed, "pos_in")
        held = outer.filter(F.col("head").isin(*sorted(probed))).select("head", "label", "p")
        before = {r["head"]: r["ece"] for r in calibration_report(held, bins).collect()}
        after = {
            r["head"]: r["ece"]
            for r in calibration_report(calibrated(held, probe), bins).collect()
        }
        fit -= {
            h
            for h in probed
            if before[h] <= 0 or after[h] > before[h] * (1 - min_improvement)
        }
    if not fit:
        return out
    final = build(rows, fit, "pos")
    kept = keeps_order(rows.filter(F.col("head").isin(*sorted(fit))), final)
    out.update({h: c for h, c in final.items() if h in kept})
    return out


def calibrate_heads(
    fit_slate: DataFrame,
    fit_history: DataFrame,
    test_slate: DataFrame,
    kind: str = "platt",
    min_positives: int = 10,
    unit: str = "unit",
) -> tuple[dict[str, Calibrator], DataFrame]:
    """Fit on one split, measure on another; slates first, history labels as fallback.

    Frames have (head, label, p) and the row identity ``unit``. Returns the
    calibrators and a report with the stage (before / after) per head.
    """
    enough = {
        r["head"]
        for r in fit_slate.groupBy("head")
        .agg(F.sum("label").alias("pos"))
        .filter(F.col("pos") >= min_positives)
        .collect()
    }
    columns = ["head", "label", "p", unit]
    chosen = fit_slate.filter(F.col("head").isin(*sorted(enough))).select(*columns).unionByName(
        fit_history.filter(~F.col("head").isin(*sorted(enough))).select(*columns)
    )
    fitted = fit_or_decline(chosen, unit, kind, min_positives)
    calibrators = {
        h: Calibrator(c.kind, c.a, c.b, c.model, "slate" if h in enough else "history")
        if c.kind != "identity"
        else c
        for h, c in fitted.items()
    }
    test = cut(test_slate.select("head", "label", "p"))
    before = calibration_report(test).withColumn("stage", F.lit("before"))
    after = calibration_report(calibrated(test, calibrators)).withColumn("stage", F.lit("after"))
    return calibrators, before.unionByName(after)


def percentile_ranks(df: DataFrame, score: str, tie: list[str], out: str = "p") -> DataFrame:
    """Pooled rank of a score scaled to [0, 1]; ``tie`` makes the order total.

    Scores are not probabilities, but equal-mass bins do not change under a
    monotone map, so the resolution of the ranks is that of the scores.
    """
    from shelfstream.scale import global_row_number

    numbered = global_row_number(df, [F.asc(score), *[F.asc(t) for t in tie]], "_r")
    n = numbered.count()
    return numbered.withColumn(out, (F.col("_r") - 1) / F.lit(max(n - 1, 1))).drop("_r")


def resolution(ranked: DataFrame, bins: int = 10) -> DataFrame:
    """How much a score explains about the label on its own slate, per head."""
    return calibration_report(ranked, bins).select(
        "head", "n", "positives", "base_rate", "resolution", "uncertainty", "resolution_share"
    )
