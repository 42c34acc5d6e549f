"""Hand-computed metrics, statistics and calibration properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfstream.operators import calibration as K
from shelfstream.operators import evaluation as E
from shelfstream.operators import isotonic
from shelfstream.operators import lists as L
from shelfstream.operators import stats as ST


def one(spark, ranked, wanted, k):
    df = spark.createDataFrame([("u", ranked, wanted)], "user_id string, ranked array<int>, target_tokens array<int>")
    return E.with_metrics(df, [k]).first()


def test_metrics_by_hand(spark):
    row = one(spark, [5, 3, 9], [3, 7], 3)
    assert row.recall_3 == 0.5 and row.hit_rate_3 == 1.0
    assert math.isclose(row.ndcg_3, (1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert one(spark, [1, 2], list(range(1, 41)), 2).recall_2 == 1.0
    nothing = one(spark, [1, 2], [], 2)
    assert nothing.recall_2 is None and nothing.ndcg_2 is None and nothing.hit_rate_2 is None
    assert one(spark, [], [1], 2).ndcg_2 == 0.0


def test_usable_ks():
    assert E.usable_ks([5, 10, 500], 100) == ([5, 10], [500])
    assert E.usable_ks([500], 100) == ([10], [500])


def test_unseen_lists_are_exact(spark):
    rows = spark.createDataFrame(
        [("a", [1, 2, 3]), ("b", []), ("c", [9, 9, 8])], "user_id string, input_tokens array<int>"
    )
    scores = spark.createDataFrame([(i, float(20 - i)) for i in range(1, 11)], "token_id int, score double")
    got = {r.user_id: r.ranked for r in L.popular_lists(rows, scores, 2, 3).collect()}
    assert got == {"a": [4, 5], "b": [1, 2], "c": [1, 2]}


def test_auc_matches_pair_counting_with_ties(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 400), rng.integers(0, 15, 400).astype(float)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "y int, s double")
    pos, neg = s[y == 1], s[y == 0]
    expected = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert math.isclose(E.auc(df, "s", "y").first().auc, expected, rel_tol=1e-12)
    assert E.auc(df.filter("y = 1"), "s", "y").first().auc is None


def gate(spark, ranker, retrieval, high, bias):
    row = spark.createDataFrame(
        [(ranker, retrieval, -1.0, high)],
        "ranker_mrr double, retrieval_mrr double, ci_low double, ci_high double",
    )
    table = None if bias is None else spark.createDataFrame(bias, "head string, bias_ratio double")
    return E.release_gate(row, table).first()


def test_release_gate_fails_closed(spark):
    good = [(h, 1.2) for h in ("purchase", "cart", "click", "return")]
    assert gate(spark, 0.5, 0.4, 0.1, good).passed
    assert not gate(spark, None, 0.4, None, good).passed
    assert not gate(spark, 0.3, 0.4, 0.1, good).passed
    assert not gate(spark, 0.5, 0.4, -0.01, good).passed
    assert not gate(spark, 0.5, 0.4, 0.1, good[:3]).passed
    assert not gate(spark, 0.5, 0.4, 0.1, [*good[:3], ("return", 0.1)]).passed
    assert gate(spark, 0.5, 0.4, 0.1, None).passed


def values(spark, xs, name="m"):
    return spark.createDataFrame([(f"u{i}", name, x) for i, x in enumerate(xs)], "user_id string, metric string, value double")


def test_bootstrap_interval(spark):
    rng = np.random.default_rng(2)
    xs = [float(x) for x in rng.normal(3, 1, 300)]
    row = ST.bootstrap_ci(values(spark, [*xs, float("nan"), None]), "value", resamples=500).first()
    assert row.n == 300 and row.ci_low < np.mean(xs) < row.ci_high
    assert math.isclose(row.ci_high - row.ci_low, 2 * 1.96 * np.std(xs) / math.sqrt(300), rel_tol=0.15)
    single = ST.bootstrap_ci(values(spark, [2.0]), "value", resamples=50).first()
    assert (single.ci_low, single["mean"], single.ci_high) == (2.0, 2.0, 2.0)


def test_bootstrap_does_not_depend_on_partitions(spark):
    df = values(spark, [float(i % 7) for i in range(200)])
    a = ST.bootstrap_ci(df.repartition(1), "value", resamples=100).first()
    b = ST.bootstrap_ci(df.repartition(7), "value", resamples=100).first()
    assert math.isclose(a.ci_low, b.ci_low) and math.isclose(a.ci_high, b.ci_high)


def test_paired_comparison(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=200)
    b = values(spark, [float(x) for x in base])
    better = values(spark, [float(x + 0.3 + 0.1 * e) for x, e in zip(base, rng.normal(size=200), strict=True)])
    noise = values(spark, [float(x + 0.1 * e) for x, e in zip(base, rng.normal(size=200), strict=True)])
    clear = ST.paired_comparison(ST.paired(better, b, ["user_id", "metric"]), resamples=400).first()
    assert clear.ci_low > 0 and 0 < clear.p_value < 0.01 and clear.verdict.endswith("better")
    same = ST.paired_comparison(ST.paired(b, b, ["user_id", "metric"]), resamples=100).first()
    assert same.p_value == 1.0 and same.verdict == "no difference detected"
    unclear = ST.paired_comparison(ST.paired(noise, b, ["user_id", "metric"]), resamples=400).first()
    assert unclear.p_value > 0.001


def test_misaligned_users_are_an_error(spark):
    a, b = values(spark, [1.0, 2.0]), values(spark, [1.0])
    with pytest.raises(Exception, match="not aligned"):
        ST.paired(a, b, ["user_id", "metric"]).collect()


def test_holm(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("f", "d", 0.9)],
                               "family string, name string, p_value double")
    got = {r.name: (round(r.p_adjusted, 9), r.significant) for r in ST.holm(df, ["family"]).collect()}
    assert got == {"a": (0.04, True), "b": (0.09, False), "c": (0.09, False), "d": (0.9, False)}


def labelled(spark, n=4000, scale=1.0, seed=4):
    rng = np.random.default_rng(seed)
    p = rng.uniform(0.02, 0.5, n)
    y = rng.uniform(size=n) < p
    rows = [("h", int(a), float(b * scale), str(i)) for i, (a, b) in enumerate(zip(y, p, strict=True))]
    return spark.createDataFrame(rows, "head string, label int, p double, unit string")


def test_murphy_identity_and_verdicts(spark):
    row = K.calibration_report(labelled(spark)).first()
    assert math.isclose(row.binned_brier, row.reliability - row.resolution + row.uncertainty)
    assert row.verdict == "calibrated"
    assert K.calibration_report(labelled(spark, scale=0.2)).first().verdict.startswith("under-confident")
    few = labelled(spark, 30)
    assert K.calibration_report(few).first().verdict == "too few outcomes to judge"
    flat = labelled(spark).withColumn("p", F.lit(0.26))
    assert K.calibration_report(flat).first().verdict == "calibrated but uninformative"


def test_platt_recovers_a_known_distortion(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(-1, 1, 6000)
    y = rng.uniform(size=6000) < 1 / (1 + np.exp(-(0.5 * z + 0.3)))
    df = spark.createDataFrame(
        [("h", int(a), float(1 / (1 + math.exp(-b)))) for a, b in zip(y, z, strict=True)],
        "head string, label int, p double",
    )
    a, b = K.fit_platt(df)["h"]
    assert abs(a - 0.5) < 0.1 and abs(b - 0.3) < 0.12


def test_every_head_is_calibrated_and_every_user_pooled(spark, folder):
    from workload import load_all
    from workload.registry import QUERIES

    load_all()
    folder = folder.replace("sf0.001", "sf0.01")  # some users lack a seed there
    heads = QUERIES["cal6_isotonic_every_head"](spark, folder)
    assert heads.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{folder}/lineitem.parquet").count()
    assert {x.head for x in heads.select("head").distinct().collect()} == {"f", "o"}
    pooled = QUERIES["ev16_pooled_every_user"](spark, folder)
    whole = QUERIES["ev16_pooled_over_seeds"](spark, folder)
    assert pooled.count() > whole.count()
    assert whole.join(pooled.filter("complete"), ["arm", "user_id", "value"], "left_anti").count() == 0


def test_incomplete_users_are_marked(spark):
    runs = spark.createDataFrame(
        [("a", 1, "u", 1.0), ("a", 2, "u", 3.0), ("a", 1, "v", 5.0)], "arm string, seed int, user_id string, value double"
    )
    got = E.pooled_over_seeds(runs, mark=True).collect()
    assert {tuple(x) for x in got} == {("a", "u", 2.0, True), ("a", "v", 5.0, False)}


def test_isotonic_pools_and_stays_flat_outside(spark):
    df = spark.createDataFrame(
        [("h", y, p) for p, y in [(0.1, 0), (0.2, 1), (0.3, 0), (0.4, 1), (0.4, 1)]], "head string, label int, p double"
    )
    model = K.fit_isotonic(df, "h")
    grid = spark.createDataFrame([(0.0,), (0.2,), (0.3,), (0.4,), (0.9,)], "p double")
    got = [round(r.calibrated, 6) for r in K.apply_isotonic(model, grid).orderBy("p").collect()]
    assert got == [0.0, 0.5, 0.5, 1.0, 1.0]


def isotonic_rows(spark, n=3000, seed=7):
    rng = np.random.default_rng(seed)
    rows = []
    for head, shape in (("rising", lambda x: x * x), ("falling", lambda x: 1 - x), ("flat", lambda x: 0.3 + 0 * x), ("stairs", np.round)):
        p = np.round(rng.random(n), 3)
        rows += zip([head] * n, (rng.random(n) < shape(p)).astype(int).tolist(), p.tolist(), strict=True)
    return spark.createDataFrame(rows, "head string, label int, p double")


def test_block_lists_merge_to_the_whole_fit(spark, monkeypatch):
    df = isotonic_rows(spark)
    table = K.merged(df).toPandas().sort_values(["head", "p"])
    want = {}
    for head, own in table.groupby("head"):
        # Max-min formula: the fit at i is the largest, over starts, of the least mean up to an end behind i.
        n, s = np.r_[0, own["n"].cumsum()], np.r_[0, own["positives"].cumsum()]
        size = len(own)
        fit = np.full(size, -1.0)
        for j in range(size):
            mean = (s[j + 1 :] - s[j]) / (n[j + 1 :] - n[j])
            low = np.minimum.accumulate(mean[::-1])[::-1]
            fit[j:] = np.maximum(fit[j:], low)
        want[head] = dict(zip(own["p"], fit, strict=True))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    monkeypatch.setattr(isotonic, "FAN", 2)
    try:
        blocks = K.fit_isotonic_heads(df)
        for most in (isotonic.KNOTS, 0):
            monkeypatch.setattr(isotonic.interpolated, "__defaults__", (most,))
            got = K.apply_isotonic(blocks, df).select("head", "p", "calibrated").distinct().collect()
            assert len(got) == len(table)
            assert all(abs(r.calibrated - want[r["head"]][r.p]) < 1e-9 for r in got)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    by_head = blocks.toPandas().sort_values(["head", "lo"]).groupby("head")
    assert all((np.diff(own["value"]) > 0).all() and (own["lo"].to_numpy()[1:] > own["hi"].to_numpy()[:-1]).all() for _, own in by_head)
    assert len(by_head.get_group("falling")) < 5 < len(by_head.get_group("rising"))


@pytest.mark.parametrize("most", [isotonic.KNOTS, 0])
def test_curves_between_and_outside_their_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(isotonic.interpolated, "__defaults__", (most,))
    df = spark.createDataFrame(
        [("h", 0, 0.1), ("h", 0, 0.2), ("h", 1, 0.4), ("h", 1, 0.6), ("g", 1, 0.5)], "head string, label int, p double")
    grid = spark.createDataFrame(
        [("h", 0.0), ("h", 0.3), ("h", 0.35), ("h", 0.9), ("h", None), ("g", 0.1), ("x", 0.1), ("h", 0.3)], "head string, p double")
    got = K.apply_isotonic(K.fit_isotonic_heads(df), grid).collect()
    key = lambda t: str(t)
    assert sorted([(r["head"], r.p, None if r.calibrated is None else round(r.calibrated, 6)) for r in got], key=key) == sorted(
        [("h", 0.0, 0.0), ("h", 0.3, 0.5), ("h", 0.3, 0.5), ("h", 0.35, 0.75), ("h", 0.9, 1.0), ("h", None, None), ("g", 0.1, 1.0), ("x", 0.1, None)], key=key)
    none = K.fit_isotonic_heads(df.filter("false"))
    assert none.count() == 0 and K.apply_isotonic(none, grid).filter("calibrated is not null").count() == 0


def test_scarce_positives_choose_the_stiffer_fit(spark):
    # Isotonic wants ten times the positives that Platt needs; both are asked for at once.
    rich = labelled(spark, scale=0.2).withColumn("head", F.lit("rich"))
    poor = labelled(spark, 700, scale=0.2).withColumn("head", F.lit("poor")).withColumn("unit", F.concat(F.lit("p"), "unit"))
    both = rich.unionByName(poor)
    fitted = K.fit_or_decline(both, "unit", kind="isotonic", min_positives=20)
    assert {h: c.kind for h, c in fitted.items()} == {"rich": "isotonic", "poor": "platt"}
    after = {r["head"]: r for r in K.calibration_report(K.calibrated(both, fitted)).collect()}
    assert all(0.9 < r.bias_ratio < 1.1 for r in after.values()) and after["rich"].ece < 0.02


def test_fit_or_decline(spark):
    declined = K.fit_or_decline(labelled(spark), "unit")["h"]
    assert declined.kind == "identity"
    wrong = labelled(spark, scale=0.2)
    fitted = K.fit_or_decline(wrong, "unit")["h"]
    assert fitted.kind == "platt" and fitted.a > 0
    after = K.calibration_report(K.calibrated(wrong, {"h": fitted})).first()
    assert 0.9 < after.bias_ratio < 1.1
    backwards = wrong.withColumn("p", 0.6 - F.col("p"))
    assert K.fit_or_decline(backwards, "unit")["h"].kind == "identity"
    assert K.fit_or_decline(labelled(spark, 60), "unit", min_positives=30)["h"].kind == "identity"


def test_pooled_comparison_is_paired_per_user(spark):
    rows = [(arm, seed, user, base + 0.01 * user + 0.1 * seed)
            for arm, base in (("x", 0.5), ("y", 0.4), ("z", 0.5)) for seed in (0, 1) for user in range(40)]
    runs = spark.createDataFrame(rows, "arm string, seed int, user_id int, value double")
    pooled = E.pooled_over_seeds(runs)
    tests = [("x-y", "x", "y"), ("x-z", "x", "z")]
    got = {r.test: r for r in ST.pooled_comparison(pooled, tests, resamples=200).collect()}
    single = ST.paired_comparison(
        ST.paired(pooled.filter("arm = 'x'"), pooled.filter("arm = 'y'"), ["user_id"]).withColumn("metric", F.lit("m")),
        resamples=200,
    ).first()
    assert got["x-y"].n == got["x-z"].n == 40  # users, not runs
    assert got["x-y"].mean_difference == pytest.approx(0.1)
    assert (got["x-y"].p_value, got["x-y"].ci_low) == (single.p_value, pytest.approx(single.ci_low))
    assert got["x-y"].significant and got["x-y"].p_adjusted == pytest.approx(2 * got["x-y"].p_value)
    assert got["x-y"].verdict.endswith("better") and got["x-z"].verdict == "no difference detected"


@pytest.mark.parametrize("change", ["missing", "twice"])
def test_pooled_comparison_refuses_users_that_are_not_aligned(spark, change):
    pooled = spark.createDataFrame([("x", 1, 0.5), ("x", 2, 0.5), ("y", 1, 0.4)], "arm string, user_id int, value double")
    if change == "twice":
        pooled = pooled.unionByName(spark.createDataFrame([("y", 2, 0.1), ("y", 2, 0.2)], pooled.schema))
    with pytest.raises(Exception, match="not aligned"):
        ST.pooled_comparison(pooled, [("t", "x", "y")], resamples=20).collect()
