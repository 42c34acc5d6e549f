"""Ranking evaluation, resampling statistics and calibration."""

from __future__ import annotations


from pyspark.sql import functions as F

from shelfstream.functions import actions as A
from shelfstream.operators import calibration as K
from shelfstream.operators import evaluation as E
from shelfstream.operators import lists as L
from shelfstream.operators import stats as ST
from shelfstream.operators import training as T
from shelfstream.scale import cut
from shelfstream.sources.tables import aligned_sequences
from workload.registry import case, cte
from workload.views import MAX_LEN, r

KS = (5, 10, 20)
SQL_HASH = "('0x' || substr(md5({}), 1, 8))::BIGINT"


@case("ev1_recall_ndcg_per_user", """
SELECT user_id, round(recall, 6) AS recall_10, round(ndcg, 6) AS ndcg_10 FROM per_user WHERE k = 10""")
def _(v):
    rows = E.with_metrics(v.popular("test", 10), [10])
    return rows.select("user_id", r("recall_10").alias("recall_10"), r("ndcg_10").alias("ndcg_10"))


@case("ev2_mean_ndcg", """
SELECT round(avg(CASE WHEN k = 5 THEN ndcg END), 6) AS ndcg_5, round(avg(CASE WHEN k = 10 THEN ndcg
  END), 6) AS ndcg_10, round(avg(CASE WHEN k = 20 THEN ndcg END), 6) AS ndcg_20 FROM per_user""")
def _(v):
    table = E.means(E.with_metrics(v.popular("test", 20), KS), KS)
    return table.select(*[r(f"ndcg_{k}").alias(f"ndcg_{k}") for k in KS])


@case("ev3_hit_rate", "SELECT user_id, hit_rate AS hit_rate_5 FROM per_user WHERE k = 5")
def _(v):
    return E.with_metrics(v.popular("test", 5), [5]).select("user_id", "hit_rate_5")


@case("ev4_coverage", """
SELECT round(count(DISTINCT token_id) / cast((SELECT count(*) + 1 FROM vocab) AS DOUBLE), 6)
  AS coverage_10 FROM lists_test WHERE position <= 10""")
def _(v):
    return E.coverage(v.popular("test", 10), 10, v.vocab_size).select(r("coverage_10").alias("coverage_10"))


cte("scopes", """
SELECT user_id, 'overall' AS scope FROM dominant UNION ALL SELECT user_id, category FROM dominant""")


@case("ev5_whole_evaluation", """
SELECT scope, m || '_' || k AS metric, round(avg(value), 6) AS value FROM (
  SELECT user_id, k, 'recall' AS m, recall AS value FROM per_user UNION ALL
  SELECT user_id, k, 'ndcg', ndcg FROM per_user UNION ALL
  SELECT user_id, k, 'hit_rate', hit_rate FROM per_user) p JOIN scopes s ON s.user_id = p.user_id
WHERE k < 20 GROUP BY scope, m, k UNION ALL
SELECT scope, 'eval_users', cast(count(*) AS DOUBLE) FROM scopes GROUP BY 1 UNION ALL
SELECT 'overall', 'coverage_' || k, round(count(DISTINCT token_id) /
  cast((SELECT count(*) + 1 FROM vocab) AS DOUBLE), 6)
FROM lists_test, (SELECT unnest([5, 10]) AS k) WHERE position <= k GROUP BY k""")
def _(v):
    table = E.evaluate(v.popular("test", 10), v.vocab, (5, 10), v.vocab_size)
    return table.select("scope", "metric", r("value").alias("value"))


@case("ev6_usable_ks", """
SELECT k, k < (SELECT count(*) FROM vocab) AS kept FROM (SELECT unnest([5, 10, 80, 200]) AS k)""")
def _(v):
    kept, dropped = E.usable_ks([5, 10, 80, 200], v.vocab_size)
    return v.spark.createDataFrame([(k, True) for k in kept] + [(k, False) for k in dropped], "k int, kept boolean")


cte("line_scores", """
SELECT l_returnflag AS g, l_quantity AS s, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS y
FROM lineitem""")


@case("ev7_auc", """
SELECT a.g AS grp, round(sum(pos * (below + neg / cast(2 AS DOUBLE))) / (sum(pos) * sum(neg)), 9) AS auc,
  cast(sum(pos) AS BIGINT) AS positives, cast(sum(neg) AS BIGINT) AS negatives FROM (
  SELECT g, s, sum(y) AS pos, sum(1 - y) AS neg, cast(sum(sum(1 - y)) OVER (PARTITION BY g ORDER BY s)
    - sum(1 - y) AS DOUBLE) AS below FROM line_scores GROUP BY 1, 2) a GROUP BY 1""")
def _(v):
    rows = v.table("lineitem").select(
        F.col("l_returnflag").alias("grp"), F.col("l_quantity").alias("s"),
        (F.col("l_linestatus") == "O").cast("int").alias("y"),
    )
    return E.auc(rows, "s", "y", ["grp"]).select("grp", r("auc", 9).alias("auc"), "positives", "negatives")


def _auc_sql(source, key, score, label):
    return f"""SELECT {key}, CASE WHEN sum(pos) * sum(neg) > 0 THEN
  round(sum(pos * (below + neg / cast(2 AS DOUBLE))) / (sum(pos) * sum(neg)), 6) END AS auc,
  cast(sum(pos) AS BIGINT) AS positives, cast(sum(neg) AS BIGINT) AS negatives FROM (
  SELECT {key}, {score} AS s, sum({label}) AS pos, sum(1 - {label}) AS neg,
    cast(sum(sum(1 - {label})) OVER (PARTITION BY {key} ORDER BY {score}) - sum(1 - {label}) AS DOUBLE)
    AS below FROM {source} GROUP BY {key}, {score}) GROUP BY {key}"""


cte("head_scores", """
SELECT h.head, h.label, p.score FROM heads_train h JOIN pop p ON h.token_id = p.token_id""")


@case("ev17_head_quality", f"""
SELECT head, auc, positives + negatives AS positions,
  round(positives / cast(positives + negatives AS DOUBLE), 6) AS positive_rate
FROM ({_auc_sql("head_scores", "head", "score", "label")})""")
def _(v):
    labels = T.head_labels(aligned_sequences(v.split("train"))).join(v.scores, "token_id")
    return E.head_quality(labels).select(
        "head", r("auc").alias("auc"), "positions", r("positive_rate").alias("positive_rate")
    )


NEG = 20
_N = SQL_HASH.format("'9u|' || user_id || '|' || i")
cte("decayed", """
SELECT token_id, sum(pow(2, -(len - 1 - pos) / cast(10 AS DOUBLE))) AS score FROM h_train GROUP BY 1""")
cte("pool_scores", f"""
SELECT user_id, positive, token_id FROM (
  SELECT user_id, positive, {_N} % vn + 1 AS token_id FROM
    (SELECT user_id, max(CASE WHEN pos = len - 1 THEN token_id END) AS positive FROM h_test GROUP BY 1),
    vocab_n, range(0, {NEG}) r(i)) WHERE token_id <> positive""")
cte("signal_ranks", """
SELECT user_id, 'popularity' AS signal, 1 + count(*) FILTER (coalesce(a.score, 0) > coalesce(b.score, 0))
  AS rank FROM pool_scores s LEFT JOIN pop a ON a.token_id = s.token_id
  LEFT JOIN pop b ON b.token_id = s.positive GROUP BY 1 UNION ALL
SELECT user_id, 'recency', 1 + count(*) FILTER (round(coalesce(a.score, 0), 9) >
  round(coalesce(b.score, 0), 9)) FROM pool_scores s LEFT JOIN decayed a ON a.token_id = s.token_id
  LEFT JOIN decayed b ON b.token_id = s.positive GROUP BY 1""")


def _ranks(v):
    rows = T.negatives(v.split("test"), v.vocab_size + 1, NEG, seed=9)
    recent = L.popularity(v.split("train"), 10).select(
        "token_id", F.round("score", 9).alias("recency")
    )
    scores = v.scores.withColumnRenamed("score", "popularity").join(recent, "token_id")
    return E.discrimination(rows, scores, ["popularity", "recency"])


@case("ev8_discrimination", f"""
SELECT signal, count(*) AS users, round(avg(CASE WHEN rank = 1 THEN cast(1 AS DOUBLE) ELSE 0 END), 6)
  AS hit_at_1, round(avg(CASE WHEN rank <= 10 THEN cast(1 AS DOUBLE) ELSE 0 END), 6) AS hit_at_10,
  round(avg(1 / cast(rank AS DOUBLE)), 6) AS mrr, quantile_cont(cast(rank AS DOUBLE), 0.5) AS median_rank,
  round(1 / cast({NEG + 1} AS DOUBLE), 6) AS random_hit_at_1
FROM signal_ranks GROUP BY 1""")
def _(v):
    table = E.discrimination_summary(_ranks(v), NEG + 1)
    return table.select(
        "signal", "users", *[r(c).alias(c) for c in ("hit_at_1", "hit_at_10", "mrr")], "median_rank",
        r("random_hit_at_1").alias("random_hit_at_1"),
    )


cte("slate_test", """
SELECT l.user_id, l.position - 1 AS position, l.token_id, l.score, t.action_id AS action FROM lists_test l
LEFT JOIN t_test t ON t.user_id = l.user_id AND t.token_id = l.token_id WHERE l.position <= 20""")
cte("slate_heads", """
SELECT user_id, position, token_id, score, 'click' AS head, CASE WHEN action IN (2, 3, 5) THEN 1 ELSE 0
  END AS label FROM slate_test UNION ALL
SELECT user_id, position, token_id, score, 'cart', CASE WHEN action IN (3, 5) THEN 1 ELSE 0 END
FROM slate_test UNION ALL
SELECT user_id, position, token_id, score, 'purchase', CASE WHEN action = 5 THEN 1 ELSE 0 END
FROM slate_test UNION ALL
SELECT user_id, position, token_id, score, 'any', CASE WHEN action IS NOT NULL THEN 1 ELSE 0 END
FROM slate_test""")


def _slate_labels(v, split="test"):
    return E.slate_labels(E.slates(v.popular(split, 20)))


@case("ev9_slates", "SELECT user_id, position, token_id, action FROM slate_test")
def _(v):
    return E.slates(v.popular("test", 20))


@case("ev10_slate_labels", "SELECT user_id, position, token_id, head, label FROM slate_heads")
def _(v):
    return _slate_labels(v).select("user_id", "position", "token_id", "head", "label")


cte("slate_order", "SELECT head, -position AS s, label FROM slate_heads")


@case("ev11_slate_order_auc", _auc_sql("slate_order", "head", "s", "label"))
def _(v):
    return E.order_quality(_slate_labels(v)).select("head", r("auc").alias("auc"), "positives", "negatives")


cte("second_scores", """
SELECT user_id, token_id, position, row_number() OVER (PARTITION BY user_id
  ORDER BY round(coalesce(d.score, 0), 9) DESC, position) AS again
FROM lists_test l LEFT JOIN decayed d USING (token_id) WHERE position <= 20""")
cte("rerank_user", """
SELECT n.user_id, coalesce(sum(CASE WHEN position <= 10 THEN 1 / log2(position + cast(1 AS DOUBLE)) END)
    FILTER (t.token_id IS NOT NULL), 0) / max(idcg) AS a,
  coalesce(sum(CASE WHEN again <= 10 THEN 1 / log2(again + cast(1 AS DOUBLE)) END)
    FILTER (t.token_id IS NOT NULL), 0) / max(idcg) AS b,
  count(*) FILTER (position <= 10 AND t.token_id IS NOT NULL) / cast(max(least(n.m, 10)) AS DOUBLE) AS ra,
  count(*) FILTER (again <= 10 AND t.token_id IS NOT NULL) / cast(max(least(n.m, 10)) AS DOUBLE) AS rb,
  max(CASE WHEN position = 1 AND again <> 1 THEN cast(1 AS DOUBLE) ELSE 0 END) AS changed
FROM n_targets n JOIN ideals i ON i.m = least(n.m, 10) JOIN second_scores s ON s.user_id = n.user_id
LEFT JOIN t_test t ON t.user_id = s.user_id AND t.token_id = s.token_id GROUP BY 1""")


@case("ev12_rerank_uplift", """
SELECT count(*) AS users, round(avg(a), 6) AS retrieval_ndcg_10, round(avg(ra), 6) AS retrieval_recall_10,
  round(avg(b), 6) AS reranked_ndcg_10, round(avg(rb), 6) AS reranked_recall_10,
  round(avg(changed), 6) AS top1_changed_share, round((avg(b) - avg(a)) * 100 / avg(a), 4)
  AS ndcg_delta_pct FROM rerank_user""")
def _(v):
    second = L.popularity(v.split("train"), 10).withColumn("score", F.round("score", 9))
    table = E.rerank_uplift(E.reranked(v.popular("test", 20), second, 10), 10)
    return table.select(
        "users", *[r(c).alias(c) for c in table.columns if c not in ("users", "ndcg_delta_pct")],
        r("ndcg_delta_pct", 4).alias("ndcg_delta_pct"),
    )


cte("arm_runs", """
SELECT CASE p_size % 3 WHEN 0 THEN 'control' WHEN 1 THEN 'a' ELSE 'b' END AS arm, lower(p_type) AS head,
  p_brand AS seed, avg(p_retailprice) / 3000 AS auc FROM part GROUP BY 1, 2, 3""")


def _arm_runs(v):
    arm = F.when(F.col("p_size") % 3 == 0, "control").when(F.col("p_size") % 3 == 1, "a").otherwise("b")
    return v.table("part").groupBy(
        arm.alias("arm"), F.lower("p_type").alias("head"), F.col("p_brand").alias("seed")
    ).agg((F.avg("p_retailprice") / 3000).alias("auc"))


@case("ev13_arms_table", """
SELECT a.arm, a.head, a.runs, round(a.m, 6) AS auc_mean, round(a.s, 6) AS auc_std, round(a.m - 0.5, 6)
  AS over_chance, round(c.m - 0.5, 6) AS control_over_chance,
  round((a.m - 0.5) / (c.m - 0.5), 4) AS vs_control, c.s > 0 AND abs(a.m - c.m) > 2 * c.s
  AS beyond_seed_noise
FROM (SELECT arm, head, count(*) AS runs, avg(auc) AS m, stddev_samp(auc) AS s FROM arm_runs GROUP BY 1, 2) a
JOIN (SELECT head, avg(auc) AS m, stddev_samp(auc) AS s FROM arm_runs WHERE arm = 'control' GROUP BY 1) c
  ON a.head = c.head""")
def _(v):
    table = E.arms_table(_arm_runs(v))
    return table.select(
        "arm", "head", "runs", *[r(c).alias(c) for c in ("auc_mean", "auc_std", "over_chance",
        "control_over_chance")], r("vs_control", 4).alias("vs_control"), "beyond_seed_noise",
    )


# -- resampling ---------------------------------------------------------------

R = 200
_KEY = SQL_HASH.format("'0|' || user_id") + f" % {ST.PRIME}"


def _mix(x):
    sq = f"(({x}) % {ST.PRIME} * (({x}) % {ST.PRIME}) % {ST.PRIME})"
    return f"({sq} * {sq} % {ST.PRIME} * (({x}) % {ST.PRIME}) % {ST.PRIME})"


_STEP = f"(r * {ST.STEP} % {ST.PRIME})"
_WEIGHT = "(" + " + ".join(f"CASE WHEN u >= {x} THEN 1 ELSE 0 END" for x in ST.POISSON_LIMITS) + ")"


def _resample_sql(source):
    """(metric, r, w, wx, sx) from rows (metric, user_id, x)."""
    return f"""SELECT metric, r, sum({_WEIGHT}) AS w, sum({_WEIGHT} * x) AS wx, sum(x * (1 - 2 * (f % 2))) AS sx
  FROM (SELECT metric, r, x, {_mix(f"k + {_STEP}")} AS u, {_mix(f"k + {_STEP} + {ST.FLIP}")} AS f
    FROM (SELECT metric, {_KEY} AS k, x FROM {source}), range(0, {R}) t(r)) GROUP BY metric, r"""


cte("ci_values", """
SELECT 'recall_10' AS metric, user_id, recall AS x FROM per_user WHERE k = 10 UNION ALL
SELECT 'ndcg_10', user_id, ndcg FROM per_user WHERE k = 10""")


def _per_user_metrics(v, half_life=0.0):
    scores = L.popularity(v.split("train"), half_life).withColumn("score", F.round("score", 9))
    lists = L.popular_lists(v.split("test"), scores, 10, MAX_LEN)
    rows = E.with_metrics(lists, [10])
    return rows.select("user_id", "recall_10", "ndcg_10")


def _long(rows):
    return rows.unpivot(["user_id"], ["recall_10", "ndcg_10"], "metric", "value")


@case("st1_bootstrap_ci", f"""
SELECT v.metric, round(v.mean, 6) AS mean, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, n
FROM (SELECT metric, avg(x) AS mean, count(*) AS n FROM ci_values GROUP BY 1) v JOIN (
  SELECT metric, quantile_cont(wx / w, 0.025) AS ci_low, quantile_cont(wx / w, 0.975) AS ci_high
  FROM ({_resample_sql("ci_values")}) GROUP BY 1) q ON q.metric = v.metric""")
def _(v):
    table = ST.bootstrap_ci(_long(_per_user_metrics(v)), "value", resamples=R)
    return table.select("metric", *[r(c).alias(c) for c in ("mean", "ci_low", "ci_high")], "n")


cte("lists_recent", """
SELECT user_id, token_id, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, token_id)
  AS position FROM (SELECT DISTINCT user_id FROM h_test), decayed
WHERE (user_id, token_id) NOT IN (SELECT (user_id, token_id) FROM h_test)""")
cte("recent_user", """
SELECT n.user_id, count(t.token_id) / cast(max(least(n.m, 10)) AS DOUBLE) AS recall,
  coalesce(sum(CASE WHEN t.token_id IS NOT NULL THEN 1 / log2(position + cast(1 AS DOUBLE)) END), 0)
  / max(idcg) AS ndcg
FROM n_targets n JOIN ideals i ON i.m = least(n.m, 10)
LEFT JOIN lists_recent l ON l.user_id = n.user_id AND position <= 10
LEFT JOIN t_test t ON t.user_id = l.user_id AND t.token_id = l.token_id GROUP BY 1""")
cte("pair_values", """
SELECT 'recall_10' AS metric, p.user_id, q.recall AS a, p.recall AS b, q.recall - p.recall AS x
FROM per_user p JOIN recent_user q ON q.user_id = p.user_id WHERE k = 10 UNION ALL
SELECT 'ndcg_10', p.user_id, q.ndcg, p.ndcg, q.ndcg - p.ndcg
FROM per_user p JOIN recent_user q ON q.user_id = p.user_id WHERE k = 10""")
cte("pair_result", f"""
SELECT v.metric, mean_a, mean_b, d AS mean_difference, ci_low, ci_high, p_value, n FROM (
  SELECT metric, avg(a) AS mean_a, avg(b) AS mean_b, avg(x) AS d, count(*) AS n FROM pair_values GROUP BY 1) v
JOIN (SELECT r.metric, quantile_cont(wx / w, 0.025) AS ci_low, quantile_cont(wx / w, 0.975) AS ci_high,
    (count(*) FILTER (abs(sx / o.n) >= abs(o.d) - 1e-12) + 1) / cast({R + 1} AS DOUBLE) AS p_value
  FROM ({_resample_sql("pair_values")}) r JOIN (SELECT metric, avg(x) AS d, count(*) AS n
    FROM pair_values GROUP BY 1) o ON o.metric = r.metric GROUP BY 1) q ON q.metric = v.metric""")
_VERDICT = """CASE WHEN ci_low > 0 OR ci_high < 0 THEN printf('%.1f', abs(mean_difference * 100) / abs(mean_b))
  || '% ' || CASE WHEN mean_difference > 0 THEN 'better' ELSE 'worse' END
  ELSE 'no difference detected' END"""


@case("st2_paired_comparison", f"""
SELECT metric, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(mean_difference, 6)
  AS mean_difference, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(p_value, 6)
  AS p_value, n, {_VERDICT} AS verdict FROM pair_result""")
def _(v):
    pairs = ST.paired(
        _long(_per_user_metrics(v, 10)), _long(_per_user_metrics(v)), ["user_id", "metric"]
    )
    table = ST.paired_comparison(pairs, resamples=R)
    numbers = ("mean_a", "mean_b", "mean_difference", "ci_low", "ci_high", "p_value")
    return table.select("metric", *[r(c).alias(c) for c in numbers], "n", "verdict")


@case("st3_seed_spread", """
SELECT arm, head, count(*) AS seeds, round(avg(auc), 6) AS mean, round(min(auc), 6) AS min,
  round(max(auc), 6) AS max, round(stddev_samp(auc), 6) AS std FROM arm_runs GROUP BY 1, 2""")
def _(v):
    table = ST.seed_spread(_arm_runs(v), "auc", ["arm", "head"])
    return table.select("arm", "head", "seeds", *[r(c).alias(c) for c in ("mean", "min", "max", "std")])


@case("st4_holm_significance", """
SELECT family, name, round(p_adjusted, 9) AS p_adjusted, p_adjusted <= 0.05 AS significant FROM (
  SELECT family, name, max(s) OVER (PARTITION BY family ORDER BY p_value, name ROWS UNBOUNDED PRECEDING)
    AS p_adjusted FROM (SELECT *, least(1.0, p_value * (count(*) OVER (PARTITION BY family) - row_number()
    OVER (PARTITION BY family ORDER BY p_value, name) + 1)) AS s FROM p_values))""")
def _(v):
    tests = v.table("part").groupBy(
        F.concat(F.lit("f"), (F.col("p_size") % 5).cast("string")).alias("family"),
        F.col("p_brand").alias("name"),
    ).agg((F.min(F.col("p_retailprice") - 900) / 1000).alias("p_value"))
    return ST.holm(tests, ["family"]).select(
        "family", "name", r("p_adjusted", 9).alias("p_adjusted"), "significant"
    )


@case("st5_verdict_text", f"""
SELECT p_brand, {_VERDICT} AS verdict FROM (SELECT p_brand, avg(p_retailprice) - 1000 AS mean_difference,
  avg(p_retailprice) AS mean_b, avg(p_retailprice) - 1000 - p AS ci_low, avg(p_retailprice) - 1000 + p
  AS ci_high FROM part, (SELECT cast(40 AS DOUBLE) AS p) GROUP BY p_brand, p)""")
def _(v):
    mean = F.avg("p_retailprice")
    rows = v.table("part").groupBy("p_brand").agg(
        (mean - 1000).alias("mean_difference"), mean.alias("mean_b"), (mean - 1040).alias("ci_low"),
        (mean - 960).alias("ci_high"),
    )
    return rows.select("p_brand", ST.verdict().alias("verdict"))


@case("st6_models_vs_reference", """
SELECT 'recency' AS model, metric, round(mean_difference, 6) AS mean_difference, round(p_value, 6)
  AS p_value, round(greatest(least(1.0, first_p * 2), CASE WHEN rn = 1 THEN 0 ELSE p_value END), 6)
  AS p_adjusted FROM (SELECT *, min(p_value) OVER () AS first_p, row_number() OVER
  (ORDER BY p_value, metric) AS rn FROM pair_result)""")
def _(v):
    models = {"popularity": 0.0, "recency": 10.0}
    parts = [_per_user_metrics(v, h).withColumn("model", F.lit(m)) for m, h in models.items()]
    table = ST.compare_models(
        cut(parts[0].unionByName(parts[1])), "popularity", ["recall_10", "ndcg_10"], resamples=R
    )
    return table.select(
        "model", "metric", *[r(c).alias(c) for c in ("mean_difference", "p_value", "p_adjusted")]
    )


cte("gate_bias", """
SELECT kind, head, avg(CASE kind WHEN 'raw' THEN p ELSE p / ratio END) / avg(label) AS ratio FROM (
  SELECT head, label, p, avg(p) OVER (PARTITION BY head) / avg(label) OVER (PARTITION BY head) AS ratio
  FROM (SELECT head, label, score / (SELECT max(score) FROM pop) AS p FROM slate_heads WHERE head <> 'any')),
  (SELECT unnest(['raw', 'scaled']) AS kind) GROUP BY 1, 2""")
cte("gate_pairs", """
SELECT 1 / cast(a.rank AS DOUBLE) AS recency, 1 / cast(b.rank AS DOUBLE) AS popularity FROM signal_ranks a
JOIN signal_ranks b ON b.user_id = a.user_id WHERE a.signal = 'recency' AND b.signal = 'popularity'""")
cte("gate_order", """
SELECT ranker, avg(x) AS a, avg(y) AS b, avg(x - y) - 1.96e0 * stddev_samp(x - y) / sqrt(cast(count(*) AS DOUBLE)) AS lo,
  avg(x - y) + 1.96e0 * stddev_samp(x - y) / sqrt(cast(count(*) AS DOUBLE)) AS hi FROM (
  SELECT 'recency' AS ranker, recency AS x, popularity AS y FROM gate_pairs UNION ALL
  SELECT 'popularity', popularity, recency FROM gate_pairs UNION ALL
  SELECT 'worse', recency / 2, recency FROM gate_pairs) GROUP BY 1""")


@case("ev14_release_gate", """
SELECT *, ordering_passed AND calibration_passed AS passed FROM (
  SELECT ranker, kind, return_too, round(a / b, 4) AS relative_mrr, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high,
    a / b >= 1 AND NOT hi < 0 AS ordering_passed, n AS measured_heads, round(worst, 4) AS worst_bias_ratio,
    NOT return_too AND n = 3 AND worst <= 4 AS calibration_passed
  FROM gate_order, (SELECT kind, count(*) AS n, max(greatest(ratio, 1 / ratio)) AS worst FROM gate_bias GROUP BY 1),
    (SELECT unnest([false, true]) AS return_too))""")
def _(v):
    # Three orderings (one of them clearly worse), raw and rescaled heads, and a head that no slate measures.
    ranks = _ranks(v).groupBy("user_id").pivot("signal", ["recency", "popularity"]).agg(F.first("reciprocal_rank"))
    def pair(name, x, y):
        return F.struct(F.lit(name).alias("ranker"), x.alias("x"), y.alias("y"))

    recent, popular = F.col("recency"), F.col("popularity")
    pairs = cut(ranks).select("user_id", F.inline(F.array(
        pair("recency", recent, popular), pair("popularity", popular, recent), pair("worse", recent / 2, recent))))
    half = 1.96 * F.stddev_samp(F.col("x") - F.col("y")) / F.sqrt(F.count("*"))
    orders = cut(pairs.groupBy("ranker").agg(
        F.avg("x").alias("ranker_mrr"), F.avg("y").alias("retrieval_mrr"),
        (F.avg(F.col("x") - F.col("y")) - half).alias("ci_low"), (F.avg(F.col("x") - F.col("y")) + half).alias("ci_high"),
    ))
    shown = _slate_labels(v).join(v.scores, "token_id").filter("head <> 'any'")
    top = v.scores.agg(F.max("score")).first()[0]
    raw = cut(shown.select("head", "label", (F.col("score") / top).alias("p")))
    ratio = K.calibration_report(raw).select("head", "bias_ratio")
    scaled = raw.join(ratio, "head").select("head", "label", (F.col("p") / F.col("bias_ratio")).alias("p"))
    measured = {"raw": cut(ratio), "scaled": cut(K.calibration_report(scaled).select("head", "bias_ratio"))}
    out = None
    for kind, bias in measured.items():
        for more in (False, True):
            heads = ("click", "cart", "purchase", *(["return"] if more else []))
            # The gate judges each row of orderings.
            one = E.release_gate(orders, bias, heads=heads).select(
                "ranker", F.lit(kind).alias("kind"), F.lit(more).alias("return_too"), "relative_mrr",
                r("ci_low").alias("ci_low"), r("ci_high").alias("ci_high"), "ordering_passed", "measured_heads",
                r("worst_bias_ratio", 4).alias("worst_bias_ratio"), "calibration_passed", "passed",
            )
            out = one if out is None else out.unionByName(one)
    return out


SHARES = (1.0, 0.5, 0.25)
SEEDS = (4, 5, 6)
_KEEP = SQL_HASH.format("seed || '|' || user_id")
cte("kept_users", f"""
SELECT share, seed, user_id FROM (SELECT share, seed, user_id, n, row_number() OVER (PARTITION BY share, seed
  ORDER BY h, user_id) AS rn FROM (SELECT seed, user_id, {_KEEP} AS h FROM h_train, (SELECT unnest({list(SEEDS)}) AS seed)
    GROUP BY 1, 2),
  (SELECT unnest([cast(1 AS DOUBLE), 0.5, 0.25]) AS share), (SELECT count(DISTINCT user_id) AS n FROM h_train))
WHERE rn <= greatest(1, round_even(n * share, 0))""")


@case("ev15_consent_cost", f"""
SELECT rate, round(avg(m), 6) AS mean, round(coalesce(stddev_samp(m), 0), 6) AS std,
  round(avg(m) / max(CASE WHEN rate = 1 THEN avg(m) END) OVER (), 6) AS relative FROM (
  SELECT share AS rate, seed, avg(hits / cast(least(m, 10) AS DOUBLE)) AS m FROM (
    SELECT s.share, s.seed, n.user_id, n.m, count(t.token_id) AS hits FROM n_targets n
    CROSS JOIN (SELECT DISTINCT share, seed FROM kept_users) s
    LEFT JOIN (SELECT share, seed, user_id, token_id, row_number() OVER (PARTITION BY share, seed, user_id
        ORDER BY score DESC, token_id) AS position FROM (SELECT DISTINCT user_id FROM h_test),
        (SELECT share, seed, token_id, count(*) AS score FROM kept_users k JOIN h_train h
          ON h.user_id = k.user_id GROUP BY 1, 2, 3)
        WHERE (user_id, token_id) NOT IN (SELECT (user_id, token_id) FROM h_test)) l
      ON l.user_id = n.user_id AND l.share = s.share AND l.seed = s.seed AND position <= 10
    LEFT JOIN t_test t ON t.user_id = l.user_id AND t.token_id = l.token_id
    GROUP BY 1, 2, 3, 4) GROUP BY 1, 2) GROUP BY 1""")
def _(v):
    # Everyone stays at rate 1 whatever the seed, so that run counts for each of them.
    train, test, points = v.split("train"), v.split("test"), None
    for share in SHARES:
        for seed in SEEDS if share < 1 else SEEDS[:1]:
            scores = L.popularity(E.keep_users(train, share, seed=seed))
            rows = E.with_metrics(L.popular_lists(test, scores, 10, MAX_LEN), [10])
            one = rows.agg(F.avg("recall_10").alias("value")).select(
                F.lit(share).alias("rate"), F.explode(F.lit(list(SEEDS if share == 1 else [seed]))).alias("seed"), "value"
            )
            points = one if points is None else points.unionByName(one)
    return E.consent_cost(points).select(
        "rate", r("mean").alias("mean"), r("std").alias("std"), r("relative").alias("relative")
    )


@case("ev15_least_active_leave_last", """
SELECT user_id FROM (SELECT user_id, row_number() OVER (ORDER BY max(len), h, user_id) AS rn FROM
  (SELECT user_id, len, ('0x' || substr(md5('0|' || user_id), 1, 8))::BIGINT AS h FROM h_train) GROUP BY user_id, h)
WHERE rn <= (SELECT round_even(count(DISTINCT user_id) * 0.5, 0) FROM h_train)""")
def _(v):
    return E.keep_users(v.split("train"), 0.5, least_active=True).select("user_id")


@case("ev16_pooled_over_seeds", """
SELECT event_type AS arm, user_id, round(avg(v), 6) AS value FROM (SELECT event_type, user_id,
  cast(sku AS INTEGER) % 2 AS seed, avg(price) AS v FROM interactions WHERE user_id IN (SELECT user_id FROM
  (SELECT user_id, event_type, count(DISTINCT cast(sku AS INTEGER) % 2) AS n FROM interactions GROUP BY 1, 2)
  GROUP BY 1 HAVING min(n) = 2) GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def _(v):
    runs = v.interactions().groupBy(
        F.col("event_type").alias("arm"), "user_id", (F.col("sku").cast("int") % 2).alias("seed")
    ).agg(F.avg("price").alias("value"))
    whole = runs.groupBy("user_id", "arm").agg(F.count("*").alias("n")).groupBy("user_id").agg(
        F.min("n").alias("n")
    ).filter("n = 2")
    pooled = E.pooled_over_seeds(runs.join(whole, "user_id", "left_semi"))
    return pooled.select("arm", "user_id", r("value").alias("value"))


@case("ev16_pooled_every_user", """
SELECT event_type AS arm, user_id, round(avg(v), 6) AS value, count(*) = max(seeds) AS complete FROM (
  SELECT event_type, user_id, cast(sku AS INTEGER) % 2 AS seed, avg(price) AS v FROM interactions GROUP BY 1, 2, 3)
JOIN (SELECT event_type, count(DISTINCT cast(sku AS INTEGER) % 2) AS seeds FROM interactions GROUP BY 1)
  USING (event_type) GROUP BY 1, 2""")
def _(v):
    runs = v.interactions().groupBy(
        F.col("event_type").alias("arm"), "user_id", (F.col("sku").cast("int") % 2).alias("seed")
    ).agg(F.avg("price").alias("value"))
    pooled = E.pooled_over_seeds(runs, mark=True)
    return pooled.select("arm", "user_id", r("value").alias("value"), "complete")


ARMS = {1.0: "all", 0.5: "half", 0.25: "quarter"}
POOLED_TESTS = [("half of the users", "half", "all"), ("quarter of the users", "quarter", "all")]

cte("consent_runs", """
SELECT CASE share WHEN 1 THEN 'all' WHEN 0.5 THEN 'half' ELSE 'quarter' END AS arm, seed, user_id,
  hits / cast(least(m, 10) AS DOUBLE) AS recall FROM (
  SELECT s.share, s.seed, n.user_id, n.m, count(t.token_id) AS hits FROM n_targets n
  CROSS JOIN (SELECT DISTINCT share, seed FROM kept_users) s
  LEFT JOIN (SELECT share, seed, user_id, token_id, row_number() OVER (PARTITION BY share, seed, user_id
      ORDER BY score DESC, token_id) AS position FROM (SELECT DISTINCT user_id FROM h_test),
      (SELECT share, seed, token_id, count(*) AS score FROM kept_users k JOIN h_train h
        ON h.user_id = k.user_id GROUP BY 1, 2, 3)
      WHERE (user_id, token_id) NOT IN (SELECT (user_id, token_id) FROM h_test)) l
    ON l.user_id = n.user_id AND l.share = s.share AND l.seed = s.seed AND position <= 10
  LEFT JOIN t_test t ON t.user_id = l.user_id AND t.token_id = l.token_id GROUP BY 1, 2, 3, 4)""")
cte("pooled_runs", "SELECT arm, user_id, avg(recall) AS value FROM consent_runs GROUP BY 1, 2")
cte("pooled_pairs", """
SELECT p.arm || ' of the users' AS metric, p.user_id, p.value AS a, q.value AS b, p.value - q.value AS x
FROM pooled_runs p JOIN pooled_runs q ON q.user_id = p.user_id AND q.arm = 'all' WHERE p.arm <> 'all'""")
cte("pooled_result", f"""
SELECT v.metric, mean_a, mean_b, d AS mean_difference, ci_low, ci_high, p_value, n FROM (
  SELECT metric, avg(a) AS mean_a, avg(b) AS mean_b, avg(x) AS d, count(*) AS n FROM pooled_pairs GROUP BY 1) v
JOIN (SELECT r.metric, quantile_cont(wx / w, 0.025) AS ci_low, quantile_cont(wx / w, 0.975) AS ci_high,
    (count(*) FILTER (abs(sx / o.n) >= abs(o.d) - 1e-12) + 1) / cast({R + 1} AS DOUBLE) AS p_value
  FROM ({_resample_sql("pooled_pairs")}) r JOIN (SELECT metric, avg(x) AS d, count(*) AS n
    FROM pooled_pairs GROUP BY 1) o ON o.metric = r.metric GROUP BY 1) q ON q.metric = v.metric""")


@case("ev16_pooled_paired_tests", f"""
SELECT metric AS test, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(mean_difference, 6)
  AS mean_difference, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(p_value, 6)
  AS p_value, n, {_VERDICT} AS verdict, round(p_adjusted, 6) AS p_adjusted, p_adjusted <= 0.05 AS significant
FROM (SELECT *, max(s) OVER (ORDER BY p_value, metric) AS p_adjusted FROM (SELECT *, least(1.0,
  (count(*) OVER () - row_number() OVER (ORDER BY p_value, metric) + 1) * p_value) AS s FROM pooled_result))""")
def _(v):
    train, test, runs = v.split("train"), v.split("test"), None
    for share in SHARES:
        for seed in SEEDS if share < 1 else SEEDS[:1]:
            scores = L.popularity(E.keep_users(train, share, seed=seed))
            one = E.with_metrics(L.popular_lists(test, scores, 10, MAX_LEN), [10]).select(
                F.lit(ARMS[share]).alias("arm"), "user_id", F.col("recall_10").alias("value"),
                F.explode(F.lit(list(SEEDS if share == 1 else [seed]))).alias("seed"),
            )
            runs = one if runs is None else runs.unionByName(one)
    table = ST.pooled_comparison(cut(E.pooled_over_seeds(cut(runs))), POOLED_TESTS, resamples=R)
    numbers = ("mean_a", "mean_b", "mean_difference", "ci_low", "ci_high", "p_value", "p_adjusted")
    return table.select("test", *[r(c).alias(c) for c in numbers], "n", "verdict", "significant")


# -- calibration --------------------------------------------------------------

cte("cal", """
SELECT lower(l_linestatus) AS head, l_orderkey, l_linenumber, l_suppkey, l_partkey,
  CASE WHEN l_returnflag = 'R' AND l_quantity > 5 THEN cast(1 AS DOUBLE) ELSE 0 END AS y,
  least(greatest(l_quantity / cast(60 AS DOUBLE) + l_discount, 0), 1) AS p FROM lineitem""")


def _cal(v):
    return v.table("lineitem").select(
        F.lower("l_linestatus").alias("head"),
        ((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 5)).cast("int").alias("label"),
        (F.col("l_quantity") / 60 + F.col("l_discount")).alias("p"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").alias("unit"),
    )


@case("cal1_brier", "SELECT head, round(avg((p - y) * (p - y)), 6) AS brier FROM cal GROUP BY 1")
def _(v):
    return K.brier(_cal(v)).select("head", r("brier").alias("brier"))


cte("edges", """
SELECT head, list_sort(list_distinct(quantile_cont(p, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])))
  AS e FROM cal GROUP BY 1""")
cte("cal_bins", """
SELECT head, bin, count(*) AS n, avg(p) AS mp, avg(y) AS obs, sum(y) AS pos, sum((p - y) * (p - y)) AS sq
FROM (SELECT c.head, c.p, c.y, len(list_filter(e[2:len(e) - 1], lambda x: x <= c.p)) AS bin
  FROM cal c JOIN edges d ON d.head = c.head) GROUP BY 1, 2""")


@case("cal2_reliability_bins", """
SELECT b.head, bin, round(e[bin + 1], 6) AS lower, round(e[bin + 2], 6) AS upper, n, round(mp, 6)
  AS mean_predicted, round(obs, 6) AS observed_rate, round(mp - obs, 6) AS gap
FROM cal_bins b JOIN edges d ON d.head = b.head""")
def _(v):
    table = K.reliability_bins(_cal(v))
    numbers = ("lower", "upper", "mean_predicted", "observed_rate", "gap")
    return table.select("head", F.col("bin").cast("long").alias("bin"), "n", *[r(c).alias(c) for c in numbers])


cte("cal_report", """
SELECT *, rel - res + unc AS binned FROM (
  SELECT head, sum(n) AS n, sum(pos) AS pos, max(base) AS base, sum(n * mp) / sum(n) AS mp,
    sum(sq) / sum(n) AS brier, sum(n * abs(mp - obs)) / sum(n) AS ece, max(abs(mp - obs)) AS mce,
    sum(n * (mp - obs) * (mp - obs)) / sum(n) AS rel, sum(n * (obs - base) * (obs - base)) / sum(n) AS res,
    max(base * (1 - base)) AS unc
  FROM (SELECT *, sum(pos) OVER (PARTITION BY head) / sum(n) OVER (PARTITION BY head) AS base
    FROM cal_bins) GROUP BY 1)""")
_REPORT = """SELECT head, cast(n AS BIGINT) AS n, pos AS positives, round(base, 6) AS base_rate,
  round(mp, 6) AS mean_predicted, round(brier, 6) AS brier, round(ece, 6) AS ece, round(mce, 6) AS mce,
  round(rel, 6) AS reliability, round(res, 6) AS resolution, round(unc, 6) AS uncertainty,
  round(1 - brier / unc, 6) AS brier_skill, round(mp / base, 6) AS bias_ratio,
  round(res / unc, 6) AS resolution_share, round(brier - binned, 6) AS overdispersion FROM cal_report"""


@case("cal3_report", _REPORT)
def _(v):
    table = K.calibration_report(_cal(v))
    numbers = ("base_rate", "mean_predicted", "brier", "ece", "mce", "reliability", "resolution",
               "uncertainty", "brier_skill", "bias_ratio", "resolution_share", "overdispersion")
    return table.select("head", "n", "positives", *[r(c).alias(c) for c in numbers])


@case("cal4_verdict", """
SELECT head, CASE WHEN mp / base BETWEEN 0.8 AND 1.25 AND ece / base < 0.25 THEN 'calibrated' ||
  CASE WHEN res / unc >= 0.01 THEN '' ELSE ' but uninformative' END
  ELSE CASE WHEN mp / base > 1 THEN 'over' ELSE 'under' END || '-confident by ' ||
  printf('%.1f', greatest(mp / base, base / mp)) || 'x' ||
  CASE WHEN res / unc >= 0.01 THEN '' ELSE ', and uninformative' END END AS verdict FROM cal_report""")
def _(v):
    return K.calibration_report(_cal(v)).select("head", "verdict")


cte("platt_rows", """
SELECT head, ln(q / (1 - q)) AS z, count(*) AS n, sum(y) AS pos FROM (SELECT head, y,
  least(greatest(p, 1e-7), 1 - 1e-7) AS q FROM cal) GROUP BY 1, 2""")
cte("platt_targets", """
SELECT r.head, z, n, pos * (tp + 1) / (tp + 2) + (n - pos) / (tn - tp + 2) AS t, (tp + 1) / (tp + 2) AS hi,
  1 / (tn - tp + 2) AS lo, tp, tn, tz FROM platt_rows r JOIN (SELECT head, sum(pos) AS tp, sum(n) AS tn,
  sum(n * z) / sum(n) AS tz FROM platt_rows GROUP BY 1) s ON s.head = r.head""")


def _newton(steps):
    """Undamped Newton steps, one nested query each; it converges on this data."""
    sql = """SELECT head, cast(1 AS DOUBLE) AS a, ln(m / (1 - m)) - tz AS b FROM (SELECT DISTINCT head, tz,
  (tp * hi + (tn - tp) * lo) / tn AS m FROM platt_targets)"""
    for _ in range(steps):
        sql = f"""SELECT head, a - (bb * ga - ab * gb) / (aa * bb - ab * ab) AS a,
  b - (aa * gb - ab * ga) / (aa * bb - ab * ab) AS b FROM (SELECT head, a, b, sum((n * q - t) * z) AS ga,
  sum(n * q - t) AS gb, sum(n * q * (1 - q) * z * z) AS aa, sum(n * q * (1 - q) * z) AS ab,
  sum(n * q * (1 - q)) AS bb FROM (SELECT c.head, a, b, z, n, t, 1 / (1 + exp(-(a * z + b))) AS q
  FROM ({sql}) c JOIN platt_targets p ON p.head = c.head) GROUP BY 1, 2, 3)"""
    return sql


@case("cal5_platt", f"SELECT head, round(a, 4) AS a, round(b, 4) AS b FROM ({_newton(9)})")
def _(v):
    params = K.fit_platt(_cal(v))
    return v.spark.createDataFrame(
        [(h, round(a, 4), round(b, 4)) for h, (a, b) in params.items()], "head string, a double, b double"
    )


cte("iso_head_points", """
SELECT head, p, row_number() OVER h AS i, sum(n) OVER h AS w, sum(pos) OVER h AS s, n, pos FROM (
  SELECT head, p, count(*) AS n, sum(y) AS pos FROM cal GROUP BY 1, 2) WINDOW h AS (PARTITION BY head ORDER BY p)""")
cte("iso_head_fit", """
SELECT head, i, max(low) AS fit FROM (
  SELECT head, j, k AS i, min(mean) OVER (PARTITION BY head, j ORDER BY k DESC) AS low FROM (
    SELECT a.head, a.i AS j, b.i AS k, (b.s - a.s + a.pos) / (b.w - a.w + a.n) AS mean
    FROM iso_head_points a JOIN iso_head_points b ON b.head = a.head AND b.i >= a.i)) GROUP BY 1, 2""")


@case("cal6_isotonic", """
SELECT head, min(p) AS lo, max(p) AS hi, cast(sum(n) AS BIGINT) AS n, cast(sum(pos) AS BIGINT) AS positives,
  round(fit, 9) AS value FROM (SELECT i.head, p, n, pos, fit FROM iso_head_points i JOIN iso_head_fit f
  ON f.head = i.head AND f.i = i.i) GROUP BY head, fit""")
def _(v):
    blocks = K.fit_isotonic_heads(_cal(v))
    return blocks.select(
        "head", "lo", "hi", F.col("n").cast("long").alias("n"), F.col("positives").cast("long").alias("positives"),
        r("value", 9).alias("value"),
    )


@case("cal6_isotonic_every_head", """
SELECT i.head, p, round(fit, 6) AS calibrated, n FROM iso_head_points i JOIN iso_head_fit f
  ON f.head = i.head AND f.i = i.i""")
def _(v):
    rows = K.usable(_cal(v))
    done = K.apply_isotonic(K.fit_isotonic_heads(rows), rows)
    return done.groupBy("head", "p").agg(
        r(F.max("calibrated")).alias("calibrated"), F.count("*").alias("n")
    )


@case("cal7_fit_or_decline")
def _(v):
    found = K.fit_or_decline(_cal(v), "unit")
    return v.spark.createDataFrame(
        [(h, c.kind, round(c.a, 6), round(c.b, 6)) for h, c in found.items()],
        "head string, kind string, a double, b double",
    )


_Z = "ln(q / (1 - q))"


@case("cal8_apply_calibrators", f"""
SELECT head, round(sum(CASE WHEN head = 'f' THEN 1 / (1 + exp(-(0.5 * {_Z} - 1))) ELSE p END), 3) AS total
FROM (SELECT *, least(greatest(p, 1e-7), 1 - 1e-7) AS q FROM cal) GROUP BY 1""")
def _(v):
    chosen = {"f": K.Calibrator("platt", 0.5, -1.0)}
    done = K.calibrated(K.usable(_cal(v)), chosen)
    return done.groupBy("head").agg(r(F.sum("p"), 3).alias("total"))


def _scaled(slates, scores):
    top = scores.agg(F.max("score")).first()[0]
    rows = slates.join(scores, "token_id")
    return rows.select(
        "head", "label", (F.col("score") / top).alias("p"),
        F.concat_ws("-", "user_id", "token_id", "head").alias("unit"),
    )


@case("cal9_calibrate_heads")
def _(v):
    history = T.head_labels(aligned_sequences(v.split("val"))).filter(F.col("head").isin(*A.HEADS))
    slate = {s: _scaled(_slate_labels(v, s).filter("head <> 'any'"), v.scores) for s in ("val", "test")}
    _, report = K.calibrate_heads(slate["val"], _scaled(history, v.scores), slate["test"])
    return report.select("stage", "head", "n", "positives", r("ece").alias("ece"), "verdict")


cte("pooled_ranks", """
SELECT head, label, (row_number() OVER (PARTITION BY head ORDER BY score, user_id, token_id) - 1) /
  cast(count(*) OVER (PARTITION BY head) - 1 AS DOUBLE) AS p FROM slate_heads""")
cte("rank_edges", """
SELECT head, list_sort(list_distinct(quantile_cont(p, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])))
  AS e FROM pooled_ranks GROUP BY 1""")


@case("cal10_slate_resolution", """
SELECT head, cast(sum(n) AS BIGINT) AS n, sum(pos) AS positives, round(sum(pos) / sum(n), 6) AS base_rate,
  round(sum(n * (pos / n - base) * (pos / n - base)) / sum(n), 7) AS resolution
FROM (SELECT *, sum(pos) OVER (PARTITION BY head) / sum(n) OVER (PARTITION BY head) AS base FROM (
  SELECT c.head, len(list_filter(e[2:len(e) - 1], lambda x: x <= c.p)) AS bin, count(*) AS n,
    cast(sum(label) AS DOUBLE) AS pos FROM pooled_ranks c JOIN rank_edges d ON d.head = c.head GROUP BY 1, 2))
GROUP BY 1""")
def _(v):
    rows = _slate_labels(v).join(v.scores, "token_id")
    one_head = rows.filter("head = 'any'").select("user_id", "token_id", "score")
    ranked = K.percentile_ranks(one_head, "score", ["user_id", "token_id"]).drop("score")
    table = K.resolution(rows.join(ranked, ["user_id", "token_id"]))
    return table.select(
        "head", "n", "positives", r("base_rate").alias("base_rate"), r("resolution", 7).alias("resolution")
    )


