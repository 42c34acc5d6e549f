"""Sequences and training examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfstream.functions.tokens import uniform
from shelfstream.operators import lists as L
from shelfstream.operators import sequences as Q
from shelfstream.operators import training as T
from shelfstream.plans import gold, silver
from shelfstream.scale import fresh_dir
from shelfstream.sources.tables import Warehouse, aligned_sequences
from workload.registry import case, cte
from workload.views import GOLD, RULES, SILVER, r, text_of

SQL_HASH = "('0x' || substr(md5({}), 1, 8))::BIGINT"


@case("seq1_silver_job", """
SELECT event_id, user_id, event_type, sku, event_rank FROM silver""")
def _(v):
    return v.silver.select("event_id", "user_id", "event_type", "sku", "event_rank")


@case("seq1_silver_tables", """
SELECT (SELECT count(*) FROM silver) AS silver_events, (SELECT count(DISTINCT user_id) FROM silver)
  AS silver_users, (SELECT count(*) FROM duplicated) AS input_events,
  (SELECT count(*) FROM duplicated) - (SELECT count(*) FROM s_consent) AS consent_dropped_events,
  (SELECT count(*) FROM catalogue WHERE p_partkey % 10 <> 9) AS items""")
def _(v):
    w = Warehouse(v.spark, fresh_dir(v.spark, "warehouse"))
    w.write("bronze.interactions", v.duplicated())
    w.write("bronze.catalog", v.catalogue(10))
    report = silver.run(w, SILVER)
    row = [report[c] for c in ("silver_events", "silver_users", "input_events", "consent_dropped_events")]
    items = w.read("silver.item_hierarchy").agg(F.count("*").alias("items"))
    one = v.spark.createDataFrame(
        [row], "silver_events long, silver_users long, input_events long, consent_dropped_events long"
    )
    return one.withColumn("_k", F.lit(1)).join(items.withColumn("_k", F.lit(1)), "_k").drop("_k")


cte("all_sequences", """
SELECT 'train' AS split, * EXCLUDE (t1, t2, newest) FROM h_train UNION ALL
SELECT 'val', * EXCLUDE (t1, t2, newest) FROM h_val UNION ALL
SELECT 'test', * EXCLUDE (t1, t2, newest) FROM h_test""")


@case("seq2_history_arrays", """
SELECT user_id, split, string_agg(token_id, ',' ORDER BY pos) AS tokens,
  string_agg(event_type, ',' ORDER BY pos) AS actions,
  string_agg(event_ts_unix, ',' ORDER BY pos) AS times,
  string_agg(returned, ',' ORDER BY pos) AS returned FROM all_sequences GROUP BY 1, 2""")
def _(v):
    return v.sequences.select(
        "user_id", "split", text_of("input_tokens").alias("tokens"),
        text_of("input_actions").alias("actions"), text_of("input_ts").alias("times"),
        text_of("input_returned").alias("returned"),
    )


@case("seq3_return_labels", """
SELECT event_type, returned, count(*) AS n FROM order_labels GROUP BY 1, 2""")
def _(v):
    rows = v.shop_orders()
    newest = rows.agg(F.max("event_ts_unix")).first()[0]
    labelled = Q.with_return_labels(rows, 120, newest)
    return labelled.groupBy("event_type", "returned").agg(F.count("*").alias("n"))


@case("seq4_time_split", "SELECT t1, t2, newest FROM cutoffs")
def _(v):
    events, t1, t2 = v.labelled
    return events.agg(
        F.lit(t1).cast("long").alias("t1"), F.lit(t2).cast("long").alias("t2"),
        F.max("event_ts_unix").alias("newest"),
    )


@case("seq5_vocabulary", "SELECT token_id, token, category, train_events FROM vocab")
def _(v):
    return v.vocab


@case("seq6_targets", """
SELECT user_id, 'test' AS split, string_agg(token_id, ',' ORDER BY token_id) AS targets,
  string_agg(action_id, ',' ORDER BY token_id) AS actions FROM t_test GROUP BY 1 UNION ALL
SELECT user_id, 'val', string_agg(token_id, ',' ORDER BY token_id),
  string_agg(action_id, ',' ORDER BY token_id) FROM t_val GROUP BY 1""")
def _(v):
    return v.sequences.filter("split <> 'train'").select(
        "user_id", "split", text_of("target_tokens").alias("targets"),
        text_of("target_actions").alias("actions"),
    )


@case("seq7_gold_tables", """
SELECT split, count(DISTINCT user_id) AS users, count(*) AS events,
  cast(sum(token_id) AS BIGINT) AS token_sum FROM all_sequences GROUP BY 1""")
def _(v):
    w = Warehouse(v.spark, fresh_dir(v.spark, "warehouse"))
    w.write("silver.interactions", v.silver)
    w.write("silver.item_hierarchy", v.items)
    gold.run(w, "config", RULES, GOLD)
    rows = w.read("gold.sequences_config").select(
        "split", "user_id", F.explode("input_tokens").alias("t")
    )
    return rows.groupBy("split").agg(
        F.count_distinct("user_id").alias("users"), F.count("*").alias("events"),
        F.sum("t").alias("token_sum"),
    )


def _vocab_size(column):
    return f"""SELECT '{column}' AS variant, count(DISTINCT c.{column}) AS vocab_size,
  count(DISTINCT e.sku) FILTER (event_ts_unix < t1) AS skus_in_training
FROM labelled e JOIN catalogue c ON c.sku = e.sku, cutoffs WHERE event_ts_unix < t1"""


@case("seq8_variants", f"""
{_vocab_size("sku")} UNION ALL {_vocab_size("style_color_id")} UNION ALL {_vocab_size("product_id")}""")
def _(v):
    w = Warehouse(v.spark, fresh_dir(v.spark, "warehouse"))
    w.write("silver.interactions", v.silver)
    w.write("silver.item_hierarchy", v.items)
    names = {"sku": "sku", "style_color": "style_color_id", "product": "product_id"}
    report = gold.run_variants(w, {n: uniform(level) for level, n in names.items()}, GOLD)
    in_training = w.read("gold.vocab_sku").agg(F.count("*").alias("skus_in_training"))
    return report.select("variant", "vocab_size", F.lit(1).alias("_k")).join(
        in_training.withColumn("_k", F.lit(1)), "_k"
    ).drop("_k")


@case("seq9_array_repair", """
SELECT user_id, split, max(len) AS n, string_agg(0, ',' ORDER BY pos) AS actions,
  string_agg(pos, ',' ORDER BY pos) AS times FROM all_sequences GROUP BY 1, 2""")
def _(v):
    broken = v.sequences.withColumn(
        "input_actions", F.slice("input_actions", F.lit(1), F.size("input_actions") - 1)
    ).drop("input_ts")
    return aligned_sequences(broken).select(
        "user_id", "split", F.size("input_tokens").cast("long").alias("n"),
        text_of("input_actions").alias("actions"), text_of("input_ts").alias("times"),
    )


cte("window_starts", """
SELECT user_id, n, CASE WHEN n <= 9 THEN 0 ELSE s END AS start, least(n, 9) AS length
FROM (SELECT user_id, max(len) AS n FROM h_train GROUP BY 1)
JOIN range(0, 200) r(s) ON (n <= 9 AND s = 0) OR (n > 9 AND s <= n - 9 AND (n - 9 - s) % 6 = 0)
UNION ALL
SELECT user_id, n, greatest((n - 9) % 6 - 9, 0), (n - 9) % 6 FROM
  (SELECT user_id, max(len) AS n FROM h_train GROUP BY 1) WHERE n > 9 AND (n - 9) % 6 >= 2""")


@case("seq10_token_windows", """
SELECT w.user_id, w.start, repeat('0,', cast(9 - length AS BIGINT)) ||
  string_agg(token_id, ',' ORDER BY pos) AS tokens
FROM window_starts w JOIN h_train h ON h.user_id = w.user_id AND pos >= w.start
  AND pos < w.start + w.length GROUP BY w.user_id, w.start, w.length""")
def _(v):
    cut = T.windows(v.split("train"), max_len=8, stride=6)
    return cut.select("user_id", F.col("start").cast("long").alias("start"), text_of("tokens").alias("tokens"))


@case("seq10_parallel_windows", """
SELECT w.user_id, w.start, repeat(min(event_ts_unix) || ',', cast(9 - length AS BIGINT)) ||
  string_agg(event_ts_unix, ',' ORDER BY pos) AS times
FROM window_starts w JOIN h_train h ON h.user_id = w.user_id AND pos >= w.start
  AND pos < w.start + w.length WHERE (n <= 9 OR length = 9) GROUP BY w.user_id, w.start, w.length""")
def _(v):
    rows = aligned_sequences(v.split("train"))
    cut = T.windows(rows, max_len=8, stride=6, keep_oldest=False, parallel=True)
    return cut.select("user_id", F.col("start").cast("long").alias("start"), text_of("times").alias("times"))


@case("seq11_padded_history", """
SELECT user_id, repeat('0,', cast(greatest(40 - len, 0) AS BIGINT)) ||
  string_agg(token_id, ',' ORDER BY pos) AS tokens,
  repeat(min(event_ts_unix) || ',', cast(greatest(40 - len, 0) AS BIGINT)) ||
  string_agg(event_ts_unix, ',' ORDER BY pos) AS times,
  repeat('-1,', cast(greatest(40 - len, 0) AS BIGINT)) || string_agg(returned, ',' ORDER BY pos)
  AS returned FROM h_train GROUP BY user_id, len""")
def _(v):
    rows = T.padded_history(aligned_sequences(v.split("train")), 40)
    return rows.select(
        "user_id", text_of("tokens").alias("tokens"), text_of("times").alias("times"),
        text_of("returned").alias("returned"),
    )


cte("heads_train", """
SELECT user_id, pos, token_id, 'click' AS head,
  CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS label FROM h_train
UNION ALL SELECT user_id, pos, token_id, 'cart', CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END
FROM h_train
UNION ALL SELECT user_id, pos, token_id, 'purchase', CASE WHEN event_type = 'purchase' THEN 1 ELSE 0
END FROM h_train
UNION ALL SELECT user_id, pos, token_id, 'return', CASE WHEN returned = 1 THEN 1 ELSE 0 END
FROM h_train WHERE returned IN (0, 1)""")


@case("seq12_head_labels", """
SELECT user_id, pos AS position, token_id, head, label FROM heads_train""")
def _(v):
    return T.head_labels(aligned_sequences(v.split("train"))).select(
        "user_id", "position", "token_id", "head", "label"
    )


cte("prefixes", """
SELECT user_id, token_id, pos FROM h_train WHERE len - pos <= 16 AND pos < len - 1""")
cte("pools", """
SELECT user_id, token_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, token_id) AS n
FROM (SELECT DISTINCT user_id FROM h_train), pop
WHERE (user_id, token_id) NOT IN (SELECT (user_id, token_id) FROM prefixes)
QUALIFY n <= 12""")


def _with_pool(v):
    rows = v.split("train")
    recent = F.slice("input_tokens", F.greatest(F.size("input_tokens") - 15, F.lit(1)), 16)
    prefix = F.slice(recent, F.lit(1), F.size(recent) - 1)
    ranking = L.popular_ids(v.scores, 12 + 16)
    return rows.withColumn("pool", L.unseen_in_order(ranking, 12, prefix))


@case("seq13_hard_negative_pool", """
SELECT user_id, string_agg(token_id, ',' ORDER BY n) AS pool FROM pools GROUP BY 1""")
def _(v):
    return _with_pool(v).select("user_id", text_of("pool").alias("pool"))


_U = SQL_HASH.format("'5u|' || user_id || '|' || i")
_P = SQL_HASH.format("'5p|' || user_id || '|' || i")
cte("vocab_n", "SELECT count(*) AS vn FROM vocab")
cte("drawn", f"""
SELECT d.user_id, d.i, d.positive, coalesce(p.token_id, d.flat) AS token_id FROM (
  SELECT user_id, i, positive, {_U} % vn + 1 AS flat, CASE WHEN i < 4 THEN {_P} % pool_n + 1 END AS pick
  FROM (SELECT user_id, max(CASE WHEN pos = len - 1 THEN token_id END) AS positive FROM h_train GROUP BY 1)
  JOIN (SELECT user_id AS pu, count(*) AS pool_n FROM pools GROUP BY 1) ON pu = user_id, vocab_n,
  range(0, 8) r(i)) d LEFT JOIN pools p ON p.user_id = d.user_id AND p.n = d.pick""")


@case("seq14_sampled_negatives", """
SELECT user_id, string_agg(token_id, ',' ORDER BY i) AS negatives,
  string_agg(CASE WHEN token_id = positive THEN 0 ELSE 1 END, ',' ORDER BY i) AS mask
FROM drawn GROUP BY 1""")
def _(v):
    rows = T.negatives(_with_pool(v), v.vocab_size + 1, 8, hard_share=0.5, seed=5)
    return rows.select("user_id", text_of("negatives").alias("negatives"), text_of("mask").alias("mask"))


_C = SQL_HASH.format("'3c|' || a.user_id")


@case("seq15_unseen_cut", f"""
SELECT a.user_id, coalesce(b.pos, a.len - 1) AS cut, b.pos IS NULL AS is_fallback FROM (
  SELECT user_id, max(len) AS len, count(*) FILTER (new AND pos > 0) AS n FROM (SELECT *, row_number()
    OVER (PARTITION BY user_id, token_id ORDER BY pos) = 1 AS new FROM h_train) GROUP BY 1) a
LEFT JOIN (SELECT user_id, pos, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS k FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, token_id ORDER BY pos) = 1 AS new FROM h_train)
  WHERE new AND pos > 0) b ON a.user_id = b.user_id AND b.k = {_C} % greatest(a.n, 1) + 1""")
def _(v):
    return T.unseen_cut(v.split("train"), seed=3).select(
        "user_id", F.col("cut").cast("long").alias("cut"), "is_fallback"
    )


@case("seq16_repeat_share", """
SELECT count(DISTINCT t.user_id) AS users, count(*) AS target_items, count(h.token_id)
  AS excluded_as_seen, count(*) - count(h.token_id) AS reachable,
  round(count(h.token_id) / cast(count(*) AS DOUBLE), 4) AS excluded_share
FROM t_test t LEFT JOIN (SELECT DISTINCT user_id, token_id FROM h_test) h
  ON t.user_id = h.user_id AND t.token_id = h.token_id""")
def _(v):
    return T.repeat_share(v.split("test"))


@case("seq17_size_affinity", """
SELECT user_id, category, size, n AS size_purchases, total AS kept_purchases FROM (
  SELECT user_id, category, size, count(*) AS n, cast(sum(count(*)) OVER (PARTITION BY user_id, category)
    AS BIGINT) AS total, row_number() OVER (PARTITION BY user_id, category ORDER BY count(*) DESC, size)
    AS rn
  FROM shop_orders s JOIN (SELECT cast(p_partkey AS VARCHAR) AS psku, lower(p_type) AS category,
    cast(p_size AS VARCHAR) AS size FROM part WHERE lower(p_type) IN ('economy', 'standard')) p
    ON p.psku = s.sku
  WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM shop_orders b WHERE
    b.event_type = 'return' AND lower(b.return_reason) IN ('too_small', 'fit') AND b.user_id = s.user_id
    AND b.order_id = s.order_id AND b.sku = s.sku)
  GROUP BY 1, 2, 3) WHERE rn = 1""")
def _(v):
    items = v.table("part").select(
        F.col("p_partkey").cast("string").alias("sku"), F.col("p_type").alias("category"),
        F.create_map(F.lit("size"), F.col("p_size").cast("string")).alias("attributes"),
    )
    return T.size_affinity(v.shop_orders(), items, ("economy", "standard"), ("too_small", "fit"))


@case("udf2_decayed_popularity", """
SELECT token_id, round(sum(pow(2, -(len - 1 - pos) / cast(10 AS DOUBLE))), 6) AS score FROM h_train
GROUP BY 1""")
def _(v):
    return L.popularity(v.split("train"), half_life=10).select("token_id", r("score").alias("score"))


@case("udf1_scorer_contract", """
SELECT user_id, cast(token_id AS INTEGER) AS token_id, cast(count(*) AS DOUBLE) AS score FROM h_test
GROUP BY 1, 2""")
def _(v):
    import pandas as pd

    def repeats(batches):
        for batch in batches:
            long = batch[["user_id", "input_tokens"]].explode("input_tokens")
            counts = long.groupby(["user_id", "input_tokens"]).size().reset_index(name="score")
            yield pd.DataFrame({
                "user_id": counts["user_id"], "token_id": counts["input_tokens"].astype("int32"),
                "score": counts["score"].astype("float64"),
            })

    rows = v.split("test").select("user_id", "input_tokens")
    return L.from_scorer(rows, repeats)


