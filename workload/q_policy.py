"""Retrieval and recommendation lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from shelfstream.operators import lists as L
from shelfstream.operators import policy as P
from shelfstream.operators import retrieval as R
from shelfstream.plans import recommend as REC
from shelfstream.scale import cut, fresh_dir
from workload.registry import case, cte
from workload.views import r, text_of

POLICY = P.Policy(
    excluded_products=("bolt",), pinned_products=("gizmo", "gear"), max_per_category=2
)
LIMIT = 8


@case("top5_exact_neighbours", """
SELECT user_id, token_id, position, round(score, 5) AS score FROM (
  SELECT user_id, token_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, token_id)
    AS position FROM tenth_neighbours WHERE token_id % 7 <> user_id % 7) WHERE position <= 10""")
def _(v):
    users, items = v.users_and_items(10)
    # Excluded: the items of the user's own residue class.
    users, items = users.withColumn("m", F.col("user_id") % 7), items.withColumn("m", F.col("token_id") % 7)
    top = R.exact_top_k(users, items, 10, apart="m")
    return top.select("user_id", "token_id", "position", r("score", 5).alias("score"))


@case("top6_probe_every_cell", """
SELECT user_id, token_id, position, round(score, 5) AS score FROM tenth_neighbours WHERE position <= 10""")
def _(v):
    # With every cell probed the approximate index has to return the exact answer.
    users, items = v.users_and_items(10)
    found = R.approximate_top_k(users, items, 10, cells=12, probes=12, block=64)
    return found.select("user_id", "token_id", "position", r("score", 5).alias("score"))


# Cells around 16 given items, those with the smallest md5 of their id.
cte("cell_centers", """
SELECT v, list_inner_product(v, v) / 2 AS half, row_number() OVER (ORDER BY h, vec_id) - 1 AS cell FROM (
  SELECT vec_id, cast(embedding AS DOUBLE[]) AS v, md5(cast(vec_id AS VARCHAR)) AS h FROM embeddings
  ORDER BY h, vec_id LIMIT 16)""")
cte("near_cells", """
SELECT vec_id, cell, e, row_number() OVER (PARTITION BY vec_id ORDER BY half - list_inner_product(e, v), cell) AS r
FROM (SELECT vec_id, cast(embedding AS DOUBLE[]) AS e FROM embeddings), cell_centers""")
cte("probed", """
SELECT n.probes, u.vec_id AS user_id, i.vec_id AS token_id, list_inner_product(u.e, i.e) AS score, row_number()
  OVER (PARTITION BY n.probes, u.vec_id ORDER BY list_inner_product(u.e, i.e) DESC, i.vec_id) AS position
FROM (SELECT unnest([2, 4, 8, 13, 16]) AS probes) n JOIN near_cells u ON u.r <= n.probes AND u.vec_id % 20 = 0
JOIN near_cells i ON i.cell = u.cell AND i.r = 1""")


def _centers(items):
    rows = items.select("vector", F.md5(F.col("token_id").cast("string")).alias("h"), "token_id")
    chosen = rows.orderBy("h", "token_id").limit(16).select("vector").collect()
    return np.array([c["vector"] for c in chosen], dtype=np.float64)


def _probed(users, items, probes):
    return R.approximate_top_k(users, items, 10, probes=probes, centers=_centers(items))


cte("recalls", """
SELECT probes, user_id, count(p_token) / cast(count(*) AS DOUBLE) AS recall FROM (
  SELECT n.probes, t.user_id, p.token_id AS p_token
  FROM (SELECT unnest([2, 4, 8, 13, 16]) AS probes) n CROSS JOIN (SELECT * FROM exact_neighbours WHERE position <= 10) t
  LEFT JOIN probed p ON p.probes = n.probes AND p.user_id = t.user_id AND p.token_id = t.token_id AND p.position <= 10)
GROUP BY 1, 2""")


def _with_recall(found, truth):
    """The answer with its measured recall beside it."""
    recall = R.measured_recall(truth, found).select(r("recall").alias("recall"))
    return found.crossJoin(F.broadcast(recall)).select(
        "user_id", "token_id", "position", r("score", 5).alias("score"), "recall"
    )


@case("top6_approximate_neighbours", """
SELECT user_id, token_id, position, round(score, 5) AS score,
  (SELECT round(avg(recall), 6) FROM recalls WHERE probes = 13) AS recall
FROM probed WHERE probes = 13 AND position <= 10""")
def _(v):
    users, items = v.users_and_items()
    found = cut(_probed(users, items, 13))
    return _with_recall(found, cut(R.exact_top_k(users, items, 10)))


@case("top6_fitted_cells")
def _(v):
    users, items = v.users_and_items()
    found = cut(R.approximate_top_k(users, items, 10, cells=16, probes=13))
    return _with_recall(found, cut(R.exact_top_k(users, items, 10)))


@case("top6_stored_index", """
SELECT probes, count(*) AS queries, round(avg(recall), 6) AS recall, round(min(recall), 6) AS worst_query_recall,
  probes < 16 AS pruned FROM recalls WHERE probes IN (4, 13, 16) GROUP BY 1""")
def _(v):
    # Two thirds of the items build the index, the others are appended without a new fit.
    users, items = v.users_and_items()
    late = F.col("token_id") % 3 == 2
    index = R.CellIndex(v.spark, fresh_dir(v.spark, "cells"))
    index.build(items.filter(~late), centers=_centers(items))
    index.append(items.filter(late))
    truth, table = cut(R.exact_top_k(users, items, 10)), None
    for probes in (4, 13, 16):
        one = R.measured_recall(truth, index.top_k(users, 10, probes))
        # One user looks into so many cells; their folders are all that is read.
        _, read = index.probed(users.orderBy("user_id").limit(1), probes)
        folders = read.select(F.col("_metadata.file_path").alias("f")).distinct().filter(
            F.regexp_extract("f", "cell=([0-9]+)", 1) != "").select(F.regexp_extract("f", "cell=([0-9]+)", 1)).distinct().count()
        one = one.withColumn("probes", F.lit(probes)).withColumn("pruned", F.lit(folders == probes and probes < 16))
        table = one if table is None else table.unionByName(one)
    return table.select("probes", "queries", r("recall").alias("recall"), r("worst_query_recall").alias("worst_query_recall"), "pruned")


@case("top7_measured_recall", """
SELECT 16 AS probes, count(DISTINCT user_id) AS queries, cast(1 AS DOUBLE) AS recall,
  cast(1 AS DOUBLE) AS worst_query_recall FROM tenth_neighbours""")
def _(v):
    users, items = v.users_and_items(10)
    truth = cut(R.exact_top_k(users, items, 10))
    found = R.approximate_top_k(users, items, 10, cells=16, probes=16)
    return R.measured_recall(truth, found).withColumn("probes", F.lit(16))


@case("top7_recall_by_probes", """
SELECT probes, count(*) AS queries, round(avg(recall), 6) AS recall, round(min(recall), 6) AS worst_query_recall
FROM recalls WHERE probes IN (2, 8, 13) GROUP BY 1""")
def _(v):
    users, items = v.users_and_items()
    truth = cut(R.exact_top_k(users, items, 10))
    table = None
    for probes in (2, 8, 13):
        one = R.measured_recall(truth, _probed(users, items, probes)).withColumn("probes", F.lit(probes))
        table = one if table is None else table.unionByName(one)
    return table.select("probes", "queries", r("recall").alias("recall"), r("worst_query_recall").alias("worst_query_recall"))


cte("heads4", """
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_discount AS purchase, l_tax AS cart,
  l_quantity / cast(60 AS DOUBLE) AS click, CASE WHEN l_returnflag = 'R' THEN cast(0.75 AS DOUBLE) ELSE 0
  END AS ret FROM lineitem""")


@case("pol1_score_blend", """
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, round(purchase * greatest(0, 1 - 1.5e0 * ret)
  + 0.05e0 * cart + 0.005e0 * click, 7) AS score FROM heads4""")
def _(v):
    rows = v.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.col("l_discount").alias("purchase"),
        F.col("l_tax").alias("cart"), (F.col("l_quantity") / 60).alias("click"),
        F.when(F.col("l_returnflag") == "R", 0.75).otherwise(0.0).alias("return"),
    )
    return rows.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey",
        r(P.blended(P.Blend(return_penalty=1.5)), 7).alias("score"),
    )


@case("pol2_availability", """
SELECT event_id, CASE WHEN NOT s.available THEN false WHEN u = 0 THEN stock_a > 0 OR stock_b > 0
  WHEN u = 1 THEN stock_a > 0 WHEN u = 2 THEN stock_b > 0 ELSE false END AS orderable
FROM (SELECT event_id, sku, cast(user_id AS BIGINT) % 4 AS u FROM interactions) i
JOIN item_states s ON i.sku = s.sku""")
def _(v):
    u = F.col("user_id").cast("long") % 4
    store = F.when(u == 1, "A").when(u == 2, "B").when(u == 3, "C")
    rows = v.interactions().join(v.item_states(), "sku")
    return rows.select("event_id", P.in_stock(F.col("available"), F.col("stock"), store).alias("orderable"))


# Candidates: each user's 40 most popular unseen tokens, with context.
cte("token_products", """
SELECT token, min(product_id) AS product_id FROM token_items WHERE p_partkey % 20 <> 19 GROUP BY 1""")
cte("context", """
SELECT user_id, CASE cast(user_id AS BIGINT) % 3 WHEN 1 THEN 'A' WHEN 2 THEN 'B' END AS store,
  CASE WHEN cast(user_id AS BIGINT) % 2 = 0 THEN cast(0.85 AS DOUBLE) END AS affinity FROM h_test
GROUP BY 1""")
cte("bought", "SELECT DISTINCT user_id, sku FROM interactions WHERE event_type = 'purchase'")
cte("shopping", """
SELECT DISTINCT i.user_id, c.category FROM interactions i JOIN catalogue c ON c.sku = i.sku
WHERE i.event_type = 'click' AND i.event_date >= DATE '2024-01-29'""")
cte("cands", """
SELECT l.user_id, l.token_id, l.position AS rank, l.score AS model_score, v.token, v.category,
  coalesce(p.product_id, v.token) AS product_id, store, affinity
FROM lists_test l JOIN vocab v ON v.token_id = l.token_id LEFT JOIN token_products p ON p.token = v.token
JOIN context c ON c.user_id = l.user_id WHERE l.position <= 40""")
cte("cand_skus", """
SELECT c.user_id, c.token_id, t.sku,
  s.sku IS NULL OR (s.available AND CASE WHEN store IS NULL THEN stock_a > 0 OR stock_b > 0
    WHEN store = 'A' THEN stock_a > 0 ELSE stock_b > 0 END) AS stocked,
  b.sku IS NOT NULL AS owned
FROM cands c JOIN (SELECT token, sku FROM token_items WHERE p_partkey % 20 <> 19) t ON t.token = c.token
LEFT JOIN (SELECT * FROM item_states WHERE cast(sku AS INTEGER) % 5 <> 0) s ON s.sku = t.sku
LEFT JOIN bought b ON b.user_id = c.user_id AND b.sku = t.sku""")
cte("checked", """
SELECT c.*, sku1, CASE WHEN c.product_id = 'bolt' THEN 'excluded' WHEN n_stocked = 0 THEN 'out_of_stock'
  WHEN n_left = 0 THEN 'purchased' END AS drop_reason
FROM cands c JOIN (SELECT user_id, token_id, count(*) FILTER (stocked) AS n_stocked,
  count(*) FILTER (stocked AND NOT owned) AS n_left, min(sku) FILTER (stocked AND NOT owned) AS sku1
  FROM cand_skus GROUP BY 1, 2) k ON k.user_id = c.user_id AND k.token_id = c.token_id""")
cte("boosted", """
SELECT k.*, s.promo_id IS NOT NULL AS promoted, model_score * least(1.5,
  CASE WHEN s.promo_id IS NOT NULL THEN cast(1.15 AS DOUBLE) ELSE 1 END *
  CASE WHEN affinity IS NOT NULL AND s.sku IS NOT NULL THEN 1 + cast(0.1 AS DOUBLE) *
    greatest(1 - abs(least(s.price / s.list_price, 2) - affinity), -1) ELSE 1 END *
  CASE WHEN w.category IS NOT NULL THEN cast(1.05 AS DOUBLE) ELSE 1 END) AS final_score
FROM checked k LEFT JOIN (SELECT * FROM item_states WHERE cast(sku AS INTEGER) % 5 <> 0) s ON s.sku = k.sku1
LEFT JOIN shopping w ON w.user_id = k.user_id AND w.category = k.category WHERE drop_reason IS NULL""")
cte("capped_rows", """
SELECT *, coalesce(sum(CASE WHEN NOT is_over THEN 1 ELSE 0 END) OVER (PARTITION BY user_id
  ORDER BY final_score DESC, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS placed,
  row_number() OVER (PARTITION BY user_id ORDER BY is_over, final_score DESC, rank) AS slot
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, category ORDER BY final_score DESC, rank) > 2
  AS is_over FROM boosted)""")
cte("pin_rows", f"""
SELECT *, slot <= {LIMIT} AND (pin IS NULL OR row_number() OVER (PARTITION BY user_id, pin ORDER BY slot) = 1)
  AS is_shown FROM (SELECT *, CASE WHEN slot <= {LIMIT} THEN CASE product_id WHEN 'gizmo' THEN 0
  WHEN 'gear' THEN 1 END END AS pin FROM capped_rows)""")
cte("final_rows", """
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pin NULLS LAST, slot) - 1 AS position
FROM pin_rows WHERE is_shown""")


def _skus(v):
    """((token, product_id), (token, sku, state))"""
    states = v.item_states().filter(F.col("sku").cast("int") % 5 != 0)
    return P.token_skus(v.catalogue(20), v.token, states)


def _owned(v):
    return v.interactions().filter("event_type = 'purchase'").select("user_id", "sku")


def _with_context(v, rows, scoring=True):
    """Store of each user and, as far as ``scoring`` reads them, price affinity and categories clicked of late."""
    u = F.col("user_id").cast("long")
    rows = rows.withColumn("store_id", F.when(u % 3 == 1, "A").when(u % 3 == 2, "B"))
    if not scoring:
        return rows
    browsing = v.interactions().filter("event_type = 'click' and event_date >= date'2024-01-29'").join(
        v.catalogue().select("sku", "category"), "sku"
    ).groupBy("user_id").agg(F.collect_set("category").alias("session_categories"))
    # The categories are few.
    return rows.join(browsing, "user_id", "left").withColumn("price_affinity", F.when(u % 2 == 0, 0.85))


def _scored(v, scoring=True):
    rows = REC.popular_candidates(
        _with_context(v, v.split("test").select("user_id", "input_tokens"), scoring), v.scores, 40, 30
    )
    return rows


def _candidates(v, scoring=True):
    return REC.candidates(_scored(v, scoring), v.vocab, _skus(v)[0], 40)


def _filtered(v, policy, scoring=True):
    return P.filtered_by_rows(_candidates(v, scoring), _skus(v)[1], _owned(v), policy)


def _applied(v):
    return P.applied(_candidates(v), POLICY, LIMIT, _skus(v)[1], _owned(v))


@case("pol3_filters", """
SELECT user_id, token_id, drop_reason, CASE WHEN drop_reason IS NULL THEN sku1 END AS suggested_sku
FROM checked""")
def _(v):
    rows = _filtered(v, POLICY, scoring=False)
    return rows.select(
        "user_id", "token_id", "drop_reason",
        F.when(F.col("drop_reason").isNull(), F.col("suggested.sku")).alias("suggested_sku"),
    )


@case("pol4_adjusted_scores", """
SELECT user_id, token_id, promoted, round(final_score, 6) AS final_score FROM boosted""")
def _(v):
    kept = _filtered(v, POLICY).filter("drop_reason is null")
    return P.adjusted(kept, POLICY).select(
        "user_id", "token_id", "promoted", r("final_score").alias("final_score")
    )


@case("pol5_category_cap", f"""
SELECT user_id, token_id, slot, is_over AND placed < {LIMIT} AS capped FROM capped_rows
WHERE slot <= {LIMIT}""")
def _(v):
    plain = P.Policy(excluded_products=("bolt",), max_per_category=2)
    kept = _filtered(v, plain).filter("drop_reason is null")
    rows = P.finalised(P.adjusted(kept, plain), plain, LIMIT).filter("position is not null")
    return rows.select(
        "user_id", "token_id", (F.col("position") + 1).cast("long").alias("slot"), "capped"
    )


@case("pol6_pins", """
SELECT user_id, token_id, position, pin IS NOT NULL AS pinned, CASE WHEN pin IS NOT NULL THEN
  'merchandising' WHEN promoted THEN 'promotion' ELSE 'relevance' END AS reason_code FROM final_rows""")
def _(v):
    rows = _applied(v).filter("position is not null")
    return rows.select("user_id", "token_id", "position", "pinned", "reason_code")


@case("pol7_trace", f"""
SELECT a.user_id, candidates_in, dropped_excluded, 0 AS dropped_no_sku, dropped_out_of_stock,
  dropped_purchased, coalesce(capped_by_category, 0) AS capped_by_category, coalesce(promoted, 0)
  AS promoted, coalesce(pinned, 0) AS pinned, coalesce(items_out, 0) AS items_out
FROM (SELECT user_id, count(*) AS candidates_in, count(*) FILTER (drop_reason = 'excluded')
    AS dropped_excluded, count(*) FILTER (drop_reason = 'out_of_stock') AS dropped_out_of_stock,
    count(*) FILTER (drop_reason = 'purchased') AS dropped_purchased FROM checked GROUP BY 1) a
LEFT JOIN (SELECT user_id, count(*) FILTER (is_over AND placed < {LIMIT}) AS capped_by_category,
    count(*) FILTER (promoted) AS promoted FROM capped_rows GROUP BY 1) b ON b.user_id = a.user_id
LEFT JOIN (SELECT user_id, count(pin) AS pinned, count(*) AS items_out FROM final_rows GROUP BY 1) c
  ON c.user_id = a.user_id""")
def _(v):
    return P.trace(_applied(v), ["user_id"])


@case("pol8_surface_setting", """
SELECT event_id, event_type NOT IN ('view', 'click') AS hide FROM interactions""")
def _(v):
    setting = {"view": False, "click": False, "purchase": True, "default": True}
    return v.interactions().select("event_id", P.excludes_seen(F.col("event_type"), setting).alias("hide"))


cte("everyone", "SELECT DISTINCT user_id FROM interactions")


@case("pol9_batch_recommendations", f"""
SELECT user_id, position, product_id, sku1 AS suggested_sku, round(final_score, 6) AS score,
  CASE WHEN pin IS NOT NULL THEN 'merchandising' WHEN promoted THEN 'promotion' ELSE 'relevance' END
  AS reason_code, 'model' AS served_from FROM final_rows
UNION ALL
SELECT user_id, n - 1, token, NULL, cast(0 AS DOUBLE), reason, reason FROM (
  SELECT user_id, CASE WHEN user_id IN (SELECT user_id FROM h_test) THEN 'policy_emptied'
    ELSE 'cold_start' END AS reason FROM everyone
  WHERE user_id NOT IN (SELECT user_id FROM final_rows)),
  (SELECT v.token, row_number() OVER (ORDER BY score DESC, p.token_id) AS n FROM pop p
   JOIN vocab v ON v.token_id = p.token_id QUALIFY n <= {LIMIT})""")
def _(v):
    spare = L.most_popular(v.scores, LIMIT).join(v.vocab.select("token_id", "token"), "token_id")
    fallback = [x["token"] for x in spare.orderBy(F.desc("score"), "token_id").collect()]
    shown, _ = REC.recommend(
        v.interactions().select("user_id").distinct(), v.split("test"), _scored(v), v.vocab, *_skus(v), _owned(v),
        fallback, POLICY, rank_k=40, limit=LIMIT,
    )
    return shown.select(
        "user_id", "position", "product_id", "suggested_sku", r("score").alias("score"), "reason_code",
        "served_from",
    )


@case("pol9_user_tails", """
SELECT user_id, string_agg(token, ',' ORDER BY event_ts, event_id) AS tokens, max(event_ts_unix) AS newest,
  count(*) AS n FROM (SELECT i.*, token, row_number() OVER (PARTITION BY user_id ORDER BY event_ts DESC,
  event_id DESC) AS back FROM interactions i JOIN token_items t ON t.sku = i.sku) WHERE back <= 50
GROUP BY 1""")
def _(v):
    events = v.interactions().join(v.catalogue().select("sku", v.token.alias("token")), "sku")
    tails = REC.user_tails(events, 50)
    return tails.select(
        "user_id", text_of(F.col("tail.token")).alias("tokens"),
        F.array_max("tail.event_ts").alias("newest"), F.size("tail").cast("long").alias("n"),
    )


@case("pol10_token_skus", """
SELECT t.token, coalesce(string_agg(c.sku, ',' ORDER BY c.sku), t.token) AS skus FROM
  (SELECT DISTINCT token FROM token_items) t
LEFT JOIN (SELECT token, sku FROM token_items WHERE p_partkey % 3 <> 2) c ON c.token = t.token GROUP BY 1""")
def _(v):
    known = P.token_catalog(v.catalogue(3), v.token)
    every = v.catalogue().select(v.token.alias("token")).distinct()
    return every.join(known, "token", "left").select(
        "token", text_of(P.skus_or_token(F.col("skus"), F.col("token"))).alias("skus")
    )
