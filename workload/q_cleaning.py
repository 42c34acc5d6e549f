"""Filters, projections, joins, aggregates, windows, set operations, scalars."""

from __future__ import annotations

from pyspark.sql import Observation, Window
from pyspark.sql import functions as F

from shelfstream.functions import actions as A
from shelfstream.functions import privacy as P
from shelfstream.functions import scalars as S
from shelfstream.functions.tokens import TokenRules, token, uniform
from shelfstream.operators import calibration as K
from shelfstream.operators import cleaning as C
from shelfstream.operators import lists as L
from shelfstream.operators import policy as POL
from shelfstream.operators import retrieval as R
from shelfstream.operators import sequences as Q
from shelfstream.operators import sessions as SE
from shelfstream.operators import stats as ST
from shelfstream.plans import silver
from shelfstream.scale import fresh_dir
from shelfstream.sources.adapters import rating_action
from shelfstream.sources.tables import tables_differ
from shelfstream.streaming import topics
from workload.registry import case, cte
from workload.views import RULES, SILVER, r, text_of

KEY = b"an example key, not a secret"


@case("flt1_consent_filter", """
SELECT event_id, consent LIKE '%analytics%' AS analytics, consent LIKE '%personalisation%' AS training
FROM interactions WHERE consent LIKE '%analytics%'""")
def _(v):
    return C.consented(v.interactions(), "analytics").select(
        "event_id", P.permits("analytics").alias("analytics"), P.permits("training").alias("training")
    )


@case("flt1_consent_text", """
SELECT doc_id, coalesce(len(list_filter(string_split(lower(text), ','),
  lambda x: trim(x, ' ') = 'analytics')) > 0, false) AS analytics, true AS serving FROM documents""")
def _(v):
    # Prose as consent text: nothing but a whole element may grant anything.
    return v.table("documents").select(
        "doc_id", P.permits("analytics", F.lower("text")).alias("analytics"),
        P.permits("serving", F.col("text")).alias("serving"),
    )


@case("flt2_consent_counts", """
SELECT count(*) AS before, count(*) FILTER (consent LIKE '%personalisation%') AS after_consent,
  count(*) - count(*) FILTER (consent LIKE '%personalisation%') AS consent_dropped_events
FROM interactions""")
def _(v):
    C.require_consent(v.interactions())
    return C.consent_counts(v.interactions(), "training")


@case("flt3_drop_types", """
SELECT event_id, event_type FROM interactions WHERE event_type NOT IN ('signup', 'error')""")
def _(v):
    return C.without_types(v.interactions(), ["signup", "error"]).select("event_id", "event_type")


@case("flt4_user_length", """
SELECT event_id, user_id FROM interactions WHERE user_id IN (
  SELECT user_id FROM interactions GROUP BY 1 HAVING count(*) BETWEEN 60 AND 75)""")
def _(v):
    rows = v.interactions()
    return C.only_users(rows, C.users_between(rows, 60, 75)).select("event_id", "user_id")


cte("bots", """
SELECT DISTINCT user_id FROM (SELECT user_id, event_date, count(*) AS n FROM interactions GROUP BY ALL)
WHERE n > 6""")


@case("flt5_bot_users", """
SELECT event_id, user_id FROM interactions WHERE user_id NOT IN (SELECT user_id FROM bots)""")
def _(v):
    rows = v.interactions()
    return C.without_users(rows, C.bot_users(rows, 6)).select("event_id", "user_id")


@case("flt6_time_windows", """
SELECT CASE WHEN event_ts_unix < t1 THEN 'train' WHEN event_ts_unix < t2 THEN 'val' ELSE 'test' END
  AS part, count(*) AS n, min(event_ts_unix) AS first_ts, max(event_ts_unix) AS last_ts
FROM labelled, cutoffs GROUP BY 1""")
def _(v):
    events, t1, t2 = v.labelled
    bounds = {"train": (None, t1), "val": (t1, t2), "test": (t2, None)}
    parts = [
        C.in_window(events, *b).select(F.lit(name).alias("part"), "event_ts_unix")
        for name, b in bounds.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("part").agg(
        F.count("*").alias("n"), F.min("event_ts_unix").alias("first_ts"),
        F.max("event_ts_unix").alias("last_ts"),
    )


@case("flt7_target_types", """
SELECT user_id, token_id, max(CASE event_type WHEN 'purchase' THEN 5 ELSE 3 END) AS commitment
FROM known WHERE event_type IN ('click', 'purchase') GROUP BY 1, 2""")
def _(v):
    events, _, _ = v.labelled
    chosen = C.with_types(Q.with_ids(events, v.vocab), ["click", "purchase"])
    return Q.strongest_actions(chosen).select("user_id", "token_id", "commitment")


@case("flt8_min_history", """
SELECT user_id, count(*) AS n FROM h_train_all GROUP BY 1 HAVING count(*) >= 25""")
def _(v):
    return Q.long_enough(v.split("train"), 25).select(
        "user_id", F.size("input_tokens").cast("long").alias("n")
    )


cte("messages", """
SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN 'return' ELSE event_type END AS event_type,
  CASE WHEN sku = '7' THEN '' ELSE sku END AS sku, price - 20 AS price,
  CASE WHEN sku > '5' THEN 'o' ELSE '' END AS order_id FROM interactions""")


@case("flt9_valid_and_rejected", """
SELECT event_id, concat_ws(';', CASE WHEN sku = '' THEN 'missing sku' END,
  CASE WHEN event_type = 'signup' THEN 'unknown event_type' END,
  CASE WHEN price < 0 THEN 'negative price' END,
  CASE WHEN event_type = 'return' AND order_id = '' THEN 'return without order_id' END) AS reasons
FROM messages""")
def _(v):
    kind = F.when(F.col("event_type") == "error", "return").otherwise(F.col("event_type"))
    rows = v.interactions().withColumns({
        "event_type": kind,
        "price": F.col("price") - 20,
        "order_id": F.when(F.col("sku") > "5", "o").otherwise(""),
        "sku": F.when(F.col("sku") == "7", "").otherwise(F.col("sku")),
    })
    valid, rejected = C.split_valid(topics.as_messages(rows))
    return valid.select("event_id", F.lit("").alias("reasons")).unionByName(
        rejected.select("event_id", F.array_join("reasons", ";").alias("reasons"))
    )


@case("prj1_tokens", "SELECT sku, token FROM token_items")
def _(v):
    return v.catalogue().select("sku", token(RULES).alias("token"))


@case("prj1_tokens_parent_missing", """
SELECT cast(p_partkey AS VARCHAR) AS sku,
  coalesce(CASE WHEN p_size > 10 THEN p_name END, cast(p_partkey AS VARCHAR)) ||
  CASE WHEN p_size % 2 = 0 THEN '|size=' || p_size ELSE '' END AS token FROM part""")
def _(v):
    rules = TokenRules.of({"level": "style_color", "plus_attributes": ["size", "absent"]})
    size = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string"))
    rows = v.table("part").select(
        F.col("p_partkey").cast("string").alias("sku"),
        F.when(F.col("p_size") > 10, F.col("p_name")).alias("style_color_id"),
        F.col("p_brand").alias("product_id"), F.col("p_type").alias("category"),
        S.attribute_map(size=size).alias("attributes"),
    )
    return rows.select("sku", token(rules).alias("token"))


@case("prj2_uniform_levels", """
SELECT 'sku' AS level, count(DISTINCT sku) AS tokens FROM catalogue UNION ALL
SELECT 'style_color', count(DISTINCT style_color_id) FROM catalogue UNION ALL
SELECT 'product', count(DISTINCT product_id) FROM catalogue""")
def _(v):
    parts = [
        v.catalogue().agg(F.lit(level).alias("level"), F.count_distinct(token(uniform(level))).alias("tokens"))
        for level in ("sku", "style_color", "product")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@case("prj3_rating_action", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity % 5 + 1 >= 4 THEN 'purchase'
  WHEN l_quantity % 5 + 1 = 3 THEN 'view' ELSE 'remove_from_cart' END AS action FROM lineitem""")
def _(v):
    return v.table("lineitem").select(
        "l_orderkey", "l_linenumber", rating_action(F.col("l_quantity") % 5 + 1).alias("action")
    )


@case("prj4_messages", """
SELECT event_id, user_id || '' AS key, cast(NULL AS VARCHAR) AS order_id, session_id, consent,
  1 AS schema_version FROM interactions""")
def _(v):
    coded = topics.encode(topics.as_messages(v.interactions()), "interactions.v1")
    back = topics.decode(coded, "interactions.v1")
    keyed = coded.select("key", F.from_json("value", "event_id string").alias("m")).select(
        "key", F.col("m.event_id").alias("event_id")
    )
    return back.join(keyed, "event_id").select(
        "event_id", "key", "order_id", "session_id", "consent", "schema_version"
    )


# -- joins --------------------------------------------------------------------


@case("jn1_known_skus", """
SELECT event_id, sku FROM interactions WHERE sku IN (SELECT sku FROM catalogue WHERE p_partkey % 10 <> 9)""")
def _(v):
    return C.known_skus(v.interactions(), v.catalogue(10)).select("event_id", "sku")


@case("jn2_attach_hierarchy", """
SELECT event_id, i.sku, category, token FROM interactions i JOIN token_items t ON i.sku = t.sku""")
def _(v):
    return Q.with_tokens(v.interactions(), v.catalogue(), RULES).select(
        "event_id", "sku", "category", "token"
    )


@case("jn3_anti_join_bots", """
SELECT user_id, count(*) AS n FROM interactions WHERE user_id NOT IN (SELECT user_id FROM bots)
GROUP BY 1""")
def _(v):
    rows = v.interactions()
    return C.without_users(rows, C.bot_users(rows, 6)).groupBy("user_id").agg(F.count("*").alias("n"))


@case("jn4_semi_join_users", """
SELECT user_id, count(*) AS n FROM s_known WHERE user_id IN (SELECT user_id FROM s_users) GROUP BY 1""")
def _(v):
    rows = C.known_skus(
        C.without_types(C.deduplicated(C.consented(v.duplicated()), ["event_id"]), ["signup"]), v.items
    )
    users = C.eligible_users(rows, SILVER.bot_per_day, SILVER.min_events, SILVER.max_events)
    return C.only_users(rows, users).groupBy("user_id").agg(F.count("*").alias("n"))


cte("returned_lines", """
SELECT DISTINCT user_id, order_id, sku FROM shop_orders WHERE event_type = 'return'""")
cte("order_labels", """
SELECT s.line, s.user_id, s.order_id, s.sku, s.event_type, s.event_ts_unix,
  CASE WHEN s.event_type <> 'purchase' THEN -1 WHEN r.sku IS NOT NULL THEN 1
  WHEN s.event_ts_unix > (SELECT max(event_ts_unix) FROM shop_orders) - 120 * 86400 THEN -2 ELSE 0 END
  AS returned
FROM shop_orders s LEFT JOIN returned_lines r
  ON s.user_id = r.user_id AND s.order_id = r.order_id AND s.sku = r.sku""")


def _order_labels(v):
    rows = v.shop_orders()
    newest = rows.agg(F.max("event_ts_unix")).first()[0]
    return Q.with_return_labels(rows, 120, newest)


@case("jn5_return_link", "SELECT line, event_type, returned FROM order_labels")
def _(v):
    return _order_labels(v).select("line", "event_type", "returned")


@case("jn6_vocabulary_join", "SELECT event_id, token, token_id FROM known")
def _(v):
    events, _, _ = v.labelled
    return Q.with_ids(events, v.vocab).select("event_id", "token", "token_id")


@case("jn7_history_with_targets", """
SELECT h.user_id, max(len) AS n_inputs, max(n) AS n_targets FROM h_test h
JOIN (SELECT user_id, count(*) AS n FROM t_test GROUP BY 1) t ON h.user_id = t.user_id GROUP BY 1""")
def _(v):
    return v.split("test").select(
        "user_id", F.size("input_tokens").cast("long").alias("n_inputs"),
        F.size("target_tokens").cast("long").alias("n_targets"),
    )


@case("jn8_paired_alignment", """
SELECT user_id, round(sum(CASE WHEN event_type = 'view' THEN price ELSE 0 END), 6) AS a,
  round(sum(CASE WHEN event_type = 'click' THEN price ELSE 0 END), 6) AS b FROM interactions GROUP BY 1""")
def _(v):
    def side(kind):
        value = F.when(F.col("event_type") == kind, F.col("price")).otherwise(0.0)
        return v.interactions().groupBy("user_id").agg(F.sum(value).alias("value"))

    return ST.paired(side("view"), side("click"), ["user_id"]).select(
        "user_id", r("a").alias("a"), r("b").alias("b")
    )


cte("item_vectors", "SELECT vec_id AS token_id, embedding AS v FROM embeddings")
cte("user_vectors", "SELECT vec_id AS user_id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0")
cte("exact_neighbours", """
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, token_id) AS position
FROM (SELECT user_id, token_id, list_dot_product(cast(u.v AS DOUBLE[]), cast(i.v AS DOUBLE[])) AS score
  FROM user_vectors u, item_vectors i)""")
# A tenth of the vectors as queries, against all vectors.
cte("tenth_vectors", "SELECT vec_id AS user_id, embedding AS v FROM embeddings WHERE vec_id % 10 = 0")
cte("tenth_neighbours", """
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, token_id) AS position
FROM (SELECT user_id, token_id, list_dot_product(cast(u.v AS DOUBLE[]), cast(i.v AS DOUBLE[])) AS score
  FROM tenth_vectors u, item_vectors i)""")


@case("jn9_pair_scores", """
SELECT user_id, token_id, round(score, 5) AS score FROM tenth_neighbours WHERE position <= 10""")
def _(v):
    users, items = v.users_and_items(10)
    pairs = R.exact_top_k(users, items, 10).select("user_id", "token_id")
    return R.pair_scores(pairs, users, items).select("user_id", "token_id", r("score", 5).alias("score"))


@case("jn10_candidate_states", """
SELECT t.token, count(*) AS skus, count(s.sku) AS with_state,
  count(*) FILTER (coalesce(s.available, true)) AS available
FROM token_items t LEFT JOIN (SELECT * FROM item_states WHERE cast(sku AS INTEGER) % 5 <> 0) s
  ON t.sku = s.sku GROUP BY 1""")
def _(v):
    states = v.item_states().filter(F.col("sku").cast("int") % 5 != 0)
    units = POL.token_units(POL.token_catalog(v.catalogue(), token(RULES)), states)
    one = F.explode("units").alias("u")
    return units.select("token", one).groupBy("token").agg(
        F.count("*").alias("skus"), F.count("u.list_price").alias("with_state"),
        F.count_if(F.coalesce("u.available", F.lit(True))).alias("available"),
    )


# -- aggregates ---------------------------------------------------------------


@case("agg1_counts_per_key", """
SELECT user_id, event_date, count(*) AS n FROM interactions GROUP BY ALL""")
def _(v):
    return C.user_days(v.interactions())


@case("agg2_distinct", """
SELECT count(DISTINCT user_id) AS users, count(DISTINCT sku) AS skus FROM interactions""")
def _(v):
    return v.interactions().agg(
        F.count_distinct("user_id").alias("users"), F.count_distinct("sku").alias("skus")
    )


@case("agg3_time_bounds", """
SELECT min(event_ts_unix) AS min_ts, max(event_ts_unix) AS max_ts FROM interactions""")
def _(v):
    return v.interactions().agg(
        F.min("event_ts_unix").alias("min_ts"), F.max("event_ts_unix").alias("max_ts")
    )


@case("agg4_exact_cutoffs", """
SELECT cast(floor(quantile_cont(cast(epoch_us(l_shipdate) // 1000000 AS DOUBLE), 0.8)) AS BIGINT) AS t1,
  cast(floor(quantile_cont(cast(epoch_us(l_shipdate) // 1000000 AS DOUBLE), 0.9)) AS BIGINT) AS t2
FROM lineitem""")
def _(v):
    rows = v.table("lineitem").select(F.unix_timestamp("l_shipdate").alias("event_ts_unix"))
    return v.spark.createDataFrame([Q.time_cutoffs(rows)[:2]], "t1 long, t2 long")


@case("agg5_first_known_value", """
SELECT sku, min(category) AS category, min(brand) AS brand FROM catalogue GROUP BY sku""")
def _(v):
    return v.catalogue().groupBy("sku").agg(
        F.min("category").alias("category"), F.min("brand").alias("brand")
    )


@case("agg6_strongest_action", "SELECT user_id, token_id, split, action_id FROM target_events")
def _(v):
    events, t1, t2 = v.labelled
    known = Q.with_ids(events, v.vocab)
    parts = [
        Q.strongest_actions(C.in_window(known, *b)).withColumn("split", F.lit(s))
        for s, b in (("val", (t1, t2)), ("test", (t2, None)))
    ]
    return parts[0].unionByName(parts[1]).select("user_id", "token_id", "split", "action_id")


@case("agg7_sorted_arrays", """
SELECT user_id, string_agg(token_id, ',' ORDER BY pos) AS tokens FROM h_train GROUP BY 1""")
def _(v):
    return v.split("train").select("user_id", text_of("input_tokens").alias("tokens"))


@case("agg8_token_catalogue", """
SELECT token, string_agg(sku, ',' ORDER BY sku) AS skus, min(product_id) AS product_id
FROM token_items GROUP BY 1""")
def _(v):
    return POL.token_catalog(v.catalogue(), token(RULES)).select(
        "token", text_of("skus").alias("skus"), "product_id"
    )


@case("agg9_sparsity_report", """
SELECT vocab_size, rare AS tokens_under_5_events, skus AS distinct_skus, n AS train_purchases,
  m AS purchases_matured, 0 AS purchases_returned, n - m AS purchases_immature,
  round(skus / cast(vocab_size AS DOUBLE), 3) AS compression_vs_sku,
  round(rare / cast(vocab_size AS DOUBLE), 4) AS sparse_token_share, cast(0 AS DOUBLE) AS return_rate
FROM (SELECT count(*) AS vocab_size, count(*) FILTER (train_events < 5) AS rare FROM vocab),
  (SELECT count(DISTINCT sku) AS skus FROM labelled),
  (SELECT count(*) AS n, count(*) FILTER (returned = 0) AS m FROM known, cutoffs
   WHERE event_type = 'purchase' AND event_ts_unix < t1)""")
def _(v):
    events, t1, _ = v.labelled
    return Q.sparsity(events, v.vocab, t1)


@case("agg9_return_rate", """
SELECT count(*) AS purchases, count(*) FILTER (returned IN (0, 1)) AS matured,
  count(*) FILTER (returned = 1) AS returned, round(count(*) FILTER (returned = 1) /
  cast(count(*) FILTER (returned IN (0, 1)) AS DOUBLE), 4) AS return_rate
FROM order_labels WHERE event_type = 'purchase'""")
def _(v):
    matured = F.count_if(F.col("returned").isin(A.KEPT, A.RETURNED))
    back = F.count_if(F.col("returned") == A.RETURNED)
    return _order_labels(v).filter("event_type = 'purchase'").agg(
        F.count("*").alias("purchases"), matured.alias("matured"), back.alias("returned"),
        r(back / matured, 4).alias("return_rate"),
    )


@case("agg10_rows_per_step", """
SELECT 'input_events' AS step, count(*) AS n FROM duplicated UNION ALL
SELECT 'after_consent', count(*) FROM s_consent UNION ALL
SELECT 'after_dedupe', count(*) FROM s_once UNION ALL
SELECT 'after_type_filter', count(*) FROM s_typed UNION ALL
SELECT 'after_catalog_join', count(*) FROM s_known UNION ALL
SELECT 'after_user_filters', count(*) FROM silver""")
def _(v):
    seen: dict[str, Observation] = {}
    silver.clean(v.duplicated(), v.items, SILVER, seen).write.parquet(fresh_dir(v.spark, "silver"))
    return v.spark.createDataFrame([(s, o.get["n"]) for s, o in seen.items()], "step string, n long")


@case("agg11_users_per_split", """
SELECT 'train' AS split, count(DISTINCT user_id) AS users FROM h_train UNION ALL
SELECT 'val', count(DISTINCT user_id) FROM h_val UNION ALL
SELECT 'test', count(DISTINCT user_id) FROM h_test""")
def _(v):
    return Q.users_per_split(v.sequences)


cte("dominant", """
SELECT user_id, category FROM (
  SELECT user_id, v.category, row_number() OVER (PARTITION BY user_id
    ORDER BY count(*) DESC, min(pos)) AS rn
  FROM h_test h JOIN vocab v ON h.token_id = v.token_id GROUP BY user_id, v.category) WHERE rn = 1""")


@case("agg12_dominant_category", "SELECT user_id, category FROM dominant")
def _(v):
    return L.dominant_category(v.split("test"), v.vocab)


# -- windows ------------------------------------------------------------------


@case("win1_event_rank", """
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_ts, event_id)
  AS event_rank FROM interactions""")
def _(v):
    return SE.event_rank(v.interactions()).select("event_id", "user_id", "event_rank")


@case("win2_vocabulary_ids", "SELECT token_id, token, category, train_events FROM vocab")
def _(v):
    return v.vocab


@case("win3_sessions", """
SELECT event_id, user_id || '#' || cast(sum(s) OVER (PARTITION BY user_id
  ORDER BY event_ts_unix, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id
FROM (SELECT *, CASE WHEN event_ts_unix - lag(event_ts_unix) OVER (PARTITION BY user_id
  ORDER BY event_ts_unix, event_id) <= 43200 THEN 0 ELSE 1 END AS s FROM interactions)""")
def _(v):
    return SE.sessionise(v.interactions().drop("session_id"), 43200).select("event_id", "session_id")


cte("line_ranks", """
SELECT l_returnflag AS g, l_quantity AS s, count(*) AS n,
  sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS pos FROM lineitem GROUP BY 1, 2""")


@case("win4_tied_ranks", """
SELECT g AS l_returnflag, s AS l_quantity,
  cast(sum(n) OVER (PARTITION BY g ORDER BY s) AS DOUBLE) - n + (n + 1) / cast(2 AS DOUBLE) AS avg_rank
FROM line_ranks""")
def _(v):
    from shelfstream.scale import running_totals

    distinct = v.table("lineitem").groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("n"))
    run = running_totals(distinct, ["l_returnflag"], ["l_quantity"], {"upto": "n"})
    return run.select(
        "l_returnflag", "l_quantity",
        (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias("avg_rank"),
    )


@case("win5_percentile_ranks", """
SELECT event_id, round((row_number() OVER (ORDER BY price, event_id) - 1) /
  cast(count(*) OVER () - 1 AS DOUBLE), 9) AS p FROM interactions""")
def _(v):
    ranked = K.percentile_ranks(v.interactions().select("event_id", "price"), "price", ["event_id"])
    return ranked.select("event_id", r("p", 9).alias("p"))


cte("p_values", """
SELECT l_shipmode AS family, name, p_value FROM (SELECT 'f' || (p_size % 5) AS l_shipmode,
  p_brand AS name, min(p_retailprice - 900) / 1000 AS p_value FROM part GROUP BY 1, 2)""")


@case("win6_holm", """
SELECT family, name, round(max(s) OVER (PARTITION BY family ORDER BY p_value, name
  ROWS UNBOUNDED PRECEDING), 9) AS p_adjusted FROM (SELECT *, least(1.0, p_value * (count(*) OVER
  (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p_value, name) + 1)) AS s
FROM p_values)""")
def _(v):
    tests = v.table("part").groupBy(
        F.concat(F.lit("f"), (F.col("p_size") % 5).cast("string")).alias("family"),
        F.col("p_brand").alias("name"),
    ).agg((F.min(F.col("p_retailprice") - 900) / 1000).alias("p_value"))
    return ST.holm(tests, ["family"]).select("family", "name", r("p_adjusted", 9).alias("p_adjusted"))


@case("win7_first_seen", """
SELECT user_id, pos AS position, token_id, row_number() OVER (PARTITION BY user_id, token_id
  ORDER BY pos) = 1 AS is_new FROM h_train""")
def _(v):
    rows = v.split("train").select(
        "user_id", "input_tokens", F.posexplode("input_tokens").alias("position", "token_id")
    )
    first = F.array_position("input_tokens", F.col("token_id")) == F.col("position") + 1
    return rows.select("user_id", "position", "token_id", first.alias("is_new"))


@case("win8_rank_in_category", """
SELECT event_id, row_number() OVER (PARTITION BY user_id, category ORDER BY price DESC, event_id)
  AS n FROM interactions i JOIN catalogue c ON i.sku = c.sku
QUALIFY n <= 3""")
def _(v):
    order = Window.partitionBy("user_id", "category").orderBy(F.desc("price"), "event_id")
    rows = v.interactions().join(v.catalogue().select("sku", "category"), "sku")
    return rows.withColumn("n", F.row_number().over(order)).filter("n <= 3").select("event_id", "n")


# -- top-k and sets -----------------------------------------------------------


@case("top1_order_and_limit", """
SELECT event_id, event_ts_unix FROM silver ORDER BY event_ts, event_id LIMIT 500""")
def _(v):
    return topics.newest_first_limit(v.silver, 500).select("event_id", "event_ts_unix")


cte("spend", """
SELECT user_id, cast(sku AS INTEGER) AS token_id, round(sum(price), 6) AS score FROM interactions
WHERE event_type <> 'purchase' GROUP BY 1, 2""")


@case("top2_unseen_top_k", """
SELECT user_id, token_id, position FROM (SELECT user_id, token_id,
  row_number() OVER (PARTITION BY user_id ORDER BY score DESC, token_id) AS position FROM spend s
  WHERE token_id > 0 AND NOT EXISTS (SELECT 1 FROM interactions b WHERE event_type = 'purchase'
    AND b.user_id = s.user_id AND cast(b.sku AS INTEGER) = s.token_id)) WHERE position <= 5""")
def _(v):
    rows = v.interactions().withColumn("token_id", F.col("sku").cast("int"))
    scores = rows.filter("event_type <> 'purchase'").groupBy("user_id", "token_id").agg(
        F.round(F.sum("price"), 6).alias("score")
    )
    seen = rows.filter("event_type = 'purchase'").select("user_id", "token_id").distinct()
    return L.top_k(scores, 5, seen).select("user_id", "token_id", "position")


@case("top3_most_popular", """
SELECT token_id, score FROM pop ORDER BY score DESC, token_id LIMIT 20""")
def _(v):
    return L.most_popular(v.scores, 20)


@case("top4_last_elements", """
SELECT user_id, string_agg(token_id, ',' ORDER BY pos) AS tokens FROM h_train WHERE len - pos <= 10
GROUP BY 1""")
def _(v):
    return v.split("train").select("user_id", text_of(S.last_n(F.col("input_tokens"), 10)).alias("tokens"))


@case("set1_union_of_splits", """
SELECT user_id, 'train' AS split, max(len) AS n FROM h_train GROUP BY 1 UNION ALL
SELECT user_id, 'val', max(len) FROM h_val GROUP BY 1 UNION ALL
SELECT user_id, 'test', max(len) FROM h_test GROUP BY 1""")
def _(v):
    return v.sequences.select("user_id", "split", F.size("input_tokens").cast("long").alias("n"))


@case("set2_dedupe", """
SELECT user_id, order_id, sku, min(line) AS line FROM shop_orders GROUP BY 1, 2, 3""")
def _(v):
    return C.deduplicated(v.shop_orders(), ["user_id", "order_id", "sku"], ["line"]).select(
        "user_id", "order_id", "sku", "line"
    )


@case("set3_distinct_rows", "SELECT DISTINCT user_id, sku, event_type FROM interactions")
def _(v):
    return v.interactions().select("user_id", "sku", "event_type").distinct()


@case("set4_table_difference", """
SELECT event_id, CASE WHEN cast(event_id AS BIGINT) % 50 = 0 THEN 'right' ELSE 'left' END AS side
FROM interactions
WHERE (event_type = 'view' AND sku = '5') <> (cast(event_id AS BIGINT) % 50 = 0)""")
def _(v):
    rows = v.interactions().select("event_id", "event_type", "sku")
    left = rows
    right = v.duplicated().select(*rows.columns).exceptAll(
        rows.filter("event_type = 'view' and sku = '5'")
    )
    return tables_differ(left, right).select("event_id", "side")


# -- scalars ------------------------------------------------------------------


@case("sc1_text", """
SELECT p_partkey, lower(trim(p_type)) || '#' || split_part(p_name, ' ', 1) AS a,
  replace(p_brand, 'Brand#', 'B') AS b, substr(p_name, 1, 3) AS c FROM part""")
def _(v):
    return v.table("part").select(
        "p_partkey",
        F.concat_ws("#", F.lower(F.trim("p_type")), F.split("p_name", " ").getItem(0)).alias("a"),
        F.regexp_replace("p_brand", "Brand#", "B").alias("b"), F.substring("p_name", 1, 3).alias("c"),
    )


@case("sc2_natural_key", """
SELECT event_id, sha256(user_id || '|' || sku || '|' || event_ts_unix) AS k FROM interactions""")
def _(v):
    return v.interactions().select(
        "event_id", S.natural_key("user_id", "sku", F.col("event_ts_unix").cast("string")).alias("k")
    )


_BLOCK = KEY.ljust(64, b"\0")
_INNER, _OUTER = (bytes(x ^ m for x in _BLOCK).hex() for m in (0x36, 0x5C))


@case("sc3_pseudonyms", f"""
SELECT event_id, substr(sha256(unhex('{_OUTER}') ||
  unhex(sha256(unhex('{_INNER}') || encode(user_id)))), 1, 32) AS pseudonym FROM interactions""")
def _(v):
    return v.interactions().select("event_id", P.pseudonym("user_id", KEY).alias("pseudonym"))


@case("sc4_dates", "SELECT event_id, event_date, event_ts_unix AS at FROM interactions")
def _(v):
    return v.interactions().select(
        "event_id", F.to_date("event_ts").alias("event_date"),
        S.unix_seconds(F.col("event_ts")).alias("at"),
    )


@case("sc5_attribute_maps", """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN cast(p_size AS VARCHAR) END AS size,
  CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS n FROM part""")
def _(v):
    size = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("  ")
    m = S.attribute_map(size=size, brand=F.col("p_brand"), none=F.lit(None))
    return v.table("part").select(
        "p_partkey", F.try_element_at(m, F.lit("size")).alias("size"), F.size(m).alias("n")
    )


@case("sc6_arrays", """
SELECT user_id, max(event_ts_unix) AS newest, max(len) AS n, bool_or(token_id = 1) AS has_top,
  count(DISTINCT token_id) AS kinds FROM h_train GROUP BY 1""")
def _(v):
    return v.split("train").select(
        "user_id", F.array_max("input_ts").alias("newest"),
        F.size("input_tokens").cast("long").alias("n"),
        F.array_contains("input_tokens", 1).alias("has_top"),
        F.size(F.array_distinct("input_tokens")).cast("long").alias("kinds"),
    )


@case("sc7_math", """
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, round(ln(p / (1 - p)), 6) AS z,
  round(1 / (1 + exp(-l_quantity)), 6) AS s, round(1 / log2(l_linenumber + cast(2 AS DOUBLE)), 6) AS d,
  round(pow(2, -l_linenumber / cast(3 AS DOUBLE)), 6) AS w
FROM (SELECT *, least(greatest(l_discount * 10, 1e-7), 1 - 1e-7) AS p FROM lineitem)""")
def _(v):
    n = F.col("l_linenumber")
    return v.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey",
        r(S.logit(F.col("l_discount") * 10)).alias("z"), r(S.sigmoid(F.col("l_quantity"))).alias("s"),
        r(S.rank_discount(n)).alias("d"), r(S.decay(n, 3)).alias("w"),
    )


@case("sc10_action_ids", """
SELECT user_id, string_agg(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase'
  THEN 5 ELSE 7 END, ',' ORDER BY pos) AS ids FROM h_train GROUP BY 1""")
def _(v):
    return v.split("train").select("user_id", text_of(A.action_ids(F.col("input_actions"))).alias("ids"))


@case("sc11_identifier_shapes", """
SELECT doc_id, word FROM (SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS word FROM documents)
WHERE regexp_matches(word, '^U\\d{4,}$') OR regexp_matches(word, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')
  OR regexp_matches(word, '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$')""")
def _(v):
    words = v.table("documents").select("doc_id", F.explode(F.split("text", r"\s+")).alias("word"))
    return words.filter(P.has_identifier_shape(F.col("word")))


@case("sc12_gap_buckets", """
SELECT user_id, string_agg(least(greatest(cast(floor(ln(cast(greatest(abs(gap), 1) AS DOUBLE)) / 0.301e0)
  AS INTEGER), 0), 128), ',' ORDER BY pos) AS buckets FROM (SELECT *, coalesce(lead(event_ts_unix) OVER
  (PARTITION BY user_id ORDER BY pos) - event_ts_unix, 0) AS gap FROM h_train) GROUP BY 1""")
def _(v):
    return v.split("train").select("user_id", text_of(S.time_gap_buckets(F.col("input_ts"))).alias("buckets"))


