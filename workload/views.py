"""The driver's tables seen as retail data; each view has a twin in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfstream.functions.tokens import TokenRules, token
from shelfstream.operators import cleaning as C
from shelfstream.operators import lists as L
from shelfstream.operators import sequences as Q
from shelfstream.plans import silver
from shelfstream.plans.gold import SequenceRules, labelled_events
from shelfstream.scale import cut, shared_dir
from shelfstream.session import tune
from workload.registry import cte

RULES = TokenRules.of(
    "sku",
    {
        "economy": "style_color",
        "standard": "product",
        "promo": {"level": "product", "plus_attributes": ["size"]},
    },
)
SILVER = silver.SilverRules(
    consumer="analytics", drop_types=("signup",), bot_per_day=6, min_events=35, max_events=58
)
GOLD = SequenceRules(max_len=30, min_input=3, return_window_days=7, consumer="training")
MAX_LEN = GOLD.max_len


def r(column: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def text_of(array: Column | str, sep: str = ",") -> Column:
    """An array as text, so that engines agree on its form."""
    value = F.col(array) if isinstance(array, str) else array
    return F.array_join(value.cast("array<string>"), sep)


_VIEWS: dict[tuple, Retail] = {}


def view_for(spark: SparkSession, folder: str) -> Retail:
    """The view of a session and folder; its stored layers serve later queries too.

    As in a warehouse, silver and gold are written once and read by many. A
    new session, or a cleared scratch folder, starts from the tables again.
    """
    key = (spark.sparkContext.applicationId, id(spark), folder)
    if key not in _VIEWS or not _VIEWS[key].alive():
        _VIEWS[key] = Retail(spark, folder)
    return _VIEWS[key]


def forget() -> None:
    """Drop the stored layers from memory, so that the next query rebuilds them."""
    _VIEWS.clear()


class Retail:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = tune(spark), folder.rstrip("/")
        self._home = shared_dir(spark)

    def alive(self) -> bool:
        """Whether the folder that holds the stored layers still exists."""
        from shelfstream.sources.tables import Warehouse

        fs, path = Warehouse(self.spark, "")._path(self._home)
        return fs.exists(path)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def parts(self) -> int:
        return self.table("part").count()

    def sku_of_event(self) -> Column:
        """A part for each event, any of the table; lower numbers are bought more often."""
        k = F.get_json_object("props", "$.k").cast("long")
        u = (F.col("event_id") * 7919 + k * 104729) % (10 * self.parts)
        return F.floor(u * u / F.lit(100 * self.parts)).cast("long").cast("string")

    def interactions(self) -> DataFrame:
        user = F.col("user_id").cast("string")
        turn = F.col("user_id") % 10
        consent = (
            F.when(turn == 0, F.lit(None).cast("string"))
            .when(turn == 1, "service")
            .when(turn == 2, "service, analytics")
            .otherwise("service,analytics,personalisation")
        )
        return self.table("events").select(
            F.col("event_id").cast("string").alias("event_id"),
            user.alias("user_id"),
            F.concat_ws("#", user, F.to_date("ts").cast("string")).alias("session_id"),
            "event_type",
            self.sku_of_event().alias("sku"),
            F.col("ts").cast("timestamp").alias("event_ts"),
            F.unix_timestamp("ts").alias("event_ts_unix"),
            F.col("value").alias("price"),
            F.lit(1).alias("quantity"),
            F.lit("").alias("order_id"),
            F.lit("").alias("return_reason"),
            consent.alias("consent"),
            F.to_date("ts").alias("event_date"),
        )

    def duplicated(self) -> DataFrame:
        rows = self.interactions()
        return rows.unionByName(rows.filter(F.col("event_id").cast("long") % 50 == 0))

    def catalogue(self, without: int | None = None) -> DataFrame:
        """All parts; with ``without`` one in that many is missing, as unknown to the shop."""
        part = self.table("part")
        if without:
            part = part.filter(F.col("p_partkey") % without != without - 1)
        return part.select(
            F.col("p_partkey").cast("string").alias("sku"),
            F.col("p_name").alias("style_color_id"),
            F.split("p_name", " ").getItem(1).alias("product_id"),
            F.lower("p_type").alias("category"),
            F.col("p_brand").alias("brand"),
            F.create_map(F.lit("size"), F.col("p_size").cast("string")).alias("attributes"),
            F.col("p_retailprice").alias("list_price"),
        )

    def shop_orders(self) -> DataFrame:
        """Purchases, and a return for each line flagged R; copies included."""
        lines = self.table("lineitem").join(
            self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")
        )
        kinds = F.when(F.col("l_returnflag") == "R", F.array(F.lit("purchase"), F.lit("return")))
        return lines.select(
            F.explode(kinds.otherwise(F.array(F.lit("purchase")))).alias("event_type"),
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey").alias("line"),
            F.col("o_custkey").cast("string").alias("user_id"),
            F.col("o_orderkey").cast("string").alias("order_id"),
            F.col("l_partkey").cast("string").alias("sku"),
            F.col("o_orderdate").cast("timestamp").alias("event_ts"),
            F.unix_timestamp("o_orderdate").alias("event_ts_unix"),
            F.when(F.col("l_linenumber") % 3 == 0, "too_small")
            .when(F.col("l_linenumber") % 3 == 1, "Fit")
            .otherwise("changed mind")
            .alias("return_reason"),
        )

    def item_states(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.table("part").select(
            k.cast("string").alias("sku"),
            (F.col("p_retailprice") * (0.7 + (k % 4) / 10)).alias("price"),
            F.col("p_retailprice").alias("list_price"),
            F.when(k % 7 == 0, F.concat(F.lit("promo"), k.cast("string"))).alias("promo_id"),
            F.create_map(
                F.lit("A"), (F.col("p_size") % 3).cast("int"),
                F.lit("B"), (F.col("p_size") % 5).cast("int"),
            ).alias("stock"),
            (k % 11 != 0).alias("available"),
        )

    def request_log(self) -> DataFrame:
        kind = F.col("event_type")
        k = F.get_json_object("props", "$.k").cast("int")
        return self.table("events").select(
            F.col("event_id").cast("string").alias("request_id"),
            F.col("user_id").cast("string").alias("user_id"),
            F.col("ts").cast("timestamp").alias("served_ts"),
            F.when(kind == "error", "retrieval_error")
            .when(kind == "signup", "cold_start")
            .otherwise("model")
            .alias("served_from"),
            (kind == "purchase").alias("ranker_used"),
            F.col("value").alias("latency_ms"),
            (k % 21).alias("n_items"),
            F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "v1")
            .otherwise("v2")
            .alias("model_version"),
            F.when(k % 17 == 0, "failed").otherwise("sent").alias("exposure_outcome"),
            F.when(k % 3 == 0, "retrieval").when(k % 3 == 1, "ranking").otherwise("rerank").alias(
                "stage"
            ),
        )

    def users_and_items(self, every: int = 20) -> tuple[DataFrame, DataFrame]:
        """Queries are the vectors whose id ``every`` divides; all vectors are items."""
        vectors = self.table("embeddings").select(
            F.col("vec_id"), F.col("embedding").alias("vector")
        )
        users = vectors.filter(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "user_id")
        return users, vectors.withColumnRenamed("vec_id", "token_id")

    # -- the pipeline, shared by later queries --------------------------------
    # Each layer is written once and read back, as the plans do between tables.

    @cached_property
    def items(self) -> DataFrame:
        return silver.hierarchy(self.catalogue(10))

    @cached_property
    def silver(self) -> DataFrame:
        return cut(silver.clean(self.duplicated(), self.items, SILVER))

    @cached_property
    def labelled(self) -> tuple[DataFrame, int, int]:
        return labelled_events(self.silver, self.items, RULES, GOLD)

    @cached_property
    def vocab(self) -> DataFrame:
        events, t1, _ = self.labelled
        return cut(Q.vocabulary(C.in_window(events, None, t1)))

    @cached_property
    def vocab_size(self) -> int:
        return self.vocab.count()

    @cached_property
    def sequences(self) -> DataFrame:
        events, t1, t2 = self.labelled
        return cut(Q.sequence_rows(events, self.vocab, t1, t2, MAX_LEN, GOLD.min_input))

    def split(self, name: str) -> DataFrame:
        return self.sequences.filter(F.col("split") == name)

    @cached_property
    def scores(self) -> DataFrame:
        return L.popularity(self.split("train"))

    def popular(self, split: str, k: int, exclude_seen: bool = True) -> DataFrame:
        return L.popular_lists(self.split(split), self.scores, k, MAX_LEN, exclude_seen)

    @property
    def token(self) -> Column:
        return token(RULES)


cte("interactions", """
SELECT cast(event_id AS VARCHAR) AS event_id, cast(user_id AS VARCHAR) AS user_id,
  cast(user_id AS VARCHAR) || '#' || strftime(ts, '%Y-%m-%d') AS session_id, event_type,
  cast(u * u // (100 * n) AS VARCHAR) AS sku, ts AS event_ts,
  epoch_us(ts) // 1000000 AS event_ts_unix, value AS price, 1 AS quantity, '' AS order_id,
  '' AS return_reason,
  CASE user_id % 10 WHEN 0 THEN NULL WHEN 1 THEN 'service' WHEN 2 THEN 'service, analytics'
    ELSE 'service,analytics,personalisation' END AS consent,
  cast(ts AS DATE) AS event_date
FROM (SELECT *, (event_id * 7919 + cast(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 104729) % (10 * n) AS u
  FROM events, (SELECT count(*) AS n FROM part))""")
cte("duplicated", """
SELECT * FROM interactions UNION ALL
SELECT * FROM interactions WHERE cast(event_id AS BIGINT) % 50 = 0""")
cte("catalogue", """
SELECT cast(p_partkey AS VARCHAR) AS sku, p_name AS style_color_id,
  split_part(p_name, ' ', 2) AS product_id, lower(p_type) AS category, p_brand AS brand,
  cast(p_size AS VARCHAR) AS size, p_retailprice AS list_price, p_partkey
FROM part""")
cte("token_items", """
SELECT *, CASE category WHEN 'economy' THEN style_color_id WHEN 'standard' THEN product_id
  WHEN 'promo' THEN product_id || '|size=' || size ELSE sku END AS token FROM catalogue""")
cte("shop_orders", """
SELECT unnest(CASE WHEN l_returnflag = 'R' THEN ['purchase', 'return'] ELSE ['purchase'] END)
    AS event_type,
  l_orderkey || '-' || l_linenumber || '-' || l_suppkey AS line,
  cast(o_custkey AS VARCHAR) AS user_id, cast(o_orderkey AS VARCHAR) AS order_id,
  cast(l_partkey AS VARCHAR) AS sku, o_orderdate AS event_ts,
  epoch_us(o_orderdate) // 1000000 AS event_ts_unix,
  CASE l_linenumber % 3 WHEN 0 THEN 'too_small' WHEN 1 THEN 'Fit' ELSE 'changed mind' END
    AS return_reason
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
cte("item_states", """
SELECT cast(p_partkey AS VARCHAR) AS sku,
  p_retailprice * (cast(0.7 AS DOUBLE) + (p_partkey % 4) / cast(10 AS DOUBLE)) AS price,
  p_retailprice AS list_price,
  CASE WHEN p_partkey % 7 = 0 THEN 'promo' || p_partkey END AS promo_id,
  p_size % 3 AS stock_a, p_size % 5 AS stock_b, p_partkey % 11 <> 0 AS available
FROM part""")
cte("request_log", """
SELECT cast(event_id AS VARCHAR) AS request_id, cast(user_id AS VARCHAR) AS user_id,
  ts AS served_ts, epoch_us(ts) // 1000000 AS at_s,
  CASE event_type WHEN 'error' THEN 'retrieval_error' WHEN 'signup' THEN 'cold_start'
    ELSE 'model' END AS served_from,
  event_type = 'purchase' AS ranker_used, value AS latency_ms,
  cast(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 21 AS n_items,
  CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'v1' ELSE 'v2' END AS model_version,
  CASE WHEN cast(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 17 = 0 THEN 'failed'
    ELSE 'sent' END AS exposure_outcome,
  CASE cast(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 3 WHEN 0 THEN 'retrieval'
    WHEN 1 THEN 'ranking' ELSE 'rerank' END AS stage
FROM events""")

# Silver, step by step.
cte("s_consent", "SELECT * FROM duplicated WHERE consent LIKE '%analytics%'")
cte("s_once", "SELECT DISTINCT * FROM s_consent")
cte("s_typed", "SELECT * FROM s_once WHERE event_type <> 'signup'")
cte("s_known", """
SELECT * FROM s_typed WHERE sku IN (SELECT sku FROM catalogue WHERE p_partkey % 10 <> 9)""")
cte("s_users", """
SELECT user_id FROM (SELECT user_id, event_date, count(*) AS n FROM s_known GROUP BY ALL)
GROUP BY user_id HAVING max(n) <= 6 AND sum(n) BETWEEN 35 AND 58""")
cte("silver", """
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_ts, event_id) AS event_rank
FROM s_known WHERE user_id IN (SELECT user_id FROM s_users)""")

# Gold.
cte("tokened", """
SELECT s.*, t.token, t.category FROM silver s
JOIN (SELECT sku AS tsku, token, category FROM token_items WHERE p_partkey % 10 <> 9) t
  ON s.sku = t.tsku
WHERE consent = 'service,analytics,personalisation'""")
cte("cutoffs", """
SELECT cast(floor(quantile_cont(cast(event_ts_unix AS DOUBLE), 0.8)) AS BIGINT) AS t1,
  cast(floor(quantile_cont(cast(event_ts_unix AS DOUBLE), 0.9)) AS BIGINT) AS t2,
  max(event_ts_unix) AS newest FROM tokened""")
cte("labelled", """
SELECT e.*, CASE WHEN event_type <> 'purchase' THEN -1
  WHEN event_ts_unix > newest - 7 * 86400 THEN -2 ELSE 0 END AS returned
FROM tokened e, cutoffs""")
cte("vocab", """
SELECT row_number() OVER (ORDER BY count(*) DESC, token) AS token_id, token,
  min(category) AS category, count(*) AS train_events
FROM labelled, cutoffs WHERE event_ts_unix < t1 GROUP BY token""")
cte("known", """
SELECT e.*, v.token_id FROM labelled e JOIN vocab v ON e.token = v.token""")
cte("h_train_all", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_rank DESC) AS back
  FROM known, cutoffs WHERE event_ts_unix < t1) WHERE back <= 30""")
cte("h_train", """
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_rank) - 1 AS pos,
  count(*) OVER (PARTITION BY user_id) AS len FROM h_train_all
WHERE user_id IN (SELECT user_id FROM h_train_all GROUP BY user_id HAVING count(*) >= 3)""")
cte("h_test_all", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_rank DESC) AS back
  FROM known, cutoffs WHERE event_ts_unix < t2) WHERE back <= 30""")
cte("target_events", """
SELECT user_id, token_id, CASE WHEN event_ts_unix < t2 THEN 'val' ELSE 'test' END AS split,
  CASE max(CASE event_type WHEN 'remove_from_cart' THEN 0 WHEN 'return' THEN 1 WHEN 'view' THEN 2
    WHEN 'click' THEN 3 WHEN 'add_to_cart' THEN 4 WHEN 'purchase' THEN 5 ELSE -1 END)
    WHEN 0 THEN 4 WHEN 1 THEN 6 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 5 ELSE 0 END
    AS action_id
FROM known, cutoffs WHERE event_ts_unix >= t1 GROUP BY 1, 2, 3""")
cte("h_test", """
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_rank) - 1 AS pos,
  count(*) OVER (PARTITION BY user_id) AS len FROM h_test_all
WHERE user_id IN (SELECT user_id FROM h_test_all GROUP BY user_id HAVING count(*) >= 3)
  AND user_id IN (SELECT user_id FROM target_events WHERE split = 'test')""")
cte("h_val", """
SELECT * FROM h_train WHERE user_id IN (SELECT user_id FROM target_events WHERE split = 'val')""")
cte("t_test", """
SELECT user_id, token_id, action_id FROM target_events
WHERE split = 'test' AND user_id IN (SELECT user_id FROM h_test)""")
cte("t_val", """
SELECT user_id, token_id, action_id FROM target_events
WHERE split = 'val' AND user_id IN (SELECT user_id FROM h_val)""")
cte("pop", "SELECT token_id, cast(count(*) AS DOUBLE) AS score FROM h_train GROUP BY token_id")
cte("lists_test", """
SELECT user_id, token_id, score,
  row_number() OVER (PARTITION BY user_id ORDER BY score DESC, token_id) AS position
FROM (SELECT DISTINCT user_id FROM h_test), pop
WHERE (user_id, token_id) NOT IN (SELECT (user_id, token_id) FROM h_test)""")
cte("lists_val", """
SELECT user_id, token_id, score,
  row_number() OVER (PARTITION BY user_id ORDER BY score DESC, token_id) AS position
FROM (SELECT DISTINCT user_id FROM h_val), pop
WHERE (user_id, token_id) NOT IN (SELECT (user_id, token_id) FROM h_val)""")
cte("n_targets", "SELECT user_id, count(*) AS m FROM t_test GROUP BY user_id")
cte("gains", """
SELECT n.user_id, k, m, coalesce(sum(CASE WHEN t.token_id IS NOT NULL THEN 1 END), 0) AS hits,
  coalesce(sum(CASE WHEN t.token_id IS NOT NULL THEN 1 / log2(cast(position + 1 AS DOUBLE)) END), 0)
    AS dcg
FROM n_targets n CROSS JOIN (SELECT unnest([5, 10, 20]) AS k)
LEFT JOIN lists_test l ON l.user_id = n.user_id AND l.position <= k
LEFT JOIN t_test t ON t.user_id = l.user_id AND t.token_id = l.token_id
GROUP BY n.user_id, k, m""")
cte("ideals", """
SELECT n AS m, sum(1 / log2(cast(n2 + 1 AS DOUBLE))) AS idcg
FROM range(1, 201) a(n), range(1, 201) b(n2) WHERE n2 <= n GROUP BY n""")
cte("per_user", """
SELECT user_id, k, hits / cast(least(g.m, k) AS DOUBLE) AS recall, dcg / idcg AS ndcg,
  CASE WHEN hits > 0 THEN cast(1 AS DOUBLE) ELSE 0 END AS hit_rate
FROM gains g JOIN ideals i ON i.m = least(g.m, g.k)""")
