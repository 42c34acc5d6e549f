"""Sources, sinks and table access."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfstream.functions import scalars as S
from shelfstream.plans import bronze, recommend
from shelfstream.scale import fresh_dir
from shelfstream.sources import adapters as A
from shelfstream.sources import tables as T
from shelfstream.sources.schemas import INTERACTION_COLUMNS
from workload.registry import case, cte
from workload.views import r, text_of

EVENT_COLUMNS = ["event_id", "user_id", "session_id", "event_type", "sku", "order_id"]
CATALOG_COLUMNS = ["sku", "style_color_id", "product_id", "category", "brand"]


@case("src1_csv_scan", """
SELECT event_id, user_id, session_id, event_type, i.sku, order_id, event_ts_unix, price, consent,
  category, size, list_price
FROM interactions i JOIN catalogue c ON i.sku = c.sku""")
def _(v):
    root = fresh_dir(v.spark, "csv")
    v.interactions().select(*INTERACTION_COLUMNS).write.option("header", True).csv(f"{root}/i")
    v.catalogue().select(
        *CATALOG_COLUMNS, F.col("attributes")["size"].alias("size"), F.lit("").alias("color"),
        F.lit(None).cast("string").alias("capacity"), "list_price",
    ).write.option("header", True).csv(f"{root}/c")
    events, items = A.load_dataset(
        v.spark, "synthetic", interactions=f"{root}/i", catalog=f"{root}/c"
    )
    return events.withColumn("event_ts_unix", F.unix_timestamp("event_ts")).join(
        items.select("sku", "category", F.col("attributes")["size"].alias("size"), "list_price"), "sku"
    ).select(*EVENT_COLUMNS, "event_ts_unix", "price", "consent", "category", "size", "list_price")


def _shop_raw(v):
    return v.interactions().join(v.catalogue(), "sku").select(
        F.concat(F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")).alias("event_time"),
        F.when(F.col("event_type") == "click", "cart").otherwise(F.col("event_type")).alias("event_type"),
        F.col("sku").alias("product_id"),
        F.lit("1").alias("category_id"),
        F.when(F.col("category") != "promo", F.concat("category", F.lit(".sub"))).alias("category_code"),
        "brand",
        "price",
        "user_id",
        F.when(F.col("user_id") != "3", F.col("session_id")).alias("user_session"),
    )


cte("shop_raw", """
SELECT strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS t, event_ts_unix,
  CASE event_type WHEN 'click' THEN 'add_to_cart' ELSE event_type END AS event_type, i.sku, user_id,
  CASE WHEN user_id <> '3' THEN session_id ELSE '' END AS session_id, price, brand,
  CASE WHEN category <> 'promo' THEN category || '.sub' END AS category_code
FROM interactions i JOIN catalogue c ON i.sku = c.sku""")


@case("src2_shop_events", """
SELECT sha256(user_id || '|' || sku || '|' || event_type || '|' || t) AS event_id, user_id,
  session_id, event_type, sku, event_ts_unix, price, '' AS order_id, consent
FROM shop_raw, (SELECT cast(NULL AS VARCHAR) AS consent)""")
def _(v):
    path = fresh_dir(v.spark, "shop")
    _shop_raw(v).write.option("header", True).csv(path)
    events, _ = A.load_dataset(v.spark, "rees46", path=path)
    return events.withColumn("event_ts_unix", F.unix_timestamp("event_ts")).select(
        *EVENT_COLUMNS, "event_ts_unix", "price", "consent"
    )


@case("src2_shop_catalogue", """
SELECT sku, sku AS style_color_id, sku AS product_id,
  coalesce(split_part(min(category_code), '.', 1), 'unknown') AS category, min(brand) AS brand,
  round(avg(price), 6) AS list_price FROM shop_raw GROUP BY sku""")
def _(v):
    _, items = A.shop_events(_shop_raw(v))
    return items.select(*CATALOG_COLUMNS, r("list_price").alias("list_price"))


@case("src3_fashion", """
SELECT sha256(o_custkey || '|' || l_partkey || '|' || strftime(o_orderdate, '%Y-%m-%d') || '|' ||
    l_linenumber) AS event_id, cast(o_custkey AS VARCHAR) AS user_id,
  o_custkey || '#' || strftime(o_orderdate, '%Y-%m-%d') AS session_id, 'purchase' AS event_type,
  cast(l_partkey AS VARCHAR) AS sku, o_custkey || '#' || strftime(o_orderdate, '%Y-%m-%d')
    AS order_id, epoch_us(o_orderdate) // 1000000 AS event_ts_unix, l_extendedprice AS price,
  split_part(p_name, ' ', 2) AS product_id, p_brand AS color
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey""")
def _(v):
    root = fresh_dir(v.spark, "fashion")
    v.table("lineitem").join(
        v.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")
    ).select(
        F.to_date("o_orderdate").cast("string").alias("t_dat"),
        F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("article_id"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_linenumber").alias("sales_channel_id"),
    ).write.options(header=True, compression="lz4").csv(f"{root}/t")
    v.table("part").select(
        F.col("p_partkey").alias("article_id"),
        F.split("p_name", " ").getItem(1).alias("product_code"),
        F.col("p_type").alias("product_type_name"),
        F.col("p_brand").alias("colour_group_name"),
        F.lit("").alias("department_name"),
    ).write.option("header", True).csv(f"{root}/a")
    events, _ = A.load_dataset(
        v.spark, "hm", transactions=f"{root}/t", articles=f"{root}/a",
        with_items={"product_id": F.col("product_id"), "color": F.col("attributes")["color"]},
    )
    return events.select(
        *EVENT_COLUMNS, F.unix_timestamp("event_ts").alias("event_ts_unix"), "price", "product_id",
        "color",
    )


def _ratings(v):
    return v.interactions().select(
        F.col("user_id").cast("int").alias("user_id"),
        F.col("sku").cast("int").alias("item_id"),
        (F.col("sku").cast("int") % 5 + 1).alias("rating"),
        F.col("event_ts_unix").alias("timestamp"),
    ).dropDuplicates(["user_id", "item_id", "timestamp"])


cte("ratings", """
SELECT DISTINCT 'U' || user_id AS user_id, 'M' || sku AS sku, cast(sku AS INTEGER) % 5 + 1 AS rating,
  event_ts_unix, sha256('U' || user_id || '|M' || sku || '|' || event_ts_unix) AS event_id
FROM interactions""")
cte("rating_sessions", """
SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY event_ts_unix, event_id
  ROWS UNBOUNDED PRECEDING) AS session_no
FROM (SELECT *, CASE WHEN event_ts_unix - lag(event_ts_unix) OVER (PARTITION BY user_id
  ORDER BY event_ts_unix, event_id) <= 1800 THEN 0 ELSE 1 END AS starts FROM ratings)""")


@case("src4_ratings", """
SELECT event_id, user_id, user_id || '#' || cast(session_no AS BIGINT) AS session_id,
  CASE WHEN rating >= 4 THEN 'purchase' WHEN rating = 3 THEN 'view' ELSE 'remove_from_cart' END
    AS event_type, sku, '' AS order_id, event_ts_unix, 'movies' AS category
FROM rating_sessions""")
def _(v):
    root = fresh_dir(v.spark, "ratings")
    rows = _ratings(v)
    rows.filter("rating <= 3").write.option("sep", "\t").csv(f"{root}/a")
    rows.filter("rating > 3").write.option("sep", "\t").csv(f"{root}/b")
    events, items = A.load_dataset(v.spark, "ml1m", paths=[f"{root}/a", f"{root}/b"])
    return events.join(items.select("sku", "category"), "sku").select(
        *EVENT_COLUMNS, F.unix_timestamp("event_ts").alias("event_ts_unix"), "category"
    )


@case("src5_genre_ratings", """
SELECT event_id, r.user_id, r.sku, event_ts_unix, split_part(lower(p_name), ' ', 1) AS category,
  cast(p_size AS VARCHAR) AS release_year, p_name AS genres
FROM ratings r JOIN part ON 'M' || p_partkey = r.sku""")
def _(v):
    root = fresh_dir(v.spark, "genres")
    _ratings(v).toDF("user_id:token", "item_id:token", "rating:float", "timestamp:float").write.option(
        "sep", "\t"
    ).option("header", True).csv(f"{root}/i")
    v.table("part").select(
        F.col("p_partkey").alias("item_id:token"),
        F.lit("t").alias("movie_title:token_seq"),
        F.col("p_size").alias("release_year:token"),
        F.col("p_name").alias("class:token_seq"),
    ).write.option("sep", "\t").option("header", True).csv(f"{root}/m")
    events, items = A.load_dataset(
        v.spark, "ml100k", interactions=f"{root}/i", items=f"{root}/m"
    )
    named = items.select(
        "sku", "category", F.col("attributes")["release_year"].alias("release_year"),
        F.col("attributes")["genres"].alias("genres"),
    )
    return events.join(named, "sku").select(
        "event_id", "user_id", "sku", F.unix_timestamp("event_ts").alias("event_ts_unix"),
        "category", "release_year", "genres",
    )


@case("src6_adapter_registry", """
SELECT split_part(sku, 'x', 1) AS sku, count(*) AS n, count(consent) AS with_consent
FROM (SELECT sku, cast(NULL AS VARCHAR) AS consent FROM shop_raw) GROUP BY ALL""")
def _(v):
    path = fresh_dir(v.spark, "shop")
    _shop_raw(v).write.option("header", True).csv(path)
    events, _ = A.load_dataset(v.spark, "rees46", path=path)
    return events.groupBy("sku").agg(
        F.count("*").alias("n"), F.count("consent").alias("with_consent")
    )


@case("src7_consent_column", """
SELECT event_id, cast(NULL AS VARCHAR) AS consent, price FROM interactions""")
def _(v):
    return A.with_consent(v.interactions().drop("consent")).select("event_id", "consent", "price")


def _warehouse(v) -> T.Warehouse:
    return T.Warehouse(v.spark, fresh_dir(v.spark, "warehouse"))


@case("src8_read_table", """
SELECT event_type, count(*) AS n, round(sum(price), 4) AS total FROM interactions GROUP BY 1""")
def _(v):
    w = _warehouse(v)
    w.write("bronze.interactions", v.interactions())
    return w.read("bronze.interactions").groupBy("event_type").agg(
        F.count("*").alias("n"), r(F.sum("price"), 4).alias("total")
    )


@case("src9_column_subset", "SELECT event_id, sku, price FROM interactions")
def _(v):
    return T.columns_present(v.interactions(), ["event_id", "sku", "absent", "price"])


@case("src10_aligned_variant", """
SELECT user_id, split, len AS n_tokens,
  string_agg(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 5 ELSE 7 END,
    ',' ORDER BY pos) AS actions,
  string_agg(pos, ',' ORDER BY pos) AS times, string_agg(-1, ',' ORDER BY pos) AS returned
FROM (SELECT 'train' AS split, user_id, len, event_type, pos FROM h_train UNION ALL
  SELECT 'val', user_id, len, event_type, pos FROM h_val UNION ALL
  SELECT 'test', user_id, len, event_type, pos FROM h_test) GROUP BY user_id, split, len""")
def _(v):
    w = _warehouse(v)
    w.write("gold.vocab_sku", v.vocab)
    # Times are one short and the return labels are missing: both get repaired.
    broken = v.sequences.drop("input_returned").withColumn(
        "input_ts", F.slice("input_ts", F.lit(1), F.size("input_ts") - 1)
    )
    w.write("gold.sequences_sku", broken)
    _, rows = T.load_variant(w, "sku")
    return rows.select(
        "user_id", "split", F.size("input_tokens").alias("n_tokens"),
        text_of("input_actions").alias("actions"), text_of("input_ts").alias("times"),
        text_of("input_returned").alias("returned"),
    )


@case("src11_table_exists", """
SELECT 'bronze.interactions' AS name, true AS present, count(*) AS n FROM interactions
UNION ALL SELECT 'bronze.absent', false, 0""")
def _(v):
    w = _warehouse(v)
    w.write("bronze.interactions", v.interactions())
    n = w.read("bronze.interactions").agg(F.count("*").alias("n"))
    return n.select(
        F.lit("bronze.interactions").alias("name"),
        F.lit(w.exists("bronze.interactions")).alias("present"), "n",
    ).unionByName(
        n.select(
            F.lit("bronze.absent").alias("name"), F.lit(w.exists("bronze.absent")).alias("present"),
            F.lit(0).cast("long").alias("n"),
        )
    )


@case("snk1_partitioned_write", """
SELECT event_date, count(*) * 2 AS n, count(DISTINCT event_id) AS ids FROM interactions GROUP BY 1""")
def _(v):
    w = _warehouse(v)
    w.write("bronze.interactions", v.interactions())
    w.write("bronze.interactions", v.interactions(), mode="append")
    assert w.observed_partitions("bronze.interactions") == ["event_date"]
    return w.read("bronze.interactions").groupBy("event_date").agg(
        F.count("*").alias("n"), F.count_distinct("event_id").alias("ids")
    )


@case("snk2_bronze_ingest", """
SELECT 'interactions' AS name, count(*) AS n FROM interactions
UNION ALL SELECT 'catalog', count(*) FROM catalogue
UNION ALL SELECT 'days', count(DISTINCT event_date) FROM interactions""")
def _(v):
    w = _warehouse(v)
    counts = bronze.ingest(w, v.interactions().drop("event_date"), v.catalogue())
    days = w.read("bronze.interactions").agg(
        F.lit("days").alias("name"), F.count_distinct("event_date").alias("n")
    )
    return v.spark.createDataFrame(list(counts.items()), "name string, n long").unionByName(days)


@case("snk3_safe_rewrite", """
SELECT event_date, count(*) AS n FROM interactions WHERE event_type <> 'error' GROUP BY 1""")
def _(v):
    w = _warehouse(v)
    w.write("bronze.interactions", v.interactions())
    w.rewrite("bronze.interactions", w.read("bronze.interactions").filter("event_type <> 'error'"))
    return w.read("bronze.interactions").groupBy("event_date").agg(F.count("*").alias("n"))


@case("snk4_keep_layout", """
SELECT event_date, count(*) AS n, 'event_date' AS layout FROM interactions
WHERE event_type = 'view' GROUP BY 1""")
def _(v):
    w = _warehouse(v)
    w.write("gold.custom", v.interactions(), partition_by=["event_date"])
    w.rewrite("gold.custom", w.read("gold.custom").filter("event_type = 'view'"))
    layout = ",".join(w.observed_partitions("gold.custom"))
    return w.read("gold.custom").groupBy("event_date").agg(F.count("*").alias("n")).withColumn(
        "layout", F.lit(layout)
    )


@case("snk5_connector_options", "SELECT event_type, count(*) AS n FROM interactions GROUP BY 1")
def _(v):
    # The storage format is a parameter; ORC stands in for connectors whose jars are absent.
    w = T.Warehouse(v.spark, fresh_dir(v.spark, "warehouse"), fmt="orc")
    w.write("bronze.interactions", v.interactions())
    return w.read("bronze.interactions").groupBy("event_type").agg(F.count("*").alias("n"))


@case("snk6_exposure_rows", """
SELECT user_id, count(*) AS n_items,
  string_agg((position - 1) || ':' || token_id, ',' ORDER BY position) AS items
FROM lists_test WHERE position <= 5 GROUP BY user_id""")
def _(v):
    shown = v.popular("test", 5).select(
        "user_id", F.posexplode("ranked").alias("position", "token_id")
    ).select(
        "user_id", "position", F.col("token_id").cast("string").alias("product_id"),
        F.lit(None).cast("string").alias("suggested_sku"), F.lit(0.0).alias("score"),
        F.lit("relevance").alias("reason_code"), F.lit("v1").alias("model_version"),
    )
    rows = recommend.exposure_rows(
        shown, F.concat(F.lit("r"), "user_id"), "home", F.timestamp_seconds(F.lit(1706659200))
    )
    path = fresh_dir(v.spark, "exposure")
    rows.write.parquet(path)
    return v.spark.read.parquet(path).select(
        "user_id", F.size("items").cast("long").alias("n_items"),
        F.array_join(
            F.transform("items", lambda i: F.concat_ws(":", i["position"], i["product_id"])), ","
        ).alias("items"),
    )


@case("sc_parse_and_decode", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE event_ts_unix END AS at,
  cast(sku AS INTEGER) AS k FROM interactions""")
def _(v):
    bad = F.when(F.col("event_type") == "error", "not a time").otherwise(
        F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    )
    payload = F.to_json(F.struct("event_id", bad.alias("t"), F.col("sku").cast("int").alias("k")))
    parsed = v.interactions().select(
        F.from_json(payload, "event_id string, t string, k int").alias("m")
    )
    return parsed.select("m.event_id", S.parse_unix(F.col("m.t")).alias("at"), "m.k")
