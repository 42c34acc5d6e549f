"""Public dataset exports to the canonical interactions and catalogue frames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfstream.functions import scalars as S
from shelfstream.operators.sessions import sessionise
from shelfstream.sources import schemas

Frames = tuple[DataFrame, DataFrame]


def with_consent(interactions: DataFrame) -> DataFrame:
    """Guarantee the consent column; unknown consent stays null."""
    present = "consent" in interactions.columns
    value = F.col("consent") if present else F.lit(None)
    return interactions.withColumn("consent", value.cast("string"))


def _canonical(events: DataFrame, more: Sequence[str] = (), **overrides: Column) -> DataFrame:
    """Fill the fields a source does not have and put columns in canonical order, ``more`` behind them."""
    blank = {
        "price": F.lit(None),
        "quantity": F.lit(1),
        "order_id": F.lit(""),
        "return_reason": F.lit(""),
        "consent": F.lit(None),
    }
    types = dict(part.split() for part in schemas.INTERACTIONS.split(", "))
    return events.select(
        *[
            overrides.get(name, F.col(name) if name in events.columns else blank.get(name))
            .cast(types[name])
            .alias(name)
            for name in schemas.INTERACTION_COLUMNS
        ],
        *more,
    )


def read_shop_csv(spark: SparkSession, interactions: str, catalog: str) -> Frames:
    """CSV export that already has the canonical fields."""
    raw_schema = schemas.INTERACTIONS.replace("event_ts timestamp", "event_ts string")
    raw = spark.read.schema(raw_schema).option("header", True).csv(interactions)
    events = _canonical(
        raw,
        event_ts=F.to_timestamp("event_ts"),
        order_id=S.blank_if_null(F.col("order_id")),
        return_reason=S.blank_if_null(F.col("return_reason")),
    )
    items = spark.read.schema(schemas.CATALOG_CSV).option("header", True).csv(catalog)
    return events, items.select(
        "sku",
        "style_color_id",
        "product_id",
        F.lower("category").alias("category"),
        "brand",
        S.attribute_map(
            size=F.col("size"), color=F.col("color"), capacity=F.col("capacity")
        ).alias("attributes"),
        "list_price",
    )


def read_shop_events(spark: SparkSession, path: str) -> Frames:
    """Multi-category shop log: one file set, catalogue derived from the events."""
    raw = spark.read.schema(schemas.SHOP_EVENTS_CSV).option("header", True).csv(path)
    return shop_events(raw)


def shop_events(raw: DataFrame) -> Frames:
    shaped = raw.select(
        F.to_timestamp(F.regexp_replace("event_time", " UTC$", "")).alias("event_ts"),
        F.col("product_id").cast("string").alias("sku"),
        F.col("user_id").cast("string").alias("user_id"),
        S.blank_if_null(F.col("user_session")).alias("session_id"),
        F.when(F.col("event_type") == "cart", "add_to_cart")
        .otherwise(F.col("event_type"))
        .alias("event_type"),
        F.col("price").cast("double").alias("price"),
    )
    key = S.natural_key("user_id", "sku", "event_type", F.col("event_ts").cast("string"))
    # min instead of first: the same row order or not, the same catalogue.
    catalog = (
        raw.groupBy(F.col("product_id").cast("string").alias("sku"))
        .agg(
            F.min("category_code").alias("category_code"),
            F.min("brand").alias("brand"),
            F.avg("price").alias("list_price"),
        )
        .select(
            "sku",
            F.col("sku").alias("style_color_id"),
            F.col("sku").alias("product_id"),
            F.lower(
                F.coalesce(F.split("category_code", r"\.").getItem(0), F.lit("unknown"))
            ).alias("category"),
            "brand",
            S.attribute_map().alias("attributes"),
            "list_price",
        )
    )
    return _canonical(shaped.withColumn("event_id", key)), catalog


def read_fashion(
    spark: SparkSession, transactions: str, articles: str, with_items: Mapping[str, Column] | None = None
) -> Frames:
    """Fashion purchases: an article is one colour, a product code all colours. ``with_items``: see :func:`fashion`."""
    sales = (
        spark.read.schema(schemas.FASHION_TRANSACTIONS_CSV).option("header", True).csv(transactions)
    )
    # Only the used columns are typed; the file has more, so names come from its header.
    items = spark.read.option("header", True).csv(articles)
    return fashion(sales, items.select(*schemas.FASHION_ARTICLES_COLUMNS), with_items)


def fashion(sales: DataFrame, articles: DataFrame, with_items: Mapping[str, Column] | None = None) -> Frames:
    """Sales and articles to the canonical frames.

    ``with_items`` adds columns of the catalogue to the events; sales of unlisted
    articles then drop out. They are joined to the sale as it was read: the
    id, session and order derived from it are several times its size.
    """
    catalog = _fashion_catalog(articles)
    more = with_items or {}
    if more:
        named = [value.alias(name) for name, value in more.items()]
        sales = sales.join(catalog.select(F.col("sku").alias("article_id"), *named), "article_id")
    day = F.concat_ws("#", "customer_id", "t_dat")
    events = sales.select(
        S.natural_key("customer_id", "article_id", "t_dat", "sales_channel_id").alias("event_id"),
        F.col("customer_id").alias("user_id"),
        day.alias("session_id"),
        F.lit("purchase").alias("event_type"),
        F.col("article_id").cast("string").alias("sku"),
        F.to_timestamp("t_dat").alias("event_ts"),
        "price",
        day.alias("order_id"),
        *more,
    )
    return _canonical(events, tuple(more)), catalog


def _fashion_catalog(articles: DataFrame) -> DataFrame:
    return articles.select(
        F.col("article_id").cast("string").alias("sku"),
        F.col("article_id").cast("string").alias("style_color_id"),
        F.col("product_code").cast("string").alias("product_id"),
        F.lit("apparel").alias("category"),
        F.lit("hm").alias("brand"),
        S.attribute_map(
            color=F.col("colour_group_name"),
            product_type=F.col("product_type_name"),
            department=F.col("department_name"),
        ).alias("attributes"),
        F.lit(None).cast("double").alias("list_price"),
    )


def rating_action(rating: Column) -> Column:
    """Liked items count as bought, lukewarm as viewed, disliked as removed."""
    return (
        F.when(rating >= 4, "purchase").when(rating == 3, "view").otherwise("remove_from_cart")
    )


def ratings_events(ratings: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """Rows of (user_id, item_id, rating, timestamp) to canonical interactions."""
    shaped = ratings.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user_id"),
        F.concat(F.lit("M"), F.col("item_id").cast("string")).alias("sku"),
        F.col("timestamp").cast("long").alias("event_ts_unix"),
        rating_action(F.col("rating")).alias("event_type"),
    ).withColumn("event_id", S.natural_key("user_id", "sku", F.col("event_ts_unix").cast("string")))
    sessions = sessionise(shaped, gap_seconds)
    return _canonical(sessions, event_ts=F.timestamp_seconds("event_ts_unix"))


def _movie_item(item_id: Column) -> list[Column]:
    sku = F.concat(F.lit("M"), item_id.cast("string"))
    return [sku.alias("sku"), sku.alias("style_color_id"), sku.alias("product_id")]


def read_ratings(spark: SparkSession, paths: list[str]) -> Frames:
    """Tab-separated ratings without item metadata, possibly in several files."""
    raw = spark.read.schema(schemas.RATINGS_TSV).option("sep", "\t").csv(paths)
    catalog = (
        raw.select("item_id")
        .distinct()
        .select(
            *_movie_item(F.col("item_id")),
            F.lit("movies").alias("category"),
            F.lit("movielens").alias("brand"),
            S.attribute_map().alias("attributes"),
            F.lit(None).cast("double").alias("list_price"),
        )
    )
    return ratings_events(raw), catalog


def untyped_names(df: DataFrame) -> DataFrame:
    """``item_id:token`` style headers to plain names."""
    return df.select(*[F.col(f"`{name}`").alias(name.split(":")[0]) for name in df.columns])


def read_genre_ratings(spark: SparkSession, interactions: str, items: str) -> Frames:
    """Ratings with typed headers and an item file that lists genres."""
    reader = spark.read.option("sep", "\t").option("header", True)
    raw = untyped_names(reader.csv(interactions)).select(
        F.col("user_id"),
        F.col("item_id"),
        F.col("rating").cast("double").alias("rating"),
        F.col("timestamp").cast("double").cast("long").alias("timestamp"),
    )
    movies = untyped_names(reader.csv(items)).withColumnsRenamed({"class": "genres"})
    return ratings_events(raw), genre_catalog(movies)


def genre_catalog(movies: DataFrame) -> DataFrame:
    """The first listed genre becomes the category."""
    return movies.select(
        *_movie_item(F.col("item_id")),
        F.lower(F.coalesce(F.split("genres", " ").getItem(0), F.lit("unknown"))).alias("category"),
        F.lit("movielens").alias("brand"),
        S.attribute_map(genres=F.col("genres"), release_year=F.col("release_year")).alias(
            "attributes"
        ),
        F.lit(None).cast("double").alias("list_price"),
    )


ADAPTERS: dict[str, Callable[..., Frames]] = {
    "synthetic": read_shop_csv,
    "rees46": read_shop_events,
    "hm": read_fashion,
    "ml1m": read_ratings,
    "ml100k": read_genre_ratings,
}


def load_dataset(spark: SparkSession, name: str, **options) -> Frames:
    """Interactions (with consent column) and catalogue of a named dataset; ``options`` go to its reader."""
    if name not in ADAPTERS:
        raise ValueError(f"unknown dataset {name!r}; expected one of {sorted(ADAPTERS)}")
    interactions, catalog = ADAPTERS[name](spark, **options)
    return with_consent(interactions), catalog
