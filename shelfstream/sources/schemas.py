"""Declared schemas; nothing is inferred."""

from __future__ import annotations

INTERACTIONS = (
    "event_id string, user_id string, session_id string, event_type string, sku string, "
    "event_ts timestamp, price double, quantity int, order_id string, return_reason string, "
    "consent string"
)
CATALOG = (
    "sku string, style_color_id string, product_id string, category string, brand string, "
    "attributes map<string,string>, list_price double"
)
INTERACTION_COLUMNS = [part.split()[0] for part in INTERACTIONS.split(", ")]
CATALOG_COLUMNS = [part.split()[0] for part in CATALOG.split(", ")]

CATALOG_CSV = (
    "sku string, style_color_id string, product_id string, category string, brand string, "
    "size string, color string, capacity string, list_price double"
)
SHOP_EVENTS_CSV = (
    "event_time string, event_type string, product_id string, category_id string, "
    "category_code string, brand string, price double, user_id string, user_session string"
)
FASHION_TRANSACTIONS_CSV = (
    "t_dat string, customer_id string, article_id string, price double, sales_channel_id string"
)
FASHION_ARTICLES_COLUMNS = (
    "article_id",
    "product_code",
    "product_type_name",
    "colour_group_name",
    "department_name",
)
RATINGS_TSV = "user_id int, item_id int, rating int, timestamp long"

# Message on the interaction topic: required fields first, then optional ones.
MESSAGE = (
    "event_id string, user_id string, session_id string, event_type string, sku string, "
    "style_color_id string, product_id string, event_ts timestamp, ingest_ts timestamp, "
    "price double, quantity int, order_id string, return_reason string, consent string, "
    "channel string, device string, surface string, store_id string, locale string, "
    "schema_version int"
)
MESSAGE_COLUMNS = [part.split()[0] for part in MESSAGE.split(", ")]
MESSAGE_REQUIRED = ("event_id", "user_id", "session_id", "event_type", "sku", "event_ts")

CATALOG_CHANGE = (
    "sku string, style_color_id string, product_id string, category string, brand string, "
    "attributes map<string,string>, change_ts timestamp"
)
PRICE_CHANGE = (
    "sku string, list_price double, current_price double, promo_id string, change_ts timestamp"
)
STOCK_CHANGE = (
    "sku string, location string, stock int, available boolean, change_ts timestamp"
)
EXPOSURE = (
    "request_id string, user_id string, session_id string, surface string, "
    "model_version string, served_ts timestamp, latency_ms double, "
    "items array<struct<position:int,product_id:string,suggested_sku:string,"
    "score:double,reason_code:string>>"
)

# Topic name -> (key columns, keep latest per key, schema).
TOPICS = {
    "interactions.v1": (("user_id",), False, MESSAGE),
    "catalog.cdc.v1": (("sku",), True, CATALOG_CHANGE),
    "pricing.cdc.v1": (("sku",), True, PRICE_CHANGE),
    "inventory.v1": (("sku", "location"), True, STOCK_CHANGE),
    "recs.served.v1": (("request_id",), False, EXPOSURE),
}
