"""Bronze to silver: consent, de-duplication, catalogue, bots, length, order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from shelfstream.functions.privacy import key_fingerprint
from shelfstream.operators import cleaning as C
from shelfstream.scale import cut
from shelfstream.sources.tables import Warehouse


@dataclass(frozen=True)
class SilverRules:
    consumer: str | None = "analytics"
    drop_types: Sequence[str] = ()
    bot_per_day: int = 500
    min_events: int = 5
    max_events: int = 2000
    pseudonym_key: bytes | None = None
    pseudonym_length: int = 32


def hierarchy(catalog: DataFrame) -> DataFrame:
    """One row per SKU; of differing copies the smallest is kept."""
    columns = [
        "sku", "style_color_id", "product_id", "category", "brand", "attributes", "list_price",
    ]
    order = [c for c in columns if c not in ("sku", "attributes")]
    return C.deduplicated(catalog.select(*columns), ["sku"], order)


def _counted(df: DataFrame, step: str, seen: dict[str, Observation] | None) -> DataFrame:
    if seen is None:
        return df
    seen[step] = Observation(step)
    return df.observe(seen[step], F.count(F.lit(1)).alias("n"))


# What decides between copies of an event that differ.
COPY_ORDER = ("event_ts", "user_id", "event_type", "sku", "consent", "price", "quantity", "order_id", "return_reason")


def clean(
    events: DataFrame,
    items: DataFrame,
    rules: SilverRules,
    seen: dict[str, Observation] | None = None,
) -> DataFrame:
    """The silver events. ``seen`` receives a row count per step, from the same pass.

    The de-duplicated events feed both the per-user rule and the result, so they
    are stored once in between; otherwise the widest shuffle would run twice.
    """
    events = _counted(events, "input_events", seen)
    if rules.consumer:
        events = _counted(C.consented(events, rules.consumer), "after_consent", seen)
    # Copies may differ: the least in a fixed order stays, whatever the partitioning.
    order = [c for c in COPY_ORDER if c in events.columns]
    events = _counted(C.deduplicated(events, ["event_id"], order), "after_dedupe", seen)
    events = _counted(C.without_types(events, rules.drop_types), "after_type_filter", seen)
    events = cut(_counted(C.known_skus(events, items), "after_catalog_join", seen))
    users = C.eligible_users(events, rules.bot_per_day, rules.min_events, rules.max_events)
    events = _counted(C.only_users(events, users), "after_user_filters", seen)
    # The length rule bounds a user's rows, so a plain per-user window is safe
    # and reuses the distribution of the join above.
    order = Window.partitionBy("user_id").orderBy("event_ts", "event_id")
    events = events.withColumn("event_rank", F.row_number().over(order))
    if rules.pseudonym_key is not None:
        events = C.pseudonymised(events, rules.pseudonym_key, rules.pseudonym_length)
    return events


def run(warehouse: Warehouse, rules: SilverRules = SilverRules()) -> dict:
    """Write silver tables and report the rows left after each step."""
    events = warehouse.read("bronze.interactions")
    if rules.consumer:
        C.require_consent(events)
    items = hierarchy(warehouse.read("bronze.catalog"))
    warehouse.write("silver.item_hierarchy", items)
    items = warehouse.read("silver.item_hierarchy")
    seen: dict[str, Observation] = {}
    warehouse.write("silver.interactions", clean(events, items, rules, seen))
    report: dict = {step: o.get["n"] for step, o in seen.items()}
    if rules.consumer:
        report["consent_dropped_events"] = report["input_events"] - report["after_consent"]
    written = warehouse.read("silver.interactions").agg(
        F.count("*").alias("events"), F.count_distinct("user_id").alias("users")
    )
    report["silver_events"], report["silver_users"] = written.first()
    report["pseudonymised"] = rules.pseudonym_key is not None
    if rules.pseudonym_key is not None:
        report["pseudonym_key_fingerprint"] = key_fingerprint(rules.pseudonym_key)
    return report
