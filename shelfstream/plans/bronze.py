"""Landing: adapter output to bronze tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from shelfstream.sources.tables import Warehouse


def ingest(warehouse: Warehouse, interactions: DataFrame, catalog: DataFrame) -> dict[str, int]:
    """Write both bronze tables; counts come from the writes themselves."""
    events, items = Observation("events"), Observation("items")
    dated = interactions.withColumn("event_date", F.to_date("event_ts"))
    warehouse.write(
        "bronze.interactions", dated.observe(events, F.count(F.lit(1)).alias("n"))
    )
    warehouse.write("bronze.catalog", catalog.observe(items, F.count(F.lit(1)).alias("n")))
    return {"interactions": events.get["n"], "catalog": items.get["n"]}
