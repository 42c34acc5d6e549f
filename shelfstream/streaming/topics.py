"""Topics as streaming DataFrames with a fixed schema; files or Kafka behind them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfstream.functions import scalars as S
from shelfstream.scale import hash_uint32
from shelfstream.sources.schemas import MESSAGE_COLUMNS, TOPICS


# JSON keeps times to the microsecond; Spark's default form ends at the millisecond.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def read_topic(
    spark: SparkSession,
    topic: str,
    path: str | None = None,
    fmt: str = "json",
    options: Mapping[str, str] | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Stream of typed messages.

    ``fmt="kafka"`` needs the connector on the classpath and its usual
    ``options``; other formats read files below ``path``.
    """
    schema = TOPICS[topic][2]
    reader = spark.readStream.format(fmt).options(**dict(options or {}))
    if fmt == "kafka":
        raw = reader.option("subscribe", topic).load()
        return decode(raw.select(F.col("value").cast("string").alias("value")), topic)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.options(**TIMES).schema(schema).load(path)


def encode(df: DataFrame, topic: str) -> DataFrame:
    """(key, value) with the message as JSON; the key keeps one entity's messages in order."""
    keys = TOPICS[topic][0]
    return df.select(
        F.concat_ws("#", *keys).alias("key"),
        F.to_json(F.struct(*[c for c in df.columns]), TIMES).alias("value"),
    )


def decode(df: DataFrame, topic: str) -> DataFrame:
    return df.select(F.from_json("value", TOPICS[topic][2], TIMES).alias("m")).select("m.*")


def as_messages(silver: DataFrame) -> DataFrame:
    """Silver rows as topic messages: typed, blank optional text as null."""
    have = set(silver.columns)
    text = ("style_color_id", "product_id", "order_id", "return_reason", "consent", "channel",
            "device", "surface", "store_id", "locale")
    made: dict[str, Column] = {
        name: S.null_if_blank(F.col(name)) if name in have else F.lit(None).cast("string")
        for name in text
    }
    session = F.col("session_id") if "session_id" in have else F.lit(None)
    made.update(
        event_id=F.col("event_id").cast("string"),
        user_id=F.col("user_id").cast("string"),
        session_id=F.coalesce(S.null_if_blank(session), F.col("event_id").cast("string")),
        event_type=F.col("event_type"),
        sku=F.col("sku"),
        event_ts=F.col("event_ts").cast("timestamp"),
        ingest_ts=F.lit(None).cast("timestamp"),
        price=F.col("price").cast("double") if "price" in have else F.lit(None).cast("double"),
        quantity=F.col("quantity").cast("int") if "quantity" in have else F.lit(None).cast("int"),
        schema_version=F.lit(1),
    )
    return silver.select(*[made[name].alias(name) for name in MESSAGE_COLUMNS])


def write_messages(messages: DataFrame, path: str) -> None:
    """Append messages as JSON files of a file topic, times to the microsecond."""
    messages.write.mode("append").options(**TIMES).json(path)


def replay(silver: DataFrame, path: str, files: int | None = None) -> None:
    """Write messages in event-time order as numbered files for a file stream.

    Range partitioning gives the global order without a single sorting task;
    without ``files`` their number follows the data.
    ``maxFilesPerTrigger`` and the trigger interval set the pace of the replay.
    A file stream takes files by modification time, and these are written in
    parallel, so consumers must not rely on the order between files: the state
    operators here order by event time.
    """
    keys = ("event_ts", "event_id")
    messages = as_messages(silver)
    dealt = messages.repartitionByRange(files, *keys) if files else messages.repartitionByRange(*keys)
    write_messages(dealt.sortWithinPartitions(*keys), path)


def newest_first_limit(silver: DataFrame, n: int) -> DataFrame:
    """The first ``n`` events in time order (top-n per partition, then merged)."""
    return silver.orderBy("event_ts", "event_id").limit(n)


def key_skew(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """Events and keys per partition with the ratio to the mean."""
    part = F.pmod(hash_uint32(key), F.lit(partitions)).cast("int").alias("partition")
    # First per key, so a hot key is one row when distinct keys are counted.
    per_key = df.groupBy(key).agg(F.count("*").alias("n")).select(part, "n")
    table = per_key.groupBy("partition").agg(
        F.sum("n").alias("events"), F.count("*").alias("keys")
    )
    total = table.agg((F.sum("events") / F.lit(partitions)).alias("mean")).withColumn("_k", F.lit(1))
    return table.withColumn("_k", F.lit(1)).join(total, "_k").select(
        "partition", "events", "keys", (F.col("events") / F.col("mean")).alias("load_ratio")
    )
