"""Session settings the library is designed for."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

# AQE does the run-time work the library relies on instead of hints: it turns a
# join into a broadcast only after measuring the side, splits skewed join
# partitions, and coalesces small ones.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even where the split costs one more shuffle afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session that something else created."""
    for key, value in ENGINE_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(
    app_name: str = "shelfstream",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    iceberg: Mapping[str, str] | None = None,
    extra: Mapping[str, str] | None = None,
) -> SparkSession:
    """A session for the Parquet or (given ``iceberg``) Iceberg backend.

    ``iceberg`` takes ``catalog``, ``uri``, ``warehouse`` and optionally
    ``s3_endpoint`` and ``packages``; the runtime jars must be reachable.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in ENGINE_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in iceberg_conf(**iceberg).items() if iceberg else ():
        builder = builder.config(key, value)
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def iceberg_conf(
    catalog: str,
    uri: str,
    warehouse: str,
    s3_endpoint: str | None = None,
    packages: str | None = None,
) -> dict[str, str]:
    """Catalog options for an Iceberg REST catalog."""
    prefix = f"spark.sql.catalog.{catalog}"
    conf = {
        "spark.sql.extensions": (
            "org.apache.iceberg.spark.extensions.IcebergSparkSessionExtensions"
        ),
        prefix: "org.apache.iceberg.spark.SparkCatalog",
        f"{prefix}.type": "rest",
        f"{prefix}.uri": uri,
        f"{prefix}.warehouse": warehouse,
        "spark.sql.defaultCatalog": catalog,
    }
    if s3_endpoint:
        conf[f"{prefix}.io-impl"] = "org.apache.iceberg.aws.s3.S3FileIO"
        conf[f"{prefix}.s3.endpoint"] = s3_endpoint
        conf[f"{prefix}.s3.path-style-access"] = "true"
    if packages:
        conf["spark.jars.packages"] = packages
    return conf
