"""Keyed tables that a stream keeps at one row per key.

Rows lie in buckets by a hash of their key. A batch rewrites the buckets its
keys fall in, beside the old ones, and then stores a manifest that says which
folder holds which bucket; that rename is the cut-over. A batch that runs
again starts from the last manifest before it and writes the same folders. So
a table never grows with the number of batches, and a reader sees the state
after one batch or the next, never between.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfstream.operators.sessions import last_per_key
from shelfstream.scale import cut
from shelfstream.sources.scoped import fs_path
from shelfstream.streaming.sinks import watch

BUCKETS = 64
# Tasks that write one bucket, each a file.
PARTS = 4
# Manifests, and the folders they name, that stay for readers that have started and for a batch that runs again.
KEPT = 2


def _manifests(spark: SparkSession, path: str) -> dict[int, str]:
    fs, folder = fs_path(spark, f"{path}/_manifests")
    if not fs.exists(folder):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return {int(n[:-5]): f"{path}/_manifests/{n}" for n in names if n.endswith(".json") and n[:-5].removeprefix("-").isdigit()}


def _load(spark: SparkSession, where: str) -> dict:
    fs, path = fs_path(spark, where)
    stream = fs.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _store(spark: SparkSession, path: str, number: int, manifest: dict) -> None:
    fs, draft = fs_path(spark, f"{path}/_manifests/.{number}.draft")
    _, final = fs_path(spark, f"{path}/_manifests/{number}.json")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(json.dumps(manifest).encode()))
    finally:
        stream.close()
    fs.delete(final, False)
    if not fs.rename(draft, final):
        raise OSError(f"could not store manifest {number} of {path!r}")


def _latest(spark: SparkSession, path: str, before: int | None = None) -> dict | None:
    found = [n for n in _manifests(spark, path) if before is None or n < before]
    return _load(spark, f"{path}/_manifests/{max(found)}.json") if found else None


def _rows(spark: SparkSession, path: str, manifest: dict, buckets: Sequence[int] | None = None) -> DataFrame:
    schema = manifest["schema"]
    folders = [
        f"{path}/version={version}/_bucket={bucket}"
        for bucket, version in manifest["buckets"].items()
        if buckets is None or int(bucket) in buckets
    ]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_manifests(spark, path.rstrip("/")))


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table after the last whole batch: one row per key."""
    path = path.rstrip("/")
    manifest = _latest(spark, path)
    if manifest is None:
        raise FileNotFoundError(f"no merged table at {path!r}")
    return _rows(spark, path, manifest)


def bucket_of(keys: Sequence[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def before_batch(spark: SparkSession, path: str, keys: DataFrame, names: Sequence[str], number: int) -> DataFrame | None:
    """The rows of ``keys`` as they stood before batch ``number``; only their buckets are read."""
    path = path.rstrip("/")
    manifest = _latest(spark, path, number)
    if manifest is None:
        return None
    touched = [r["_b"] for r in keys.select(bucket_of(names, manifest["size"]).alias("_b")).distinct().collect()]
    return _rows(spark, path, manifest, touched).join(keys.select(*names).distinct(), list(names), "left_semi")


def merge_batch(
    rows: DataFrame, path: str, keys: Sequence[str], number: int, buckets: int = BUCKETS, order: str | None = None
) -> None:
    """Put ``rows`` in the place of those with their keys; of rows with one key the last in ``order`` counts.

    Without ``order`` a key must occur once in a batch, as Update mode ensures.
    Only buckets with a changed key are read and written. Streams number their
    batches from 0; what was there before them is batch -1.
    """
    spark, path, keys = rows.sparkSession, path.rstrip("/"), list(keys)
    known = _latest(spark, path, number)
    size = known["size"] if known else buckets
    if order is not None:
        rows = last_per_key(rows, keys, order)
    names = rows.columns
    delta = cut(rows.withColumn("_bucket", bucket_of(keys, size)))
    touched = sorted(r["_bucket"] for r in delta.select("_bucket").distinct().collect())
    manifest = {
        "batch": number, "size": size,
        "schema": known["schema"] if known else ", ".join(
            f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields),
        "buckets": dict(known["buckets"]) if known else {},
    }
    if touched:
        merged = delta
        if known:
            old = _rows(spark, path, known, touched).withColumn("_bucket", bucket_of(keys, size))
            # A batch is small beside the table: its keys are broadcast where their stored size allows it.
            kept = old.join(delta.select(*keys), keys, "left_anti").select(*names, "_bucket")
            merged = kept.unionByName(delta)
        # Else every task writes a file into every bucket.
        part = F.pmod(F.xxhash64(F.lit(1), *keys), F.lit(PARTS))
        merged.repartition("_bucket", part).write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/version={number}")
        manifest["buckets"].update({str(b): number for b in touched})
    _store(spark, path, number, manifest)
    _clear(spark, path, number)


def _clear(spark: SparkSession, path: str, number: int) -> None:
    """Delete manifests beyond the last KEPT up to ``number``, and folders that none of the rest names."""
    found = _manifests(spark, path)
    past = sorted(n for n in found if n <= number)[:-KEPT]
    held = {(str(v), b) for n in set(found) - set(past) for b, v in _load(spark, found[n])["buckets"].items()}
    fs, _ = fs_path(spark, path)
    for n in past:
        gone = {(str(v), b) for b, v in _load(spark, found[n])["buckets"].items()} - held
        for version, bucket in gone:
            fs.delete(fs_path(spark, f"{path}/version={version}/_bucket={bucket}")[1], True)
        fs.delete(fs_path(spark, found[n])[1], False)
    versions = {v for v, _ in held}
    for status in fs.listStatus(fs_path(spark, path)[1]):
        name = status.getPath().getName()
        if name.startswith("version=") and name.split("=")[1] not in versions and int(name.split("=")[1]) <= number:
            fs.delete(status.getPath(), True)


def write_merged(
    df: DataFrame, path: str, checkpoint: str, keys: Sequence[str], mode: str = "update", buckets: int = BUCKETS, **trigger
):
    """Keep the newest row per key of a stream of changed rows in a merged table."""
    watch(df.sparkSession)

    def save(batch: DataFrame, number: int) -> None:
        merge_batch(batch, path, keys, number, buckets)

    return (
        df.writeStream.outputMode(mode)
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
