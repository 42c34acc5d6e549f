"""Merged tables: one row per key, whatever runs again."""

import random

import pytest
from pyspark.sql import functions as F

from shelfstream.streaming import merged, sinks


def batch_of(spark, number, keys, parts=2):
    return spark.createDataFrame(
        [(f"k {k}/{k % 3}", number, float(number * 100 + k)) for k in keys], "sku string, made int, value double"
    ).repartition(parts)


def files_of(spark, path):
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)


def test_twenty_batches_leave_one_row_per_key(spark, tmp_path):
    rng, path, want = random.Random(1), str(tmp_path / "t"), {}
    for number in range(20):
        keys = rng.sample(range(60), rng.choice([0, 1, 5, 30]))
        batch = batch_of(spark, number, keys)
        merged.merge_batch(batch, path, ["sku"], number, buckets=4)
        want.update({f"k {k}/{k % 3}": number for k in keys})
        if number % 5 == 4:
            rows = merged.current(spark, path).collect()
            assert {r.sku: r.made for r in rows} == want and len(rows) == len(want)
    # On disk, too: no more than the last manifests name.
    stored = spark.read.option("recursiveFileLookup", True).parquet(path).count()
    assert len(want) <= stored <= merged.KEPT * len(want)
    assert len(merged._manifests(spark, path)) == merged.KEPT


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    merged.merge_batch(batch_of(spark, 0, range(10)), path, ["sku"], 0, buckets=3)
    merged.merge_batch(batch_of(spark, 1, range(5, 12)), path, ["sku"], 1)
    once = sorted(map(tuple, merged.current(spark, path).collect()))

    class Stop(Exception):
        pass

    def refuse(*_):
        raise Stop

    # The files of batch 2 are written, but its manifest is not: readers see batch 1.
    with monkeypatch.context() as patch:
        patch.setattr(merged, "_store", refuse)
        with pytest.raises(Stop):
            merged.merge_batch(batch_of(spark, 2, range(3)), path, ["sku"], 2)
    assert sorted(map(tuple, merged.current(spark, path).collect())) == once
    for _ in range(2):  # it runs again, and once more after its manifest
        merged.merge_batch(batch_of(spark, 2, range(3)), path, ["sku"], 2)
        rows = {r.sku: r.made for r in merged.current(spark, path).collect()}
        assert len(rows) == 12 and sum(m == 2 for m in rows.values()) == 3
    before = merged.before_batch(spark, path, batch_of(spark, 9, [1, 11, 77]).select("sku"), ["sku"], 2)
    assert {r.sku: r.made for r in before.collect()} == {"k 1/1": 0, "k 11/2": 1}


def test_only_changed_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    merged.merge_batch(batch_of(spark, 0, range(200)), path, ["sku"], 0, buckets=16)
    before = {r.path for r in files_of(spark, path).collect()}
    merged.merge_batch(batch_of(spark, 1, [7]), path, ["sku"], 1)
    added = {r.path for r in files_of(spark, path).collect()} - before
    assert len({p.split("_bucket=")[1].split("/")[0] for p in added}) == 1
    assert merged.current(spark, path).count() == 200
    with pytest.raises(FileNotFoundError):
        merged.current(spark, str(tmp_path / "none"))


def test_the_last_of_a_batch_counts(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "x", 3), ("a", "y", 2), ("b", "x", 1)], "sku string, place string, at int")
    merged.merge_batch(rows, str(tmp_path), ["sku", "place"], 0, order="at")
    assert sorted(map(tuple, merged.current(spark, str(tmp_path)).collect())) == [("a", "x", 3), ("a", "y", 2), ("b", "x", 1)]


def test_a_stream_restarts_on_its_table(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / n) for n in ("source", "table", "checkpoint"))
    for number in range(4):
        batch_of(spark, number, range(number, number + 6), 1).write.mode("append").parquet(source)
        if number % 2:
            stream = spark.readStream.schema("sku string, made int, value double").option("maxFilesPerTrigger", 1).parquet(source)
            newest = stream.groupBy("sku").agg(F.max("made").alias("made"))
            sinks.finish(merged.write_merged(newest, path, checkpoint, ["sku"], buckets=2))
    rows = {r.sku: r.made for r in merged.current(spark, path).collect()}
    assert rows == {f"k {k}/{k % 3}": min(k, 3) for k in range(9)}


def test_a_batch_writes_few_files_whatever_its_partitions(spark, tmp_path):
    # Every partition wrote a file into every bucket.
    path = f"{tmp_path}/t"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        merged.merge_batch(spark.range(4_000).repartition(16), path, ["id"], 0, buckets=4)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    table = merged.current(spark, path)
    assert table.count() == table.distinct().count() == 4_000
    assert len(table.inputFiles()) <= 4 * merged.PARTS
