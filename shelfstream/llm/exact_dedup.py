"""Exact duplicates by digest: heavy digests are settled map-side, the rest by a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfstream.scale import cut

# Counters of a Misra-Gries summary. A digest with 2N / (COUNTERS + 1) of N rows
# or more is surely found; at most COUNTERS + 1 digests are broadcast (some 300 KB).
COUNTERS = 4095


def misra_gries(summary: pd.Series, batch: pd.Series, counters: int) -> pd.Series:
    """Merge counts into a summary and cut it back to ``counters`` entries.

    Taking the (counters + 1)-th largest count off all entries is the batched
    form of the decrement step: an entry loses at most rows / (counters + 1).
    """
    merged = batch if summary.empty else summary.add(batch, fill_value=0)
    if len(merged) > counters:
        spare = np.partition(merged.to_numpy(), len(merged) - counters - 1)
        merged = merged - spare[len(merged) - counters - 1]
        merged = merged[merged > 0]
    return merged.astype("int64")


def heavy_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, group_size, keep_id) of the heavy digests, counted exactly; counters + 1 rows at most.

    Estimates are merged per digest. They add up to N at most, so no more than
    counters + 1 of them reach N / (counters + 1); and since an estimate misses
    at most that much, every digest with twice that many rows is among them.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = pd.Series(dtype="int64")
        for batch in batches:
            counts = batch.column(0).value_counts()
            values, numbers = counts.field("values"), counts.field("counts")
            step = pd.Series(numbers.to_numpy(), index=values.to_pylist())
            summary = misra_gries(summary, step, counters)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(summary.index), pa.string()), pa.array(summary.to_numpy(), pa.int64())],
            ["digest", "estimate"],
        )

    rows = digests.count()
    candidates = (
        digests.select("digest").mapInArrow(summarise, "digest string, estimate long")
        .groupBy("digest").agg(F.sum("estimate").alias("estimate"))
        .where(F.col("estimate") * (counters + 1) >= rows)
        .select("digest")
    )
    # Verify: exact sizes and winners, pre-aggregated in each task.
    return cut(
        digests.join(F.broadcast(candidates), "digest")
        .groupBy("digest")
        .agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
    )


def judge_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. Of equal texts the
    row with the largest doc_id stays. Rows without an id lose to any id; a
    group of such rows has a null keep_id and keeps them all. Repeated rows
    (same id, same text) count in group_size and share one verdict. An empty
    table gives no rows; other columns are ignored.
    """
    digests = cut(
        docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    )
    heavy = heavy_digests(digests, counters)
    settled = digests.join(F.broadcast(heavy), "digest")
    light = digests.join(F.broadcast(heavy), "digest", "left_anti")
    winners = light.groupBy("digest").agg(
        F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id")
    )
    columns = ["digest", "doc_id", "group_size", "keep_id"]
    judged = settled.select(columns).union(light.join(winners, "digest").select(columns))
    return judged.select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
