"""Building blocks that stay correct and balanced when one key is huge.

Spark's own ``Window.partitionBy(key)`` sends a whole key to one task and
``Window.orderBy`` without a key sends everything to one task. The helpers here
split such groups by value range first and stitch the pieces together with
small per-piece totals.
"""

from __future__ import annotations

import math
import re
import tempfile
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``; only a local master (tests,
    a laptop) may leave it unset and gets a scratch folder. Elsewhere each
    executor would write to a folder of its own, so that is refused.
    """
    context = spark.sparkContext
    configured = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir")
        or context.getCheckpointDir()
    )
    if not configured:
        master = str(context.master)
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a shared folder (master {master})")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below :func:`shared_dir`."""
    import uuid

    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a table in the shared folder and read it back.

    Computed once, independent of executors that held it, columnar, and of a
    size Catalyst knows when it plans the joins that follow.
    """
    path = fresh_dir(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hash_uint32(*columns: Column | str, seed: int | str = 0) -> Column:
    """A repeatable uniform integer in [0, 2**32) from the given values.

    Built on md5 so that any other engine can reproduce the draw.
    """
    parts = [F.lit(str(seed))] + [
        (F.col(c) if isinstance(c, str) else c).cast("string") for c in columns
    ]
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def hash_unit(*columns: Column | str, seed: int | str = 0) -> Column:
    """:func:`hash_uint32` scaled to [0, 1)."""
    return hash_uint32(*columns, seed=seed) / F.lit(4294967296.0)


def _threshold_index(value: Column, splits: Sequence[float], base: int = 0) -> Column:
    """How many of the sorted ``splits`` are <= ``value``, as a balanced CASE tree."""
    if not splits:
        return F.lit(base)
    middle = len(splits) // 2
    return F.when(
        value < F.lit(splits[middle]), _threshold_index(value, splits[:middle], base)
    ).otherwise(_threshold_index(value, splits[middle + 1 :], base + middle + 1))


def bin_index(value: Column, inner_edges: Sequence[float]) -> Column:
    """Bin number of ``value`` given inner edges; a bin is closed on its left side."""
    return _threshold_index(value, sorted(inner_edges))


def pieces(df: DataFrame, order: Sequence[str | Column], out: str = "_piece") -> DataFrame:
    """``df`` stored in ``order``, with the number of the stretch a row lies in.

    Rows are range-partitioned on the whole sort key, so neither a hot group
    nor rows that tie on the first columns gather in one piece, and the number
    of pieces follows the data. The numbers are stored with the rows: a
    retried task can't change them. They never fall along ``order``.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    sorted_rows = df.orderBy(*keys).withColumn("_position", F.monotonically_increasing_id())
    return cut(sorted_rows).withColumn(out, F.shiftright("_position", 33))


def running_totals(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], sums: dict[str, str]
) -> DataFrame:
    """Inclusive running sums per group in ``order``; ``sums`` maps output to input.

    Work per task is one (group, piece); the per-group window runs over the
    totals of pieces only.
    """
    groups = list(groups)
    piece = pieces(df, [*groups, *order]).drop("_position")
    totals = piece.groupBy(*groups, "_piece").agg(
        *[F.sum(source).alias(f"_t_{out}") for out, source in sums.items()]
    )
    before = Window.partitionBy(*groups).orderBy("_piece").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = totals.select(
        *groups,
        "_piece",
        *[F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_o_{out}") for out in sums],
    )
    inside = Window.partitionBy(*groups, "_piece").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    joined = piece.select(
        "*", *[F.sum(source).over(inside).alias(f"_i_{out}") for out, source in sums.items()]
    ).join(offsets, [*groups, "_piece"])
    for out in sums:
        joined = joined.withColumn(out, F.col(f"_i_{out}") + F.col(f"_o_{out}"))
    drop = ["_piece"] + [f"_i_{o}" for o in sums] + [f"_o_{o}" for o in sums]
    return joined.drop(*drop)


def ranked_rows(df: DataFrame, groups: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """``row_number`` per group that splits a hot group."""
    marked = df.withColumn("_one", F.lit(1).cast("long"))
    return running_totals(marked, groups, order, {out: "_one"}).drop("_one")


def global_row_number(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """1-based position in a total order, without funnelling rows into one task.

    Each stored piece is numbered from its rows' positions in it and from the
    sizes of the pieces before (one row per piece, joined and not listed).
    """
    ordered = pieces(df, order)
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy("_piece").agg(F.count("*").alias("_size")).select(
        "_piece", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    local = F.col("_position").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        ordered.join(starts, "_piece")
        .withColumn(out, (F.col("_start") + local + 1).cast("long"))
        .drop("_piece", "_position", "_start")
    )


# Bits of a value's key that one counting pass settles.
DIGIT = 16
# Rows of a bin that are looked at one by one instead of counted once more.
FEW = 1_000


def _order_keys(batches):
    """(group, double) to (group, long): keys that sort as the values do, with one key for both zeros."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        values = batch.column(1).to_numpy(zero_copy_only=False) + 0.0
        bits = values.view(np.int64)
        keys = np.where(bits < 0, bits ^ np.int64(0x7FFF_FFFF_FFFF_FFFF), bits)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys)], ["_g", "_k"])


def _shared_bits(low: int, high: int) -> int:
    """How many leading bits all 64-bit keys from ``low`` to ``high`` have in common."""
    return 64 - (low ^ high).bit_length() if (low < 0) == (high < 0) else 0


def _value_of(key: int) -> float:
    import struct

    return struct.unpack("<d", struct.pack("<q", key if key >= 0 else key ^ 0x7FFF_FFFF_FFFF_FFFF))[0]


def order_statistics(
    df: DataFrame,
    column: str,
    ranks: Callable[[int], Iterable[int]],
    by: str | None = None,
) -> dict:
    """Exact values at 0-based ranks of ``column``; ``ranks`` maps a group's row count to them.

    ``F.percentile`` keeps every distinct value of a group in one task, and a
    sort moves every row. Here values are stored once as 64-bit keys of the
    same order (whole numbers as they are), and each pass counts the next 16 bits of those rows that share
    a wanted rank's bits so far, from the first bit in which a group's least
    and largest key differ: four passes at most, fewer where a bin gets small,
    whatever the values are. Counts combine before the shuffle, so
    neither a hot group nor a value that many rows share gathers anywhere. What
    reaches the driver is a row per group and wanted rank, and at the end
    FEW rows for each. Null and NaN are left out, infinities are values.
    Returns ``{group: (n, {rank: value})}``; the group is ``None`` without ``by``.
    """
    spark = df.sparkSession
    group = (F.col(by).cast("string") if by else F.lit("")).alias("_g")
    whole = dict(df.dtypes).get(column) in ("tinyint", "smallint", "int", "bigint")
    if whole:
        # Whole numbers are their own keys, so times need no Python.
        data = cut(df.select(group, F.col(column).cast("long").alias("_k")).filter("_k is not null"))
    else:
        values = df.select(group, F.col(column).cast("double").alias("_v"))
        data = cut(values.filter(F.col("_v").isNotNull() & ~F.isnan("_v")).mapInArrow(_order_keys, "_g string, _k long"))
    found: dict = {}
    # (group, rank): the bits known so far, the rank among rows with these bits, and the number of these.
    wanted: dict[tuple, tuple[int, int, int]] = {}
    groups = data.groupBy("_g").agg(F.count("*").alias("n"), F.min("_k").alias("low"), F.max("_k").alias("high")).collect()
    # The bits that every group's values share need no pass; times of a month share about twenty.
    settled = min((_shared_bits(r["low"], r["high"]) for r in groups), default=0)
    for r in groups:
        found[r["_g"]] = (r["n"], {})
        bits = r["low"] >> 64 - settled if settled else 0
        wanted.update({(r["_g"], rank): (bits, rank, r["n"]) for rank in set(ranks(r["n"]))})
    while wanted and settled < 64 and any(n > FEW for _, _, n in wanted.values()):
        bins = _bins(data, wanted, settled)
        rows = spark.createDataFrame(
            [(g, rank, bits, rest) for (g, rank), (bits, rest, _) in wanted.items()],
            "_w string, _rank long, _b long, _rest long",
        )
        same = bins["_g"].eqNullSafe(rows["_w"]) & (bins["_bits"] == rows["_b"])
        inside = (F.col("_rest") >= F.col("_before")) & (F.col("_rest") < F.col("_before") + F.col("_n"))
        hits = F.broadcast(rows).join(bins, same & inside).select(
            "_w", "_rank", "_next", "_n", (F.col("_rest") - F.col("_before")).alias("_rest")
        )
        wanted = {(h["_w"], h["_rank"]): (h["_next"], h["_rest"], h["_n"]) for h in hits.collect()}
        settled += min(DIGIT, 64 - settled)
    values: dict[tuple, list[tuple[int, int]]] = {}
    if wanted and settled < 64:
        for r in _matching(data, wanted, settled).groupBy("_g", "_bits", "_k").count().orderBy("_k").collect():
            values.setdefault((r["_g"], r["_bits"]), []).append((r["_k"], r["count"]))
    for (group, rank), (bits, rest, _) in wanted.items():
        key = bits
        for key, n in values.get((group, bits), []):
            if rest < n:
                break
            rest -= n
        found[group][1][rank] = float(key) if whole else _value_of(key)
    return {(group if by else None): value for group, value in found.items()}


def _matching(data: DataFrame, wanted: dict, settled: int) -> DataFrame:
    """Rows whose first ``settled`` bits a wanted rank shares, with these bits."""
    if not settled:
        return data.withColumn("_bits", F.lit(0).cast("long"))
    pairs = sorted({(g, bits) for (g, _), (bits, _, _) in wanted.items()}, key=str)
    chosen = data.sparkSession.createDataFrame(pairs, "_h string, _bits long")
    own = F.shiftright(data["_k"], 64 - settled) == chosen["_bits"]
    # Keys that repeat are small as a file, so without the hint Catalyst collects all rows on the driver to broadcast them.
    return data.join(F.broadcast(chosen), data["_g"].eqNullSafe(chosen["_h"]) & own).select("_g", "_k", "_bits")


def _bins(data: DataFrame, wanted: dict, settled: int) -> DataFrame:
    """(_g, _bits, _next, _n, _before): rows per value of the next digit, and those in the bins below it."""
    digit = F.shiftright("_k", max(0, 64 - settled - DIGIT))
    counts = _matching(data, wanted, settled).groupBy("_g", "_bits", digit.alias("_next")).agg(F.count("*").alias("_n"))
    # At most 65,536 bins for each group and prefix, whatever the number of rows.
    below = Window.partitionBy("_g", "_bits").orderBy("_next").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(below), F.lit(0)))


def exact_quantiles(
    df: DataFrame, column: str, probabilities: Sequence[float], by: str | None = None
) -> dict:
    """Exact linearly interpolated quantiles: ``{group: [values]}`` (see above)."""

    def ranks(n: int) -> set[int]:
        low = {math.floor(p * (n - 1)) for p in probabilities}
        return low | {min(r + 1, n - 1) for r in low}

    out = {}
    for group, (n, value) in order_statistics(df, column, ranks, by).items():
        quantiles = []
        for p in probabilities:
            at = p * (n - 1)
            below = math.floor(at)
            a, b = value[below], value[min(below + 1, n - 1)]
            quantiles.append(a + (b - a) * (at - below))
        out[group] = quantiles
    return out
