"""Isotonic fits as block lists that merge.

A monotone fit pools neighbours whose rates fall. What is pooled inside a
stretch of the probability range stays pooled in the whole, so each stretch is
reduced to its blocks (range, rows, positives) and block lists of neighbouring
stretches are pooled again, in rounds, until one list per head is left.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfstream.scale import cut, pieces, ranked_rows, running_totals

BLOCKS = "head string, _piece long, lo double, hi double, n double, positives double"
# Neighbouring lists pooled in one task of a round.
FAN = 16
# Knots that are broadcast (16 bytes each); longer curves are joined.
KNOTS = 200_000


def pooled(lo: np.ndarray, hi: np.ndarray, n: np.ndarray, positives: np.ndarray) -> tuple[list, list, list, list]:
    """Blocks of strictly rising rate from neighbours in ascending order."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    first, last, size, sums = out
    for a, b, m, s in zip(lo.tolist(), hi.tolist(), n.tolist(), positives.tolist(), strict=True):
        while size and sums[-1] * m >= s * size[-1]:
            a = first.pop()
            last.pop()
            m += size.pop()
            s += sums.pop()
        for column, value in zip(out, (a, b, m, s), strict=True):
            column.append(value)
    return out


def _pool(table: pa.Table) -> pa.Table:
    order = np.argsort(table.column("lo").to_numpy(), kind="stable")
    columns = [table.column(c).to_numpy()[order] for c in ("lo", "hi", "n", "positives")]
    blocks = pooled(*columns)
    count = len(blocks[0])
    return pa.table({
        "head": pa.array([table.column("head")[0].as_py()] * count, pa.string()),
        "_piece": pa.array([table.column("_piece")[0].as_py()] * count, pa.int64()),
        **{c: pa.array(v, pa.float64()) for c, v in zip(("lo", "hi", "n", "positives"), blocks, strict=True)},
    })


def fit_blocks(merged: DataFrame) -> DataFrame:
    """(head, lo, hi, n, positives, value) of every head, from rows (head, p, n, positives) with distinct p.

    All heads in one plan, nothing on the driver. Rates of blocks rise
    strictly and are ratios of counts that sum to the N rows, so a head has
    at most about N^(2/3) blocks, whatever the labels are; a task of the last
    round holds one such list and no rows.
    """
    stretches = pieces(
        merged.select("head", "p", F.col("n").cast("double").alias("n"), F.col("positives").cast("double").alias("positives")),
        ["head", "p"],
    )
    rows = stretches.select("head", "_piece", F.col("p").alias("lo"), F.col("p").alias("hi"), "n", "positives")
    blocks = cut(rows.groupBy("head", "_piece").applyInArrow(_pool, BLOCKS))
    most = blocks.agg(F.max("_piece")).first()[0]
    while most:
        most //= FAN
        # Numbers of stretches never fall along the range, so neighbours come together.
        joined = blocks.withColumn("_piece", F.floor(F.col("_piece") / FAN))
        blocks = cut(joined.groupBy("head", "_piece").applyInArrow(_pool, BLOCKS))
    return blocks.select("head", "lo", "hi", "n", "positives", (F.col("positives") / F.col("n")).alias("value"))


def knots(blocks: DataFrame) -> DataFrame:
    """(head, x, y): the ends of every block."""
    ends = F.when(F.col("lo") < F.col("hi"), F.array("lo", "hi")).otherwise(F.array("lo"))
    return blocks.select("head", F.explode(ends).alias("x"), F.col("value").alias("y"))


def interpolated(blocks: DataFrame, df: DataFrame, p: str, out: str, most: int = KNOTS) -> DataFrame:
    """``df`` with ``out``: the head's curve at ``p``, linear between blocks and flat outside.

    Null where ``p`` is null or the head has no curve. Curves are broadcast up
    to ``most`` knots in all; beyond that rows and knots are counted in one
    order and joined by position.
    """
    curve = cut(knots(blocks))
    if curve.count() <= most:
        return _looked_up(curve, df, p, out)
    return _joined(curve, df, p, out)


def _looked_up(curve: DataFrame, df: DataFrame, p: str, out: str) -> DataFrame:
    found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    table = curve.toPandas().sort_values(["head", "x"])
    for head, own in table.groupby("head"):
        found[head] = (own["x"].to_numpy(), own["y"].to_numpy())
    held = df.sparkSession.sparkContext.broadcast(found)
    schema = df.withColumn(out, F.lit(None).cast("double")).schema
    at_p, at_head, names = df.columns.index(p), df.columns.index("head"), schema.names

    def run(batches):
        curves = held.value
        for batch in batches:
            heads = np.array(batch.column(at_head).to_pylist(), object)
            value = batch.column(at_p).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            fitted = np.full(len(value), np.nan)
            for head in set(heads.tolist()) & curves.keys():
                own = heads == head
                fitted[own] = np.interp(value[own], *curves[head])
            column = pa.array(fitted, pa.float64(), mask=np.isnan(fitted))
            columns = [batch.column(i) for i in range(batch.num_columns)]
            if out in batch.schema.names:
                columns[batch.schema.get_field_index(out)] = column
            else:
                columns.append(column)
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, schema)


def _joined(curve: DataFrame, df: DataFrame, p: str, out: str) -> DataFrame:
    numbered = cut(ranked_rows(curve, ["head"], ["x"], "_at"))
    rows = cut(df.withColumn("_row", F.monotonically_increasing_id()))
    points = rows.filter(F.col(p).isNotNull()).select("head", F.col(p).cast("double").alias("x"), F.lit(0).cast("long").alias("_knot"), "_row")
    marks = numbered.select("head", "x", F.lit(1).cast("long").alias("_knot"), F.lit(None).cast("long").alias("_row"))
    # Knots sort before points of the same value: the sum is the number of the last knot at or below.
    counted = running_totals(
        points.unionByName(marks), ["head"], ["x", F.desc("_knot"), "_row"], {"_below": "_knot"}
    ).filter("_row is not null")
    left = numbered.select("head", F.col("_at").alias("_l"), F.col("x").alias("_x0"), F.col("y").alias("_y0"))
    right = numbered.select("head", F.col("_at").alias("_r"), F.col("x").alias("_x1"), F.col("y").alias("_y1"))
    near = (
        counted.withColumn("_l", F.greatest("_below", F.lit(1))).withColumn("_r", F.col("_below") + 1)
        .join(left, ["head", "_l"]).join(right, ["head", "_r"], "left")
    )
    share = (F.col("x") - F.col("_x0")) / (F.col("_x1") - F.col("_x0"))
    flat = (F.col("_below") == 0) | F.col("_x1").isNull()
    fitted = F.when(flat, F.col("_y0")).otherwise(F.col("_y0") + share * (F.col("_y1") - F.col("_y0")))
    return rows.drop(out).join(near.select("_row", fitted.alias(out)), "_row", "left").select(
        *[c for c in df.columns if c != out], out
    )


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
