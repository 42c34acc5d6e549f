"""Placement on shards by a permutation-filled lookup table (native DataFrame functions only)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 32
# A prime well above 100 x SHARDS, so that shares differ by about one per cent at most.
SLOTS = 4093


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: int = SHARDS, slots: int = SLOTS) -> list[int]:
    """The shard of every slot. Parameters alone decide it; no data is looked at.

    Shard i prefers slots (offset + j * skip) mod ``slots``, which visits all
    of them as ``slots`` is prime. Shards take turns, each claiming its next
    free slot, until none is left. When a shard is added, few slots move.
    """
    if shards < 1 or slots < shards or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime and at least the number of shards")
    offsets = [_number(f"offset:{i}") % slots for i in range(shards)]
    skips = [_number(f"skip:{i}") % (slots - 1) + 1 for i in range(shards)]
    owner, following, left = [-1] * slots, [0] * shards, slots
    while True:
        for i in range(shards):
            while True:
                slot = (offsets[i] + following[i] * skips[i]) % slots
                following[i] += 1
                if owner[slot] < 0:
                    break
            owner[slot] = i
            left -= 1
            if left == 0:
                return owner


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key: its md5 (first 60 bits) mod ``slots``; null hashes like ''."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots


def table(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(slot, shard): ``slots`` rows, whatever the data."""
    text = ",".join(map(str, fill(shards, slots)))
    return spark.range(1).select(
        F.posexplode(F.split(F.lit(text), ",")).alias("slot", "shard")
    ).select(F.col("slot").cast("long").alias("slot"), F.col("shard").cast("int").alias("shard"))


def place(df: DataFrame, key: str = "doc_id", shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard``, by one lookup in the broadcast table per row.

    Equal keys share a shard, so repeated rows stay together; null keys go
    where '' goes. Columns of ``df`` named slot or shard are replaced. The
    broadcast holds ``slots`` rows of 12 bytes, a parameter and not the data.
    """
    df = df.drop("slot", "shard")
    columns = df.columns
    spot = df.withColumn("slot", slot_of(F.col(f"`{key}`"), slots))
    placed = spot.join(F.broadcast(table(df.sparkSession, shards, slots)), "slot", "left")
    return placed.select(*[f"`{c}`" for c in columns], "slot", "shard")


def deal(df: DataFrame, key: str = "doc_id", shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """:func:`place`, with the rows of a shard side by side, ready to be written as its files.

    ``REBALANCE`` lets Spark split a shard that is too large for one task.
    """
    return place(df, key, shards, slots).hint("rebalance", "shard")
