"""Helpers the corpus operators share: batch access, a two-part dictionary, components."""

from __future__ import annotations

import sys
import types
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfstream.scale import cut

# Entries a task's local dictionary may hold before it is handed on or cleared (some 200 bytes each).
LOCAL_ENTRIES = 250_000


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def raw_texts(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


# Bytes of text that are described at a time, and the rows of a batch between Spark and a worker.
SLICE_BYTES, BATCH_ROWS = 1 << 20, 1_000


def slices(batch: pa.RecordBatch, place: int | str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in stretches of about ``size`` bytes of the string column ``place`` (one row at least).

    What is held per text besides the batch (bytes, words, features) is then
    bounded by the longest text, not by the rows of a batch.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False)
    number = np.cumsum(sizes, dtype=np.int64) // size
    ends = [*(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
    for begin, end in zip([0, *ends], ends):
        if end > begin:
            yield batch.slice(begin, end - begin)


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, with its session handing texts to workers BATCH_ROWS at a time at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(docs.sparkSession.conf.get(key))
    if not 0 < now <= BATCH_ROWS:
        docs.sparkSession.conf.set(key, str(BATCH_ROWS))
    return docs


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space (0x20, 0x09-0x0D)."""
    return text.lower().split()


def crc_of_id(doc_id) -> int:
    """crc32 of the id as decimal text, the hash behind every hold-out rule."""
    return zlib.crc32(str(doc_id).encode())


def held_out(column: str, modulus: int, remainder: int):
    """Boolean column: crc32(id as text) mod ``modulus`` is ``remainder``; false for null."""
    return F.coalesce(
        F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False)
    )


class Memo(dict):
    """A dict that fills itself by ``fn`` and starts anew when it gets too large."""

    def __init__(self, fn: Callable, limit: int = LOCAL_ENTRIES):
        super().__init__()
        self.fn, self.limit = fn, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.fn(key)
        return value


def per_worker(name: str, make: Callable):
    """An object that lives as long as the Python worker, which Spark reuses for many tasks.

    For caches of bounded size whose content never changes a result.
    """
    store = vars(sys.modules.setdefault("worker_objects", types.ModuleType("worker_objects")))
    if name not in store:
        store[name] = make()
    return store[name]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def token_counts(
    docs: DataFrame, split: Callable[[bytes], Iterable[bytes]], column: str = "text", least: int = 1
) -> DataFrame:
    """(token binary, n long): how often each token occurs, summed per task before the shuffle.

    ``least`` above 1 leaves out what a task sees more rarely, which is enough
    to find the frequent ones.
    """

    def emit(seen: Counter) -> Iterator[pa.RecordBatch]:
        if least > 1:
            seen = Counter({k: n for k, n in seen.items() if n >= least})
        keys, counts = list(seen), list(seen.values())
        for at in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[at : at + 100_000], pa.binary()),
                 pa.array(counts[at : at + 100_000], pa.int64())], ["token", "n"]
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in raw_texts(batch.column(0)):
                seen.update(split(text))
                if len(seen) > LOCAL_ENTRIES:
                    yield from emit(seen)
                    seen.clear()
        yield from emit(seen)

    tallies = docs.select(column).mapInArrow(count, "token binary, n long")
    return tallies.groupBy("token").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, limit: int) -> DataFrame:
    """The most frequent tokens, at most ``limit`` of them: all counts from some size up.

    The size comes from a histogram of the counts' logarithms (a few hundred
    rows at any scale), so nothing is sorted or gathered to find it.
    """
    size = F.floor(F.log2(F.col("n").cast("double")) * 8)
    bins = counts.groupBy(size.alias("size")).agg(F.count("*").alias("tokens")).collect()
    least, total = None, 0
    for row in sorted(bins, key=lambda r: -r["size"]):
        total += row["tokens"]
        if total > limit:
            break
        least = row["size"]
    return counts.where(size >= least) if least is not None else counts.where(F.lit(False))


def postings(counted: list[Counter]) -> pa.Array:
    """One list<struct<token, n>> per document, as an Arrow array."""
    offsets = np.zeros(len(counted) + 1, dtype=np.int32)
    np.cumsum([len(c) for c in counted], out=offsets[1:])
    tokens = pa.array([t for c in counted for t in c], pa.binary())
    numbers = pa.array([n for c in counted for n in c.values()], pa.int64())
    items = pa.StructArray.from_arrays([tokens, numbers], ["token", "n"])
    return pa.ListArray.from_arrays(pa.array(offsets), items)


CHUNK = 1 << 14


def merged(rows: DataFrame, length: int, kind, add: Callable) -> np.ndarray:
    """One array of ``length`` from (chunk int, part binary) rows, chunks combined by ``add``.

    Parts are zlib-compressed arrays of CHUNK values. Chunks are combined as
    they stream in, so a task holds each of its chunks once, however many
    tasks sent it; the driver gets the finished array, whose length is fixed.
    """

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(packed), kind)
                held[k] = add(held[k], part) if k in held else part
        for k, part in held.items():
            yield chunk_rows(k, part)

    out = np.zeros(length, kind)
    whole = rows.repartition("chunk").mapInArrow(combine, "chunk int, part binary")
    for row in whole.collect():
        part = np.frombuffer(zlib.decompress(row["part"]), kind)
        out[row["chunk"] * CHUNK : row["chunk"] * CHUNK + len(part)] = part
    return out


def chunk_rows(k: int, part: np.ndarray) -> pa.RecordBatch:
    packed = zlib.compress(np.ascontiguousarray(part).tobytes(), 1)
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed])], ["chunk", "part"])


def chunks_of(values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The non-zero chunks of an array as rows for :func:`merged`."""
    for k in range(-(-len(values) // CHUNK)):
        part = values[k * CHUNK : (k + 1) * CHUNK]
        if part.any():
            yield chunk_rows(k, part)


# Bits of the sieve (4 MB, broadcast).
SIEVE_BITS = 25


def sieve_places(ids: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.uint64)) >> np.uint64(64 - SIEVE_BITS)


def sifted(df: DataFrame, column: str, ids: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` (long ``column``) that may be in ``ids`` (long ``name``); none of these is lost.

    A bitmap of fixed size goes to the tasks, so a join that follows shuffles
    few rows besides those that match. It only saves work: once it is full,
    more rows pass.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << SIEVE_BITS, bool)
        for batch in batches:
            seen[sieve_places(batch.column(0).to_numpy())] = True
        yield from chunks_of(np.packbits(seen))

    bits = merged(
        ids.select(name).mapInArrow(mark, "chunk int, part binary"), 1 << (SIEVE_BITS - 3), np.uint8, np.bitwise_or
    )
    held, place = df.sparkSession.sparkContext.broadcast(bits), df.columns.index(column)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = sieve_places(batch.column(place).fill_null(0).to_numpy())
            hit = (held.value[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1
            yield batch.filter(pa.array(hit.astype(bool)))

    return df.mapInArrow(pick, df.schema)


POSTINGS = "array<struct<token:binary,n:long>>"


def components(edges: DataFrame) -> DataFrame:
    """(node, component): connected components of ``edges`` (a, b); component is the least node.

    Alternates large-star and small-star steps until the edge set is stable.
    Every round is a table in the shared folder, minima are pre-aggregated, so
    neither links nor components pass through the driver or one task.
    """
    edges = cut(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where("a < b").distinct()
    )
    while True:
        # Large star: hang every larger neighbour below the least node around.
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
        large = large.where("a < b").distinct()
        # Small star: hang a node and its smaller neighbours below the least of them.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        down = large.join(least, "b")
        small = down.select(F.col("m").alias("a"), F.col("a").alias("b")).union(
            down.select(F.col("m").alias("a"), "b")
        )
        edges = cut(small.where("a < b").distinct())
        # Done when every node hangs below one other, and that below none.
        ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(
            edges.select("a", F.lit(0), F.lit(1))
        )
        roles = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        if roles.where("below > 1 or (below = 1 and above = 1)").isEmpty():
            break
    top = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return top.union(top.select(F.col("component").alias("node"), "component").distinct())
