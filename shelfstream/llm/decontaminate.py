"""Benchmark decontamination: Wu-Manber search of all benchmark windows over whole documents."""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfstream.llm.common import per_worker, raw_texts, slices
from shelfstream.scale import cut

WINDOW = 13
# Benchmark items searched in one pass over the documents; more items take more
# passes. With item texts of some KB this bounds what a pass broadcasts.
ITEMS_PER_PASS = 20_000
# ... and so does this on their text (UTF-8); an item above it is a pass of its own. A
# worker's searchers take some 14 bytes for each while they are built (0.9 GB).
BYTES_PER_PASS = 64 << 20

# Every byte outside 0-9, a-z (after lower-casing) and non-ASCII separates words.
SEPARATORS = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def search_words(text: bytes) -> list[bytes]:
    return text.lower().translate(SEPARATORS).split()


class WuManber:
    """Windows of one length, searched by blocks of two words (one for one-word windows).

    ``shift`` says for the slot of the block that ends at a position how far
    the window may move before any pattern can end there; a slot no pattern
    fills lets it move a whole window. At shift 0 the window is looked up in
    the bucket of that slot, and the text of what is found there is compared.
    Hashes choose slots and buckets only: two that collide cost time, never a
    result. All parts are flat arrays, about 14 bytes for a byte of text at the
    peak of building. Python's hash differs between processes, so an object
    must be searched where it was built.
    """

    def __init__(self, length: int, windows: int):
        self.length, self.block = length, min(2, length)
        self.most = min(255, length - self.block + 1)
        self.bits = max(8, (2 * windows).bit_length())
        self.mask, self.low = (1 << self.bits) - 1, (1 << (64 - self.bits)) - 1
        self.shift = bytearray([self.most]) * (1 << self.bits)
        self.parts: list[tuple] = []
        self.end = 0

    def add(self, item_id: int, words: list[bytes]) -> None:
        """The windows of one item, which has ``length`` words or more."""
        length, block, shift, mask = self.length, self.block, self.shift, self.mask
        slots = [hash(tuple(words[i : i + block])) & mask for i in range(len(words) - block + 1)]
        for i, slot in enumerate(slots):
            shift[slot] = min(shift[slot], max(0, length - block - i))
        n = len(words) - length + 1
        keys = np.fromiter(
            (self.key(slots[i + length - block], words[i : i + length]) for i in range(n)), np.uint64, n
        )
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(sizes + 1) - sizes - 1
        size = first[length - 1 :] + sizes[length - 1 :] - first[:n]
        text = b" ".join(words)
        self.parts.append((keys, first[:n] + self.end, size.astype(np.int32), np.full(n, item_id, np.int64), text))
        self.end += len(text)

    def key(self, slot: int, window: list[bytes]) -> int:
        return (slot << (64 - self.bits)) | (hash(tuple(window)) & self.low)

    def close(self) -> WuManber:
        """Sort the windows by bucket; equal ones become one with the list of their items."""
        self.text = b"".join(p[4] for p in self.parts)
        keys = np.concatenate([p[0] for p in self.parts])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        self.at, self.size, self.items = (np.concatenate([p[k] for p in self.parts])[order] for k in (1, 2, 3))
        self.parts = []
        new = np.r_[True, keys[1:] != keys[:-1]]
        starts = np.flatnonzero(new)
        ends = np.r_[starts[1:], len(keys)]
        for a, b in zip(*(x[ends - starts > 1].tolist() for x in (starts, ends)), strict=True):
            head = self.window(a)
            if any(self.window(k) != head for k in range(a + 1, b)):  # different windows under one key
                run = np.array(sorted(range(a, b), key=self.window))
                for column in (self.at, self.size, self.items):
                    column[a:b] = column[run]
                new[a + 1 : b] = [self.window(k) != self.window(k - 1) for k in range(a + 1, b)]
        self.first = np.append(np.flatnonzero(new), len(keys))
        self.keys = keys[self.first[:-1]]
        return self

    def window(self, k: int) -> bytes:
        return self.text[self.at[k] : self.at[k] + self.size[k]]

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(end position, items) of every occurrence."""
        shift, mask, length, block = self.shift, self.mask, self.length, self.block
        end, total, ends, keys = length, len(words), [], []
        while end <= total:
            slot = hash(tuple(words[end - block : end])) & mask
            step = shift[slot]
            if step:
                end += step
                continue
            ends.append(end)
            keys.append(self.key(slot, words[end - length : end]))
            end += 1
        if not ends:
            return
        keys = np.array(keys, np.uint64)
        place = np.searchsorted(self.keys, keys)
        for i in np.flatnonzero(self.keys[np.minimum(place, len(self.keys) - 1)] == keys):
            end, k = ends[i], place[i]
            text = b" ".join(words[end - length : end])
            while k < len(self.keys) and self.keys[k] == keys[i]:
                if self.window(self.first[k]) == text:
                    yield end, self.items[self.first[k] : self.first[k + 1]].tolist()
                k += 1


def compile_items(items: Sequence[tuple], window: int) -> list[WuManber]:
    """One searcher per window length: ``window``, and those of shorter items."""
    windows: Counter = Counter()
    for _, text in items:
        total = len(search_words((text or "").encode()))
        if total:
            windows[min(window, total)] += max(1, total - window + 1)
    made = {length: WuManber(length, n) for length, n in sorted(windows.items())}
    for item_id, text in items:
        found = search_words((text or "").encode())
        if found:
            made[min(window, len(found))].add(item_id, found)
    return [searcher.close() for searcher in made.values()]


def compiled(name: str, items: Sequence[tuple], window: int) -> list[WuManber]:
    """The searchers of a block, built once per Python worker; a worker keeps those of one block."""
    held = per_worker("decontaminate", dict)
    if name not in held:
        held.clear()
        held[name] = compile_items(items, window)
    return held[name]


def scan(searchers: list[WuManber], text: bytes) -> tuple[int, list[tuple[int, int]], set]:
    """(number of words, disjoint hit ranges, items) of one text."""
    words = search_words(text)
    ranges, items = [], set()
    for searcher in searchers:
        for end, found in searcher.find(words):
            items.update(found)
            ranges.append((end - searcher.length, end))
    return len(words), merge(ranges), items


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def benchmark_blocks(benchmark: DataFrame, per_pass: int, size: int) -> Iterator[list[tuple]]:
    """The benchmark in blocks that fit one broadcast each; null ids and texts find nothing."""
    usable = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    block, held = [], 0
    for row in usable.toLocalIterator():
        own = len(row["text"].encode())
        if block and (len(block) >= per_pass or held + own > size):
            yield block
            block, held = [], 0
        block.append((row["item_id"], row["text"]))
        held += own
    yield block


def report(n_words: int, hits: list[tuple[int, int]], items: set) -> tuple:
    """(n_words, n_hit, n_items, items_sha256, contaminated)"""
    n_hit = sum(end - start for start, end in hits)
    names = ",".join(sorted(map(str, items)))
    return (n_words, n_hit, len(items), hashlib.sha256(names.encode()).hexdigest(),
            n_hit > 0 and 20 * n_hit >= n_words)


HITS = "hits array<struct<first:long,last:long>>, items array<long>"
HIT_TYPE = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def find_overlap(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    items_per_pass: int = ITEMS_PER_PASS,
    bytes_per_pass: int = BYTES_PER_PASS,
) -> DataFrame:
    """row, doc_id, n_words, hits (disjoint word ranges, end exclusive) and items of every document.

    A window is ``window`` consecutive words of an item, or a shorter item
    whole; items without words match nothing. Null and empty texts have no
    words. Repeated rows are reported each; an empty benchmark finds nothing;
    other columns are ignored. Documents are read once per block of the
    benchmark and never shuffled for one block; the ranges of several blocks
    are joined by row.
    """
    source = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text"
    )

    def searched(block: list[tuple]) -> DataFrame:
        held, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searchers = compiled(name, held.value, window)
            for batch in batches:
                found = [scan(searchers, t) for t in raw_texts(batch.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("doc_id"),
                     pa.array([n for n, _, _ in found], pa.int64()),
                     pa.array([[{"first": a, "last": b} for a, b in h] for _, h, _ in found], HIT_TYPE),
                     pa.array([sorted(i) for _, _, i in found], pa.list_(pa.int64()))],
                    ["row", "doc_id", "n_words", "hits", "items"],
                )

        return source.mapInArrow(search, f"row long, doc_id long, n_words long, {HITS}")

    blocks = benchmark_blocks(benchmark, items_per_pass, bytes_per_pass)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        return searched(block)
    source = cut(source)  # several passes must agree on the row numbers
    joined = cut(searched(block))
    while following is not None:
        more = cut(searched(following)).select(
            "row", F.col("hits").alias("_h"), F.col("items").alias("_i")
        )
        joined = cut(
            joined.join(more, "row").select(
                "row", "doc_id", "n_words", F.concat("hits", "_h").alias("hits"),
                F.array_union("items", "_i").alias("items"),
            )
        )
        following = next(blocks, None)
    return joined


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from :func:`find_overlap`."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        for batch in batches:
            rows = [
                report(n, merge([(h["first"], h["last"]) for h in hits]), set(items))
                for n, hits, items in zip(
                    batch.column("n_words").to_pylist(), batch.column("hits").to_pylist(),
                    batch.column("items").to_pylist(), strict=True)
            ]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    return found.select("doc_id", "n_words", "hits", "items").mapInArrow(
        finish,
        "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean",
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, items_per_pass: int = ITEMS_PER_PASS
) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns.

    A row is judged by its text alone, so it is filtered where it lies: no
    shuffle, no join on an id that may be null or repeated. Only where the
    benchmark takes several passes are rows joined, by the digest of their
    text. Null and empty texts stay, as do all rows where the benchmark is
    empty; repeated rows are judged each; an empty table stays empty.
    """
    blocks = benchmark_blocks(benchmark, items_per_pass, BYTES_PER_PASS)
    block = next(blocks)
    if next(blocks, None) is not None:
        # The share of hit words needs all blocks together; equal ids of unequal
        # texts are told apart by the text's digest.
        name = "_key"
        while name in docs.columns:
            name += "_"
        key = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
        keyed = docs.select(F.monotonically_increasing_id().alias("doc_id"), "text", key.alias(name))
        keyed = cut(keyed)
        judged = digest(find_overlap(keyed, benchmark, window, items_per_pass)).where("contaminated")
        bad = keyed.join(judged.select("doc_id"), "doc_id", "left_semi").select(name).distinct()
        return docs.withColumn(name, key).join(bad, name, "left_anti").select(
            *[f"`{c}`" for c in docs.columns]
        )
    held, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers = compiled(name, held.value, window)
        for batch in (part for whole in batches for part in slices(whole, place)):
            clean = [not report(*scan(searchers, t))[4] for t in raw_texts(batch.column(place))]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
