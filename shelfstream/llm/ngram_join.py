"""N-gram Jaccard join: prefix filtering over rare-first ordered shingles, verified once per pair.

The join runs over distinct shingle sets. Each set sends its prefix (its
rarest shingles) to the lists of those shingles. Pairs of a short list that
survive the length and positional filters are made distinct and put to the
suffix filter; a long list, where pairs would be too many, applies all filters
itself and hands on a spanning forest of its candidates. Sets that may be
linked, directly or through others, so end in one cluster. A cluster receives
each of its sets once and verifies a pair at most once, skipping pairs that
links found before already connect. Long lists and large clusters are split
into pairs of blocks, so no task holds more than two blocks.

Where links are asked for (``link_counts``), a cluster skips no pair: each
pair of different sets is verified once and counts for both. What leaves a
task are counts per set and a spanning forest of the links, so the output stays
linear although the pairs of a large group do not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfstream.llm.common import Memo, chunks_of, components, merged, mix, raw_texts, sifted, words
from shelfstream.scale import cut

SHINGLE = 3
PERCENT = 90
# Members of a list or cluster that one task compares with as many others, and
# shingles of the members of a cluster's block.
BLOCK, BLOCK_SHINGLES = 1_024, 1_000_000
# Counters of the frequency sketch that orders shingles (4 MB, broadcast).
SKETCH_BITS = 20
# Lists up to this long emit pairs; longer ones are searched in blocks.
SHORT_LIST = 32
# The suffix filter counts shingles in hash classes, about one class for this many.
PER_CLASS = 24


def hashed_words() -> Memo:
    return Memo(xxhash.xxh64_intdigest)


def shingle_set(text: bytes, memo: Memo, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; a shorter text is one shingle."""
    found = words(text)
    h = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
    if not len(h):
        return h
    size = min(size, len(h))
    total = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k]
    return np.unique(mix(total + np.uint64(size)))


def needed(total: int, percent: int) -> int:
    """The least overlap of two sets whose sizes add up to ``total``: 100 i >= percent (total - i)."""
    return -(-percent * total // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """A set of ``n`` shares one of this many first shingles with every set it links to."""
    return n - -(-percent * n // 100) + 1 if n else 0


def frequency_sketch(docs: DataFrame, size: int = SHINGLE) -> np.ndarray:
    """Shingle counts by hash, 2^SKETCH_BITS of them: large exactly where frequent shingles are.

    Any common order keeps the join whole; this one puts rare shingles first.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, counts = hashed_words(), np.zeros(1 << SKETCH_BITS, np.int64)
        shift = np.uint64(64 - SKETCH_BITS)
        for batch in batches:
            for text in raw_texts(batch.column(0)):
                np.add.at(counts, shingle_set(text, memo, size) >> shift, 1)
        yield from chunks_of(counts)

    rows = docs.select("text").mapInArrow(tally, "chunk int, part binary")
    return merged(rows, 1 << SKETCH_BITS, np.int64, np.add).astype(np.float32)


def class_counts(shingles: np.ndarray) -> np.ndarray:
    """Shingles per class of their low hash bits; the number of classes is a power of two."""
    bits = max(0, (len(shingles) // PER_CLASS).bit_length() - 1)
    low = (shingles & np.uint64((1 << bits) - 1)).astype(np.int64)
    return np.bincount(low, minlength=1 << bits).astype(np.uint16 if len(shingles) < 65_536 else np.int32)


def unpacked(classes: bytes, size: int) -> np.ndarray:
    return np.frombuffer(classes, np.uint16 if size < 65_536 else np.int32).astype(np.int32)


def most_shared(x: np.ndarray, y: np.ndarray) -> int:
    """An upper bound of two sets' overlap: what each class allows. More classes fold onto fewer."""
    while len(x) > len(y):
        x = x[: len(x) // 2] + x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] + y[len(y) // 2 :]
    return int(np.minimum(x, y).sum())


def describe(docs: DataFrame, percent: int, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, key (of the set), prefix (packed), classes (packed) per document."""
    sketch = docs.sparkSession.sparkContext.broadcast(frequency_sketch(docs, size))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, shift = hashed_words(), np.uint64(64 - SKETCH_BITS)
        for batch in batches:
            sizes, keys, prefixes, classes = [], [], [], []
            for text in raw_texts(batch.column("text")):
                s = shingle_set(text, memo, size)
                rarest = np.lexsort((s, sketch.value[s >> shift]))[: prefix_length(len(s), percent)]
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                prefixes.append(s[rarest].tobytes())
                classes.append(class_counts(s).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(prefixes, pa.binary()), pa.array(classes, pa.binary())],
                ["doc_id", "n_shingles", "key", "prefix", "classes"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        pack, "doc_id long, n_shingles long, key binary, prefix binary, classes binary"
    )


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return int(x)

    def roots(self) -> np.ndarray:
        """The root of every position, after flattening."""
        while True:
            higher = self.up[self.up]
            if np.array_equal(higher, self.up):
                return self.up
            self.up = higher

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def spread(sized: DataFrame, member: str) -> DataFrame:
    """``sized`` (with ``_n``, the number of blocks of a row's group) dealt to (low, high, side): block pairs.

    A group of one block is one part. A larger one is cut into blocks by hash,
    and a row goes to every pair that its block is in.
    """
    blocks = F.col("_n").cast("int")
    own = F.pmod(F.xxhash64(member), blocks).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda k: F.struct(F.least(k, own).alias("low"), F.greatest(k, own).alias("high"), own.alias("side")),
    )
    columns = [c for c in sized.columns if c != "_n"]
    return sized.select(*columns, F.explode(pairs).alias("_p")).select(
        *columns, "_p.low", "_p.high", "_p.side"
    )


def in_reach(size_x, size_y, place_x, place_y, percent: int):
    """Length and positional filter of pairs that share a shingle at the given places."""
    least = needed(size_x + size_y, percent)
    # Shared shingles lie before both places or behind both.
    most = np.minimum(place_x, place_y) + np.minimum(size_x - place_x, size_y - place_y)
    close = 100 * np.minimum(size_x, size_y) >= percent * np.maximum(size_x, size_y)
    return close & (most >= least)


def candidates(node, size, place, side, classes, apart: bool, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of one long list (or block pair) that pass the filters."""
    order = np.lexsort((node, size))
    node, size, place, side = node[order], size[order], place[order], side[order]
    counts = [unpacked(classes[k], int(size[i])) for i, k in enumerate(order)]
    forest, out = Forest(len(node)), []
    for i in range(len(node) - 1):
        others = np.arange(i + 1, int(np.searchsorted(size, 100 * size[i] // percent, side="right")))
        roots = forest.roots()
        others = others[roots[others] != roots[i]]
        if apart:
            others = others[side[others] != side[i]]
        others = others[in_reach(size[i], size[others], place[i], place[others], percent)]
        for j in others:
            if most_shared(counts[i], counts[j]) >= needed(int(size[i] + size[j]), percent) and forest.join(i, int(j)):
                out.append((int(node[i]), int(node[j])))
    return out


def verify(ids: np.ndarray, sets: list[np.ndarray], apart: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the linked pairs among ``sets``; a pair is compared at most once."""
    order = sorted(range(len(ids)), key=lambda k: (len(sets[k]), ids[k]))
    ids, sets = ids[order], [sets[k] for k in order]
    apart = apart[order] if apart is not None else None
    size = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    del sets
    begin = np.cumsum(size) - size
    mark = np.zeros(int(codes.max()) + 1, np.uint8)
    forest, out = Forest(len(ids)), []
    for i in range(len(ids) - 1):
        last = int(np.searchsorted(size, 100 * size[i] // percent, side="right"))
        others = np.arange(i + 1, last)
        roots = forest.roots()
        others = others[roots[others] != roots[i]]
        if apart is not None:
            others = others[apart[others] != apart[i]]
        if not len(others):
            continue
        own = codes[begin[i] : begin[i] + size[i]]
        mark[own] = 1
        shared = np.array([np.count_nonzero(mark[codes[begin[j] : begin[j] + size[j]]]) for j in others])
        mark[own] = 0
        union = size[i] + size[others] - shared
        for j in others[100 * shared >= percent * union]:
            if forest.join(i, int(j)):
                out.append((int(ids[i]), int(ids[j])))
    return out


def tally_links(
    ids: np.ndarray, sets: list[np.ndarray], weight: np.ndarray, apart: np.ndarray | None, percent: int
) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """(spanning forest of the links, ids, links per id): every pair of ``sets`` is verified once.

    With ``apart`` only pairs of its two sides count. A link counts as often
    as the other set's ``weight``.
    """
    size = np.array([len(s) for s in sets])
    order = np.lexsort((ids, size))
    ids, size, weight = ids[order], size[order], weight[order]
    codes = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)[1].astype(np.int32)
    begin = np.cumsum(size) - size
    if apart is None:
        left = right = np.arange(len(ids))
        held, at = codes, begin
    else:
        side = apart[order]
        left, right = np.flatnonzero(side == side[0]), np.flatnonzero(side != side[0])
        held = codes[np.repeat(side != side[0], size)]
        at = np.cumsum(size[right]) - size[right]
    ends = np.r_[at, len(held)]
    mark = np.zeros(int(codes.max()) + 1, np.uint8)
    forest, out, links = Forest(len(ids)), [], np.zeros(len(ids), np.int64)
    for i in left:
        last = int(np.searchsorted(size[right], 100 * size[i] // percent, side="right"))
        first = i + 1 if apart is None else int(np.searchsorted(size[right], -(-percent * size[i] // 100)))
        if first >= last:
            continue
        own = codes[begin[i] : begin[i] + size[i]]
        mark[own] = 1
        span = mark[held[ends[first] : ends[last]]]
        shared = np.add.reduceat(span, ends[first:last] - ends[first], dtype=np.int64)
        mark[own] = 0
        others = right[first:last]
        others = others[100 * shared >= percent * (size[i] + size[others] - shared)]
        links[i] += weight[others].sum()
        links[others] += weight[i]
        roots = forest.roots()
        for j in others[roots[others] != roots[i]]:
            if forest.join(int(i), int(j)):
                out.append((int(ids[i]), int(ids[j])))
    return out, ids, links


def edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())],
        ["a", "b"],
    )


def candidate_edges(sets: DataFrame, percent: int, block: int) -> DataFrame:
    """(a, b) of candidates between representatives, a spanning forest per list."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = batch.column("prefix").to_pylist()
            counts = np.array([len(p) // 8 for p in prefixes], np.int64)
            rows = np.repeat(np.arange(len(prefixes)), counts)
            places = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
            grams = np.frombuffer(b"".join(prefixes), np.int64)
            for at in range(0, len(rows), 100_000):
                part = pa.array(rows[at : at + 100_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[at : at + 100_000]), batch.column("node").take(part),
                     batch.column("size").take(part), pa.array(places[at : at + 100_000], pa.int64())],
                    ["gram", "node", "size", "place"],
                )

    lists = sets.select("node", "size", "prefix").mapInArrow(
        unpack, "gram long, node long, size long, place long"
    ).withColumns({c: F.col(c).cast("int") for c in ("size", "place")})
    # Most shingles have one owner: only those with more go on, by counts that
    # are pre-aggregated in each task.
    owners = lists.groupBy("gram").agg(F.count("*").alias("_c")).where("_c > 1")
    lists = cut(lists.join(owners, "gram"))

    def pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = ("gram", "node", "size", "place"), None
        for batch in batches:
            new = {c: batch.column(c).to_numpy().astype(np.int64) for c in names}
            old = np.zeros(len(new["gram"]), bool)
            if held is not None:
                old = np.r_[np.ones(len(held["gram"]), bool), old]
                new = {c: np.concatenate([held[c], new[c]]) for c in names}
            for d in range(1, SHORT_LIST):
                if d >= len(old):
                    break
                first, second = slice(None, -d), slice(d, None)
                # Pairs within what an earlier batch left are done already.
                same = (new["gram"][first] == new["gram"][second]) & ~old[second]
                if not same.any():
                    continue
                at = np.flatnonzero(same)
                x, y = ({c: new[c][k] for c in names} for k in (at, at + d))
                ok = in_reach(x["size"], y["size"], x["place"], y["place"], percent)
                a, b = x["node"][ok], y["node"][ok]
                if len(a):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"]
                    )
            held = {c: v[-SHORT_LIST:] for c, v in new.items()}

    short = lists.where(F.col("_c") <= SHORT_LIST).select("gram", "node", "size", "place")
    pairs = (
        short.repartition("gram").sortWithinPartitions("gram").mapInArrow(pair_up, "a long, b long").distinct()
    )
    one = sets.select(F.col("node").alias("a"), F.col("size").alias("x"), F.col("classes").alias("cx"))
    two = sets.select(F.col("node").alias("b"), F.col("size").alias("y"), F.col("classes").alias("cy"))

    def suffix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, cx, cy = (batch.column(c).to_pylist() for c in ("x", "y", "cx", "cy"))
            keep = [
                most_shared(unpacked(p, m), unpacked(q, n)) >= needed(m + n, percent)
                for m, n, p, q in zip(x, y, cx, cy, strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    near = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y", "cx", "cy").mapInArrow(
        suffix, "a long, b long"
    )

    def search(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_numpy() for c in ("node", "size", "place", "side")]
        apart = table.column("low")[0].as_py() != table.column("high")[0].as_py()
        found = candidates(*columns, table.column("classes").to_pylist(), apart, percent)
        return pa.Table.from_batches([edge_batch(found)])

    long = lists.where(F.col("_c") > SHORT_LIST).withColumn("_n", F.ceil(F.col("_c") / block)).drop("_c")
    far = (
        spread(long.join(sets.select("node", "classes"), "node"), "node")
        .groupBy("gram", "low", "high").applyInArrow(search, "a long, b long")
    )
    return near.union(far)


def clustered(docs: DataFrame, percent: int, block: int, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents described, distinct sets, texts dealt to block pairs of the candidates' clusters)."""
    info = cut(describe(docs, percent, size))
    sets = (
        info.where("n_shingles > 0 and doc_id is not null").groupBy("key")
        .agg(F.min("doc_id").alias("node"), F.any_value(F.struct("n_shingles", "prefix", "classes")).alias("s"))
        .select("key", "node", F.col("s.n_shingles").alias("size"), "s.prefix", "s.classes")
    )
    sets = cut(sets)
    clusters = components(candidate_edges(sets, percent, block))

    # Each candidate's text goes to its cluster once (or to the block pairs of a large one).
    share = F.greatest(F.count("*") / block, F.sum("size") / BLOCK_SHINGLES)
    sizes = (
        clusters.join(sets.select("node", "size"), "node").groupBy("component").agg(F.ceil(share).alias("_n"))
    )
    dealt = cut(spread(clusters.join(sizes, "component"), "node"))
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    parts = sifted(texts, "node", dealt, "node").join(dealt, "node")
    return info, sets, parts


def link_components(
    docs: DataFrame, percent: int = PERCENT, block: int = BLOCK, size: int = SHINGLE
) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Documents link when 100 * shared >= percent * union of their distinct
    ``size``-word shingles (A-Z lower-cased, ASCII white space). The component is
    the least doc_id reachable. Null, empty and blank texts have no shingles
    and link with nothing; a row without doc_id is described but takes part in
    no link and has a null component. Repeated rows get equal values. An empty
    table gives no rows; other columns are ignored.
    """
    info, sets, parts = clustered(docs, percent, block, size)

    def check(table: pa.Table) -> pa.Table:
        ids, first = np.unique(table.column("node").to_numpy(), return_index=True)
        table, memo = table.take(first), hashed_words()
        found = [shingle_set(t, memo, size) for t in raw_texts(table.column("text"))]
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        apart = table.column("side").to_numpy() if low != high else None
        return pa.Table.from_batches([edge_batch(verify(ids, found, apart, percent))])

    links = parts.groupBy("component", "low", "high").applyInArrow(check, "a long, b long")
    linked = components(links)
    members = sets.select("key", "node").join(linked, "node", "left").select(
        "key", F.coalesce("component", "node").alias("least")
    )
    mine = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return info.join(members, "key", "left").select("doc_id", "n_shingles", mine.alias("component_id"))


def link_counts(
    docs: DataFrame, percent: int = PERCENT, block: int = BLOCK, size: int = SHINGLE
) -> DataFrame:
    """doc_id, n_shingles, component_id as :func:`link_components`, and n_links of every document.

    ``n_links`` is the number of other documents that one links with. Exact
    copies of a shingle set are counted, not compared; all pairs of different
    sets that may link are verified, and the components follow from these links.
    """
    info, sets, parts = clustered(docs, percent, block, size)
    owners = info.where("n_shingles > 0 and doc_id is not null").select("key", "doc_id").distinct()
    sets = cut(sets.select("key", "node").join(owners.groupBy("key").agg(F.count("*").alias("weight")), "key"))

    def check(table: pa.Table) -> pa.Table:
        ids, first = np.unique(table.column("node").to_numpy(), return_index=True)
        table, memo = table.take(first), hashed_words()
        found = [shingle_set(t, memo, size) for t in raw_texts(table.column("text"))]
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        apart = table.column("side").to_numpy() if low != high else None
        edges, ids, links = tally_links(ids, found, table.column("weight").to_numpy(), apart, percent)
        ids, links = ids[links > 0], links[links > 0]
        return pa.table({
            "a": pa.array([*(a for a, _ in edges), *ids.tolist()], pa.int64()),
            "b": pa.array([*(b for _, b in edges), *[None] * len(ids)], pa.int64()),
            "n": pa.array([*[0] * len(edges), *links.tolist()], pa.int64()),
        })

    found = cut(
        parts.join(sets.select("node", "weight"), "node")
        .groupBy("component", "low", "high").applyInArrow(check, "a long, b long, n long")
    )
    linked = components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    members = sets.join(linked, "node", "left").join(counts, "node", "left").select(
        "key", F.coalesce("component", "node").alias("least"),
        (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
    )
    mine = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    links = F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0)
    return info.join(members, "key", "left").select(
        "doc_id", "n_shingles", mine.alias("component_id"), links.alias("n_links")
    )


def keep_one(
    docs: DataFrame, percent: int = PERCENT, block: int = BLOCK, size: int = SHINGLE
) -> DataFrame:
    """The rows of ``docs`` with one document of each component, that with the least doc_id.

    Rows without doc_id all stay; of repeated rows (doc_id and text) one stays.
    Where a doc_id has different texts, each of them is a document of its own.
    """
    names = [f"`{c}`" for c in docs.columns]
    twice = cut(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"))
    if not twice.isEmpty():
        prints = docs.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(
            (F.min(F.xxhash64("text")) < F.max(F.xxhash64("text"))).alias("differ")
        )
        if not prints.where("differ").isEmpty():
            # Texts are numbered in the order of doc_id, and the numbers take its place.
            rows = docs.select("doc_id", "text", F.xxhash64("text").alias("print"), F.struct(*names).alias("whole"))
            numbers = rows.where("doc_id is not null").select("doc_id", "print").distinct()
            numbers = cut(
                numbers.orderBy("doc_id", "print").withColumn("number", F.monotonically_increasing_id())
            )
            rows = rows.join(numbers, ["doc_id", "print"], "left").select(
                F.col("number").alias("doc_id"), "text", "whole"
            )
            return keep_one(rows, percent, block, size).select("whole.*")
    gone = link_components(docs, percent, block, size).where("doc_id <> component_id").select("doc_id").distinct()
    rest = docs.join(cut(gone), "doc_id", "left_anti").select(*names)
    if twice.isEmpty():
        return rest
    once = rest.join(twice, "doc_id", "left_anti").select(*names)
    more = rest.join(twice, "doc_id", "left_semi").select(*names)
    return once.unionByName(more.dropDuplicates(["doc_id"]))
