"""Language-model scores from a log-frequency Bloom filter over words and word pairs.

Counts of all training n-grams are quantised logarithmically; an n-gram of
level q is put into the filter q times, as (n-gram, 1) ... (n-gram, q). A
scorer asks for (n-gram, 1), (n-gram, 2), ... until the filter says no. The
filter grows with the number of n-grams and is broadcast in segments of a
bounded size, one pass over the documents each.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfstream.llm.common import (
    POSTINGS, Memo, crc_of_id, frequent, held_out, mix, postings, raw_texts, token_counts, words,
)
from shelfstream.scale import cut

MODULUS, REMAINDER = 7, 2
# Ratio of the count levels.
RATIO = 1.6
# Filter bits for each (n-gram, level); every entry sets PROBES bits of one 64-bit word.
BITS_PER_ENTRY, PROBES = 10, 4
# What one broadcast of the filter may take.
SEGMENT_BYTES = 128 << 20
# Tokens for which a reducer counts n-grams and builds its block of the filter.
BUCKET_TOKENS = 1 << 20
# N-grams a task holds before it hands them on, and bytes of text scored together.
HELD_GRAMS, STRETCH_BYTES = 2_000_000, 1 << 20
# Words whose exact counts are broadcast for the base score; the others are joined by a shuffle.
FREQUENT = 250_000
# Interpolation weights of the word-pair model; a document is scored by their even mixture.
WEIGHTS = (0.02, 0.1, 0.3, 0.6, 0.9)
# The border of a text: its end, and what stands before its first word.
BORDER = xxhash.xxh64_intdigest(b"", seed=1)
MOST_LEVELS = 120


def level(count: np.ndarray) -> np.ndarray:
    """1 for a count of 1, one more for each power of RATIO passed."""
    return 1 + np.floor(np.log(count) / math.log(RATIO) + 1e-9).astype(np.int64)


def bounds() -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest count of each level; 0 for level 0."""
    edges = np.ceil(RATIO ** np.arange(MOST_LEVELS + 1, dtype=np.float64) - 1e-9)
    low, high = edges[:-1], np.maximum(edges[:-1], edges[1:] - 1)
    return np.append(0.0, low), np.append(0.0, high)


def hashes(text: bytes, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens (words, then the border) and of the pairs (token before, token)."""
    found = words(text)
    one = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
    one = np.append(one, np.uint64(BORDER))
    before = np.concatenate([one[-1:], one[:-1]])
    return mix(one), mix(before * np.uint64(0x9E3779B97F4A7C15) + one * np.uint64(0xC2B2AE3D27D4EB4F))


def bits_of(gram: np.ndarray, k: int, offset: np.ndarray, size: np.ndarray):
    """(word, mask) of (n-gram, level k) in blocks at ``offset`` with ``size`` words."""
    h = mix(gram + np.uint64((k * 0xD6E8FEB86659FD93) & (2**64 - 1)))
    word = offset + (((h >> np.uint64(32)) * size) >> np.uint64(32)).astype(np.int64)
    mask = np.zeros(len(h), np.uint64)
    for p in range(PROBES):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * p)) & np.uint64(63))
    return word, mask


@dataclass
class Segment:
    """Blocks first ... first + len(size) - 1 of the filter, of 2^bits blocks in all."""

    bits: int
    first: int
    size: np.ndarray
    data: np.ndarray

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """Level of each n-gram by repeated probes; 0 where absent or in another segment."""
        out = np.zeros(len(grams), np.uint8)
        block = (grams >> np.uint64(64 - self.bits)).astype(np.int64) - self.first
        live = np.flatnonzero((block >= 0) & (block < len(self.size)))
        offset = np.cumsum(self.size) - self.size
        live = live[self.size[block[live]] > 0]
        for k in range(1, MOST_LEVELS):
            if not len(live):
                break
            own = block[live]
            word, mask = bits_of(grams[live], k, offset[own], self.size[own].astype(np.uint64))
            live = live[(self.data[word] & mask) == mask]
            out[live] = k
        return out


def stretches(texts: list[bytes], limit: int) -> Iterator[list[bytes]]:
    """``texts`` in runs of about ``limit`` bytes, so that their n-grams take bounded memory."""
    run, held = [], 0
    for text in texts:
        run.append(text)
        held += len(text)
        if held >= limit:
            yield run
            run, held = [], 0
    if run:
        yield run


def build_filter(train: DataFrame, tokens: int) -> tuple[DataFrame, int]:
    """((bucket, words, block) of the filter, bits): one block per bucket of n-gram hashes.

    Tasks pre-aggregate n-gram hashes and send them packed per bucket; the
    number of buckets follows the number of tokens, so a bucket fits one task.
    """
    bits = max(1, math.ceil(math.log2(max(1, tokens) / BUCKET_TOKENS)) if tokens else 1)

    def emit(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        grams, counts = np.unique(np.concatenate(parts), return_counts=True)
        counts = counts.astype(np.uint32)
        bucket = (grams >> np.uint64(64 - bits)).astype(np.int64)
        borders = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        for a, b in zip(borders, np.r_[borders[1:], len(grams)], strict=True):
            for at in range(a, b, 500_000):
                to = min(b, at + 500_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(bucket[a])], pa.int64()), pa.array([grams[at:to].tobytes()]),
                     pa.array([counts[at:to].tobytes()])], ["bucket", "grams", "counts"],
                )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, parts, held = Memo(xxhash.xxh64_intdigest), [], 0
        for batch in batches:
            for text in raw_texts(batch.column(0)):
                both = hashes(text, memo)
                parts += both
                held += 2 * len(both[0])
                if held > HELD_GRAMS:
                    yield from emit(parts)
                    parts, held = [], 0
        if parts:
            yield from emit(parts)

    def build(table: pa.Table) -> pa.Table:
        grams = np.concatenate([np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()])
        counts = np.concatenate([np.frombuffer(c, np.uint32) for c in table.column("counts").to_pylist()])
        grams, inverse = np.unique(grams, return_inverse=True)
        levels = level(np.bincount(inverse, weights=counts, minlength=len(grams)))
        size = int(levels.sum()) * BITS_PER_ENTRY // 64 + 1
        data, where = np.zeros(size, np.uint64), np.zeros(1, np.int64)
        for k in range(1, int(levels.max()) + 1):
            chosen = grams[levels >= k]
            word, mask = bits_of(chosen, k, where, np.array([size], np.uint64))
            np.bitwise_or.at(data, word, mask)
        return pa.table({
            "bucket": pa.array([table.column("bucket")[0].as_py()], pa.int64()),
            "words": pa.array([size], pa.int64()), "block": pa.array([data.tobytes()]),
        })

    blocks = (
        train.select("text").mapInArrow(count, "bucket long, grams binary, counts binary")
        .groupBy("bucket").applyInArrow(build, "bucket long, words long, block binary")
    )
    return cut(blocks), bits


def segments(blocks: DataFrame, bits: int, limit: int = SEGMENT_BYTES) -> Iterator[Segment]:
    """The filter in runs of blocks of ``limit`` bytes at most (a block alone may not exceed it)."""
    sizes = {r["bucket"]: r["words"] for r in blocks.select("bucket", "words").toLocalIterator()}
    first, held, runs = 0, 0, []
    for bucket in range(1 << bits):
        own = 8 * sizes.get(bucket, 0)
        if held and held + own > limit:
            runs.append((first, bucket))
            first, held = bucket, 0
        held += own
    for first, last in [*runs, (first, 1 << bits)]:
        size = np.array([sizes.get(b, 0) for b in range(first, last)], np.int64)
        begin, data = np.cumsum(size) - size, np.zeros(int(size.sum()), np.uint64)
        # Block by block, so that the driver holds a segment once.
        for row in blocks.where(f"bucket >= {first} and bucket < {last}").toLocalIterator():
            at = begin[row["bucket"] - first]
            data[at : at + row["words"]] = np.frombuffer(row["block"], np.uint64)
        yield Segment(bits, first, size, data)


def level_total(counts: DataFrame, ends: int) -> float:
    """Sum over all tokens of the least count of their level, the end included; a row per level is read."""
    of_level = F.floor(F.log(F.col("n").cast("double")) / math.log(RATIO) + 1e-9) + 1
    low, _ = bounds()
    rows = counts.groupBy(of_level.alias("level")).agg(F.count("*").alias("tokens")).collect()
    own = low[level(np.array([ends]))[0]] if ends else 0.0
    return float(own + sum(low[r["level"]] * r["tokens"] for r in rows))


def log_probability(one: np.ndarray, two: np.ndarray, singles: float, kinds: int) -> float:
    """log10 of the text's probability from the levels of its tokens and pairs.

    ``singles`` is :func:`level_total`, so that the token model adds up to 1
    with one unit left for a token never seen. A pair takes the least count of
    its level and its context the largest one, so the pairs of a context add
    up to 1 at most, and an even mixture of such models to 1 at most.
    """
    low, high = bounds()
    before = np.concatenate([high[one][-1:], high[one][:-1]])
    single = (low[one] + 1) / (singles + kinds + 1)
    pair = np.divide(np.minimum(low[two], np.minimum(before, high[one])), before,
                     out=np.zeros_like(before), where=before > 0)
    sums = []
    for weight in WEIGHTS:
        share = np.where(before > 0, weight, 0.0)
        sums.append(float(np.log10(share * pair + (1 - share) * single).sum()))
    most = max(sums)
    return most + math.log10(sum(10 ** (s - most) for s in sums) / len(sums))


def score_texts(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES, head: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Training rows are those that are not held out (crc32 of the id as text;
    rows without an id train). Null and empty texts consist of their end
    alone. Repeated rows count and are scored each. With no training rows all
    counts are 0 and every token has the probability 1 / (0 + 0 + 1). An empty
    table gives no rows; other columns are ignored.

    Base counts are exact: frequent words by a bounded broadcast, the others
    by a join. The model's counts come from the filter alone. The score is an
    even mixture over WEIGHTS of interpolated word-pair models, so it adapts to
    each document. What follows a context adds up to 1 at most over the n-grams
    that were counted; the filter's false positives, which raise a count by a
    level, come on top.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    train = docs.where(~held_out("doc_id", MODULUS, REMAINDER))
    counts = cut(token_counts(train, words))
    ends = train.count()
    seen = counts.agg(F.count("*"), F.sum("n")).first()
    kinds, total = seen[0] + (ends > 0), (seen[1] or 0) + ends
    common = frequent(counts, head).toArrow()
    exact = spark.sparkContext.broadcast(
        dict(zip(common["token"].to_pylist(), common["n"].to_pylist(), strict=True))
    )
    singles = level_total(counts, ends)
    blocks, bits = build_filter(train, total)

    source = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.lit(None).cast("binary").alias("state")
    )

    def probe(batch: pa.RecordBatch, segment: Segment, memo: Memo) -> list[np.ndarray]:
        """Levels of all tokens and then all pairs of each document, with what earlier passes found."""
        out, states = [], batch.column("state").to_pylist()
        for texts in stretches(raw_texts(batch.column("text")), STRETCH_BYTES):
            both = [hashes(t, memo) for t in texts]
            unique, inverse = np.unique(np.concatenate([np.concatenate(b) for b in both]), return_inverse=True)
            levels = segment.levels(unique)[inverse]
            out += np.split(levels, np.cumsum([2 * len(one) for one, _ in both])[:-1])
        return [np.maximum(x, np.frombuffer(s, np.uint8)) if s else x for x, s in zip(out, states, strict=True)]

    def collect(held):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memo, segment = Memo(xxhash.xxh64_intdigest), Segment(*held.value)
            for batch in batches:
                levels = [x.tobytes() for x in probe(batch, segment, memo)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("row", "doc_id", "text")), pa.array(levels, pa.binary())],
                    ["row", "doc_id", "text", "state"],
                )

        return step

    def finish(held):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memo, known, segment = Memo(xxhash.xxh64_intdigest), exact.value, Segment(*held.value)
            for batch in batches:
                scores = [
                    log_probability(x[: len(x) // 2], x[len(x) // 2 :], singles, kinds)
                    for x in probe(batch, segment, memo)
                ]
                sizes, found, logs, rare, out = [], [], [], [], []
                for text, doc_id in zip(raw_texts(batch.column("text")), batch.column("doc_id").to_pylist(), strict=True):
                    tokens = words(text)
                    values = list(map(known.get, tokens))
                    rest = Counter(t for t, v in zip(tokens, values, strict=True) if v is None)
                    values = np.array([v for v in values if v is not None], np.float64)
                    sizes.append(len(tokens) + 1)
                    found.append(len(values) + (ends > 0))
                    logs.append(float(np.log10(values + 1).sum()) + math.log10(ends + 1))
                    rare.append(rest)
                    out.append(doc_id is not None and crc_of_id(doc_id) % MODULUS == REMAINDER)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("doc_id"), pa.array(out, pa.bool_()),
                     pa.array(sizes, pa.int64()), pa.array(found, pa.int64()), pa.array(logs, pa.float64()),
                     pa.array(scores, pa.float64()), postings(rare)],
                    ["row", "doc_id", "held_out", "n_tokens", "found", "logs", "score", "rare"],
                )

        return step

    parts = segments(blocks, bits, segment_bytes)
    segment = next(parts)
    while True:
        # Plain values: workers can't import this package, and need not.
        held = spark.sparkContext.broadcast((segment.bits, segment.first, segment.size, segment.data))
        segment = next(parts, None)
        if segment is None:
            break
        source = cut(source.mapInArrow(collect(held), source.schema))
        held.unpersist()
    scored = cut(
        source.mapInArrow(
            finish(held),
            "row long, doc_id long, held_out boolean, n_tokens long, found long, logs double, "
            f"score double, rare {POSTINGS}",
        )
    )
    rare = scored.select("row", F.explode("rare").alias("p")).select("row", "p.token", F.col("p.n").alias("times"))
    rest = (
        rare.join(counts, "token").groupBy("row")
        .agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("logs_more"))
    )
    base = F.col("logs") + F.coalesce("logs_more", F.lit(0.0)) - F.col("n_tokens") * math.log10(total + kinds + 1)
    return scored.drop("rare").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("found") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"), "score",
    )
