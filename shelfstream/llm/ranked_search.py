"""Ranked lexical search: term-at-a-time, rarest term first, with a limit on new accumulators.

Documents stay where they lie. A task turns a batch of them into postings of
the query terms and runs every query over these; a document outside a batch's
best k can't be among the best k of all.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfstream.llm.common import chunks_of, merged, raw_texts
from shelfstream.scale import cut

BEST = 50
# Text of the queries of one pass over the documents; what a pass broadcasts follows it. More take more passes.
BYTES_PER_PASS = 8 << 20
# Tasks whose lists are merged together before the last merge.
FIRST_MERGE = 1_000

# Every byte outside 0-9, a-z (after lower-casing) and non-ASCII separates terms.
SEPARATORS = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
NO_ID = np.iinfo(np.int64).max


def terms(text: bytes) -> list[bytes]:
    return text.lower().translate(SEPARATORS).split()


def query_blocks(items: DataFrame, size: int) -> Iterator[list[tuple]]:
    """(item_id, distinct terms) in blocks whose texts have ``size`` bytes at most, or of one query."""
    block, held = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        text = (row["text"] or "").encode()
        if block and held + len(text) > size:
            yield block
            block, held = [], 0
        block.append((row["item_id"], sorted(set(terms(text)))))
        held += len(text)
    if block:
        yield block


def matches(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), found, times: numbers and frequencies of the query terms in each document."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = held.value
        for batch in batches:
            sizes, found, times = [], [], []
            for text in raw_texts(batch.column("text")):
                own = terms(text)
                seen = Counter(filter(number.__contains__, own))
                sizes.append(len(own))
                found.append(np.fromiter(map(number.__getitem__, seen), np.uint32, len(seen)).tobytes())
                times.append(np.fromiter(seen.values(), np.uint32, len(seen)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(found, pa.binary()),
                 pa.array(times, pa.binary())], ["doc_id", "n", "found", "times"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        count, "doc_id long, n long, found binary, times binary"
    )


def document_frequencies(matched: DataFrame, size: int) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for batch in batches:
            for found in batch.column(0).to_pylist():
                seen[np.frombuffer(found, np.uint32)] += 1
        yield from chunks_of(seen)

    return merged(matched.select("found").mapInArrow(count, "chunk int, part binary"), size, np.int64, np.add)


def best_of(postings: list[tuple[np.ndarray, np.ndarray]], docs: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) that can be among the best ``k``, from (documents, parts of score) per term, rarest first.

    ``least`` is a score that k documents are known to reach. While the terms
    to come could lift an unseen document to the k-th best partial score (or to
    ``least``), a posting without an accumulator gets one; from then on only
    documents that have one are updated, with every term, so that their scores are exact.
    """
    bounds = [int(parts.max()) if len(parts) else 0 for _, parts in postings]
    to_come = sum(bounds)
    score, live, creating = np.zeros(docs, np.int64), np.zeros(docs, bool), True
    for (where, parts), bound in zip(postings, bounds, strict=True):
        if creating:
            reached = least
            own = score[live]
            if len(own) >= k:
                reached = max(reached, int(np.partition(own, len(own) - k)[len(own) - k]))
            creating = to_come >= reached
        to_come -= bound
        if creating:
            live[where] = True
            score[where] += parts
        else:
            kept = live[where]
            score[where[kept]] += parts[kept]
    found = np.flatnonzero(live & (score > 0) & (score >= least))
    return found, score[found]


class Best:
    """The best ``k`` of one query so far: highest score first, equal scores by ascending id."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 0

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.append(self.ids, ids), np.append(self.scores, scores)
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]


def search_block(
    matched: DataFrame, block: list[tuple], vocabulary: dict[bytes, int], documents: int, length: int, k: int
) -> DataFrame:
    """query, item_id, doc_id, score: each task's best ``k`` for each query of the block."""
    df = document_frequencies(matched, len(vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    queries = [
        (item_id, sorted((vocabulary[t] for t in own), key=lambda t: (df[t], t))) for item_id, own in block
    ]
    held = matched.sparkSession.sparkContext.broadcast((queries, weight))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight = held.value
        best = [Best(k) for _ in queries]
        for batch in batches:
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            n = batch.column("n").to_numpy()
            found, times = batch.column("found").to_pylist(), batch.column("times").to_pylist()
            where = np.repeat(np.arange(len(ids)), [len(f) // 4 for f in found])
            term = np.frombuffer(b"".join(found), np.uint32)
            tf = np.frombuffer(b"".join(times), np.uint32).astype(np.int64)
            m = 50 + (50 * n * documents) // max(1, length)
            part = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[where]))
            order = np.argsort(term, kind="stable")
            where, part = where[order], part[order]
            ends = np.cumsum(np.bincount(term, minlength=len(weight)))
            for (_, own), top in zip(queries, best, strict=True):
                lists = [(where[a:b], part[a:b]) for a, b in ((ends[t - 1] if t else 0, ends[t]) for t in own) if b > a]
                docs, scores = best_of(lists, len(ids), k, top.least())
                top.add(ids[docs], scores)
        for query, ((item_id, _), top) in enumerate(zip(queries, best, strict=True)):
            if len(top.ids):
                size = len(top.ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([query] * size, pa.int64()), pa.array([item_id] * size, pa.int64()),
                     pa.array(top.ids, pa.int64(), mask=top.ids == NO_ID), pa.array(top.scores, pa.int64())],
                    ["query", "item_id", "doc_id", "score"],
                )

    return matched.mapInArrow(rank, "query long, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = BEST, bytes_per_pass: int = BYTES_PER_PASS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each row of ``items``.

    A score sums, over the item's distinct terms, term weight times damped
    term frequency, all in integers; documents that share no term of positive
    weight are not listed. Equal scores go by ascending doc_id, a null doc_id
    last. Null, empty and blank documents have no terms and count in no
    statistic; such items find nothing. Repeated documents count and rank each
    for itself; repeated items are queries of their own. Empty tables give no
    rows; other columns are ignored.

    Queries are read in blocks of bounded text. Per block the documents are
    read once; what is stored of each is the frequencies of the block's terms.
    """
    spark = docs.sparkSession
    results: list[DataFrame] = []
    sizes = None
    for block in query_blocks(items, bytes_per_pass):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, own in block for t in own}))}
        matched = cut(matches(docs, vocabulary))
        if sizes is None:
            sizes = matched.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not vocabulary:
            continue
        own = search_block(matched, block, vocabulary, sizes[0], sizes[1], k)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        some = F.pmod(F.spark_partition_id(), F.lit(FIRST_MERGE))
        first = own.withColumn("some", some).withColumn(
            "rank", F.row_number().over(Window.partitionBy("query", "some").orderBy(*order))
        )
        last = first.where(F.col("rank") <= k).withColumn(
            "rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))
        )
        results.append(last.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
