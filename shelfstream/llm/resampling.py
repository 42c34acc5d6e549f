"""Importance resampling towards a target: hashed features, gains per bucket, and a Gumbel draw.

A document's weight is the mean gain of its features, how much likelier a
feature's bucket is in the target than in all documents. Gumbel noise from a
hash of the id turns "highest scores" into a draw by weight without replacement.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfstream.llm.common import Memo, chunks_of, merged
from shelfstream.scale import cut, global_row_number

BUCKETS = 10_000
LONGEST = 1
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Featurizer:
    """Buckets of the runs of 1 to ``longest`` words of a text.

    The words and their offsets come from an untrained Split of the tokenizer
    library over the text with A-Z lower-cased.
    """

    def __init__(self, longest: int, buckets: int):
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.split = Split(Regex(WORD), behavior="removed", invert=True)
        self.longest = longest
        self.bucket = Memo(lambda feature: zlib.crc32(feature.encode()) % buckets)

    def __call__(self, text: str) -> tuple[int, np.ndarray]:
        """(number of words, bucket of every feature, repeats included)"""
        lowered = text.encode().lower().decode()
        found = self.split.pre_tokenize_str(lowered)
        flat = [self.bucket[word] for word, _ in found]
        for size in range(2, self.longest + 1):
            # A window's first and last offsets bound it; words one blank apart are a slice of the text.
            for k in range(len(found) - size + 1):
                begin, end = found[k][1][0], found[k + size - 1][1][1]
                run = found[k : k + size]
                plain = end - begin == sum(b - a for _, (a, b) in run) + size - 1
                feature = lowered[begin:end] if plain else ""
                if not plain or feature.count(" ") != size - 1:
                    feature = " ".join(word for word, _ in run)
                flat.append(self.bucket[feature])
        return len(found), np.array(flat, np.uint32)


def describe(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """row, doc_id, n_words, n_features, features (bucket numbers, 16 bits where they fit) of every row."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurizer = Featurizer(longest, buckets)
        for batch in batches:
            found = [featurizer(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array([n for n, _ in found], pa.int64()),
                 pa.array([len(f) for _, f in found], pa.int64()),
                 pa.array([f.astype(kind).tobytes() for _, f in found], pa.binary())],
                ["row", "doc_id", "n_words", "n_features", "features"],
            )

    return texts.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "row long, doc_id long, n_words long, n_features long, features binary"
    )


def histogram(described: DataFrame, buckets: int) -> np.ndarray:
    """Features per bucket over all rows: one array per task, added up chunk by chunk."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            for features in batch.column(0).to_pylist():
                seen += np.bincount(np.frombuffer(features, kind), minlength=buckets)
        yield from chunks_of(seen)

    return merged(described.select("features").mapInArrow(count, "chunk int, part binary"), buckets, np.int64, np.add)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of target share over source share per bucket, both smoothed by one."""
    size = float(len(source))
    share = (target + 1.0) * (float(source.sum()) + size) / ((source + 1.0) * (float(target.sum()) + size))
    return np.floor(1000 * np.log(share)).astype(np.int64)


def noise(doc_id, seed: int) -> int:
    """A repeatable Gumbel draw in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def mean_gain(gain: np.ndarray, features: np.ndarray) -> int:
    return int(gain[features].sum()) // len(features) if len(features) else 0


def learn(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS
) -> tuple[DataFrame, np.ndarray]:
    """(described documents, gain per bucket)"""
    described = cut(describe(docs, longest, buckets))
    aims = describe(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), longest, buckets)
    return described, gains(histogram(described, buckets), histogram(aims, buckets))


def rank(described: DataFrame, gain: np.ndarray, percent: int, least_words: int, seed: int) -> DataFrame:
    """:func:`score` from what :func:`learn` found."""
    held = described.sparkSession.sparkContext.broadcast(gain)
    kind = np.uint16 if len(gain) <= 1 << 16 else np.uint32

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [mean_gain(held.value, np.frombuffer(f, kind)) for f in batch.column("features").to_pylist()]
            draws = [noise(i, seed) for i in batch.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "doc_id", "n_words", "n_features")), pa.array(weights, pa.int64()),
                 pa.array([w + d for w, d in zip(weights, draws, strict=True)], pa.int64())],
                ["row", "doc_id", "n_words", "n_features", "weight", "score"],
            )

    scored = cut(described.mapInArrow(
        weigh, "row long, doc_id long, n_words long, n_features long, weight long, score long"
    ))
    able = F.col("n_words") >= least_words
    wanted, least = cutoff(scored.where(able), percent)
    chosen = able & (F.col("score") >= least) if wanted else F.lit(False)
    # Only what may be drawn is sorted: the drawn and those that tie with the last of them.
    ranked = global_row_number(
        scored.where(chosen), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")], "rank"
    )
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank")).unionByName(
        scored.where(~chosen).select(*columns, F.lit(None).cast("long").alias("rank"))
    )


def score(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, longest: int = LONGEST, buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null for those that are not drawn.

    Of the documents with ``least_words`` words or more, ``percent`` in a
    hundred are drawn: highest scores, equal ones by ascending doc_id, a null
    doc_id last. Null and empty texts have no features and weight 0. Repeated rows
    get equal scores and ranks of their own; a null id hashes as an empty one.
    With an empty target all buckets are equally likely in it. An empty table
    gives no rows; other columns are ignored.

    The text is read once; what is stored of it is a number per feature.
    """
    return rank(*learn(docs, target, longest, buckets), percent, least_words, seed)


def cutoff(able: DataFrame, percent: int) -> tuple[int, int]:
    """(number to draw, least score among them).

    One row per distinct score reaches the driver. Gains and noise are
    thousandths of logarithms of 64-bit counts, so there are under 200,000.
    """
    bins = sorted(((r["score"], r["count"]) for r in able.groupBy("score").count().collect()), reverse=True)
    wanted = percent * sum(n for _, n in bins) // 100
    seen = 0
    for least, n in bins:
        seen += n
        if seen >= wanted:
            return wanted, least
    return 0, 0


def draw(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, longest: int = LONGEST, buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """The rows of ``docs`` that :func:`score` ranks, with all their columns, in no order.

    Once the last drawn score and id are known, a row is judged where it lies,
    by its text and id alone: texts are read twice and never shuffled. Rows
    that repeat the last drawn one are drawn with it.
    """
    described, gain = learn(docs, target, longest, buckets)
    ranked = rank(described, gain, percent, least_words, seed)
    last = ranked.where("rank is not null").orderBy(F.desc("rank")).limit(1).collect()
    bar = (last[0]["score"], last[0]["doc_id"]) if last else None
    held = docs.sparkSession.sparkContext.broadcast(gain)
    text, doc_id = docs.columns.index("text"), docs.columns.index("doc_id")

    def above(own: int, i) -> bool:
        if own != bar[0]:
            return own > bar[0]
        return bar[1] is None or i is not None and i <= bar[1]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurizer = Featurizer(longest, buckets)
        for batch in batches:
            kept = []
            for i, t in zip(batch.column(doc_id).to_pylist(), batch.column(text), strict=True):
                n, features = featurizer(t.as_py() or "")
                kept.append(
                    bar is not None and n >= least_words and above(mean_gain(held.value, features) + noise(i, seed), i)
                )
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
