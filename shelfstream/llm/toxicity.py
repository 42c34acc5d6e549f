"""Toxicity by a weighted finite-state grammar over clauses, its lexicon learned from labels.

Transducers rewrite a clause's tokens into (label, weight) pairs, one after
another: the lexicon marks insults, threats, targets, negations and reporting
words; target, threat, negation and report transducers then rename insults by
what stands around them. A document's features sum the weights per final
label; a logistic layer turns them into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfstream.llm.common import Memo, crc_of_id, held_out, raw_texts, slices
from shelfstream.llm.decontaminate import search_words
from shelfstream.scale import cut

MODULUS, REMAINDER = 4, 2
THRESHOLD = 0.3
# Labelled rows that the grammar is fitted on at most (half for the lexicon, half for the layer).
SAMPLE = 24_000
# Lexicon entries kept at most, and the least lower bound of an entry's log odds.
ENTRIES, LEAST_WEIGHT, LEAST_DOCS = 4_000, 1.5, 3
STEMS = range(4, 9)

CLAUSE = re.compile(rb"[.!?;:\n]+")
# Seed classes of the grammar; words of the four languages, lower case.
TARGETS = frozenset(
    w.encode() for w in "you your yours he she they them his her their those these people "
    "du dich dir ihr euch sie ihm tu te toi vous ton votre il elle ils usted tú ti vosotros ellos".split()
)
NEGATIONS = frozenset(w.encode() for w in "not no never none nor nicht kein keine nie pas jamais ne nunca ni".split())
REPORTS = frozenset(
    w.encode() for w in "said says wrote called quoted claimed reported sagte schrieb nannte dit écrit dijo llamó".split()
)
THREATS = frozenset(
    w.encode() for w in "kill hurt destroy burn beat shoot stab murder die töten verletzen tuer frapper matar golpear".split()
)
# Reach, in tokens, of the target, negation and threat transducers.
NEAR_TARGET, NEAR_NEGATION, NEAR_THREAT = 4, 2, 4

LABELS = ("insult", "targeted", "negated", "reported", "threat")
# Prior weights of the layer: a targeted insult counts more, a denied or reported one less.
PRIOR = np.array([-4.0, 1.0, 1.2, 0.6, 0.6, 1.0, 1.0, 1.0])


def lexicon(tokens: list[bytes], weight: Memo) -> list[tuple[str, float]]:
    out = []
    for token in tokens:
        w = weight[token]
        if w > 0:
            out.append(("insult", w))
        elif token in THREATS:
            out.append(("danger", 1.0))
        elif token in TARGETS:
            out.append(("target", 0.0))
        elif token in NEGATIONS:
            out.append(("negation", 0.0))
        elif token in REPORTS:
            out.append(("report", 0.0))
        else:
            out.append(("", 0.0))
    return out


def near(tape: list[tuple[str, float]], cue: str, reach: int, both: bool, old: str, new: str):
    """Rename ``old`` to ``new`` within ``reach`` tokens behind a cue (or, with ``both``, before one).

    Two passes of a counter automaton: one reads left to right, one right to left.
    """
    tape = list(tape)
    for order in (range(len(tape)), range(len(tape) - 1, -1, -1)) if both else (range(len(tape)),):
        left = 0
        for k in order:
            label, weight = tape[k]
            if label == cue:
                left = reach
            elif left:
                left -= 1
                if label == old:
                    tape[k] = (new, weight)
    return tape


def read_clause(tokens: list[bytes], weight: Memo) -> list[tuple[str, float]]:
    """The composed transducers: lexicon, target, threat, negation, report."""
    tape = lexicon(tokens, weight)
    tape = near(tape, "target", NEAR_TARGET, True, "insult", "targeted")
    tape = near(tape, "target", NEAR_THREAT, True, "danger", "threat")
    for old in ("insult", "targeted", "threat"):
        tape = near(tape, "negation", NEAR_NEGATION, False, old, "negated")
    for old in ("insult", "targeted", "threat"):
        tape = near(tape, "report", len(tape), False, old, "reported")
    return tape


@dataclass
class Grammar:
    """Weights of stems and of whole words (these end in a blank), and the logistic layer."""

    weights: dict[bytes, float]
    layer: np.ndarray

    def weigher(self) -> Memo:
        known = self.weights.get

        def weight(token: bytes) -> float:
            best = known(token + b" ", 0.0)
            for n in STEMS:
                if n <= len(token):
                    best = max(best, known(token[:n], 0.0))
            return best

        return Memo(weight)

    def features(self, text: bytes, weight: Memo) -> tuple[np.ndarray, list[tuple[int, str]]]:
        """(features, matched clauses with their strongest label) of one text."""
        out, clauses = np.zeros(len(PRIOR)), []
        out[0] = 1.0
        tokens = search_words(text)
        if not any(w > 0 or t in THREATS for t, w in zip(tokens, map(weight.__getitem__, tokens), strict=True)):
            return out, clauses
        best, total = 0.0, 0.0
        for number, clause in enumerate(CLAUSE.split(text)):
            matched = [p for p in read_clause(search_words(clause), weight) if p[0] in LABELS]
            if matched:
                top = max(matched, key=lambda p: p[1])
                clauses.append((number, top[0]))
                for label, w in matched:
                    out[1 + LABELS.index(label)] += w
                best, total = max(best, top[1]), total + sum(w for _, w in matched)
        # Sums grow with length: squash them, and give the density besides.
        out[1:6] = np.log1p(out[1:6])
        out[6] = best
        out[7] = math.log1p(100 * total / max(1, len(tokens)))
        return out, clauses

    def score(self, text: bytes, weight: Memo) -> tuple[float, list[tuple[int, str]]]:
        features, clauses = self.features(text, weight)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(features @ self.layer))))), clauses


def stems_of(token: bytes) -> Iterator[bytes]:
    yield token + b" "
    for n in STEMS:
        if n <= len(token):
            yield token[:n]


def fit_layer(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps, pulled towards PRIOR."""
    w = PRIOR.copy()
    if len(y) == 0 or y.min() == y.max():
        return w
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * (w - PRIOR)
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def sample_labels(labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, toxic): at most ``sample`` labelled training rows, by hash of the id."""
    return (
        labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic is not null")
        .where(~held_out("doc_id", MODULUS, REMAINDER))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )


def distinct_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(half, toxic, text) of the sampled labelled documents, one of each group of near copies.

    Near copies share the least hash of their five-word shingles; without this
    a group of a thousand copies would make each of its words look telling.
    """

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for text in raw_texts(batch.column("text")):
                found = search_words(text)
                keys.append(min(
                    (xxhash.xxh64_intdigest(b" ".join(found[k : k + 5])) for k in range(max(1, len(found) - 4))),
                    default=0,
                ) >> 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array(keys, pa.int64()), batch.column("text")],
                ["doc_id", "toxic", "key", "text"],
            )

    chosen = cut(sample_labels(labels, sample))
    # The sample is bounded by a parameter: some 300 KB at most.
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    keyed = cut(
        texts.select("doc_id", "toxic", "text")
        .mapInArrow(least, "doc_id long, toxic int, key long, text string")
    )
    single = keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    one = keyed.join(F.broadcast(cut(single.distinct())), "doc_id").dropDuplicates(["doc_id"])
    return cut(one.select((F.col("key") % 2).alias("half"), "toxic", "text"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Grammar:
    """Lexicon from one half of the sample, layer from the other.

    An entry is a whole word or a stem of 4 to 8 bytes; its weight is the lower
    bound of its log odds between toxic and other documents.
    """
    rows = distinct_sample(docs, labels, sample)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()

        def emit():
            keys = list(toxic.keys() | clean.keys())
            for at in range(0, len(keys), 100_000):
                part = keys[at : at + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.binary()), pa.array([toxic[k] for k in part], pa.int64()),
                     pa.array([clean[k] for k in part], pa.int64())], ["stem", "toxic", "clean"],
                )

        for batch in batches:
            for label, text in zip(batch.column("toxic").to_pylist(), raw_texts(batch.column("text")), strict=True):
                found = {s for token in set(search_words(text)) for s in stems_of(token)}
                (toxic if label else clean).update(found)
                if len(toxic) + len(clean) > 500_000:
                    yield from emit()
                    toxic.clear()
                    clean.clear()
        yield from emit()

    halves = {(r["half"], r["toxic"]): r["count"] for r in rows.groupBy("half", "toxic").count().collect()}
    n_toxic = sum(n for (h, t), n in halves.items() if h == 0 and t)
    n_clean = sum(n for (h, t), n in halves.items() if h == 0 and not t)
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a / (n_toxic + 1.0)) - F.log(b / (n_clean + 1.0))
    entries = (
        rows.where("half = 0").select("toxic", "text").mapInArrow(tally, "stem binary, toxic long, clean long")
        .groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(F.col("toxic") >= LEAST_DOCS)
        .withColumn("weight", odds - 1.64 * F.sqrt(1 / a + 1 / b))
        .where(F.col("weight") >= LEAST_WEIGHT)
        .orderBy(F.desc(F.col("weight") * F.sqrt("toxic")), "stem").limit(ENTRIES)
        .select("stem", "weight").collect()
    )
    weights = {bytes(r["stem"]): r["weight"] for r in entries}
    grammar = Grammar(weights, PRIOR)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = grammar.weigher()
        for batch in batches:
            x = [grammar.features(t, weight)[0].tolist() for t in raw_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"]
            )

    fitted = (
        rows.where("half = 1").select("toxic", "text")
        .mapInArrow(describe, "toxic int, x array<double>").toArrow()
    )
    x = np.array(fitted["x"].to_pylist(), np.float64).reshape(-1, len(PRIOR))
    return Grammar(weights, fit_layer(x, fitted["toxic"].to_numpy().astype(np.float64)))


def score_texts(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, clauses of every document.

    ``clauses`` lists the matched clauses as (number, label). Null and empty
    texts match nothing and get the layer's base score. Repeated rows get
    equal scores, an empty table gives no rows. Only the text is an input;
    other columns are ignored. Row-local, no shuffle.
    """
    # Plain values: workers can't import this package, and need not.
    held = docs.sparkSession.sparkContext.broadcast((grammar.weights, grammar.layer))
    clause_type = pa.list_(pa.struct([("number", pa.int64()), ("label", pa.string())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(*held.value)
        weight = grammar.weigher()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            out = [grammar.score(t, weight) for t in raw_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"),
                 pa.array([i is not None and crc_of_id(i) % MODULUS == REMAINDER for i in ids], pa.bool_()),
                 pa.array([s for s, _ in out], pa.float64()),
                 pa.array([int(s >= threshold) for s, _ in out], pa.int32()),
                 pa.array([[{"number": n, "label": k} for n, k in c] for _, c in out], clause_type)],
                ["doc_id", "held_out", "score", "predicted", "clauses"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        score,
        "doc_id long, held_out boolean, score double, predicted int, "
        "clauses array<struct<number:long,label:string>>",
    )


def drop_toxic(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast((grammar.weights, grammar.layer))
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(*held.value)
        weight = grammar.weigher()
        for batch in (part for whole in batches for part in slices(whole, place)):
            clean = [grammar.score(t, weight)[0] < threshold for t in raw_texts(batch.column(place))]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
