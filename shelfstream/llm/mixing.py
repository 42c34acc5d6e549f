"""Mixing to target weights with soft domain membership.

A softmax classifier, fitted on a bounded labelled sample, gives every document
a posterior over domains. Rates r >= 0 are then fitted so that the expected
tokens per domain, the sum of r * tokens * posterior, meet the targets, and
among such rates those nearest to 1: ridge least squares by Newton steps on its
dual, each step one distributed sum over the documents. The ridge shrinks until
the targets are met; targets that no rates meet are reported.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfstream.llm.common import Memo, raw_texts, slices, words
from shelfstream.scale import cut

# Domains of the labelled table, and their shares of the mixed tokens.
DOMAINS = ("good", "low", "toxic")
TARGETS = {"good": 0.88, "low": 0.07, "toxic": 0.05}
# Behind a filter of toxic documents: the others keep their proportions.
FILTERED_TARGETS = {d: TARGETS[d] for d in ("good", "low")}
# Labelled rows the classifier is fitted on at most, and hashed features.
SAMPLE, FEATURES = 6_000, 1 << 15
PACE, RIDGE = 1.0, 3e-5
# Weight of staying near the rate 1 against meeting the targets, at first; a rate has no upper bound.
PULL, MOST = 1e-6, math.inf
# Shares count as met within MISS; until then the weight shrinks tenfold, down to LEAST_PULL.
MISS, LEAST_PULL = 1e-4, 1e-9
# Passes over the documents at most (more is an error), and the gradient at which a fit has converged.
STEPS, TOLERANCE = 300, 1e-6


SYMBOLS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())


def features(text: bytes, memo: Memo) -> np.ndarray:
    """Distinct hashed features: word stems, and classes of length, symbol and repetition shares."""
    found, lines = words(text), text.split(b"\n")
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    cues = [
        b"n%d" % int(math.log2(len(found) + 1)),
        b"s%d" % int(20 * symbols / max(1, len(text))),
        b"u%d" % int(10 * len(set(found)) / max(1, len(found))),
        b"l%d" % int(10 * len(set(lines)) / len(lines)),
    ]
    out = {memo[w] for w in found}
    out.update(xxhash.xxh64_intdigest(c, seed=2) % FEATURES for c in cues)
    return np.fromiter(out, np.int64, len(out))


def stems() -> Memo:
    """word -> feature of its first six bytes without symbols at the ends."""
    return Memo(lambda w: xxhash.xxh64_intdigest(w.strip(b".,;:!?\"'|()")[:6], seed=1) % FEATURES)


@dataclass
class Classifier:
    weights: np.ndarray  # domains x FEATURES
    bias: np.ndarray

    def posterior(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Posteriors of documents whose feature numbers lie one after another in ``flat``."""
        begins = np.cumsum(sizes) - sizes
        if not len(sizes):
            return np.zeros((0, len(self.bias)))
        z = np.stack([np.add.reduceat(w[flat], begins) for w in self.weights], axis=1)
        z = z / np.sqrt(sizes)[:, None] + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def among(self, domains: Mapping[str, float]) -> Classifier:
        """The posterior given that a document is of one of ``domains``."""
        rows = [k for k, d in enumerate(DOMAINS) if d in domains]
        return Classifier(self.weights[rows], self.bias[rows])

    def of_texts(self, texts: list[bytes], memo: Memo) -> np.ndarray:
        rows = [features(t, memo) for t in texts]
        sizes = np.array([len(r) for r in rows], np.int64)
        return self.posterior(np.concatenate(rows) if rows else np.zeros(0, np.int64), sizes)


def fit_softmax(flat: np.ndarray, sizes: np.ndarray, y: np.ndarray, classes: int, steps: int = 150) -> Classifier:
    """Softmax regression by full-batch gradient steps, scaled per feature, with a small ridge."""
    model = Classifier(np.zeros((classes, FEATURES)), np.zeros(classes))
    if not len(sizes):
        return model
    truth = np.eye(classes)[y]
    model.bias = np.log(truth.mean(axis=0) + 1e-3)
    seen, drift = np.full_like(model.weights, 1e-8), np.full(classes, 1e-8)
    for _ in range(steps):
        error = (model.posterior(flat, sizes) - truth) / len(sizes)
        for k in range(classes):
            pushed = np.repeat(error[:, k] / np.sqrt(sizes), sizes)
            gradient = np.bincount(flat, weights=pushed, minlength=FEATURES) + RIDGE * model.weights[k]
            seen[k] += gradient**2
            model.weights[k] -= PACE * gradient / np.sqrt(seen[k])
        slope = error.sum(axis=0)
        drift += slope**2
        model.bias = model.bias - 0.1 * slope / np.sqrt(drift)
    return model


def labelled_domains(labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, domain number) of at most ``sample`` labelled rows, by hash of the id."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    return (
        labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
        .select("doc_id", domain.alias("domain"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )


def fit_classifier(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fitted on the sampled labelled documents; what reaches the driver is bounded by ``sample``
    rows of at most FEATURES feature numbers."""
    chosen = cut(labelled_domains(labels, sample))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = stems()
        for batch in (part for whole in batches for part in slices(whole, "text")):
            rows = [features(t, memo).astype(np.int32) for t in raw_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("domain"), pa.array(rows, pa.list_(pa.int32()))], ["domain", "x"]
            )

    table = (
        docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
        .dropDuplicates(["doc_id"]).select("domain", "text")
        .mapInArrow(describe, "domain int, x array<int>").toArrow()
    )
    lists = table["x"].combine_chunks()
    flat = lists.flatten().to_numpy()
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    return fit_softmax(flat, sizes, table["domain"].to_numpy(), len(DOMAINS))


def memberships(docs: DataFrame, model: Classifier) -> DataFrame:
    """row, doc_id, source, n_tokens, p (posterior per domain) of every document."""
    # Plain values: workers can't import this package, and need not.
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, model = stems(), Classifier(*held.value)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            texts = raw_texts(batch.column("text"))
            p = model.of_texts(texts, memo)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("source"),
                 pa.array([len(words(t)) for t in texts], pa.int64()),
                 pa.array(p.tolist(), pa.list_(pa.float64()))],
                ["row", "doc_id", "source", "n_tokens", "p"],
            )

    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string").alias("source")
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), source, "text"
    ).mapInArrow(classify, "row long, doc_id long, source string, n_tokens long, p array<double>")


def rate_column(push: np.ndarray):
    """The rate of a document: 1 less the push on its domains, projected on [0, MOST]."""
    along = F.lit(0.0)
    for k in range(len(push)):
        along = along + F.col("p")[k] * F.lit(float(push[k]))
    return F.greatest(F.lit(0.0), F.least(F.lit(MOST), 1.0 - along))


def fit_rates(members: DataFrame, targets: Mapping[str, float] = TARGETS, steps: int = STEPS):
    """(push per domain, expected token shares under it, target shares), for the domains in ``targets``.

    Minimises |s(r) - w|^2 / 2 + pull |r - 1|^2 / 2 over rates r >= 0, where s
    are the expected domain tokens and the second norm weighs rows by their
    tokens. The optimum is r = max(0, 1 - p . push), where push minimises the
    dual pull |push|^2 / 2 + w . push + |r|^2 / 2, so only ``push`` is kept and
    moved: by Newton steps, halved until the dual falls. A pass sums gradient,
    Gram matrix of the rows with r > 0, and dual. Shares miss the targets by
    pull * push, so the pull shrinks until they are within MISS. If they are not
    at the least pull, no rates meet the targets, and these are the closest.
    """
    domains = [d for d in DOMAINS if d in targets]
    n = len(domains)
    tokens, p = F.col("n_tokens").cast("double"), F.col("p")
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    wanted = np.array([targets[d] for d in domains], np.float64)
    wanted = wanted / wanted.sum()
    total = float(members.agg(F.sum(tokens)).first()[0] or 0.0)
    if not total > 0:
        return np.zeros(n), np.zeros(n), wanted

    def measure(push: np.ndarray):
        """Shares, Gram matrix and |r|^2 at ``push``: one pass."""
        rated = members.select(tokens.alias("t"), "p", rate_column(push).alias("r"))
        free = F.when(F.col("r") > 0, F.col("t")).otherwise(0.0)
        got = rated.agg(
            F.sum(F.col("t") * F.col("r") * F.col("r")),
            *[F.sum(F.col("t") * p[k] * F.col("r")) for k in range(n)],
            *[F.sum(free * p[i] * p[j]) for i, j in pairs],
        ).first()
        gram = np.zeros((n, n))
        for (i, j), value in zip(pairs, got[1 + n :], strict=True):
            gram[i, j] = gram[j, i] = value / total
        return np.array(got[1 : 1 + n]) / total, gram, got[0] / total

    push, pull, passes = np.zeros(n), PULL, 1
    shares, gram, square = measure(push)
    while True:
        gradient = shares - wanted - pull * push
        if np.abs(gradient).max() >= TOLERANCE:
            dual = pull * push @ push / 2 + wanted @ push + square / 2
            step, stride = np.linalg.solve(gram + pull * np.eye(n), gradient), 1.0
            while True:
                if passes >= steps:
                    raise RuntimeError(f"rates have not converged in {steps} passes: {shares} for {wanted}")
                there, passes = push + stride * step, passes + 1
                found = measure(there)
                less = dual - (pull * there @ there / 2 + wanted @ there + found[2] / 2)
                if less >= 1e-4 * stride * (gradient @ step) or np.abs(found[0] - wanted - pull * there).max() < TOLERANCE:
                    break
                stride /= 2
            push, (shares, gram, square) = there, found
        elif np.abs(shares - wanted).max() > MISS and pull > LEAST_PULL:
            pull /= 10
        else:
            return push, shares, wanted


def mix(
    docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, sample: int = SAMPLE
) -> DataFrame:
    """row, doc_id, source, n_tokens, p_<domain>..., rate, copies, miss of every document.

    ``copies`` rounds the rate down or up by a hash of the id, so that its
    expectation is the rate. ``miss`` is the largest difference of an expected
    share to its target, the same in all rows: above MISS, no rates meet the
    targets and these come closest. Null and empty texts have no tokens; their rate
    counts for nothing. Without labels all posteriors are equal. Repeated rows
    get equal rates; null ids hash alike; an empty table gives no rows; other
    columns are ignored.
    """
    members = cut(memberships(docs, fit_classifier(docs, labels, sample).among(targets)))
    push, shares, wanted = fit_rates(members, targets)
    domains = [d for d in DOMAINS if d in targets]
    rate = rate_column(push)
    coin = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6
    return members.withColumn("rate", rate).select(
        "row", "doc_id", "source", "n_tokens",
        *[F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(domains)],
        "rate", (F.floor("rate") + (coin < F.col("rate") - F.floor("rate")).cast("long")).cast("int").alias("copies"),
        F.lit(float(np.abs(shares - wanted).max())).alias("miss"),
    )


def apply_mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = FILTERED_TARGETS) -> DataFrame:
    """``docs`` with each row as often as its ``copies`` say: none, once or more.

    Warns when no rates meet the targets; the closest are used.
    """
    model = fit_classifier(docs, labels).among(targets)
    push, shares, wanted = fit_rates(cut(memberships(docs, model)), targets)
    if shares.any() and np.abs(shares - wanted).max() > MISS:
        warnings.warn(f"no rates meet the targets {wanted}; expected shares are {shares}", stacklevel=2)
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, push))
    text, doc_id = docs.columns.index("text"), docs.columns.index("doc_id")

    def repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, (weights, bias, push) = stems(), held.value
        model = Classifier(weights, bias)
        for batch in (part for whole in batches for part in slices(whole, text)):
            p = model.of_texts(raw_texts(batch.column(text)), memo)
            rate = np.clip(1.0 - p @ push, 0.0, MOST)
            coin = np.array([xxhash.xxh64_intdigest(str(i).encode()) for i in batch.column(doc_id).to_pylist()])
            copies = np.floor(rate) + (coin % 1_000_000 / 1e6 < rate - np.floor(rate))
            rows = np.repeat(np.arange(len(p)), copies.astype(int))
            # A text that is repeated often goes on in batches of few rows, too.
            for at in range(0, len(rows), 1_000):
                yield batch.take(pa.array(rows[at : at + 1_000]))

    return docs.mapInArrow(repeat, docs.schema)
