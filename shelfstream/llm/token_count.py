"""Token counts without token ids: pieces per distinct pre-token, joined to document frequencies."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfstream.llm.common import POSTINGS, frequent, postings, raw_texts, token_counts
from shelfstream.scale import cut

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
# Pre-tokens whose piece counts are broadcast (some 20 bytes each); the others are joined by a shuffle.
FREQUENT = 400_000

# The library writes white space U+0020 as U+2581 and puts one in front of a
# text. No piece holds it behind another character, and none holds a newline,
# so no merge crosses the borders between these parts.
PRE_TOKEN = re.compile(rb" *[^ \n]+| +|\n")


def pre_tokens(text: bytes) -> list[bytes]:
    """The parts of a text that are tokenised independently; none for an empty text."""
    return PRE_TOKEN.findall(b" " + text.replace("▁".encode(), b" ")) if text else []


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_counter(path: str):
    """bytes -> number of pieces, for a part in the middle of a text.

    A newline in front keeps the library from putting white space before the
    part; its own pieces are taken off.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    base = len(model.encode("\n"))

    def count(parts: list[bytes]) -> list[int]:
        texts = ["\n" + p.decode("utf-8", "replace") for p in parts]
        return [len(ids) - base for ids in model.encode(texts, num_threads=1)]

    return count


def piece_counts(tokens: DataFrame, path: str | None) -> DataFrame:
    """(token, pieces) for a frame of distinct pre-tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_counter(path or model_path())
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.column(0).slice(at, 2_000)
                yield pa.RecordBatch.from_arrays(
                    [part, pa.array(pieces(part.to_pylist()), pa.int64())], ["token", "pieces"]
                )

    return tokens.select("token").mapInArrow(count, "token binary, pieces long")


def count_tokens(
    docs: DataFrame, path: str | None = None, limit: int = LIMIT, head: int = FREQUENT
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document.

    Null and empty texts have no bytes and no tokens. Whole texts count; a text
    without white space is one pre-token. Repeated rows are counted each for
    itself, a null doc_id stays null, an empty table gives no rows.

    One pass finds the frequent pre-tokens; which of them are found changes
    the route of a pre-token, never a count. Their piece counts are broadcast
    (``head`` bounds them). The second pass sums them within each document and
    lists the rare ones with their frequencies; those are joined to the piece
    counts of the distinct rare pre-tokens and summed per document.
    """
    spark = docs.sparkSession
    common = frequent(cut(token_counts(docs, pre_tokens, least=3)), head)
    known = piece_counts(common, path).toArrow()
    table = spark.sparkContext.broadcast(
        dict(zip(known["token"].to_pylist(), known["pieces"].to_pylist(), strict=True))
    )

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = table.value
        for batch in batches:
            sizes, sums, rare = [], [], []
            for text in raw_texts(batch.column("text")):
                total, rest = 0, []
                for part in pre_tokens(text):
                    n = pieces.get(part)
                    if n is None:
                        rest.append(part)
                    else:
                        total += n
                sizes.append(len(text))
                sums.append(total)
                rare.append(Counter(rest))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(sizes, pa.int64()),
                 pa.array(sums, pa.int64()), postings(rare)],
                ["row", "doc_id", "n_bytes", "common", "rare"],
            )

    # The row number is stored with the row, so later reads agree on it.
    weighed = cut(
        docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
        .mapInArrow(weigh, f"row long, doc_id long, n_bytes long, common long, rare {POSTINGS}")
    )
    rare = weighed.select("row", F.explode("rare").alias("p")).select("row", "p.token", "p.n")
    rest = (
        rare.join(piece_counts(rare.select("token").distinct(), path), "token")
        .groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("rest"))
    )
    total = F.col("common") + F.coalesce("rest", F.lit(0))
    return (
        weighed.drop("rare").join(rest, "row", "left")
        .select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
    )
