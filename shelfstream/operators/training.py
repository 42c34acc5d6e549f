"""Training examples cut from sequence rows; every step is local to a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfstream.functions import actions as A
from shelfstream.functions import scalars as S
from shelfstream.scale import hash_uint32

ARRAYS = ("input_tokens", "input_actions", "input_ts", "input_returned")


def valid_positions(rows: DataFrame, vocab_size: int) -> DataFrame:
    """Drop padding and out-of-range ids from all parallel arrays at once."""
    names = [c for c in ARRAYS if c in rows.columns]
    kept = F.filter(
        F.arrays_zip(*names),
        lambda e: (e["input_tokens"] > 0) & (e["input_tokens"] < vocab_size),
    )
    zipped = rows.withColumn("_e", kept)
    return zipped.select(
        *[c for c in rows.columns if c not in names],
        *[F.col("_e")[name].alias(name) for name in names],
    )


def windows(
    rows: DataFrame, max_len: int, stride: int, keep_oldest: bool = True, parallel: bool = False
) -> DataFrame:
    """Overlapping windows of ``max_len + 1`` events anchored at the newest one.

    Shorter histories and, with ``keep_oldest``, the oldest partial window are
    padded on the left. ``parallel`` also cuts actions and times.
    """
    span = max_len + 1
    n = F.size("input_tokens")
    oldest = F.pmod(n - span, F.lit(stride))
    whole = F.transform(
        F.sequence(n - span, oldest, F.lit(-stride)),
        lambda s: F.struct(s.alias("start"), F.lit(span).alias("length")),
    )
    short = F.array(F.struct(F.lit(0).alias("start"), n.alias("length")))
    none = F.expr("cast(array() as array<struct<start:int,length:int>>)")
    tail = F.least(oldest, F.lit(span))
    partial = F.when(
        tail >= 2,
        F.array(F.struct((oldest - tail).alias("start"), tail.alias("length"))),
    ).otherwise(none)
    plan = F.when(n <= span, short).otherwise(
        F.concat(whole, partial) if keep_oldest else whole
    )
    cut = rows.filter(n >= 2).select("*", F.inline(plan))

    def piece(name):
        return F.slice(name, F.col("start") + 1, F.col("length"))

    columns = ["user_id", "start", "length"]
    columns.append(S.left_pad(piece("input_tokens"), span, F.lit(0)).alias("tokens"))
    if parallel:
        first = F.element_at(piece("input_ts"), 1)
        columns.append(S.left_pad(piece("input_actions"), span, F.lit(0)).alias("actions"))
        columns.append(S.left_pad(piece("input_ts"), span, first).alias("times"))
    return cut.select(*columns)


def padded_history(rows: DataFrame, n: int, cut: str | None = None) -> DataFrame:
    """Left-padded last ``n`` events; ``cut`` names the last position to keep.

    Times are padded with the first kept time so that no artificial gap
    appears.
    """

    def tail(name):
        values = F.slice(name, F.lit(1), F.col(cut) + 1) if cut else F.col(name)
        return S.last_n(values, n)

    first = F.coalesce(F.get(tail("input_ts"), F.lit(0)), F.lit(0).cast("long"))
    return rows.select(
        "user_id",
        S.left_pad(tail("input_tokens"), n, F.lit(0)).alias("tokens"),
        S.left_pad(tail("input_actions"), n, F.lit(0)).alias("actions"),
        S.left_pad(tail("input_ts"), n, first).alias("times"),
        S.left_pad(tail("input_returned"), n, F.lit(-1)).alias("returned"),
    )


def head_label(head: str, action: Column, returned: Column) -> Column:
    if head == "return":
        return (returned == A.RETURNED).cast("int")
    return action.isin(*A.head_action_ids(head)).cast("int")


def head_mask(head: str, action: Column, returned: Column) -> Column:
    """1 where the label carries information."""
    if head == "return":
        return returned.isin(A.KEPT, A.RETURNED).cast("int")
    return (action > 0).cast("int")


def head_labels(rows: DataFrame) -> DataFrame:
    """Long form (user, position, token, head, label): one row per usable label."""
    events = rows.select(
        "user_id",
        F.posexplode(F.arrays_zip("input_tokens", "input_actions", "input_returned")).alias(
            "position", "e"
        ),
    )
    cells = [
        F.struct(
            F.lit(head).alias("head"),
            head_label(head, F.col("e.input_actions"), F.col("e.input_returned")).alias("label"),
            head_mask(head, F.col("e.input_actions"), F.col("e.input_returned")).alias("mask"),
        )
        for head in A.HEADS
    ]
    return (
        events.select(
            "user_id",
            "position",
            F.col("e.input_tokens").alias("token_id"),
            F.inline(F.array(*cells)),
        )
        .filter("mask = 1")
        .drop("mask")
    )


def uniform_draw(user: Column, i: Column, vocab_size: int, seed: int) -> Column:
    """A repeatable uniform token id in [1, vocab_size)."""
    return (F.pmod(hash_uint32(user, i, seed=f"{seed}u"), F.lit(vocab_size - 1)) + 1).cast("int")


def negatives(
    rows: DataFrame,
    vocab_size: int,
    count: int,
    hard_share: float = 0.0,
    seed: int = 0,
    positive: Column | None = None,
) -> DataFrame:
    """Sampled negatives per row: a mix of the row's ``pool`` and uniform draws.

    An empty or padded pool slot falls back to the uniform draw. ``mask`` is 0
    where a draw equals the positive, so the label is not contradicted.
    """
    hard = min(count, round(count * hard_share)) if "pool" in rows.columns else 0
    positive = F.element_at("input_tokens", -1) if positive is None else positive
    user = F.col("user_id")

    def draw(i):
        flat = uniform_draw(user, i, vocab_size, seed)
        if not hard:
            return flat
        size = F.greatest(F.size("pool"), F.lit(1))
        picked = F.get("pool", F.pmod(hash_uint32(user, i, seed=f"{seed}p"), size).cast("int"))
        return F.when((i < hard) & (F.coalesce(picked, F.lit(0)) > 0), picked).otherwise(flat)

    drawn = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), draw)
    return (
        rows.withColumn("positive", positive)
        .withColumn("negatives", drawn)
        .withColumn(
            "mask", F.transform("negatives", lambda x: (x != F.col("positive")).cast("int"))
        )
    )


def unseen_cut(rows: DataFrame, seed: int = 0) -> DataFrame:
    """Choose an event whose item is new to the user as the one to predict.

    Adds ``cut`` (0-based position) and ``is_fallback``: no such event exists
    and the last one is used.
    """
    n = F.size("input_tokens")
    first_time = F.filter(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: (i < n)
        & (F.array_position("input_tokens", F.get("input_tokens", i)) == i + 1),
    )
    marked = rows.withColumn("_new", first_time)
    size = F.greatest(F.size("_new"), F.lit(1))
    pick = F.get("_new", F.pmod(hash_uint32("user_id", seed=f"{seed}c"), size).cast("int"))
    return (
        marked.withColumn("is_fallback", F.size("_new") == 0)
        .withColumn("cut", F.coalesce(pick, F.greatest(n - 1, F.lit(0))))
        .drop("_new")
    )


def repeat_share(rows: DataFrame) -> DataFrame:
    """How many targets the user had already met, over all rows."""
    both = F.size(F.array_intersect("target_tokens", "input_tokens"))
    total = F.sum(F.size(F.array_distinct("target_tokens")))
    return rows.agg(
        F.count("*").alias("users"),
        total.alias("target_items"),
        F.sum(both).alias("excluded_as_seen"),
        (total - F.sum(both)).alias("reachable"),
    ).withColumn("excluded_share", F.round(F.try_divide("excluded_as_seen", "target_items"), 4))


def size_affinity(
    events: DataFrame,
    hierarchy: DataFrame,
    categories: tuple[str, ...],
    fit_reasons: tuple[str, ...],
) -> DataFrame:
    """Preferred size per (user, category) from purchases that were not fit returns."""
    keys = ["user_id", "order_id", "sku"]
    misfits = events.filter(
        (F.col("event_type") == "return") & F.lower("return_reason").isin(*fit_reasons)
    ).select(*keys)
    sized = hierarchy.select(
        "sku", F.lower("category").alias("category"), F.element_at("attributes", "size").alias("size")
    ).filter(F.col("category").isin(*categories) & F.col("size").isNotNull())
    kept = events.filter("event_type = 'purchase'").join(misfits, keys, "left_anti")
    counts = (
        kept.join(sized, "sku").groupBy("user_id", "category", "size").agg(F.count("*").alias("n"))
    )
    # Equal counts go to the smaller size text.
    first = F.min(F.struct((-F.col("n")).alias("n"), "size"))
    return (
        counts.groupBy("user_id", "category")
        .agg(first.alias("f"), F.sum("n").alias("kept_purchases"))
        .select(
            "user_id",
            "category",
            F.col("f.size").alias("size"),
            (-F.col("f.n")).alias("size_purchases"),
            "kept_purchases",
        )
    )
