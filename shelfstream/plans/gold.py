"""Silver to gold: vocabulary and sequences of one or more granularity variants."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from shelfstream.functions.tokens import TokenRules
from shelfstream.operators import cleaning as C
from shelfstream.operators import sequences as Q
from shelfstream.scale import cut
from shelfstream.sources.tables import Warehouse


@dataclass(frozen=True)
class SequenceRules:
    max_len: int = 200
    train: float = 0.8
    val: float = 0.1
    min_input: int = 3
    target_types: Sequence[str] = ()
    return_window_days: int = 30
    approximate: float = 0.0
    # Sequences are training data: apply the stricter purpose here.
    consumer: str | None = "training"


def labelled_events(
    events: DataFrame, items: DataFrame, tokens: TokenRules, rules: SequenceRules
) -> tuple[DataFrame, int, int]:
    """Events with token and return label, and the two time cutoffs.

    The events are stored once, with their token and the evidence of a return;
    the cutoffs read one column of that table, and the label, which needs the
    newest time, is a column over it. So callers need not store them again.
    """
    if rules.consumer and "consent" in events.columns:
        events = C.consented(events, rules.consumer)
    tokened = cut(Q.with_tokens(Q.with_return_evidence(events), items, tokens))
    t1, t2, newest = Q.time_cutoffs(tokened, rules.train, rules.val, rules.approximate)
    return Q.label_returns(tokened, rules.return_window_days, newest), t1, t2


def run(
    warehouse: Warehouse,
    variant: str,
    tokens: TokenRules,
    rules: SequenceRules = SequenceRules(),
) -> dict:
    events = warehouse.read("silver.interactions")
    items = warehouse.read("silver.item_hierarchy")
    # Read by the vocabulary, the three splits and the report; stored by labelled_events.
    labelled, t1, t2 = labelled_events(events, items, tokens, rules)
    vocab_table, rows_table = f"gold.vocab_{variant}", f"gold.sequences_{variant}"
    # Written and read back: the ids are fixed before anything depends on them,
    # and Catalyst knows the size of the stored table when it plans the joins.
    warehouse.write(vocab_table, Q.vocabulary(C.in_window(labelled, None, t1)), partition_by=[])
    vocab = warehouse.read(vocab_table)
    rows = Q.sequence_rows(
        labelled, vocab, t1, t2, rules.max_len, rules.min_input, rules.target_types
    )
    warehouse.write(rows_table, rows)
    report = Q.sparsity(labelled, vocab, t1).first().asDict()
    users = {r["split"]: r["users"] for r in Q.users_per_split(warehouse.read(rows_table)).collect()}
    report.update(
        variant=variant,
        cutoff_train_end_unix=t1,
        cutoff_val_end_unix=t2,
        **{f"{split}_users": users.get(split, 0) for split in ("train", "val", "test")},
    )
    return report


def run_variants(
    warehouse: Warehouse, variants: Mapping[str, TokenRules], rules: SequenceRules = SequenceRules()
) -> DataFrame:
    """Several granularities side by side, one report row each."""
    reports = [run(warehouse, name, tokens, rules) for name, tokens in variants.items()]
    return warehouse.spark.createDataFrame(reports)
