"""Action vocabulary: ids, commitment order, heads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ids are stored in tables, so entries are only ever appended.
ACTION_ID = {
    "view": 1,
    "click": 2,
    "add_to_cart": 3,
    "remove_from_cart": 4,
    "purchase": 5,
    "return": 6,
}
PADDING_ACTION = 0
UNKNOWN_ACTION = 7

# How strongly an action commits the customer, weakest first.
COMMITMENT = {
    "remove_from_cart": 0,
    "return": 1,
    "view": 2,
    "click": 3,
    "add_to_cart": 4,
    "purchase": 5,
}

# The actions that count as a positive for each predicted action.
HEAD_ACTIONS = {
    "click": ("click", "add_to_cart", "purchase"),
    "cart": ("add_to_cart", "purchase"),
    "purchase": ("purchase",),
}
HEADS = ("click", "cart", "purchase", "return")

# Return label codes.
NOT_A_PURCHASE = -1
IMMATURE = -2
KEPT = 0
RETURNED = 1


def lookup(table: dict, key: Column, default) -> Column:
    """Literal-map lookup with a default for missing keys."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(default))


def action_id(name: Column) -> Column:
    return lookup(ACTION_ID, name, UNKNOWN_ACTION)


def action_ids(names: Column) -> Column:
    """Array of names to array of ids; an unknown name becomes one reserved id."""
    return F.transform(F.coalesce(names, F.array()), lambda a: action_id(a))


def commitment(name: Column) -> Column:
    return lookup(COMMITMENT, name, -1)


def action_of_commitment(rank: Column) -> Column:
    return lookup({r: ACTION_ID[n] for n, r in COMMITMENT.items()}, rank, PADDING_ACTION)


def head_action_ids(head: str) -> list[int]:
    return [ACTION_ID[name] for name in HEAD_ACTIONS[head]]
