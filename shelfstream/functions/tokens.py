"""From purchasable unit to model token, by category."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Granularity levels and the catalogue column behind each.
LEVELS = {"sku": "sku", "style_color": "style_color_id", "product": "product_id"}


@dataclass(frozen=True)
class TokenRules:
    """``default`` and per-category rules; a rule is ``(level, [attribute, ...])``."""

    default: tuple[str, tuple[str, ...]] = ("sku", ())
    by_category: Mapping[str, tuple[str, tuple[str, ...]]] = field(default_factory=dict)

    @classmethod
    def of(cls, default="sku", by_category: Mapping | None = None) -> TokenRules:
        return cls(
            _rule(default), {str(c).lower(): _rule(r) for c, r in (by_category or {}).items()}
        )


def _rule(raw) -> tuple[str, tuple[str, ...]]:
    if isinstance(raw, str):
        level, attributes = raw, ()
    elif isinstance(raw, Mapping):
        level, attributes = raw.get("level", "sku"), tuple(raw.get("plus_attributes") or ())
    elif isinstance(raw, Sequence):
        level, attributes = raw[0], tuple(raw[1])
    else:
        raise ValueError(f"not a granularity rule: {raw!r}")
    if level not in LEVELS:
        raise ValueError(f"unknown granularity level {level!r}; expected one of {sorted(LEVELS)}")
    return level, attributes


def uniform(level: str) -> TokenRules:
    """One level for every category."""
    return TokenRules.of(level)


def describe(rules: TokenRules) -> dict[str, str]:
    """Readable form of the rules, one line per category."""

    def text(rule):
        return rule[0] + (" + " + ",".join(rule[1]) if rule[1] else "")

    lines = {"_default": rules.default[0]}
    lines.update({c: text(rules.by_category[c]) for c in sorted(rules.by_category)})
    return lines


def _token_under(rule: tuple[str, tuple[str, ...]]) -> Column:
    level, attributes = rule
    parts = [F.coalesce(F.col(LEVELS[level]).cast("string"), F.col("sku").cast("string"))]
    for name in attributes:
        # concat is null when the attribute is, and concat_ws skips nulls.
        parts.append(F.concat(F.lit(f"{name}="), F.element_at("attributes", name)))
    return F.concat_ws("|", *parts) if attributes else parts[0]


def token(rules: TokenRules) -> Column:
    """Token of a row with sku, style_color_id, product_id, category, attributes."""
    category = F.lower(F.coalesce(F.col("category").cast("string"), F.lit("")))
    cases = None
    for name, rule in rules.by_category.items():
        value = _token_under(rule)
        cases = (
            F.when(category == name, value)
            if cases is None
            else cases.when(category == name, value)
        )
    fallback = _token_under(rules.default)
    return fallback if cases is None else cases.otherwise(fallback)
