"""Business rules over scored candidates, for all users at once.

Candidates carry user_id, rank (retrieval order), token_id, product_id,
category and model_score. The SKUs behind a candidate are either its own
column ``units`` (an array, for lists of few), or the rows of a table keyed by
``token``: then a candidate carries the one SKU it suggests, however many its
token has. A user has at most ``rank_k`` candidates, which bounds every
per-user window here.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfstream.scale import cut, ranked_rows

DROP_REASONS = ("excluded", "no_sku", "out_of_stock", "purchased", "capped_by_category")


@dataclass(frozen=True)
class Policy:
    require_in_stock: bool = True
    exclude_purchased: bool = True
    excluded_products: tuple[str, ...] = ()
    promo_boost: float = 1.15
    price_affinity_weight: float = 0.10
    category_boost: float = 1.05
    max_per_category: int = 3
    pinned_products: tuple[str, ...] = ()
    max_total_boost: float = 1.5


@dataclass(frozen=True)
class Blend:
    """Business value of each predicted action, in one unit."""

    click: float = 0.005
    cart: float = 0.05
    purchase: float = 1.0
    return_penalty: float = 1.0


def blended(blend: Blend, click="click", cart="cart", purchase="purchase", returned="return"):
    """Expected value; return risk scales the purchase term only."""
    kept = F.greatest(F.lit(0.0), 1 - F.lit(blend.return_penalty) * F.col(returned))
    return (
        F.lit(blend.purchase) * F.col(purchase) * kept
        + F.lit(blend.cart) * F.col(cart)
        + F.lit(blend.click) * F.col(click)
    )


def in_stock(available: Column, stock: Column, store: Column) -> Column:
    """Orderable at ``store`` (any location when null); no stock feed means in stock."""
    unknown = stock.isNull() | (F.size(stock) == 0)
    anywhere = F.exists(F.map_values(stock), lambda n: n > 0)
    here = F.coalesce(F.try_element_at(stock, store), F.lit(0)) > 0
    held = F.when(unknown, F.lit(True)).when(store.isNull(), anywhere).otherwise(here)
    return F.coalesce(available, F.lit(True)) & held


def token_catalog(hierarchy: DataFrame, token: Column) -> DataFrame:
    """(token, skus, product_id): the SKU side of each model token."""
    tokens = hierarchy.withColumn("token", token)
    return tokens.groupBy("token").agg(
        F.array_sort(F.collect_set("sku")).alias("skus"),
        F.coalesce(F.min("product_id"), F.first("token")).alias("product_id"),
    )


def skus_or_token(skus: Column, token: Column) -> Column:
    """A token without catalogue entry stands for itself."""
    return F.coalesce(skus, F.array(token))


UNIT = (
    "array<struct<sku:string,price:double,list_price:double,promo_id:string,"
    "stock:map<string,int>,available:boolean>>"
)


def token_units(catalog: DataFrame, states: DataFrame) -> DataFrame:
    """Join item state once on the catalogue side: (token, product_id, units).

    ``states`` has sku, price, list_price, promo_id, stock, available. A SKU
    without state keeps nulls, which every rule reads as available.
    """
    one = catalog.select("token", "product_id", F.explode("skus").alias("sku")).join(
        states, "sku", "left"
    )
    unit = F.struct(
        *[F.col(c) for c in ("sku", "price", "list_price", "promo_id", "stock", "available")]
    )
    # Maps cannot be sorted, so the array is ordered by SKU through its key.
    units = F.array_sort(
        F.collect_list(unit),
        lambda a, b: F.when(a["sku"] < b["sku"], -1).when(a["sku"] > b["sku"], 1).otherwise(0),
    )
    return one.groupBy("token", "product_id").agg(units.cast(UNIT).alias("units"))


STATE = ("price", "list_price", "promo_id", "stock", "available")


def token_skus(hierarchy: DataFrame, token: Column, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((token, product_id), (token, sku, state columns)): what :func:`token_units` gathers, as rows."""
    tokens = hierarchy.withColumn("token", token)
    products = tokens.groupBy("token").agg(F.coalesce(F.min("product_id"), F.first("token")).alias("product_id"))
    skus = tokens.select("token", "sku").filter("sku is not null").distinct()
    return products, skus.join(states.select("sku", *STATE), "sku", "left")


def filtered(candidates: DataFrame, policy: Policy) -> DataFrame:
    """Add ``drop_reason`` (null = kept), ``available_skus`` and the ``suggested`` unit.

    Optional context columns: store_id, purchased_skus.
    """
    store = _context(candidates, "store_id", "string")
    bought = F.coalesce(_context(candidates, "purchased_skus", "array<string>"), F.array())
    units = F.coalesce("units", F.array().cast(UNIT))
    stocked = units
    if policy.require_in_stock:
        stocked = F.filter(units, lambda u: in_stock(u["available"], u["stock"], store))
    left = stocked
    if policy.exclude_purchased:
        left = F.filter(stocked, lambda u: ~F.array_contains(bought, u["sku"]))
    excluded = F.lit(False)
    if policy.excluded_products:
        excluded = F.coalesce(F.col("product_id").isin(*policy.excluded_products), F.lit(False))
    reason = (
        F.when(excluded, "excluded")
        .when(F.size(units) == 0, "no_sku")
        .when(F.size(stocked) == 0, "out_of_stock")
        .when(F.size(left) == 0, "purchased")
    )
    return candidates.withColumns(
        {
            "drop_reason": reason,
            "available_skus": F.transform(left, lambda u: u["sku"]),
            "suggested": F.get(left, F.lit(0)),
        }
    )


def filtered_by_rows(candidates: DataFrame, skus: DataFrame, owned: DataFrame, policy: Policy) -> DataFrame:
    """:func:`filtered` with the SKUs as rows: ``skus`` has token, sku and state, ``owned`` user_id and sku.

    A token's SKUs in stock are numbered once per store that asks for them, as
    far as anyone needs them: who owns m SKUs gets one of the first m + 1. Most
    users own none of them and get the first; for the others the first number
    that is missing among those they own is looked up. So no row holds a
    token's SKUs, and the work grows with candidates, SKUs and purchases. A
    token without rows stands for itself. Optional context column: store_id.
    """
    store = _context(candidates, "store_id", "string")
    # A key without nulls: no store is a group of its own. The joins below read the candidates four times.
    rows = cut(candidates.withColumn("_at", F.coalesce(F.concat(F.lit("="), store), F.lit(""))))
    asked = rows.select("token", "_at").distinct()
    here = F.when(F.col("_at") != "", F.expr("substring(_at, 2)"))
    units = asked.join(skus, "token", "left").withColumn("sku", F.coalesce("sku", "token"))
    if policy.require_in_stock:
        units = units.filter(in_stock(F.col("available"), F.col("stock"), here))
    unit = F.struct("sku", *STATE).alias("_unit")
    most, mine = 0, None
    if policy.exclude_purchased:
        mine = cut(owned.select("user_id", "sku").distinct().join(rows.select("user_id", "_at").distinct(), "user_id"))
        most = mine.groupBy("user_id", "_at").count().agg(F.max("count")).first()[0] or 0
    numbered = cut(_numbered(units.select("token", "_at", "sku", unit), most + 1))
    first = numbered.filter("_no = 1").select("token", "_at", F.col("_unit").alias("_first"))
    checked = rows.join(first, ["token", "_at"], "left")
    suggested = F.col("_first")
    if policy.exclude_purchased:
        later = _first_not_owned(mine, numbered)
        checked = checked.join(later, ["user_id", "token", "_at"], "left")
        suggested = F.when(F.col("_owns"), F.col("_later")).otherwise(suggested)
    excluded = F.lit(False)
    if policy.excluded_products:
        excluded = F.coalesce(F.col("product_id").isin(*policy.excluded_products), F.lit(False))
    reason = (
        F.when(excluded, "excluded")
        .when(F.col("_first").isNull(), "out_of_stock")
        .when(F.col("suggested").isNull(), "purchased")
    )
    return checked.withColumn("suggested", suggested).withColumn("drop_reason", reason).drop(
        "_at", "_first", "_later", "_owns"
    )


# Up to so many SKUs of a token every input partition keeps its first ones for itself.
FEW = 1_000


def _numbered(units: DataFrame, least: int) -> DataFrame:
    """``units`` with ``_no``, their number by SKU per token and store; at least the first ``least`` of each."""
    keys = ["token", "_at"]
    if least > FEW:
        return ranked_rows(units, keys, ["sku"], "_no")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("sku"))
    # The limit holds before the shuffle, so a token with very many SKUs brings few to its task.
    return units.withColumn("_no", number.cast("long")).filter(F.col("_no") <= least)


def _first_not_owned(mine: DataFrame, numbered: DataFrame) -> DataFrame:
    """(user_id, token, _at, _later, _owns) of users who own a numbered SKU; ``_later`` is null if they own all.

    ``mine`` has (user_id, _at, sku), what each user owns.
    """
    held = mine.join(numbered.select("token", "_at", "sku", "_no"), ["sku", "_at"])
    keys = ["user_id", "token", "_at"]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_no"))
    gaps = held.withColumn("_nth", nth).groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("_no") != F.col("_nth"), F.col("_nth"))), F.count("*") + 1).alias("_no")
    )
    units = numbered.select("token", "_at", "_no", F.col("_unit").alias("_later"))
    return gaps.join(units, ["token", "_at", "_no"], "left").drop("_no").withColumn("_owns", F.lit(True))


def _context(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def adjusted(kept: DataFrame, policy: Policy) -> DataFrame:
    """Bounded multiplicative adjustments of the model score.

    Optional context columns: price_affinity, session_categories.
    """
    unit = F.col("suggested")
    promo = F.coalesce(unit["promo_id"] != "", F.lit(False))
    affinity = _context(kept, "price_affinity", "double")
    priced = affinity.isNotNull() & (unit["price"] != 0) & (unit["list_price"] != 0)
    relative = F.least(
        unit["price"] / F.greatest(unit["list_price"], F.lit(1e-6)), F.lit(2.0)
    )
    close = F.greatest(1 - F.abs(relative - affinity), F.lit(-1.0))
    price_factor = F.when(priced, 1 + F.lit(policy.price_affinity_weight) * close).otherwise(1.0)
    shopping = F.coalesce(
        F.array_contains(_context(kept, "session_categories", "array<string>"), F.col("category"))
        & (F.col("category") != ""),
        F.lit(False),
    )
    boost = (
        F.when(promo, F.lit(policy.promo_boost)).otherwise(1.0)
        * price_factor
        * F.when(shopping, F.lit(policy.category_boost)).otherwise(1.0)
    )
    return kept.withColumns(
        {
            "boost": F.least(boost, F.lit(policy.max_total_boost)),
            "promoted": promo,
            "reason_code": F.when(promo, "promotion").otherwise("relevance"),
        }
    ).withColumn("final_score", F.col("model_score") * F.col("boost"))


def finalised(scored: DataFrame, policy: Policy, limit: int) -> DataFrame:
    """Order, cap per category, refill from what the cap held back, pin.

    Adds ``position`` (0-based, null when not shown), ``capped`` and ``pinned``.
    """
    best = [F.desc("final_score"), F.asc("rank")]
    mine = Window.partitionBy("user_id")
    shelf = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("_unknown"))
    rows = scored.withColumn("_shelf", shelf)
    if policy.max_per_category:
        per_shelf = Window.partitionBy("user_id", "_shelf").orderBy(*best)
        over = F.row_number().over(per_shelf) > policy.max_per_category
    else:
        over = F.lit(False)
    rows = rows.withColumn("_over", over)
    before = mine.orderBy(*best).rowsBetween(Window.unboundedPreceding, -1)
    placed = F.coalesce(F.sum(F.when(~F.col("_over"), 1).otherwise(0)).over(before), F.lit(0))
    # An item counts as capped only if the list was not already full when it came up.
    rows = rows.withColumn("capped", F.col("_over") & (placed < limit))
    slot = F.row_number().over(mine.orderBy(F.asc("_over"), *best))
    rows = rows.withColumn("_slot", slot).withColumn("_shown", F.col("_slot") <= limit)
    pin = F.lit(None).cast("int")
    if policy.pinned_products:
        pins = F.create_map(
            *[x for i, p in enumerate(policy.pinned_products) for x in (F.lit(p), F.lit(i))]
        )
        pin = F.when(F.col("_shown"), pins[F.col("product_id")])
    rows = rows.withColumn("_pin", pin)
    # One item per pinned product moves up; further items of that product make room.
    first = Window.partitionBy("user_id", "_pin").orderBy("_slot")
    twin = F.col("_pin").isNotNull() & (F.row_number().over(first) > 1)
    rows = rows.withColumn("_shown", F.col("_shown") & ~twin)
    final = F.row_number().over(
        mine.orderBy(F.desc("_shown"), F.asc_nulls_last("_pin"), F.asc("_slot"))
    )
    return rows.withColumns(
        {
            "position": F.when(F.col("_shown"), final - 1),
            "pinned": F.col("_shown") & F.col("_pin").isNotNull(),
        }
    ).withColumn(
        "reason_code",
        F.when(F.col("pinned"), "merchandising").otherwise(F.col("reason_code")),
    ).drop("_shelf", "_over", "_slot", "_pin", "_shown")


def applied(
    candidates: DataFrame, policy: Policy, limit: int, skus: DataFrame | None = None, owned: DataFrame | None = None
) -> DataFrame:
    """All stages. Dropped candidates stay, with their reason and no position.

    With ``skus`` and ``owned`` see :func:`filtered_by_rows`, else :func:`filtered`.
    """
    if skus is None:
        checked = filtered(candidates, policy)
    else:
        # Read by the kept and by the dropped rows.
        checked = cut(filtered_by_rows(candidates, skus, owned, policy))
    kept = finalised(adjusted(checked.filter("drop_reason is null"), policy), policy, limit)
    return kept.unionByName(checked.filter("drop_reason is not null"), allowMissingColumns=True)


def trace(decided: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Why lists look the way they do: counts per reason."""
    reason = F.col("drop_reason")
    return decided.groupBy(*by).agg(
        F.count("*").alias("candidates_in"),
        *[
            F.count_if(reason == r).alias(f"dropped_{r}")
            for r in ("excluded", "no_sku", "out_of_stock", "purchased")
        ],
        F.count_if(F.coalesce("capped", F.lit(False))).alias("capped_by_category"),
        F.count_if(F.coalesce("promoted", F.lit(False))).alias("promoted"),
        F.count_if(F.coalesce("pinned", F.lit(False))).alias("pinned"),
        F.count("position").alias("items_out"),
    )


def excludes_seen(surface: Column, setting: bool | Mapping[str, bool] = True) -> Column:
    """Whether a surface hides items the user already met."""
    if isinstance(setting, bool):
        return F.lit(setting)
    default = F.lit(bool(setting.get("default", True)))
    named = [x for k, v in setting.items() for x in (F.lit(k), F.lit(bool(v)))]
    if not named:
        return default
    return F.coalesce(F.create_map(*named)[surface], default)
