"""Policy over SKU rows: the same decisions as over arrays, without a token's SKUs in a candidate."""

from pyspark.sql import functions as F

from shelfstream.operators import policy as P

SKU = "token string, sku string, price double, list_price double, promo_id string, stock map<string,int>, available boolean"


def test_rows_and_arrays_decide_alike(spark):
    skus = [("hot", f"h{i:03d}", 9.0, 10.0, None, {"A": i % 3, "B": i % 2}, i % 11 != 0) for i in range(300)]
    skus += [("gone", "g1", 9.0, 10.0, None, {"A": 0}, True), ("one", "o1", 9.0, 10.0, "x", None, None)]
    stocked = [s[1] for s in skus[:300] if s[6] and s[5]["A"] > 0]
    owned = [("first", stocked[0]), ("first", stocked[0]), ("gap", stocked[1]), ("run", stocked[0]), ("run", stocked[1]),
             ("run", stocked[3]), ("other", "h000"), ("other", "o1"), ("lone", "lonely"), ("lone", "o1")]
    owned += [("all", s) for s in stocked]
    users = [(u, s) for u in ("first", "gap", "run", "other", "lone", "all", "none") for s in ("A", "B", None, "nowhere")]
    tokens = [("hot", "p"), ("gone", "p"), ("one", "p"), ("lonely", "p"), ("one", "banned")]
    rows = [(f"{u}", s, t, p, i) for u, s in users for i, (t, p) in enumerate(tokens)]
    candidates = spark.createDataFrame(rows, "user_id string, store_id string, token string, product_id string, rank int")
    table = spark.createDataFrame(skus, SKU)
    owned = spark.createDataFrame(owned, "user_id string, sku string")
    unit = F.struct("sku", *P.STATE)
    units = table.groupBy("token").agg(
        F.array_sort(F.collect_list(unit), lambda a, b: F.when(a["sku"] < b["sku"], -1).otherwise(1)).alias("units")
    )
    alone = F.array(F.struct(F.col("token").alias("sku"), F.lit(None).cast("double").alias("price"),
                             F.lit(None).cast("double").alias("list_price"), F.lit(None).cast("string").alias("promo_id"),
                             F.lit(None).cast("map<string,int>").alias("stock"), F.lit(None).cast("boolean").alias("available")))
    wide = candidates.join(units, "token", "left").withColumn("units", F.coalesce("units", alone.cast(P.UNIT))).join(
        owned.groupBy("user_id").agg(F.collect_set("sku").alias("purchased_skus")), "user_id", "left"
    )
    keys = ["user_id", "store_id", "token", "product_id", "rank", "drop_reason", "suggested.sku", "suggested.promo_id"]
    for policy in (P.Policy(excluded_products=("banned",)), P.Policy(exclude_purchased=False), P.Policy(require_in_stock=False)):
        narrow = P.filtered_by_rows(candidates, table, owned, policy)
        found = sorted(map(repr, narrow.select(*keys).collect()))
        assert found == sorted(map(repr, P.filtered(wide, policy).select(*keys).collect()))
        assert len(found) == len(rows)


def test_a_candidate_does_not_hold_the_skus_of_its_token(spark, folder):
    # It did: a token of so many SKUs met each of its candidates with all of them.
    from workload import q_policy as Q
    from workload.views import view_for

    v = view_for(spark, folder)
    for df in (Q._candidates(v), Q._filtered(v, Q.POLICY), Q._applied(v)):
        assert not [c for c, kind in df.dtypes if kind.startswith("array") and c != "session_categories"]


def test_only_the_skus_that_someone_needs_are_numbered(spark):
    # All were: a token of very many SKUs was sorted as a whole, and stored with its numbers.
    units = spark.range(900).select(
        F.lit("hot").alias("token"), F.lit("").alias("_at"), F.format_string("%04d", F.col("id")).alias("sku")
    )
    for least, kept in ((3, 3), (P.FEW + 1, 900)):
        found = sorted((r["_no"], r["sku"]) for r in P._numbered(units.repartition(5), least).collect())
        assert found == [(i + 1, f"{i:04d}") for i in range(kept)]


def test_a_user_who_owns_more_than_few_skus(spark, monkeypatch):
    monkeypatch.setattr(P, "FEW", 3)
    skus = spark.createDataFrame([("t", f"s{i}", 1.0, 1.0, None, None, True) for i in range(9)], SKU)
    owned = spark.createDataFrame([("u", f"s{i}") for i in range(7)] + [("w", "s1")], "user_id string, sku string")
    candidates = spark.createDataFrame([("u", "t", "p"), ("w", "t", "p")], "user_id string, token string, product_id string")
    found = P.filtered_by_rows(candidates, skus, owned, P.Policy()).select("user_id", "suggested.sku").collect()
    assert sorted(map(tuple, found)) == [("u", "s7"), ("w", "s0")]


def test_filters_do_not_build_what_only_scores_read(spark, folder, monkeypatch):
    # The clicks were joined with the catalogue and a list of categories was stored with every candidate.
    from workload.registry import QUERIES

    stored, store = [], P.cut
    monkeypatch.setattr(P, "cut", lambda df: stored.append(df.columns) or store(df))
    rows = QUERIES["pol3_filters"](spark, folder)
    assert stored and not any({"session_categories", "price_affinity"} & set(columns) for columns in stored)
    assert any("store_id" in columns for columns in stored) and rows.count() > 0
