"""The bootstrap's tails hold every interaction the query counts."""

from pyspark.sql import functions as F


def test_users_with_few_known_types_keep_their_tails(spark, folder, tmp_path):
    # Sign-ups and errors were rejected; that showed only where fewer than 20 other events were left.
    from workload import load_all
    from workload.registry import QUERIES

    load_all()
    kinds = F.array(*[F.lit(k) for k in ("signup", "error", "click", "signup", "error", "view")])
    events = spark.read.parquet(f"{folder}/events.parquet").filter("event_id < 18").withColumns({
        "user_id": F.floor(F.col("event_id") / 6).cast("long"),
        "event_type": F.element_at(kinds, (F.col("event_id") % 6 + 1).cast("int")),
    })
    events.write.parquet(f"{tmp_path}/events.parquet")
    spark.read.parquet(f"{folder}/part.parquet").write.parquet(f"{tmp_path}/part.parquet")
    row = QUERIES["str9_bootstrap_order"](spark, str(tmp_path)).first()
    assert (row.users, row.entries) == (3, 18)
