"""Helpers that must be exact on skewed data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfstream import scale as SC
from shelfstream.operators import sessions as SE


def skewed(spark, n=6000):
    # One user holds a third of all rows, and a third share one timestamp.
    return spark.range(n).select(
        F.col("id").cast("string").alias("event_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("user_id"),
        F.when(F.col("id") % 9 < 3, 1000).otherwise(F.pmod(F.col("id") * 7919, F.lit(5003))).alias(
            "event_ts_unix"
        ),
    ).withColumn("event_ts", F.timestamp_seconds("event_ts_unix"))


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(size=400), np.full(300, 0.25), rng.exponential(size=300) * 1e6])
    df = spark.createDataFrame([(float(v), "a" if i % 3 else "b") for i, v in enumerate(values)], "v double, g string")
    probabilities = [0.0, 0.1, 0.5, 0.9, 0.95, 1.0]
    whole = SC.exact_quantiles(df, "v", probabilities)[None]
    assert np.allclose(whole, np.quantile(values, probabilities), rtol=1e-12)
    grouped = SC.exact_quantiles(df, "v", probabilities, by="g")
    for name in "ab":
        mine = [v for i, v in enumerate(values) if ("a" if i % 3 else "b") == name]
        assert np.allclose(grouped[name], np.quantile(mine, probabilities), rtol=1e-12)


def test_order_statistics_ignore_missing_values(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    assert SC.order_statistics(df, "v", lambda n: {0, n - 1})[None] == (2, {0: 1.0, 1: 3.0})


def test_order_statistics_take_infinite_values_and_ties(spark):
    values = [1.0, 2.0, 2.0, 2.0, 5.0, float("inf"), float("-inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    n, found = SC.order_statistics(df, "v", range)[None]
    assert n == 7 and [found[k] for k in range(7)] == sorted(values)


def test_order_statistics_keep_every_group(spark):
    df = spark.range(60_000).select((F.col("id") % 25_000).alias("g"), F.col("id").alias("v"))
    found = SC.order_statistics(df, "v", lambda n: {0}, by="g")
    assert len(found) == 25_000 and all(found[str(g)][1][0] == g for g in range(0, 25_000, 997))


def test_event_rank_with_a_hot_user(spark):
    df = skewed(spark)
    got = {(r.user_id, r.event_id): r.event_rank for r in SE.event_rank(df).collect()}
    rows = sorted((r.user_id, r.event_ts_unix, r.event_id) for r in df.collect())
    seen: dict = {}
    for user, _, event in rows:
        seen[user] = seen.get(user, 0) + 1
        assert got[(user, event)] == seen[user]


def test_sessions_with_a_hot_user(spark):
    df = skewed(spark)
    got = {r.event_id: r.session_id for r in SE.sessionise(df, 3).collect()}
    last: dict = {}
    number: dict = {}
    for user, ts, event in sorted((r.user_id, r.event_ts_unix, r.event_id) for r in df.collect()):
        if user not in last or ts - last[user] > 3:
            number[user] = number.get(user, 0) + 1
        last[user] = ts
        assert got[event] == f"{user}#{number[user]}"


def test_gap_exactly_at_the_limit_stays_in_the_session(spark):
    df = spark.createDataFrame(
        [("u", "a", 0), ("u", "b", 1800), ("u", "c", 3601)], "user_id string, event_id string, event_ts_unix long"
    )
    got = {r.event_id: r.session_id for r in SE.sessionise(df).collect()}
    assert got == {"a": "u#1", "b": "u#1", "c": "u#2"}


def test_session_table_of_a_stream_equals_the_batch(spark, tmp_path):
    rows = [("a", 0.0), ("a", 1800.0), ("a", 3600.000001), ("b", 5.0), ("a", 9000.0), ("b", 9000.0), (None, 7.0)]
    def frame(part):
        return spark.createDataFrame(part, "user_id string, s double").select("user_id", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("event_ts"))
    whole = frame(rows)
    # The event exactly at the gap stays, one a microsecond later does not.
    expected = {("a", 0, 1800, 2), ("a", 3600, 3600, 1), ("b", 5, 5, 1), ("a", 9000, 9000, 1), ("b", 9000, 9000, 1), (None, 7, 7, 1)}

    def found(table):
        return {(r.user_id, int(r.started.timestamp()), int(r.ended.timestamp()), r.events) for r in table.collect()}

    assert found(SE.session_table(whole)) == expected
    for part in (rows[:4], rows[4:], [("beat", 1e6)]):
        frame(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sessions = SE.session_table(stream, lateness="2 hours")
    query = sessions.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert found(spark.read.schema(sessions.schema).parquet(str(tmp_path / "out"))) == expected


@pytest.mark.parametrize("few", [1_000, 0])
def test_order_statistics_by_counting(spark, monkeypatch, few):
    monkeypatch.setattr(SC, "FEW", few)
    rng = np.random.default_rng(2)
    groups = {
        "normal": rng.normal(size=3000) * 10.0 ** rng.integers(-200, 200, 3000),
        "ties": np.where(rng.random(3000) < 0.6, 1.5, rng.normal(size=3000)),  # most rows are one value
        "close": 1.0 + np.arange(2000) * 2.0**-52,  # neighbours in the last bit
        "odd": np.array([np.inf, -np.inf, -0.0, 0.0, 5e-324, -5e-324, 1e308]),
        "one": np.array([-7.25]),
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [(None, 3.0), (None, 1.0), ("odd", None), ("odd", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = SC.order_statistics(df, "v", lambda n: range(0, n, max(1, n // 7)), "g")
    assert set(got) == {*groups, None} and got[None] == (2, {0: 1.0, 1: 3.0})
    for g, xs in groups.items():
        n, found = got[g]
        assert n == len(xs) and found == {k: float(np.sort(xs)[k]) for k in range(0, n, max(1, n // 7))}
    assert SC.order_statistics(df.filter("false"), "v", lambda n: [0]) == {}


def test_ranks_are_found_without_a_range_exchange(spark, monkeypatch):
    plans, whole = [], SC._bins

    def seen(*args):
        out = whole(*args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(SC, "_bins", seen)
    df = spark.range(20_000).select((F.col("id") % 7).cast("double").alias("v"))
    assert SC.exact_quantiles(df, "v", [0.5]) == {None: [3.0]}
    assert plans and not any("rangepartitioning" in p for p in plans)


def test_rows_to_rank_are_never_broadcast(spark, monkeypatch):
    # 200,000 rows of seven values are a small file; all of them went to the driver and to every executor.
    plans, whole = [], SC._matching

    def seen(*args):
        out = whole(*args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(SC, "_matching", seen)
    df = spark.range(200_000).select((F.col("id") % 7).cast("double").alias("v"), (F.col("id") % 2).cast("string").alias("g"))
    assert SC.exact_quantiles(df, "v", [0.5], by="g") == {"0": [3.0], "1": [3.0]}
    joins = [line for p in plans for line in p.splitlines() if "Join" in line]
    assert len(joins) == len(plans) > 1 and all("BroadcastHashJoin" in j and "BuildRight" in j for j in joins)


def test_global_row_number(spark):
    df = skewed(spark, 900).select("event_id", "event_ts_unix")
    order = [F.desc("event_ts_unix"), F.asc("event_id")]
    got = {r.event_id: r.n for r in SC.global_row_number(df, order, "n").collect()}
    expected = sorted(df.collect(), key=lambda r: (-r.event_ts_unix, r.event_id))
    assert got == {r.event_id: i + 1 for i, r in enumerate(expected)}


def test_running_totals_with_a_hot_group(spark):
    df = skewed(spark, 500).withColumn("x", F.col("event_id").cast("long"))
    run = SC.running_totals(df, ["user_id"], ["event_ts_unix", "event_id"], {"t": "x"})
    total: dict = {}
    for r in sorted(run.collect(), key=lambda r: (r.user_id, r.event_ts_unix, r.event_id)):
        total[r.user_id] = total.get(r.user_id, 0) + r.x
        assert r.t == total[r.user_id]


def test_a_cluster_must_name_the_shared_folder():
    from unittest.mock import MagicMock

    import pytest

    session = MagicMock()
    session.conf.get.return_value = None
    session.sparkContext.getConf.return_value.get.return_value = None
    session.sparkContext.getCheckpointDir.return_value = None
    session.sparkContext.master = "yarn"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        SC.shared_dir(session)


def test_shared_folder_comes_from_the_session():
    from unittest.mock import MagicMock

    session = MagicMock()
    session.conf.get.return_value = "hdfs:///shared"
    session.sparkContext.getCheckpointDir.return_value = None
    assert SC.fresh_dir(session, "x").startswith("hdfs:///shared/x-")
    session.sparkContext.setCheckpointDir.assert_called_once_with("hdfs:///shared")


def test_shared_leading_bits_take_no_pass(spark, monkeypatch):
    # Times of a month took three passes over all rows, most of them for bits that all times share.
    passes, bins = [], SC._bins
    monkeypatch.setattr(SC, "_bins", lambda *a: passes.append(1) or bins(*a))
    times = spark.range(50_000).select((F.lit(1_704_067_200) + F.col("id") * 53 % 2_678_400).alias("v"))
    n, found = SC.order_statistics(times, "v", lambda n: {0, n // 2, n - 1})[None]
    values = sorted(1_704_067_200 + i * 53 % 2_678_400 for i in range(50_000))
    assert n == 50_000 and found == {r: values[r] for r in (0, n // 2, n - 1)} and len(passes) == 1


def test_order_statistics_where_few_or_all_bits_are_shared(spark):
    for values in ([7.5] * 2_000, [-1.0] * 1_500 + [2.0] * 1_500, [-(2.0**40) - i for i in range(3_000)], [0.0, -0.0] * 800):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        n, found = SC.order_statistics(df, "v", lambda n: range(0, n, 97))[None]
        assert n == len(values) and found == {r: sorted(values)[r] for r in range(0, n, 97)}
    # Numbers that differ in their last bits only: less than a digit is left.
    close = [1.0 + i * 2.0**-52 for i in range(3_000)]
    df = spark.createDataFrame([(v,) for v in close], "v double").repartition(3)
    assert SC.order_statistics(df, "v", lambda n: {0, 1_234, n - 1})[None][1] == {r: close[r] for r in (0, 1_234, 2_999)}


def test_whole_numbers_are_ranked_without_python(spark, monkeypatch):
    # Times went through a Python worker to become keys.
    monkeypatch.setattr(SC, "_order_keys", None)
    values = [None, 0, -5, 2**60, -(2**60), 7, 7, *range(1_700_000_000, 1_700_003_000)]
    for kind, own in (("long", values), ("int", [v for v in values if v is None or abs(v) < 2**31])):
        df = spark.createDataFrame([(v,) for v in own], f"v {kind}")
        wanted = sorted(float(v) for v in own if v is not None)
        n, found = SC.order_statistics(df, "v", lambda n: range(0, n, 7))[None]
        assert n == len(wanted) and found == {r: wanted[r] for r in range(0, n, 7)}
    assert SC.order_statistics(df.filter("v is null"), "v", lambda n: [0]) == {}
