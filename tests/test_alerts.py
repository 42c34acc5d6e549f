"""Alerts wait before they fire, on a table and on a stream alike."""

import pytest
from pyspark.sql import functions as F

from shelfstream.operators import alerts as A
from shelfstream.operators import monitoring as M
from shelfstream.streaming import sinks
from shelfstream.streaming.alerting import alert_stream

LOG = "request_id string, served_ts timestamp, latency_ms double, served_from string, n_items int, exposure_outcome string"
ERRORS = A.Rule("errors", (A.Condition("retrieval_errors", 60, total=None),), 60, "page")
SHARE = A.Rule("share", (A.Condition("slow", 60, 0.5), A.Condition("slow", 120, 0.25)), 0, "ticket")
QUIET = A.Rule("quiet", (A.Condition("requests", 60, none=True),), 30, "page")
RULES = (ERRORS, SHARE, QUIET)


def log_of(spark, rows):
    """Rows of (second, slow, error); a second of None is a heartbeat's."""
    return spark.createDataFrame(
        [(f"r{i}", s, 200.0 if slow else 5.0, "retrieval_error" if error else "model", 3, None)
         for i, (s, slow, error) in enumerate(rows)],
        "request_id string, s long, latency_ms double, served_from string, n_items int, exposure_outcome string",
    ).select("request_id", F.timestamp_seconds("s").alias("served_ts"), "latency_ms", "served_from", "n_items", "exposure_outcome")


def brute(rows, every, until):
    """Transitions by evaluating every rule at every tick."""
    out, first = set(), min(s for s, _, _ in rows) // every
    for rule in RULES:
        since, fired = None, False
        for tick in range(first, until // every):
            now, ok = (tick + 1) * every, True
            for c in rule.conditions:
                own = [r for r in rows if now - c.seconds <= r[0] < now]
                count = {"requests": len(own), "slow": sum(r[1] for r in own), "retrieval_errors": sum(r[2] for r in own)}
                if c.none:
                    ok &= count[c.counter] == 0
                elif c.total is None:
                    ok &= count[c.counter] > c.limit
                else:
                    ok &= bool(own) and count[c.counter] / len(own) > c.limit
            if ok:
                if since is None:
                    since = now
                    if rule.wait:
                        out.add((rule.name, now, "pending"))
                if not fired and now - since >= rule.wait:
                    fired = True
                    out.add((rule.name, now, "firing"))
            elif since is not None:
                out.add((rule.name, now, "resolved" if fired else "cleared"))
                since, fired = None, False
    return out


def some_rows(seed):
    import random

    rng, rows, at = random.Random(seed), [], 86400 * 3 - 700
    for _ in range(160):
        at += rng.choice([1, 5, 20, 20, 40, 130])
        bad = at // 400 % 2
        rows.append((at, rng.random() < (0.8 if bad else 0.1), rng.random() < (0.5 if bad else 0.02)))
    return rows


@pytest.mark.parametrize("every", [30, 7])
def test_batch_transitions_equal_brute_force(spark, every):
    rows = some_rows(every)
    rules = [A.Rule(r.name, tuple(A.Condition(c.counter, c.seconds // every * every, c.limit, c.total, c.none) for c in r.conditions), r.wait, r.severity) for r in RULES]
    globals()["RULES"], kept = tuple(rules), RULES
    try:
        until = (rows[-1][0] // every + 1) * every
        ticks = A.tick_counts(log_of(spark, rows), every)
        got = A.transitions(A.episodes(A.evaluations(ticks, rules, every), rules, every))
        found = [tuple(r) for r in got.collect()]
        assert len(found) == len(set(found)) and set(found) == brute(rows, every, until)
    finally:
        globals()["RULES"] = kept


def test_an_alert_waits_and_resolves(spark):
    seconds = [0, 35, 65, 100, 130, 400]
    log = log_of(spark, [(s, False, s < 200) for s in seconds])
    found = A.episodes(A.evaluations(A.tick_counts(log, 30), [ERRORS], 30), [ERRORS], 30).collect()
    # Errors are in the window at 30 ... 180, so it fires at 90 and resolves at 210.
    assert [tuple(r) for r in found] == [("errors", 30, 90, 210, "resolved")]
    short = log_of(spark, [(0, False, True), (300, False, False)])
    found = A.episodes(A.evaluations(A.tick_counts(short, 30), [ERRORS], 30), [ERRORS], 30).collect()
    assert [tuple(r) for r in found] == [("errors", 30, None, 90, "cleared")]
    lasting = A.episodes(A.evaluations(A.tick_counts(log, 30), [ERRORS], 30, until_unix=150), [ERRORS], 30).first()
    assert (lasting.state, lasting.ended_at) == ("firing", None)
    none = A.tick_counts(log_of(spark, []), 30)
    assert A.episodes(A.evaluations(none, [ERRORS], 30), [ERRORS], 30).count() == 0


def test_stream_equals_brute_force_with_late_rows_and_silence(spark, tmp_path):
    rows = some_rows(99)
    path, every, lateness = str(tmp_path / "log"), 30, 300
    # Neighbouring rows change places within the lateness; files follow each other.
    order = sorted(range(len(rows)), key=lambda i: rows[i][0] + (i * 37) % 150)
    size = len(order) // 5 + 1
    for k in range(5):
        part = [rows[i] for i in order[k * size : (k + 1) * size]]
        log_of(spark, part).coalesce(1).write.mode("append").parquet(path)
    end = (rows[-1][0] // every + 10) * every
    beat = log_of(spark, [(end + lateness, False, False)]).withColumn("request_id", F.lit(None).cast("string"))
    beat.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(path)
    alerts = alert_stream(stream, RULES, every, f"{lateness} seconds")
    sinks.finish(sinks.append_stream(alerts, str(tmp_path / "out"), str(tmp_path / "checkpoint")))
    got = [tuple(r) for r in spark.read.schema(alerts.schema).parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, every, end)


def test_every_rule_waits():
    assert all(r.wait > 0 and r.severity in ("page", "ticket") for r in A.RULES)
    assert len({r.name for r in A.RULES}) == len(A.RULES)


def test_sketches_unite_without_counting_twice(spark):
    log = spark.range(60_000).select(
        F.timestamp_seconds(F.floor(F.col("id") / 6000) * 86400).alias("served_ts"),
        # 20,000 users, each seen on three days; a third of all rows are one user's.
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 20_000).alias("user_id"),
    )
    days = M.distinct_sketches(log, "user_id")
    exact = log.agg(F.count_distinct("user_id")).first()[0]
    assert days.count() == 10
    one = M.distinct_over(days, 864_000).first()
    assert one.rows == 60_000 and abs(one.distinct - exact) <= 5 * 1.04 / 2**6 * exact
    per_day = M.distinct_over(days, 86_400).agg(F.sum("distinct")).first()[0]
    assert per_day > 1.3 * one.distinct
    assert M.distinct_sketches(log.filter("false"), "user_id").count() == 0
    nulls = log.withColumn("user_id", F.lit(None).cast("long"))
    assert M.distinct_over(M.distinct_sketches(nulls, "user_id"), 864_000).first().distinct == 0
