"""Privacy, retention, erasure and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfstream.operators import alerts as AL
from shelfstream.operators import cleaning as C
from shelfstream.operators import monitoring as M
from shelfstream.operators import policy as POL
from shelfstream.plans import governance as G
from shelfstream.scale import cut, fresh_dir
from shelfstream.sources import scoped
from shelfstream.sources.schemas import INTERACTION_COLUMNS, INTERACTIONS
from shelfstream.sources.tables import Warehouse
from shelfstream.streaming import sinks
from shelfstream.streaming.alerting import alert_stream
from workload.q_cleaning import _INNER, _OUTER, KEY
from workload.q_policy import LIMIT, _applied
from workload.registry import case, cte
from workload.views import r

SUBJECT = "7"


def _warehouse(v):
    w = Warehouse(v.spark, fresh_dir(v.spark, "warehouse"))
    w.write("bronze.interactions", v.interactions())
    return w


@case("prv1_pseudonymise_column", f"""
SELECT substr(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(user_id)))), 1, 24)
  AS user_id, count(*) AS n FROM interactions GROUP BY 1""")
def _(v):
    return C.pseudonymised(v.interactions(), KEY, 24).groupBy("user_id").agg(F.count("*").alias("n"))


@case("prv2_find_identifiers", """
SELECT 'user_id' AS path, 'field name' AS reason, count(*) AS rows FROM interactions UNION ALL
SELECT 'session_id', 'field name', count(*) FROM interactions""")
def _(v):
    return G.find_identifiers(v.interactions())


@case("prv2_identifiers_in_text", """
SELECT 'word' AS path, 'value shape' AS reason, count(*) AS rows FROM (SELECT unnest(string_split_regex(text,
  '\\s+')) AS word FROM documents) WHERE regexp_matches(word, '^U\\d{4,}$') OR
  regexp_matches(word, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') OR
  regexp_matches(word, '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$')""")
def _(v):
    words = v.table("documents").select("doc_id", F.explode(F.split("text", r"\s+")).alias("word"))
    return G.find_identifiers(words)


@case("prv3_scrub", """
SELECT event_id, true AS has_user_id, true AS has_session_id, CASE WHEN sku = '5' THEN NULL ELSE 2 END
  AS n_order_ids, sku FROM interactions""")
def _(v):
    rows = v.interactions().select(
        "event_id", "user_id",
        F.struct("session_id", F.when(F.col("sku") != "5", F.array("sku", "sku")).alias("order_ids"),
                 "sku").alias("detail"),
    )
    return G.scrub(rows).select(
        "event_id", "has_user_id", F.col("detail.has_session_id").alias("has_session_id"),
        F.col("detail.n_order_ids").alias("n_order_ids"), F.col("detail.sku").alias("sku"),
    )


def _unchanged(w, table, before):
    """Whether each file that was there and still is kept its length and time: (path, same)."""
    old = before.select("path", F.struct("modificationTime", "length").alias("old"))
    now = w.files(table).select("path", F.struct("modificationTime", "length").alias("now"))
    return old.join(now, "path").select("path", (F.col("old") == F.col("now")).alias("same"))


def _listing(w, table):
    """The table's files as they are now, kept while the table changes."""
    return cut(w.files(table))


@case("prv4_dated_retention", """
SELECT event_date, count(*) AS n, true AS same_files FROM interactions WHERE event_date >= cast((SELECT
  max(event_ts) FROM interactions) - INTERVAL 20 DAY AS DATE) GROUP BY 1""")
def _(v):
    # Partitions past the window go as folders; every file of the others keeps name, length and time.
    w, table = _warehouse(v), "bronze.interactions"
    before = _listing(w, table)
    G.retention(w, {table: 20}, clock="data")
    day = F.to_date(F.regexp_extract("path", "event_date=([0-9-]+)", 1))
    added = w.files(table).join(before, "path", "left_anti").select(day.alias("event_date"), F.lit(False).alias("same"))
    files = _unchanged(w, table, before).select(day.alias("event_date"), "same").unionByName(added)
    same = files.groupBy("event_date").agg(F.bool_and("same").alias("same_files"))
    return w.read(table).groupBy("event_date").agg(F.count("*").alias("n")).join(same, "event_date")


@case("prv4_refuses_large_share", """
SELECT 'refused' AS outcome, count(*) AS rows_left FROM interactions""")
def _(v):
    w = _warehouse(v)
    report = G.retention(w, {"bronze.interactions": 5}, clock="data")
    refused = report.filter("status like 'refused%'").count()
    return w.read("bronze.interactions").agg(
        F.lit("refused" if refused else "pruned").alias("outcome"), F.count("*").alias("rows_left")
    )


@case("prv4_retention_by_files", """
SELECT event_type, count(*) FILTER (event_date >= cut) AS n, true AS others_kept FROM interactions,
  (SELECT cast(max(event_ts) - INTERVAL 20 DAY AS DATE) AS cut FROM interactions) GROUP BY 1
HAVING count(*) FILTER (event_date >= cut) > 0""")
def _(v):
    # Not partitioned by date, but written in its order: only files that reach past the window are replaced.
    w, table = Warehouse(v.spark, fresh_dir(v.spark, "warehouse")), "archive.interactions"
    v.interactions().repartitionByRange(8, "event_ts").write.partitionBy("event_type").parquet(w.location(table))
    before = _listing(w, table)
    cut_at = v.interactions().agg(F.date_sub(F.to_date(F.max("event_ts")), 20)).first()[0]
    old = w.read(table).filter(F.col("event_date") < cut_at).select(F.col("_metadata.file_path").alias("path"))
    old = cut(old.distinct())
    G.retention(w, {table: 20}, clock="data", newest=v.interactions())
    kept = _unchanged(w, table, before).join(old, "path", "left_anti")
    want = before.join(old, "path", "left_anti").count()
    fine = kept.filter("same").count() == want and want > 0 and _unchanged(w, table, before).count() == want
    return w.read(table).groupBy("event_type").agg(F.count("*").alias("n")).withColumn("others_kept", F.lit(fine))


@case("prv5_sequence_retention", """
SELECT split, user_id, newest, true AS whole FROM (
  SELECT 'train' AS split, user_id, max(event_ts_unix) AS newest FROM h_train GROUP BY 2 UNION ALL
  SELECT 'val', user_id, max(event_ts_unix) FROM h_val GROUP BY 2 UNION ALL
  SELECT 'test', user_id, max(event_ts_unix) FROM h_test GROUP BY 2)
WHERE newest >= (SELECT newest FROM cutoffs) - 8 * 86400""")
def _(v):
    # The stored sequences of every split are rewritten; a user stays with the whole history or goes.
    w, table = Warehouse(v.spark, fresh_dir(v.spark, "warehouse")), "gold.sequences_config"
    w.write(table, v.sequences)
    events, _, _ = v.labelled
    report = G.retention(w, {}, {table: 8}, clock="data", max_share=0.9, newest=events)
    if report.first()["status"] != "pruned":
        raise AssertionError(report.first())
    before = v.sequences.select("split", "user_id", F.col("input_ts").alias("was"))
    return w.read(table).join(before, ["split", "user_id"]).select(
        "split", "user_id", F.array_max("input_ts").alias("newest"), (F.col("input_ts") == F.col("was")).alias("whole")
    )


@case("prv6_retention_report", """
SELECT 'bronze.interactions' AS "table", 'would prune' AS status, count(*) AS rows_before,
  count(*) FILTER (event_date < cut) AS rows_removed, NULL AS partitions_dropped FROM interactions,
  (SELECT cast(max(event_ts) - INTERVAL 25 DAY AS DATE) AS cut FROM interactions) UNION ALL
SELECT 'bronze.interactions', 'pruned', count(*), count(*) FILTER (event_date < cut),
  count(DISTINCT event_date) FILTER (event_date < cut) FROM interactions,
  (SELECT cast(max(event_ts) - INTERVAL 25 DAY AS DATE) AS cut FROM interactions) UNION ALL
SELECT 'silver.interactions', 'nothing to prune', count(*), 0, NULL FROM silver UNION ALL
SELECT 'silver.absent', 'absent', NULL, NULL, NULL UNION ALL
SELECT 'gold.sequences_config', 'pruned', count(*), count(*) FILTER (newest < (SELECT max(event_ts_unix) FROM
  interactions) - 7 * 86400), 0 FROM (
  SELECT user_id, max(event_ts_unix) AS newest FROM h_train GROUP BY 1 UNION ALL
  SELECT user_id, max(event_ts_unix) FROM h_val GROUP BY 1 UNION ALL
  SELECT user_id, max(event_ts_unix) FROM h_test GROUP BY 1) UNION ALL
SELECT 'gold.sequences_sku', 'no window configured', NULL, NULL, NULL""")
def _(v):
    w = _warehouse(v)
    w.write("silver.interactions", v.silver)
    w.write("gold.sequences_config", v.sequences)
    first = G.retention(w, {"bronze.interactions": 25}, clock="data", dry_run=True)
    rest = G.retention(
        w, {"bronze.interactions": 25, "silver.interactions": 400, "silver.absent": 30},
        {"gold.sequences_config": 7, "gold.sequences_sku": 0}, clock="data", max_share=0.9,
    )
    return first.unionByName(rest).select("table", "status", "rows_before", "rows_removed", "partitions_dropped")


ERASED = ("bronze.interactions", "silver.interactions", "gold.sequences_sku", "online.tails")
RAW = INTERACTIONS.replace("event_ts timestamp", "event_ts string")


def _layers(v):
    """Raw files and all tables with ids that no other column holds by chance: (warehouse, raw path)."""
    named = v.interactions().withColumn("user_id", F.format_string("user-%s-x", "user_id")).withColumn(
        "session_id", F.concat_ws("#", "user_id", "event_date"))
    # Every layer reads it.
    named = cut(named)
    w = Warehouse(v.spark, fresh_dir(v.spark, "warehouse"))
    w.write("bronze.interactions", named)
    events = named.drop("session_id")
    w.write("silver.interactions", C.pseudonymised(events, KEY))
    w.write("gold.sequences_sku", C.pseudonymised(
        events.groupBy("user_id").agg(F.sort_array(F.collect_list("sku")).alias("tokens")), KEY), partition_by=[])
    w.write("online.tails", events.groupBy("user_id").agg(F.max("event_ts").alias("last_ts")), partition_by=[])
    raw = f"{fresh_dir(v.spark, 'raw')}/interactions"
    named.select(*INTERACTION_COLUMNS).repartitionByRange(8, "user_id").write.option("header", True).csv(raw)
    return w, raw


def _layers_erased(v, tables):
    """The receipt for the subject, erased from ``tables`` and the raw files."""
    w, raw = _layers(v)
    return G.erase(w, f"user-{SUBJECT}-x", tables, {raw: RAW}, key=KEY)


@case("prv7_erase_subject", f"""
SELECT layer, n, true AS others_kept FROM (
  SELECT 'bronze.interactions' AS layer, count(*) AS n FROM interactions WHERE user_id <> '{SUBJECT}'
  UNION ALL SELECT 'silver.interactions', count(*) FROM interactions WHERE user_id <> '{SUBJECT}'
  UNION ALL SELECT 'gold.sequences_sku', count(DISTINCT user_id) FROM interactions WHERE user_id <> '{SUBJECT}'
  UNION ALL SELECT 'online.tails', count(DISTINCT user_id) FROM interactions WHERE user_id <> '{SUBJECT}'
  UNION ALL SELECT 'raw', count(*) FROM interactions WHERE user_id <> '{SUBJECT}')""")
def _(v):
    # Files without a row of the subject keep name, length and time in every layer.
    w, raw = _layers(v)
    subject, spark = f"user-{SUBJECT}-x", v.spark
    owners = G.subject_identifiers(subject, KEY)
    read = {t: (lambda t=t: w.read(t)) for t in ERASED} | {"raw": lambda: spark.read.option("header", True).csv(raw)}
    files = {t: (lambda t=t: w.files(t)) for t in ERASED} | {"raw": lambda: scoped.stored_files(spark, raw)}
    before, held = {}, {}
    for layer in read:
        before[layer] = cut(files[layer]().filter("path not like '%/\\_%'"))
        held[layer] = cut(
            read[layer]().filter(F.col("user_id").isin(*owners)).select(F.col("_metadata.file_path").alias("path")).distinct())
    G.erase(w, subject, ERASED, {raw: RAW}, key=KEY)
    out = None
    for layer in read:
        now = files[layer]().select("path", F.struct("modificationTime", "length").alias("now"))
        others = before[layer].join(held[layer], "path", "left_anti").join(now, "path", "left")
        same = F.coalesce(F.struct("modificationTime", "length") == F.col("now"), F.lit(False))
        kept = others.agg(F.coalesce(F.bool_and(same), F.lit(True)).alias("others_kept"))
        part = read[layer]().agg(F.count("*").alias("n")).crossJoin(kept).select(F.lit(layer).alias("layer"), "n", "others_kept")
        out = part if out is None else out.unionByName(part)
    return out


@case("prv8_verify_finds_derived_columns", """
SELECT 'bronze.interactions' AS "where", count(*) AS matches FROM interactions WHERE
  event_id LIKE '%42%' OR user_id LIKE '%42%' OR session_id LIKE '%42%' OR sku LIKE '%42%' OR
  event_type LIKE '%42%' OR consent LIKE '%42%'""")
def _(v):
    # A literal search finds the id inside other columns too.
    return G.verify_erased(_warehouse(v), ["42"])


@case("prv8_many_subjects", """
SELECT u.user_id AS subject, w AS "where", count(*) AS matches
FROM (SELECT DISTINCT user_id FROM interactions) u, (SELECT unnest(['bronze.interactions', 'online.notes']) AS w), interactions i
WHERE CASE WHEN w = 'bronze.interactions' THEN
  contains(i.event_id, u.user_id) OR contains(i.user_id, u.user_id) OR contains(i.session_id, u.user_id) OR
  contains(i.sku, u.user_id) OR contains(i.event_type, u.user_id) OR coalesce(contains(i.consent, u.user_id), false) OR
  contains('/event_date=' || strftime(i.event_date, '%Y-%m-%d'), u.user_id)
  ELSE contains(i.session_id || ' ' || i.sku, u.user_id) END GROUP BY ALL""")
def _(v):
    # Every user in one scan per file set; the notes are text files, packed.
    w = _warehouse(v)
    notes = v.interactions().select(F.concat_ws(" ", "session_id", "sku").alias("value"))
    notes.write.option("compression", "gzip").text(w.location("online.notes"))
    users = [x["user_id"] for x in v.interactions().select("user_id").distinct().collect()]
    return G.verify_subjects(w, {u: [u] for u in users})


cte("per_store", f"""
SELECT s, CASE WHEN s LIKE 'gold%' OR s LIKE 'online%' THEN least(count(*), 1) ELSE count(*) END AS m
FROM interactions, (SELECT unnest(['raw', 'bronze.interactions', 'silver.interactions', 'gold.sequences_sku',
  'online.tails']) AS s) WHERE user_id = '{SUBJECT}' GROUP BY s""")


@case("prv9_receipt", f"""
SELECT kind, store_kind, complete, n, substr(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') ||
  encode('user-{SUBJECT}-x')))), 1, 16) AS subject_digest FROM (
  SELECT 'step' AS kind, s AS store_kind, true AS complete, m AS n FROM per_store
  UNION ALL SELECT 'unerasable', 'outside', true, NULL)""")
def _(v):
    # With all stores named nothing survives, so there is no row of that kind.
    store = F.when(F.col("store").isin(*ERASED), F.col("store")).when(F.col("kind") == "step", "raw").otherwise("outside")
    return _layers_erased(v, ERASED).groupBy("kind", store.alias("store_kind"), "complete", "subject_digest").agg(
        F.sum("rows").alias("n"))


@case("prv9_receipt_of_all_layers", f"""
SELECT erased, kind, complete, CASE WHEN store LIKE '%.%' THEN store ELSE 'raw or outside' END AS store, cast(sum(n) AS BIGINT) AS n
FROM (
  SELECT 'all' AS erased, 'step' AS kind, true AS complete, s AS store, m AS n FROM per_store
  UNION ALL SELECT 'not tails', 'step', false, s, m FROM per_store WHERE s <> 'online.tails'
  UNION ALL SELECT 'not tails', 'survived', false, s, m FROM per_store WHERE s = 'online.tails'
  UNION ALL SELECT e, 'unerasable', e = 'all', 'x', NULL FROM (SELECT unnest(['all', 'not tails']) AS e))
GROUP BY ALL""")
def _(v):
    done = _layers_erased(v, ERASED).withColumn("erased", F.lit("all"))
    part = _layers_erased(v, ERASED[:-1]).withColumn("erased", F.lit("not tails"))
    store = F.when(F.col("store").isin(*ERASED), F.col("store")).otherwise("raw or outside")
    return done.unionByName(part).groupBy("erased", "kind", "complete", store.alias("store")).agg(
        F.sum("rows").alias("n")
    )


# -- monitoring ---------------------------------------------------------------


@case("mon1_requests", """
SELECT at_s // 3600 * 3600 AS start_unix, served_from, ranker_used, count(*) AS requests FROM request_log
GROUP BY ALL""")
def _(v):
    return M.requests(v.request_log()).select(
        F.unix_timestamp("w.start").alias("start_unix"), "served_from", "ranker_used", "requests"
    )


@case("mon2_latency_histogram", """
SELECT stage, le, count(*) FILTER (latency_ms <= le) AS bucket_count, round(sum(latency_ms), 4) AS total,
  count(*) AS n FROM request_log, (SELECT unnest([1.0, 2.5, 5.0, 10.0, 25.0, 35.0, 50.0, 100.0, 250.0,
  500.0, 1000.0, 'inf'::DOUBLE]) AS le) GROUP BY 1, 2""")
def _(v):
    table = M.cumulative_histogram(v.request_log(), "latency_ms", M.LATENCY_BOUNDS_MS, ["stage"])
    return table.select("stage", "le", "bucket_count", r("total", 4).alias("total"), "n")


@case("mon3_burn_rate", """
SELECT (t.tick + 1) * 300 AS at_unix, round(s.r1, 9) AS r1h, round(s.r6, 9) AS r6h, s.r1 > 0.144e0 AND
  s.r6 > 0.144e0 AS fast_burn FROM (SELECT DISTINCT at_s // 300 AS tick FROM request_log) t,
  LATERAL (SELECT count(*) FILTER (latency_ms > 100 AND at_s // 300 > t.tick - 12) / cast(count(*) FILTER
    (at_s // 300 > t.tick - 12) AS DOUBLE) AS r1, count(*) FILTER (latency_ms > 100) / cast(count(*) AS DOUBLE)
    AS r6 FROM request_log WHERE at_s // 300 <= t.tick AND at_s // 300 > t.tick - 72) s""")
def _(v):
    ratios = M.sliding_ratios(v.request_log(), {"r1h": 3600, "r6h": 21600}, 300)
    return M.burn_alerts(ratios, "r1h", "r6h").select(
        "at_unix", r("r1h", 9).alias("r1h"), r("r6h", 9).alias("r6h"), "fast_burn"
    )


EVERY = 60


def _sum_sql(name, seconds):
    return f"sum({name}) OVER (ORDER BY tick ROWS BETWEEN {seconds // EVERY - 1} PRECEDING AND CURRENT ROW)"


def _holds_sql(c):
    own = _sum_sql(c.counter, c.seconds)
    if c.none:
        return f"{own} = 0"
    if c.total is None:
        return f"{own} > {c.limit!r}"
    whole = _sum_sql(c.total, c.seconds)
    return f"coalesce({own} / nullif(cast({whole} AS DOUBLE), 0) > cast({c.limit!r} AS DOUBLE), false)"


cte("alert_ticks", f"""
SELECT tick, count(request_id) AS requests, count(*) FILTER (latency_ms > 100) AS slow,
  count(*) FILTER (served_from <> 'model') AS fallbacks,
  count(*) FILTER (served_from = 'retrieval_error') AS retrieval_errors, count(*) FILTER (n_items = 0) AS empty,
  count(exposure_outcome) AS exposures, count(*) FILTER (exposure_outcome = 'failed') AS exposures_failed
FROM (SELECT unnest(range((SELECT min(at_s) // {EVERY} FROM request_log),
  (SELECT max(at_s) // {EVERY} + 1 FROM request_log))) AS tick) t
LEFT JOIN request_log l ON l.at_s // {EVERY} = t.tick GROUP BY 1""")
cte("alert_holds", " UNION ALL ".join(
    f"SELECT '{rule.name}' AS rule, {rule.wait} AS wait, (tick + 1) * {EVERY} AS at_unix, "
    f"{' AND '.join(map(_holds_sql, rule.conditions))} AS holds FROM alert_ticks" for rule in AL.RULES))
cte("alert_episodes", f"""
SELECT rule, wait, min(at_unix) AS pending_at, max(at_unix) AS last_at FROM (SELECT *, at_unix // {EVERY} -
  row_number() OVER (PARTITION BY rule ORDER BY at_unix) AS run FROM alert_holds WHERE holds) GROUP BY rule, wait, run""")
cte("alert_states", f"""
SELECT rule, pending_at, CASE WHEN last_at >= pending_at + wait THEN pending_at + wait END AS firing_at,
  CASE WHEN last_at < (SELECT max(at_unix) FROM alert_holds) THEN last_at + {EVERY} END AS ended_at
FROM alert_episodes""")


@case("mon3_firing", """
SELECT *, CASE WHEN firing_at IS NULL THEN CASE WHEN ended_at IS NULL THEN 'pending' ELSE 'cleared' END
  WHEN ended_at IS NULL THEN 'firing' ELSE 'resolved' END AS state FROM alert_states""")
def _(v):
    ticks = cut(AL.tick_counts(v.request_log(), EVERY))
    return AL.episodes(AL.evaluations(ticks, every=EVERY), every=EVERY)


@case("mon3_firing_on_a_stream", """
SELECT rule, pending_at AS at_unix, 'pending' AS state FROM alert_states UNION ALL
SELECT rule, firing_at, 'firing' FROM alert_states WHERE firing_at IS NOT NULL UNION ALL
SELECT rule, ended_at, CASE WHEN firing_at IS NULL THEN 'cleared' ELSE 'resolved' END FROM alert_states
WHERE ended_at IS NOT NULL""")
def _(v):
    # The log arrives in four batches; a heartbeat closes the last tick.
    log, root = v.request_log(), fresh_dir(v.spark, "alerts")
    low, high = log.agg(F.min(F.unix_timestamp("served_ts")), F.max(F.unix_timestamp("served_ts"))).first()
    part = F.least(F.floor((F.unix_timestamp("served_ts") - low) * 4 / max(1, high - low)), F.lit(3))
    for k in range(4):
        log.filter(part == k).coalesce(1).write.mode("append").parquet(f"{root}/log")
    # Lateness and the heartbeat cancel out: all ticks of the log are evaluated and none behind it.
    beat = F.timestamp_seconds(F.lit((high // EVERY + 1) * EVERY + 600))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in log.schema.fields if f.name != "served_ts"]
    v.spark.range(1).select(*empty, beat.alias("served_ts")).select(*log.columns).coalesce(1).write.mode("append").parquet(f"{root}/log")
    stream = v.spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/log")
    alerts = alert_stream(stream, every=EVERY, lateness="10 minutes")
    sinks.finish(sinks.append_stream(alerts, f"{root}/out", f"{root}/checkpoint"))
    return v.spark.read.schema(alerts.schema).parquet(f"{root}/out")


@case("mon6_stale_firing", """
SELECT 'stale' AS rule, min(at_unix) AS pending_at, CASE WHEN max(at_unix) - min(at_unix) >= 1800 THEN
  min(at_unix) + 1800 END AS firing_at, CASE WHEN max(at_unix) < (SELECT max(at_s) // 600 + 1 FROM request_log) * 600
  THEN max(at_unix) + 600 END AS ended_at
FROM (SELECT at_unix, at_unix // 600 - row_number() OVER (ORDER BY at_unix) AS run FROM (
  SELECT tick * 600 + 600 AS at_unix, max(mark) OVER (ORDER BY tick) AS mark FROM (
    SELECT tick, max(at_s) AS mark FROM (SELECT unnest(range((SELECT min(at_s) // 600 FROM request_log),
      (SELECT max(at_s) // 600 + 1 FROM request_log))) AS tick) LEFT JOIN request_log ON at_s // 600 = tick GROUP BY 1))
  WHERE at_unix - mark > 1200) GROUP BY run""")
def _(v):
    # The newest request is the mark that has to be renewed; 20 minutes are its limit, 30 the wait.
    marks = v.request_log().select(F.col("served_ts").alias("created_ts"))
    rule = AL.Rule("stale", (), 1800, "ticket")
    return AL.episodes(AL.overdue(marks, 600, 1200), [rule], 600).drop("state")


@case("mon3_sliding_windows", """
SELECT e * 900 AS at_unix, round(count(*) FILTER (latency_ms > 100) / cast(count(*) AS DOUBLE), 9) AS ratio,
  count(*) AS n FROM (SELECT latency_ms, unnest(range(at_s // 900 + 1, at_s // 900 + 5)) AS e FROM request_log)
GROUP BY 1""")
def _(v):
    table = M.failure_ratio(v.request_log(), "1 hour", "15 minutes")
    return table.select(F.unix_timestamp("at").alias("at_unix"), r("ratio", 9).alias("ratio"), "n")


@case("mon4_health_ratios", """
SELECT at_s // 600 * 600 AS start_unix, count(*) AS requests, round(count(*) FILTER (served_from <> 'model') /
  cast(count(*) AS DOUBLE), 9) AS fallback_share, count(*) FILTER (n_items = 0) / cast(count(*) AS DOUBLE)
  > 0.01e0 AS empty_alert, count(*) FILTER (exposure_outcome = 'failed') / cast(count(*) AS DOUBLE) > 0.05e0
  AS exposure_alert FROM request_log GROUP BY 1""")
def _(v):
    return M.health_ratios(v.request_log()).select(
        "start_unix", "requests", r("fallback_share", 9).alias("fallback_share"), "empty_alert",
        "exposure_alert",
    )


@case("mon5_drop_dominance", f"""
SELECT reason, n, round(n / greatest(sum(n) OVER (), 1), 9) AS share, n / greatest(sum(n) OVER (), 1) > 0.9
  AS alert FROM (SELECT drop_reason AS reason, count(*) AS n FROM checked WHERE drop_reason IS NOT NULL
  GROUP BY 1 UNION ALL SELECT 'capped_by_category', count(*) FROM capped_rows WHERE is_over
  AND placed < {LIMIT})""")
def _(v):
    decided = _applied(v)
    reason = F.when(F.col("capped"), "capped_by_category").otherwise(F.col("drop_reason"))
    drops = decided.select(reason.alias("reason"), F.lit(1).alias("n")).filter("reason is not null")
    return M.drop_dominance(drops).select("reason", "n", r("share", 9).alias("share"), "alert")


@case("mon6_staleness", """
SELECT 1707000000 - max(at_s) AS age_seconds, 1707000000 - max(at_s) > 604800 AS stale FROM request_log""")
def _(v):
    builds = v.request_log().select(F.col("served_ts").alias("created_ts"))
    return M.staleness(builds, 1707000000)


@case("mon7_nearest_rank", """
SELECT stage, max(latency_ms) FILTER (rn = greatest(1, least(n, round_even(0.5e0 * n + 0.5e0, 0)))) AS p50,
  max(latency_ms) FILTER (rn = greatest(1, least(n, round_even(0.95e0 * n + 0.5e0, 0)))) AS p95,
  max(latency_ms) FILTER (rn = greatest(1, least(n, round_even(0.99e0 * n + 0.5e0, 0)))) AS p99,
  max(n) AS n FROM (SELECT stage, latency_ms, row_number() OVER (PARTITION BY stage ORDER BY latency_ms)
  AS rn, count(*) OVER (PARTITION BY stage) AS n FROM request_log) GROUP BY 1""")
def _(v):
    fractions = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    return M.nearest_rank(v.request_log(), "latency_ms", fractions, "stage")


@case("mon8_version_skew", """
SELECT at_s // 1800 * 1800 AS start_unix, count(DISTINCT model_version) AS versions, count(*) FILTER
  (served_from = 'retrieval_error') AS retrieval_errors, count(DISTINCT model_version) > 1 AS skew_alert,
  count(*) FILTER (served_from = 'retrieval_error') > 0 AS retrieval_alert FROM request_log GROUP BY 1""")
def _(v):
    return M.version_skew(v.request_log())


@case("mon8_distinct_users_by_sketch", """
SELECT at_s // 604800 * 604800 AS start_unix, served_from, count(*) AS rows, count(DISTINCT user_id) AS exact,
  true AS within FROM request_log GROUP BY 1, 2""")
def _(v):
    # Sketches per day, united per week; the estimate lies within five standard errors of the exact count.
    by, log = ["served_from"], v.request_log()
    weeks = M.distinct_over(cut(M.distinct_sketches(log, "user_id", by=by)), 604800, by)
    start = F.floor(F.unix_timestamp("served_ts") / 604800) * 604800
    exact = log.groupBy(start.alias("start_unix"), *by).agg(F.count_distinct("user_id").alias("exact"))
    error = 5 * 1.04 / 2 ** (M.SKETCH_BITS / 2)
    return weeks.join(exact, ["start_unix", *by]).select(
        "start_unix", "served_from", "rows", "exact", (F.abs(F.col("distinct") - F.col("exact")) <= error * F.col("exact") + 1).alias("within")
    )


@case("mon8_silent_windows", """
SELECT s * 60 AS start_unix FROM range((SELECT min(at_s) // 60 FROM request_log),
  (SELECT max(at_s) // 60 FROM request_log)) t(s) WHERE s NOT IN (SELECT at_s // 60 FROM request_log)""")
def _(v):
    return M.silent_windows(v.request_log(), 60)


