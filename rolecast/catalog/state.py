"""Queries on keyed state, run log and run difference, over the event table."""

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from rolecast.catalog.base import epoch_us, query, table
from rolecast.operators import state as ST
from rolecast.operators.common import shared_dir
from rolecast.streaming.observe import seen_times

SPLIT = "2024-01-16"


def events(spark, d):
    """Events as observed postings keyed by user and type."""
    n = F.col("event_id")
    return table(spark, d, "events").select(
        n.alias("ingest_seq"), F.concat_ws("|", "user_id", "event_type").alias("key"),
        F.concat(F.lit("c"), n).alias("company"), F.col("event_type").alias("title"),
        F.col("user_id").cast("string").alias("location"), F.concat(F.lit("u"), n).alias("apply_url"),
        F.col("props").alias("source"),
        F.when(n % 3 == 0, F.col("ts").cast("date")).alias("posted_date"),
        F.col("ts").cast("timestamp").alias("seen_at"))


def state_of(spark, rows):
    return ST.observe(spark.createDataFrame([], ST.STATE_SCHEMA), rows)


EV = """ev AS (SELECT event_id AS n, user_id || '|' || event_type AS key, event_type, user_id, props, ts,
  CASE WHEN event_id % 3 = 0 THEN ts::DATE END AS posted FROM events)"""
OBSERVED = f"""{EV},
obs AS (SELECT key, 'c' || min(n) AS company, 'u' || max(n) AS url, arg_max(props, n) AS source,
  arg_max(posted, n) FILTER (posted IS NOT NULL) AS posted, min(ts) AS first_seen,
  max(ts) AS last_seen FROM ev GROUP BY key)"""


@query("observe", f"""
WITH {OBSERVED} SELECT key, company, url, source, posted::VARCHAR AS posted_date,
  epoch_us(first_seen) AS first_us, epoch_us(last_seen) AS last_us FROM obs""")
def observe(spark, d):
    """State after the first half of the month, then after the second."""
    ev = events(spark, d)
    half = F.col("seen_at") < F.lit(SPLIT).cast("timestamp")
    state = ST.observe(state_of(spark, ev.where(half)), ev.where(~half))
    return state.select("key", "company", "url", "source", F.col("posted_date").cast("string"),
                        epoch_us(F.col("first_seen")).alias("first_us"),
                        epoch_us(F.col("last_seen")).alias("last_us"))


@query("first_seen", f"""
WITH {EV}, s AS (SELECT key, min(ts) AS f FROM ev WHERE ts < TIMESTAMP '{SPLIT}' GROUP BY key)
SELECT n, key, epoch_us(f) AS first_us FROM ev LEFT JOIN s USING (key)""")
def first_seen(spark, d):
    ev = events(spark, d)
    state = state_of(spark, ev.where(F.col("seen_at") < F.lit(SPLIT).cast("timestamp")))
    return ST.first_seen(ev, state).select(
        F.col("ingest_seq").alias("n"), "key", epoch_us(F.col("first_seen")).alias("first_us"))


@query("record_verdicts", f"""
WITH {EV}, s AS (SELECT DISTINCT key FROM ev WHERE ts < TIMESTAMP '{SPLIT}'),
v AS (SELECT key, max(ts) AS t, arg_max(event_type, ts) AS st FROM ev
  WHERE ts >= TIMESTAMP '{SPLIT}' GROUP BY key)
SELECT key, st AS last_status, epoch_us(t) AS verified_us FROM s LEFT JOIN v USING (key)""")
def record_verdicts(spark, d):
    ev = events(spark, d)
    half = F.col("seen_at") < F.lit(SPLIT).cast("timestamp")
    verdicts = ev.where(~half).select("key", F.col("title").alias("live_status"),
                                      F.col("seen_at").alias("live_checked_at"))
    return ST.record_verdicts(state_of(spark, ev.where(half)), verdicts).select(
        "key", "last_status", epoch_us(F.col("last_verified")).alias("verified_us"))


def runs(spark, d):
    """Each day is a run; the runs of the 1st and of every 10th day never finished.
    Errors are not reported."""
    ev = table(spark, d, "events").select(
        F.dayofmonth("ts").cast("bigint").alias("run_id"),
        F.concat_ws("|", "user_id", "event_type").alias("key"),
        (F.col("event_type") != "error").alias("reported"), F.col("ts").cast("timestamp").alias("ts"))
    listings = ev.groupBy("run_id", "key").agg(F.max("reported").alias("reported"))
    log = ev.groupBy("run_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("_end"))
    done = (F.col("run_id") > 1) & (F.col("run_id") % 10 > 0)
    return log.withColumn("finished_at", F.when(done, F.col("_end"))).drop("_end"), listings


RUNS = """rl AS (SELECT DISTINCT day(ts) AS run_id, user_id || '|' || event_type AS key,
  event_type <> 'error' AS reported FROM events),
log AS (SELECT run_id, run_id > 1 AND run_id % 10 > 0 AS done FROM (SELECT DISTINCT run_id FROM rl)),
cur AS (SELECT key FROM rl WHERE reported AND run_id = (SELECT max(run_id) FROM log)),
prev AS (SELECT key FROM rl WHERE reported AND run_id = (SELECT max(run_id) FROM log
  WHERE done AND run_id < (SELECT max(run_id) FROM log)))"""


def _sides(spark, d):
    log, listings = runs(spark, d)
    last = log.agg(F.max("run_id")).first()[0]
    current = listings.where((F.col("run_id") == last) & F.col("reported")).select("key")
    return current, ST.previous_reported(log, listings, last)


@query("run_diff", f"""
WITH {RUNS} SELECT key, 'new' AS change FROM (FROM cur EXCEPT FROM prev)
UNION ALL SELECT key, 'closed' FROM (FROM prev EXCEPT FROM cur)""")
def run_diff(spark, d):
    return ST.diff_keys(*_sides(spark, d))


@query("new_keys", f"WITH {RUNS} FROM cur EXCEPT FROM prev")
def new_keys(spark, d):
    return ST.new_keys(*_sides(spark, d))


@query("closed_keys", f"WITH {RUNS} FROM prev EXCEPT FROM cur")
def closed_keys(spark, d):
    return ST.closed_keys(*_sides(spark, d))


@query("previous_run", f"WITH {RUNS} SELECT max(run_id) AS prev_run FROM log WHERE done")
def previous_run(spark, d):
    return ST.previous_run(runs(spark, d)[0])


@query("run_counters", """
WITH e AS (SELECT user_id || '|' || event_type AS key, event_type, value FROM events),
k AS (SELECT key, any_value(event_type) AS t FROM e GROUP BY key)
SELECT (SELECT count(*) FROM e) AS n_fetched, (SELECT count(*) FROM k) AS n_listings,
  count(*) FILTER (t <> 'view') AS n_eligible, count(*) FILTER (t = 'error') AS n_dead,
  count(*) FILTER (t NOT IN ('view', 'error')) AS n_retained,
  count(*) FILTER (t = 'click') AS n_reported FROM k""")
def run_counters(spark, d):
    """Rows, keys, then keys by type: errors count as dead, clicks as reported."""
    ev = events(spark, d).select("key", "title")
    merged = ev.groupBy("key").agg(F.min("title").alias("title"))
    checked = merged.where("title <> 'view'").withColumn(
        "live_status", F.when(F.col("title") == "error", "dead").otherwise("live"))
    return ST.run_counters(ev, merged, checked, merged.where("title = 'click'"))


@query("seen_times", """
SELECT user_id || '|' || event_type AS key, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us,
  arg_max(event_id, ts) AS url FROM events GROUP BY ALL""")
def seen_by_key(spark, d):
    rows = table(spark, d, "events").select(
        F.concat_ws("|", "user_id", "event_type").alias("key"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("url"))
    return seen_times(rows).select("key", epoch_us(F.col("first_seen")).alias("first_us"),
                                   epoch_us(F.col("last_seen")).alias("last_us"), "url")


@query("run_log", f"""
WITH {EV}, half AS (SELECT DISTINCT key, ts < TIMESTAMP '{SPLIT}' AS early FROM ev)
SELECT 1::BIGINT AS run_id, true AS finished, count(*) FILTER (early) AS n_listings,
  count(*) FILTER (early AND key LIKE '%|click') AS n_reported FROM half
UNION ALL SELECT 2, true, count(*) FILTER (NOT early), count(*) FILTER (NOT early AND key LIKE '%|click') FROM half
UNION ALL SELECT 3, false, NULL, NULL""")
def run_log(spark, d):
    """Two finished runs over the halves of the month, the second one twice, and one broken off."""
    root = f"{shared_dir(spark)}/runs-{uuid.uuid4()}"
    for early in (True, False):
        run = ST.start_run(spark, root, datetime(2024, 1, 1))
        rows = events(spark, d).where((F.col("seen_at") < F.lit(SPLIT).cast("timestamp")) == F.lit(early))
        rows = rows.select("key", F.col("key").endswith("|click").alias("reported"), F.lit("live").alias("live_status"))
        for _ in range(1 if early else 2):
            ST.record_run_listings(rows, root, run)
            kept = ST.read_run_listings(spark, root).where(F.col("run_id") == run)
            n = kept.agg(F.count("*").alias("n"), F.count_if("reported").alias("r")).first()
            ST.finish_run(spark, root, run, datetime(2024, 1, 2), n["n"], n["r"])
    ST.start_run(spark, root, datetime(2024, 1, 3))
    return ST.read_runs(spark, root).select(
        F.col("run_id").cast("bigint"), F.col("finished_at").isNotNull().alias("finished"), "n_listings", "n_reported")


LOG_DAYS, LOG_RUNS = 3, 10


@query("state_log", f"""
WITH {OBSERVED} SELECT key, company, url, source, posted::VARCHAR AS posted_date,
  epoch_us(first_seen) AS first_us, epoch_us(last_seen) AS last_us,
  CASE WHEN key LIKE '%|error' THEN 'dead' END AS last_status,
  CASE WHEN key LIKE '%|error' THEN epoch_us(last_seen) END AS verified_us FROM obs""")
def state_log(spark, d):
    """The month as ten runs of three days, the third one twice; every run writes only its own keys,
    errors as verdicts, and tiers of four runs are merged. The view reads what is left."""
    root = f"{shared_dir(spark)}/log-{uuid.uuid4()}"
    ev = events(spark, d).withColumn("_run", F.least(F.lit(LOG_RUNS), F.floor((F.dayofmonth("seen_at") - 1) / LOG_DAYS) + 1))
    for run in [1, 2, 3, *range(3, LOG_RUNS + 1)]:
        rows = ev.where(F.col("_run") == run)
        verdicts = rows.where("title = 'error'").select("key", F.lit("dead").alias("live_status"), F.col("seen_at").alias("live_checked_at"))
        ST.write_delta(spark, root, run, ST.delta(ST.fold_batch(rows), verdicts, run))
    return ST.state_view(spark, root).select(
        "key", "company", "url", "source", F.col("posted_date").cast("string"), epoch_us(F.col("first_seen")).alias("first_us"),
        epoch_us(F.col("last_seen")).alias("last_us"), "last_status", epoch_us(F.col("last_verified")).alias("verified_us"))
