"""Streaming queries: a file stream of the event table, drained to the end."""

import uuid

from pyspark.sql import functions as F

from rolecast.catalog.base import epoch_us, query, table
from rolecast.catalog.state import OBSERVED
from rolecast.catalog.ingest import DOCS, docs, role_sql
from rolecast.operators import state as ST
from rolecast.operators.common import shared_dir
from rolecast.sources import boards as B
from rolecast.streaming import landing as LA, sessions as SE
from rolecast.streaming.observe import STREAM, dedupe_stream, observe_stream

EVENTS = ("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, "
          "props string")


def event_stream(spark, d):
    return (spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(d)
            .select(F.col("event_id").alias("ingest_seq"),
                    F.concat_ws("|", "user_id", "event_type").alias("key"),
                    F.concat(F.lit("c"), "event_id").alias("company"),
                    F.col("event_type").alias("title"), F.col("user_id").cast("string").alias("location"),
                    F.concat(F.lit("u"), "event_id").alias("apply_url"), F.col("props").alias("source"),
                    F.when(F.col("event_id") % 3 == 0, F.col("ts").cast("date")).alias("posted_date"),
                    F.col("ts").cast("timestamp").alias("seen_at")))


@query("stream_observe", f"""
WITH {OBSERVED} SELECT key, company, url, source, posted::VARCHAR AS posted_date,
  epoch_us(first_seen) AS first_us, epoch_us(last_seen) AS last_us FROM obs""")
def stream_observe(spark, d):
    root = f"{shared_dir(spark)}/observe-{uuid.uuid4()}"
    job = observe_stream(event_stream(spark, d), root, f"{root}/offsets")
    job.awaitTermination()
    return ST.state_view(spark, f"{root}/{STREAM}").select(
        "key", "company", "url", "source", F.col("posted_date").cast("string"),
        epoch_us(F.col("first_seen")).alias("first_us"),
        epoch_us(F.col("last_seen")).alias("last_us"))


@query("stream_dedupe", """
SELECT DISTINCT user_id || '|' || event_type AS key FROM events""")
def stream_dedupe(spark, d):
    """The horizon spans the month, so every key is kept once."""
    root = f"{shared_dir(spark)}/dedupe-{uuid.uuid4()}"
    kept = dedupe_stream(event_stream(spark, d).select("key", "seen_at"), ["key"], "seen_at", "60 days")
    job = (kept.writeStream.format("parquet").option("checkpointLocation", f"{root}/offsets")
           .option("path", f"{root}/rows").trigger(availableNow=True).start())
    job.awaitTermination()
    return spark.read.parquet(f"{root}/rows").select("key")


DROPS, DROP_DAYS, LATE_BY, EVERY, HORIZON, DELAY = 4, 8, 2, 13, "3 days", "12 hours"
DROP_SQL = f"least({DROPS - 1}, (day(ts) - 1) // {DROP_DAYS})"
SESSIONS = f"""
kept AS (SELECT user_id || '|' || event_type AS key, ts FROM events
  WHERE NOT (event_id % {EVERY} = 0 AND {DROP_SQL} + {LATE_BY} < {DROPS})),
marked AS (SELECT key, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL '{HORIZON}' THEN 0 ELSE 1 END AS starts
  FROM kept WINDOW w AS (PARTITION BY key ORDER BY ts)),
numbered AS (SELECT key, ts, sum(starts) OVER (PARTITION BY key ORDER BY ts, starts ROWS UNBOUNDED PRECEDING) AS s FROM marked),
sess AS (SELECT key, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n_rows FROM numbered GROUP BY key, s)"""


def dropped_off(spark, d, make):
    """The events land in drops by time; of the early ones every 13th row comes two drops later, when
    the watermark has passed it. The stream is run after each drop, from its checkpoint."""
    root = f"{shared_dir(spark)}/drops-{uuid.uuid4()}"
    slot = F.least(F.lit(DROPS - 1), F.floor((F.dayofmonth("ts") - 1) / DROP_DAYS))
    held = (F.col("event_id") % EVERY == 0) & (slot + LATE_BY < DROPS)
    rows = table(spark, d, "events").select(F.concat_ws("|", "user_id", "event_type").alias("key"),
                                            F.col("ts").cast("timestamp").alias("ts"),
                                            F.when(held, slot + LATE_BY).otherwise(slot).alias("_drop"))
    late = 0
    for i in range(DROPS):
        rows.where(F.col("_drop") == i).drop("_drop").write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema("key string, ts timestamp").parquet(f"{root}/in")
        late += SE.late_rows(SE.drain(make(stream), root))
    return spark.read.parquet(f"{root}/rows"), late


@query("expired_keys", f"""
WITH {SESSIONS} SELECT key, epoch_us(first_seen) AS first_us, epoch_us(last_seen) AS last_us, n_rows,
  (SELECT count(*) FROM events) - (SELECT count(*) FROM kept) AS n_late
FROM (SELECT *, lead(first_seen) OVER (PARTITION BY key ORDER BY first_seen) AS again FROM sess)
WHERE again IS NOT NULL OR last_seen + INTERVAL '{HORIZON}' < (SELECT max(ts) FROM events) - INTERVAL '{DELAY}'""")
def expired_keys(spark, d):
    """Sessions of keys that were not seen for three days, closed by timers or by a later row of the
    key, and the number of late rows."""
    out, late = dropped_off(spark, d, lambda stream: SE.closed_keys(stream, HORIZON, DELAY))
    return out.select("key", epoch_us(F.col("first_seen")).alias("first_us"),
                      epoch_us(F.col("last_seen")).alias("last_us"), "n_rows", F.lit(late).cast("long").alias("n_late"))


@query("stream_dedupe_expiring", f"""
WITH {SESSIONS} SELECT key, epoch_us(first_seen) AS first_us FROM sess""")
def stream_dedupe_expiring(spark, d):
    """Each key once per session: a horizon far shorter than the data, state removed on the way."""
    out, _ = dropped_off(spark, d, lambda stream: SE.first_rows(stream, HORIZON, DELAY))
    return out.select("key", epoch_us(F.col("first_seen")).alias("first_us"))


@query("landed_stream", f"""
WITH {DOCS}, l AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'export' ELSE 'board' END AS label, doc_id % 7 = 3 AS broken FROM docs)
SELECT label AS source_label, broken AS rejected, md5(CASE WHEN broken THEN doc_id::VARCHAR ELSE title END) AS what, count(*) AS n
FROM l WHERE broken OR {role_sql("title", "text")} GROUP BY ALL""")
def landed_stream(spark, d):
    """Documents land as the files of two sources in two drops, one record in seven broken off. The
    stream stops after the first drop and goes on from its checkpoint after the second."""
    root = f"{shared_dir(spark)}/landing-{uuid.uuid4()}"
    n, title, body = F.col("doc_id"), F.col("title"), F.col("text")
    export = F.to_json(F.struct(n.cast("string").alias("company"), title.alias("title"), body.alias("description")))
    board = F.to_json(F.struct(F.lit("b").alias("slug"), n.cast("string").alias("id"), title.alias("text"), body.alias("descriptionPlain")))
    item = F.when(n % 2 == 0, export).otherwise(board)
    # The end of a record with its number in front: no JSON.
    rows = docs(spark, d).select(n, F.when(n % 7 == 3, F.concat(n.cast("string"), F.lit(" {"))).otherwise(item).alias("value"))
    sources = {"export": LA.Landed(f"{root}/export", B.EXPORT_SCHEMA, B.user_export),
               "board": LA.Landed(f"{root}/board", B.EPOCH_SCHEMA, B.epoch_board)}
    for drop in range(2):
        for i, source in enumerate(sources.values()):
            some = rows.where((n % 2 == i) & (F.floor(n / 2) % 2 == drop)).select("value")
            some.write.mode("append").text(source.path)
        LA.land(spark, sources, f"{root}/log", f"{root}/offsets").awaitTermination()
    good = LA.postings(spark, f"{root}/log").select("source_label", F.lit(False).alias("rejected"), F.md5("title").alias("what"))
    bad = LA.rejected(spark, f"{root}/log").select("source_label", F.lit(True).alias("rejected"), F.md5(F.split("record", " ")[0]).alias("what"))
    return good.unionByName(bad).groupBy("source_label", "rejected", "what").agg(F.count("*").alias("n"))
