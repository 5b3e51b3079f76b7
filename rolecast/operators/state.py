"""What was seen when: keyed state, run log and run-over-run difference.

State is a log of deltas in a ledger (`operators/ledger.py`): a run writes one row for each key it
saw or judged, numbered by the run, and never reads or rewrites the others. Readers merge the rows
of a key; the sets are merged by size tiers, so a row is rewritten a logarithmic number of times.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rolecast.operators import ledger
from rolecast.operators.common import lookup_join

STATE_SCHEMA = (
    "key string, company string, title string, location string, url string, source string, "
    "posted_date date, first_seen timestamp, last_seen timestamp, last_status string, "
    "last_verified timestamp")
RUN_SCHEMA = ("run_id long, started_at timestamp, finished_at timestamp, n_listings long, "
              "n_reported long")
RUN_LISTING_SCHEMA = "run_id long, key string, reported boolean, live_status string"


def fold_batch(batch: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """One row per key of a batch with key, seen_at and posting fields.

    The first row freezes company, title and location; the last gives url and source;
    the last known date counts. Only min_by and max_by, folded before the shuffle.
    """
    return folded(batch.groupBy("key").agg(*[c.alias(n) for n, c in fold_columns(seq).items()]), "key")


def fold_columns(seq: str = "ingest_seq") -> dict[str, Column]:
    """The aggregates of `fold_batch`, by name."""
    return {
        "_first": F.min_by(F.struct("company", "title", "location"), seq),
        "_last": F.max_by(F.struct(F.col("apply_url").alias("url"), "source"), seq),
        "_dated": F.max_by("posted_date", F.when(F.col("posted_date").isNotNull(), F.col(seq))),
        "_from": F.min("seen_at"), "_until": F.max("seen_at")}


def folded(rows: DataFrame, *keep: str) -> DataFrame:
    """The rows of `fold_batch` from its aggregates."""
    return rows.select(*keep, "_first.*", "_last.*", F.col("_dated").alias("posted_date"),
                       F.col("_from").alias("first_seen"), F.col("_until").alias("last_seen"))


def observe(state: DataFrame, batch: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """The state after a batch. first_seen never moves, last_seen does."""
    return observe_folded(state, fold_batch(batch, seq))


def observe_folded(state: DataFrame, new: DataFrame) -> DataFrame:
    """The state after the folded rows of a batch."""
    new = new.withColumnsRenamed({c: f"n_{c}" for c in new.columns if c != "key"})
    both = state.join(new, "key", "full_outer")
    known, again = F.col("first_seen").isNotNull(), F.col("n_first_seen").isNotNull()
    frozen = {c: F.when(known, F.col(c)).otherwise(F.col(f"n_{c}"))
              for c in ("company", "title", "location")}
    moving = {c: F.when(again, F.col(f"n_{c}")).otherwise(F.col(c))
              for c in ("url", "source")}
    return both.select(
        "key", *[c.alias(n) for n, c in (frozen | moving).items()],
        F.coalesce("n_posted_date", "posted_date").alias("posted_date"),
        F.coalesce("first_seen", "n_first_seen").alias("first_seen"),
        F.greatest("last_seen", "n_last_seen").alias("last_seen"),
        "last_status", "last_verified")


def first_seen(listings: DataFrame, state: DataFrame) -> DataFrame:
    """Adds first_seen by key. The listings may repeat a key any number of times."""
    seen = state.select("key", "first_seen")
    return lookup_join(listings.drop("first_seen"), seen, ["key"], "left")


def record_verdicts(state: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Sets last_status and last_verified for the keys of `verdicts`
    (key, live_status, live_checked_at); the newest verdict of a key counts."""
    new = verdicts.groupBy("key").agg(F.max(F.struct("live_checked_at", "live_status")).alias("_v"))
    out = state.join(new, "key", "left")
    hit = F.col("_v").isNotNull()
    return (out.withColumn("last_status", F.when(hit, F.col("_v.live_status"))
                           .otherwise(F.col("last_status")))
            .withColumn("last_verified", F.when(hit, F.col("_v.live_checked_at"))
                        .otherwise(F.col("last_verified"))).drop("_v"))


def previous_run(runs: DataFrame, before=None) -> DataFrame:
    """(prev_run): the latest finished run, of those before run `before`."""
    done = runs.where(F.col("finished_at").isNotNull())
    if before is not None:
        done = done.where(F.col("run_id") < before)
    return done.agg(F.max("run_id").alias("prev_run"))


def previous_reported(runs: DataFrame, run_listings: DataFrame, run_id) -> DataFrame:
    """(key): keys reported in the latest finished run before `run_id`."""
    last = previous_run(runs, run_id)
    return (run_listings.where("reported")
            .join(F.broadcast(last), F.col("run_id") == F.col("prev_run"))  # one row
            .select("key").distinct())


def diff_keys(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(key, change): 'new' or 'closed' keys between two sets of keys."""
    cur = current.select("key", F.lit(1).alias("c"), F.lit(0).alias("p"))
    prev = previous.select("key", F.lit(0).alias("c"), F.lit(1).alias("p"))
    both = cur.unionByName(prev).groupBy("key").agg(F.max("c").alias("c"), F.max("p").alias("p"))
    return both.where("c <> p").select(
        "key", F.when(F.col("c") == 1, "new").otherwise("closed").alias("change"))


def new_keys(current: DataFrame, previous: DataFrame) -> DataFrame:
    return diff_keys(current, previous).where("change = 'new'").select("key").orderBy("key")


def closed_keys(current: DataFrame, previous: DataFrame) -> DataFrame:
    return diff_keys(current, previous).where("change = 'closed'").select("key").orderBy("key")


def run_counters(fetched: DataFrame, merged: DataFrame, checked: DataFrame,
                 reported: DataFrame) -> DataFrame:
    """One row: rows before and after merging, eligible, dead, retained, reported."""
    def count(df: DataFrame, **more: Column) -> DataFrame:
        return df.agg(*[F.count_if(c).alias(n) for n, c in more.items()])

    dead = F.col("live_status") == "dead"
    rows = [count(fetched, n_fetched=F.lit(True)), count(merged, n_listings=F.lit(True)),
            count(checked, n_eligible=F.lit(True), n_dead=dead, n_retained=~F.coalesce(dead, F.lit(False))),
            count(reported, n_reported=F.lit(True))]
    # Each table is read once and gives one row.
    parts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    names = ["n_fetched", "n_listings", "n_eligible", "n_dead", "n_retained", "n_reported"]
    return parts.agg(*[F.max(n).alias(n) for n in names])


# ---- the state as a log of deltas -------------------------------------------

STATE, LISTED, ENDED = "state", "listed", "ended"   # tables of the ledger
DELTA_SCHEMA = f"{STATE_SCHEMA}, since long, until long, dated_in long, judged_in long, bucket int"
BUCKETS = 1024
ORDER = ["bucket", "key"]


def delta(folded: DataFrame | None, verdicts: DataFrame | None, run: int) -> DataFrame:
    """The rows a run adds to the log: of keys seen (as `fold_batch` gives them) and of keys judged
    (key, live_status, live_checked_at). `since`, `until`, `dated_in` and `judged_in` are the runs that
    saw the key first and last, gave its date and judged it."""
    now = F.lit(run).cast("long")
    parts = []
    if folded is not None:
        parts.append(folded.withColumns({
            "since": now, "until": now, "dated_in": F.when(F.col("posted_date").isNotNull(), now)}))
    if verdicts is not None:
        newest = F.max(F.struct("live_checked_at", "live_status")).alias("v")
        parts.append(verdicts.groupBy("key").agg(newest).select(
            "key", F.col("v.live_status").alias("last_status"), F.col("v.live_checked_at").alias("last_verified"),
            now.alias("judged_in")))
    empty = next(p.sparkSession for p in parts).createDataFrame([], DELTA_SCHEMA)
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [empty.drop("bucket"), *parts])
    return merge_deltas(rows) if len(parts) > 1 else _bucketed(rows)


def _bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))


def merge_deltas(rows: DataFrame) -> DataFrame:
    """One row per key of rows of the log, in any order and grouping."""
    merged = rows.groupBy("key").agg(
        F.min_by(F.struct("company", "title", "location", "first_seen"), "since").alias("_first"),
        F.max_by(F.struct("url", "source"), "until").alias("_last"),
        F.max_by("posted_date", "dated_in").alias("posted_date"),
        F.max("last_seen").alias("last_seen"),
        F.max_by(F.struct("last_status", "last_verified"), "judged_in").alias("_verdict"),
        F.min("since").alias("since"), F.max("until").alias("until"),
        F.max("dated_in").alias("dated_in"), F.max("judged_in").alias("judged_in"))
    return _bucketed(merged.select("key", "_first.*", "_last.*", "posted_date", "last_seen", "_verdict.*",
                                   "since", "until", "dated_in", "judged_in"))


def state_view(spark: SparkSession, root: str, commit: int | None = None, keys: DataFrame | None = None) -> DataFrame:
    """The state as of a commit, or the rows of some keys of it.

    A key that was judged but never seen has no row. Files are sorted by buckets of the key, so
    a few keys (their buckets are counted) read just the row groups of their buckets."""
    sets = ledger.live_sets(spark, root, STATE, commit)
    rows = ledger._rows(spark, root, sets, DELTA_SCHEMA)
    if keys is not None:
        wanted = [r[0] for r in _bucketed(keys.select("key")).select("bucket").distinct().collect()]  # at most BUCKETS
        rows = rows.where(F.col("bucket").isin(wanted)).join(keys.select("key").distinct(), "key", "left_semi")
    if len(sets) > 1:
        rows = merge_deltas(rows)
    judged = F.col("judged_in") >= F.col("since")   # not before the key was seen
    verdict = {c: F.when(judged, F.col(c)) for c in ("last_status", "last_verified")}
    return rows.where("since IS NOT NULL").withColumns(verdict).select(*[f.split()[0] for f in STATE_SCHEMA.split(", ")])


def write_delta(spark: SparkSession, root: str, run: int, rows: DataFrame, **tables: DataFrame) -> None:
    """Shows the rows of a run together, replacing those of an earlier try, and merges full tiers."""
    order, runs = {STATE: ORDER, LISTED: ["key"]}, {LISTED: "run_id", ENDED: "run_id"}
    ledger.replace_run(spark, root, run, {STATE: rows, **tables}, order, runs)
    ledger.compact(spark, root, STATE, DELTA_SCHEMA, merge_deltas, ORDER)
    for name, schema in ((LISTED, RUN_LISTING_SCHEMA), (ENDED, RUN_SCHEMA)):
        if name in tables:
            ledger.compact(spark, root, name, schema, lambda df: df, order.get(name))


# ---- run log ----------------------------------------------------------------

def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """Run log, one row per run; a run without an end is unfinished. Ends are either logged by
    `finish_run` or committed with the rows of their run."""
    events = ledger.read(spark, root, ENDED, RUN_SCHEMA)
    started = ledger._read(spark, f"{root}/runs", RUN_SCHEMA)
    if started is not None:
        events = events.unionByName(started.select(*events.columns))
    return events.groupBy("run_id").agg(
        *[F.max(c).alias(c) for c in ("started_at", "finished_at", "n_listings", "n_reported")])


def start_run(spark: SparkSession, root: str, at) -> int:
    """Logs a run and returns its id, one above the highest so far."""
    last = read_runs(spark, root).agg(F.max("run_id")).first()[0]
    run_id = (last or 0) + 1
    _log(spark, root, run_id, "start", started_at=at)
    return run_id


def finish_run(spark: SparkSession, root: str, run_id: int, at, n_listings: int,
               n_reported: int) -> None:
    _log(spark, root, run_id, "end", finished_at=at, n_listings=n_listings, n_reported=n_reported)


def _log(spark, root, run_id, part, **values):
    fields = ("run_id", "started_at", "finished_at", "n_listings", "n_reported")
    row = tuple(run_id if f == "run_id" else values.get(f) for f in fields)
    (spark.createDataFrame([row], RUN_SCHEMA).coalesce(1).write.mode("overwrite")
     .parquet(f"{root}/runs/entry={run_id}-{part}"))


def record_run_listings(listings: DataFrame, root: str, run_id: int) -> None:
    """Writes (key, reported, live_status) of a run; the same run again replaces it.
    A key reported by any of its rows counts as reported."""
    (listings.groupBy("key").agg(F.max("reported").alias("reported"),
                                 F.max("live_status").alias("live_status"))
     .write.mode("overwrite").parquet(f"{root}/run_listings/run_id={run_id}"))


def read_run_listings(spark: SparkSession, root: str) -> DataFrame:
    """Rows of all runs, written by themselves or committed with their run."""
    rows = ledger.read(spark, root, LISTED, RUN_LISTING_SCHEMA)
    alone = ledger._read(spark, f"{root}/run_listings", RUN_LISTING_SCHEMA, basePath=f"{root}/run_listings")
    return rows if alone is None else rows.unionByName(alone.select(*rows.columns))
