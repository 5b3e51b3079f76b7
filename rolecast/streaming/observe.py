"""Keyed state over a posting stream, and dedupe within a horizon."""

from pyspark.sql import DataFrame, functions as F

from rolecast.operators import ledger, state as st

STREAM = "stream_state"


def seen_times(rows: DataFrame, key: str = "key", ts: str = "ts", url: str = "url") -> DataFrame:
    """(key, first_seen, last_seen, url): folded per key; works on tables and streams."""
    return rows.groupBy(key).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"),
                                 F.max_by(url, ts).alias(url))


def observe_stream(stream: DataFrame, root: str, checkpoint: str, trigger: dict | None = None):
    """Adds each micro-batch as a delta to the state under `root`/stream_state (`state.state_view`).

    The stream has the posting fields, key, seen_at and ingest_seq. Batch n writes run n + 1 of the
    log, so a batch run twice replaces its own rows. The first batch of a new stream also
    takes over the state of the runs under `root`, as run 0.
    """
    log = f"{root}/{STREAM}"

    def fold(batch: DataFrame, n: int) -> None:
        # The batch has its own session, which carries the settings of the stream.
        spark = batch.sparkSession
        if not n and ledger.newest(spark, root) and not ledger.newest(spark, log):
            before = [s for s in ledger.live_sets(spark, root, st.STATE)]
            rows = st.merge_deltas(ledger._rows(spark, root, before, st.DELTA_SCHEMA))
            # What the runs knew comes before all batches.
            rows = rows.withColumns({c: F.when(F.col(c).isNotNull(), F.lit(0).cast("long")) for c in (
                "since", "until", "dated_in", "judged_in")})
            st.write_delta(spark, log, 0, rows)
        st.write_delta(spark, log, n + 1, st.delta(st.fold_batch(batch), None, n + 1))

    return (stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def dedupe_stream(stream: DataFrame, key: list[str], ts: str = "ts",
                  horizon: str = "30 days") -> DataFrame:
    """First row of each key within the horizon; later copies are dropped."""
    return (stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, horizon)
            .dropDuplicatesWithinWatermark(key))
