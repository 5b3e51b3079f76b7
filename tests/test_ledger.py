"""Sets, commits and merging by tiers; the state as a log of deltas."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rolecast.operators import ledger as LG, state as ST
from rolecast.streaming.observe import STREAM, observe_stream

T0 = datetime(2026, 6, 1)
BATCH = ("ingest_seq long, key string, company string, title string, location string, apply_url string, "
         "source string, posted_date date, seen_at timestamp")


def rows(spark, *keys, seq=0, at=T0, posted=None):
    return spark.createDataFrame([(seq + i, k, f"c{seq}", "t", "l", f"u{seq + i}", "s", posted, at) for i, k in enumerate(keys)], BATCH)


def verdicts(spark, *pairs, at=T0):
    return spark.createDataFrame([(k, v, at) for k, v in pairs], "key string, live_status string, live_checked_at timestamp")


def view(spark, root, **kw):
    return {r["key"]: r for r in ST.state_view(spark, root, **kw).collect()}


def test_a_set_without_a_commit_is_not_seen(spark, tmp_path):
    root = str(tmp_path)
    assert LG.read(spark, root, "a", "x int").count() == 0 and LG.newest(spark, root) == 0
    one, two = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "x int")
    LG.replace_run(spark, root, 1, {"a": one, "b": one})
    # A run that breaks off after its first table leaves both tables as they were.
    LG.write_set(two, root, "a", 2, 2)
    assert [LG.read(spark, root, t, "x int").collect()[0][0] for t in "ab"] == [1, 1]
    LG.replace_run(spark, root, 2, {"a": two, "b": two})
    LG.replace_run(spark, root, 2, {"a": two, "b": two})  # again: replaced
    assert [sorted(r[0] for r in LG.read(spark, root, t, "x int").collect()) for t in "ab"] == [[1, 2], [1, 2]]
    assert LG.read(spark, root, "a", "x int", commit=1).count() == 1  # older commits can still be read
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        spark.createDataFrame([], LG.MANIFEST).write.parquet(f"{root}/manifest/commit=3")
    before = LG.size_of(spark, root)
    gone = LG.vacuum(spark, root)
    assert len(gone) == 2 + 3 and LG.size_of(spark, root) < before  # two commits, the lost set and the replaced two
    assert LG.read(spark, root, "a", "x int").count() == 2
    assert LG.vacuum(spark, root) == []


def test_tiers_keep_sets_few_and_runs_replaceable(spark, tmp_path):
    root = str(tmp_path)
    data = lambda run: spark.createDataFrame([(run, run * 10)], "run_id long, x long")
    for run in range(1, 22):
        LG.replace_run(spark, root, run, {"a": data(run)}, run_column={"a": "run_id"})
        LG.compact(spark, root, "a", "run_id long, x long", lambda df: df)
        sets = LG.live_sets(spark, root, "a")
        assert len(sets) <= 3 * 3 and [s.n_rows for s in sets] == [s.last_run - s.first_run + 1 for s in sets]
    assert [(s.level, s.first_run, s.last_run) for s in LG.live_sets(spark, root, "a")] == [(2, 1, 16), (1, 17, 20), (0, 21, 21)]
    LG.replace_run(spark, root, 5, {"a": spark.createDataFrame([(5, 7)], "run_id long, x long")}, run_column={"a": "run_id"})
    assert sorted(map(tuple, LG.read(spark, root, "a", "run_id long, x long").collect())) == [(r, 7 if r == 5 else 10 * r) for r in range(1, 22)]


def test_log_of_deltas_equals_state(spark, tmp_path):
    """Against the state rewritten whole, for runs that overlap, repeat and judge."""
    root, state = str(tmp_path), spark.createDataFrame([], ST.STATE_SCHEMA)
    for run in range(1, 8):
        at = T0 + timedelta(days=run)
        batch = rows(spark, *[f"k{(run * 3 + i) % 11}" for i in range(5)], "k0", seq=run * 100, at=at,
                     posted=date(2026, 5, run) if run % 2 else None)
        said = verdicts(spark, (f"k{run}", "dead" if run % 3 else "live"), ("never seen", "live"), at=at)
        state = ST.record_verdicts(ST.observe(state, batch), said)
        for _ in range(2 if run == 4 else 1):
            ST.write_delta(spark, root, run, ST.delta(ST.fold_batch(batch), said, run))
        want = {r["key"]: r for r in state.collect()}
        assert view(spark, root) == want
    some = spark.createDataFrame([("k3",), ("no",), ("k3",)], "key string")
    assert view(spark, root, keys=some) == {"k3": want["k3"]}
    assert len(LG.live_sets(spark, root, ST.STATE)) <= 5


def test_a_verdict_before_the_key_was_seen_does_not_count(spark, tmp_path):
    root = str(tmp_path)
    ST.write_delta(spark, root, 1, ST.delta(ST.fold_batch(rows(spark, "a")), verdicts(spark, ("b", "dead")), 1))
    assert set(view(spark, root)) == {"a"}
    ST.write_delta(spark, root, 2, ST.delta(ST.fold_batch(rows(spark, "b", at=None)), None, 2))
    assert view(spark, root)["b"]["last_status"] is None
    ST.write_delta(spark, root, 3, ST.delta(None, verdicts(spark, ("b", "live")), 3))
    assert view(spark, root)["b"]["last_status"] == "live"


def test_a_small_run_writes_little(spark, tmp_path):
    root, n = str(tmp_path), 40_000
    many = spark.range(n).select(F.col("id").alias("ingest_seq"), F.sha2(F.col("id").cast("string"), 256).alias("key"),
                                 *[F.sha2(F.concat(F.lit(c), F.col("id").cast("string")), 256).alias(c) for c in ("company", "title", "location", "apply_url")],
                                 F.lit("s").alias("source"), F.lit(date(2026, 6, 1)).alias("posted_date"), F.lit(T0).alias("seen_at"))
    for run, batch in ((1, many), (2, many.where("ingest_seq % 100 = 0"))):
        ST.write_delta(spark, root, run, ST.delta(ST.fold_batch(batch), None, run))
    first, second = [LG.size_of(spark, f"{root}/{s.path}") for s in LG.live_sets(spark, root, ST.STATE)]
    assert second < first * 0.05
    assert ST.state_view(spark, root).count() == n


def test_stream_continues_the_runs(spark, tmp_path):
    root, src = f"{tmp_path}/state", f"{tmp_path}/in"
    ST.write_delta(spark, root, 1, ST.delta(ST.fold_batch(rows(spark, "a", at=T0)), None, 1))
    for k, (seq, keys) in enumerate([(10, ["a", "b"]), (20, ["b", "c"])]):
        rows(spark, *keys, seq=seq, at=T0 + timedelta(days=k + 1)).coalesce(1).write.mode("append").parquet(src)
        # The second drop comes after a restart.
        observe_stream(spark.readStream.schema(BATCH).parquet(src), root, f"{tmp_path}/offsets").awaitTermination()
    got = view(spark, f"{root}/{STREAM}")
    assert {k: (r["company"], r["first_seen"].day, r["last_seen"].day) for k, r in got.items()} == {
        "a": ("c0", 1, 2), "b": ("c10", 2, 3), "c": ("c20", 3, 3)}
    assert view(spark, root)["a"]["last_seen"] == T0  # the runs' own state stays
