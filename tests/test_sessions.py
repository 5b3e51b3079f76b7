"""Sessions over a stream: timers, late rows, hot and null keys, restarts."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rolecast.streaming import sessions as S

T0 = datetime(2026, 1, 1)


def hours(*h):
    return [T0 + timedelta(hours=x) for x in h]


class Drops:
    def __init__(self, spark, path):
        self.spark, self.path, self.late = spark, str(path), 0

    def __call__(self, rows, make=S.sessions):
        self.spark.createDataFrame(rows, "key string, ts timestamp, state string").write.mode("append").parquet(f"{self.path}/in")
        stream = self.spark.readStream.schema("key string, ts timestamp, state string").parquet(f"{self.path}/in")
        self.late += S.late_rows(S.drain(make(stream, "6 hours", "3 hours"), self.path))
        return sorted(tuple(r) for r in self.spark.read.parquet(f"{self.path}/rows").collect())


def rows(key, *h):
    return [(key, t, "x") for t in hours(*h)]


def test_keys_open_and_close(spark, tmp_path):
    drop = Drops(spark, tmp_path)
    at = lambda h: hours(h)[0]
    first = drop(rows("a", 1, 0, 5) + rows("b", 0) + rows(None, 1) + [("c", None, "x")])
    assert first == [("a", "open", at(0), at(0), 1), ("b", "open", at(0), at(0), 1)]
    # The gap within one drop splits a session; b is closed by its timer, a by its next row.
    second = drop(rows("a", 11, 30, 31))
    assert set(second) - set(first) == {("a", "closed", at(0), at(11), 4), ("a", "open", at(30), at(30), 1), ("b", "closed", at(0), at(0), 1)}
    # Seen again after it was closed: a session of its own. Rows behind the watermark are counted.
    third = drop(rows("b", 40, 40) + rows("a", 2))
    assert set(third) - set(second) == {("b", "open", at(40), at(40), 1)} and drop.late == 1
    last = drop(rows("z", 90))
    assert set(last) - set(third) == {("a", "closed", at(30), at(31), 2), ("b", "closed", at(40), at(40), 2), ("z", "open", at(90), at(90), 1)}
    assert drop([]) == last


def test_first_rows_keep_one_of_a_hot_key(spark, tmp_path):
    drop = Drops(spark, tmp_path)
    many = [("hot", T0 + timedelta(minutes=i % 300), "x") for i in range(3000)] + rows("cold", 0, 20)
    got = drop(many, S.first_rows)
    assert got == [("cold", T0), ("cold", hours(20)[0]), ("hot", T0)]


def test_keys_of_one_bucket_are_followed_apart(spark, tmp_path):
    drop = Drops(spark, tmp_path)
    one = lambda *a: S.sessions(*a, buckets=1)
    at = lambda h: hours(h)[0]
    first = drop(rows("a", 0) + rows("b", 8) + rows("c", 9), one)
    assert first == [(k, "open", at(h), at(h), 1) for k, h in (("a", 0), ("b", 8), ("c", 9))]
    # The bucket has a row, which closes the due key without rows and no other.
    second = drop(rows("c", 13), one)
    assert set(second) - set(first) == {("a", "closed", at(0), at(0), 1)}
    # Without a row for b or c, timers close them; the state of the bucket goes on.
    third = drop(rows("d", 40), one)
    assert set(third) - set(second) == {("b", "closed", at(8), at(8), 1), ("c", "closed", at(9), at(13), 2), ("d", "open", at(40), at(40), 1)}


def test_python_is_called_per_bucket(spark, tmp_path):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), F.lit(T0).cast("timestamp").alias("ts"))
    keys.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(keys.schema).parquet(f"{tmp_path}/in")
    job = S.drain(S.sessions(stream, "6 hours", "3 hours"), str(tmp_path))
    states = max(op["numRowsTotal"] for p in job.recentProgress for op in S._plain(p)["stateOperators"])
    assert states <= S.BUCKETS and spark.read.parquet(f"{tmp_path}/rows").count() == 3000
