"""Operators that keep hot groups balanced, against plain ones."""

import random

from pyspark.sql import Window as W, functions as F

from rolecast.operators import common as K


def hot(spark, n=4000):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randint(0, 300)}", rng.randint(0, 5)) for i in range(n)]
    return spark.createDataFrame(rows + [(n, None, 1)], "i long, k string, v int")


def test_lookup_join_is_the_same_in_every_way(spark):
    left = hot(spark)
    right = left.where("k is not null").groupBy("k").agg(F.max("i").alias("m")).where("m % 2 = 0")
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    for how in ("left", "inner", "left_semi", "left_anti"):
        want = key(left.join(right, ["k"], how))
        assert key(K.lookup_join(left, right, ["k"], how, small=True)) == want
        assert key(K.lookup_join(left, right, ["k"], how, small=False)) == want


def test_variants_pass_a_large_lookup(spark):
    left = hot(spark).withColumn("raw", F.to_variant_object(F.struct("v")))
    right = left.where("k is not null").select("k").distinct().withColumn("x", F.lit(1))
    got = K.lookup_join(left, right, ["k"], "left", small=False)
    assert got.where("x = 1 AND try_variant_get(raw, '$.v', 'int') = v").count() == 4000


def test_rows_of_a_product_follow_their_owner(spark):
    rows = hot(spark)
    owners = spark.createDataFrame([(i, k) for i, k in enumerate(["hot"] * 9 + [f"k{i}" for i in range(40)]
                                                                 + ["hot", "none", None])], "owner int, k string")
    counts = rows.groupBy("k").agg(F.count("*").alias("_n"))
    want = sorted(owners.join(rows, "k").select("k", "owner", "i", "v").collect())
    for run, parts in ((100, 4), (1000, 2), (10_000, 1)):
        got = K.product_join(owners, rows, ["k"], counts, ["i"], run, 4).select("k", "owner", "i", "v").collect()
        assert sorted(got) == want
        met = [r["owner"] for r in got if r["k"] == "hot"]
        assert 1 + sum(a != b for a, b in zip(met, met[1:])) <= 10 * parts
    assert K.product_join(owners, rows.limit(0), ["k"], counts.limit(0), ["i"]).count() == 0


def test_hot_keys_are_spread(spark):
    left = hot(spark)
    right = left.where("k is not null").select("k").distinct().withColumn("x", F.lit(1))
    plan = K.lookup_join(left, right, ["k"], "left", small=False)._jdf.queryExecution().toString()
    assert "_salt" in plan


def test_null_keys_are_spread(spark):
    left = spark.range(0, 8000, numPartitions=4).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).alias("k"))
    right = spark.range(0, 8000, 7).select(F.col("id").alias("k"), F.lit(1).alias("x"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = K.lookup_join(left, right, ["k"], "left", small=False)
        sizes = [r["n"] for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 8000 and max(sizes) < 2 * 8000 / 4
    assert got.where("x = 1").count() == left.join(right, "k").count()


def test_ranges_are_numbered(spark):
    df = hot(spark).where("k is not null")
    order = [F.col("k").desc(), F.col("i")]
    plain = df.withColumn("r", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))
    assert sorted(K.number_all(df, [F.col("v"), F.col("i")], "r").select("r").collect()) == sorted(plain.select("r").collect())
    got = K.number_all(df, [F.col("v"), F.col("i")], "r").orderBy("r").select("v", "i").collect()
    assert got == sorted(got)


def test_equal_rows_of_a_hot_key(spark):
    left = spark.range(0, 3000, numPartitions=8).select(F.lit("hot").alias("k"))
    right = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, x int")
    got = K.lookup_join(left, right, ["k"], "inner", small=False)
    assert (got.count(), got.agg(F.sum("x")).first()[0]) == (3000, 3000)


def test_size_check(spark):
    df = hot(spark)
    assert K.is_small(df) and not K.is_small(df, rows=100) and not K.is_small(df, size=1000)


def test_forward_fill_over_chunks(spark):
    df = hot(spark)
    assert df.where("k is null").count() > 0
    value = F.when(F.col("v") == 3, F.col("i"))
    plain = df.withColumn("f", F.last(value, True).over(W.partitionBy("k").orderBy("i").rowsBetween(
        W.unboundedPreceding, 0)))
    for chunk in (1, 7, 100000):
        got = K.forward_fill(df, ["k"], "i", value, "f", chunk)
        assert sorted(got.select("i", "f").collect()) == sorted(plain.select("i", "f").collect())


def test_number_rows(spark):
    df = hot(spark)
    keys = [F.col("v"), F.when(F.col("i") % 5 == 0, F.col("i") % 2)]
    plain = df.withColumn("r", F.row_number().over(W.partitionBy("k").orderBy(*keys, "i")))
    got = K.number_rows(df, ["k"], keys, "i", "r", chunk=50)
    assert sorted(got.select("i", "r").collect()) == sorted(plain.select("i", "r").collect())
    everything = K.number_rows(df, [], keys, "i", "r", chunk=50)
    assert sorted(r["r"] for r in everything.collect()) == list(range(1, df.count() + 1))


def test_computed_survives_a_filter(spark):
    df = K.computed(spark.range(5), y=F.col("id") * 2).where("y > 3")
    assert [r["y"] for r in df.orderBy("id").collect()] == [4, 6, 8]


def test_merging_stores_texts_once(spark, monkeypatch):
    """Copies are folded and merged in one step; the key made of their texts is not stored."""
    from rolecast.operators import freshness as FR, state as ST
    from rolecast.plans import run as R
    from rolecast.sources.listing import LISTING

    kept = []
    for module in (R, FR):
        store = module.checkpointed
        monkeypatch.setattr(module, "checkpointed", lambda df, store=store: kept.append(df.columns) or store(df))
    fields = ["company", "title", "location", "apply_url", "source", "posted_date", "date_confidence"]
    rows = [(0, "A", "Data Intern", "X", "u0", "github:a", None, "unverified"), (1, "a!", "data  intern", "x", "u1", "greenhouse:b", "1998-06-01", "verified"),
            (2, "A", "Data Intern", "X", "u2", "lever:c", "1998-06-02", "verified"), (3, "B", "Other", "", "u3", "github:a", None, "unverified"),
            (4, None, None, None, None, None, None, None)]
    rest = [F.lit(None).cast(t).alias(n) for n, t in LISTING.items() if n not in fields and n != "raw"]
    listings = spark.createDataFrame(rows, "ingest_seq long, " + ", ".join(f"{n} string" for n in fields)).select(
        "*", *rest).withColumn("posted_date", F.col("posted_date").cast("date"))
    key = FR.with_key(listings).where("ingest_seq = 3").first()["key"]
    state = spark.createDataFrame([(key, "1998-01-05 00:00:00")], "key string, first_seen string").select(
        "key", F.col("first_seen").cast("timestamp").alias("first_seen"))
    merged, seen = R.merge_fresh(listings, state, "1998-06-15 08:00:00")
    assert sum("title" in c for c in kept) == 1 and not any("key" in c for c in kept)
    got = {r["ingest_seq"]: r for r in merged.collect()}
    assert sorted(got) == [1, 3, 4] and got[1]["also_seen"] == "lever:c, github:a" and got[1]["n_merged"] == 3
    assert str(got[3]["first_seen"]) == "1998-01-05 00:00:00" and str(got[3]["posted_date"]) == "1998-01-05"
    assert str(got[4]["first_seen"]) == "1998-06-15 08:00:00" and got[3]["also_seen"] == ""
    keyed = FR.with_key(listings).withColumn("seen_at", F.lit("1998-06-15 08:00:00").cast("timestamp"))
    assert sorted(map(str, seen.collect())) == sorted(map(str, ST.fold_batch(keyed).collect()))
