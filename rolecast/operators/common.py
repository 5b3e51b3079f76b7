"""Building blocks that stay balanced when one key holds a large share of the rows."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
CHUNK = 100_000
HOT_SHARE = 256      # a key is hot above 1/256 of the rows, so at most 255 keys are
HOT_SPLITS = 64
RUN = 512            # rows that product_join sets under one owner at a time, where a hot key has that many


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a fresh local one only in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    path = tempfile.mkdtemp(prefix="rolecast-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder, so lost executors cost no recompute.

    Written as Parquet, so later readers take only the columns they use. Every call has a
    folder of its own below `steps`, which is the caller's to remove after the run.
    """
    path = f"{shared_dir(df.sparkSession)}/steps/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Does the table stay under both bounds? Runs a job over at most `rows` + 1 rows."""
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16
                 for c in df.columns), F.lit(0))
    # Rows are measured where they are; only their widths meet.
    seen = df.select(width.alias("w")).limit(rows + 1).agg(F.count("*").alias("n"), F.sum("w").alias("b")).first()
    return seen["n"] <= rows and (seen["b"] or 0) <= size


def computed(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds columns that are worked out once per row, also when a filter reads them.

    Spark moves a filter below a plain projection and so repeats its expressions; it
    cannot move one below a generator.
    """
    row = F.struct(*[c.alias(n) for n, c in cols.items()])
    return df.select("*", F.inline(F.array(row)))


def _content(df: DataFrame) -> Column:
    """A number of a row's content and partition; variants and maps have no hash and are left out."""
    kept = [c for c, kind in df.dtypes if "variant" not in kind and "map<" not in kind]
    return F.xxhash64(*[F.col(f"`{c}`") for c in kept], F.spark_partition_id())


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left",
                small: bool | None = None, hot_splits: int = HOT_SPLITS) -> DataFrame:
    """Join a large left side, skewed or not, to a right side of any size.

    A right side under the size bound is broadcast. Beyond it the hot keys of the left
    side (more than 1/256 of its rows each, so a bounded list) are spread over
    `hot_splits` tasks and the right rows of just those keys are repeated. Finding them
    reads the left keys once more. Rows with a null key match nothing and go everywhere.
    Spark is not left to guess there: it takes a compressed or exploded side for smaller
    than it is, and would send it whole through the driver.
    """
    if is_small(right) if small is None else small:
        return left.join(F.broadcast(right), on, how)
    missing = F.lit(False)
    for c in on:
        missing = missing | F.col(c).isNull()
    counts = left.where(~missing).groupBy(*on).count()
    bound = counts.agg(F.sum("count") / HOT_SHARE).scalar()
    hot = F.broadcast(counts.where(F.col("count") > bound).select(*on, F.lit(True).alias("_hot")))
    # The rows of one hot key go round the splits by their content and partition: a
    # retried task sends every row to the same place again, and copies of one row that
    # come from different tasks go to different places.
    content = _content(left)
    spread = F.pmod(content, F.lit(hot_splits))
    left = (left.join(hot, on, "left")
            .withColumn("_salt", F.when(F.col("_hot"), spread)
                        .when(missing, F.pmod(content, F.lit(1 << 20))).otherwise(F.lit(0)).cast("int"))
            .drop("_hot"))
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(hot_splits - 1))).otherwise(
        F.array(F.lit(0)))
    right = right.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right.hint("merge"), [*on, "_salt"], how).drop("_salt")


def product_join(owners: DataFrame, rows: DataFrame, on: list[str], counts: DataFrame,
                 by: list[str], run: int = RUN, hot_splits: int = HOT_SPLITS) -> DataFrame:
    """Inner join by few keys, whose result is far larger than its sides.

    Each owner comes out next to a run of `rows`, never each row next to all owners: a file
    of the result then holds an owner's values once a run, in dictionaries that stay small.
    `counts` has the number of `rows` (_n) for every key. Hot keys (as in `lookup_join`) are cut
    by the content of the columns `by` into parts of some `run` rows, `hot_splits` at most, and
    the owners of just those keys are repeated. Rows with a null key match nothing.
    """
    bound = counts.agg(F.sum("_n") / HOT_SHARE).scalar()
    splits = F.least(F.ceil(F.col("_n") / run), F.lit(hot_splits)).cast("int")
    hot = F.broadcast(counts.where((F.col("_n") > bound) & (splits > 1)).select(*on, splits.alias("_splits")))
    last = F.coalesce("_splits", F.lit(1))
    rows = rows.dropna(subset=on).join(hot, on, "left")
    rows = rows.withColumn("_part", F.pmod(_content(rows.select(*by)), last).cast("int")).drop("_splits")
    owners = owners.join(hot, on, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), last - 1))).drop("_splits")
    # A stated number of tasks, for sides this small would be drawn together into a few. A merge
    # join goes through the right side for each row of the left one.
    cells = [*on, "_part"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return owners.repartition(n, *cells).hint("merge").join(rows.repartition(n, *cells), cells).drop("_part")


def forward_fill(df: DataFrame, group: list[str], position: str, value: Column, name: str,
                 chunk: int = CHUNK) -> DataFrame:
    """Carry the last non-null `value` down each group, in order of an integer position.

    Runs per chunk of positions, then carries one value per chunk over the chunk
    heads, so a group of any size is spread over many tasks. A null group is a group like any
    other; rows with a null position come before all others of their group.
    """
    df = (df.withColumn("_value", value)
          .withColumn("_chunk", F.floor(F.col(position) / chunk)))
    inside = (W.partitionBy(*group, "_chunk").orderBy(position)
              .rowsBetween(W.unboundedPreceding, 0))
    filled = df.withColumn(name, F.last("_value", ignorenulls=True).over(inside))
    # A chunk needs the tail of the nearest chunk before it that has one.
    place = F.coalesce(F.col(position), F.lit(-(1 << 62)))
    tails = df.groupBy(*group, "_chunk").agg(F.max_by(
        "_value", F.when(F.col("_value").isNotNull(), place)).alias("_tail"))
    before = (W.partitionBy(*group).orderBy("_chunk")
              .rowsBetween(W.unboundedPreceding, -1))
    carry = tails.select(*group, "_chunk",
                         F.last("_tail", ignorenulls=True).over(before).alias("_carry"))
    return (_null_safe_join(filled, carry, [*group, "_chunk"])
            .withColumn(name, F.coalesce(F.col(name), F.col("_carry")))
            .drop("_value", "_chunk", "_carry"))


def number_rows(df: DataFrame, group: list[str], keys: list[Column], tie: str, name: str,
                chunk: int = CHUNK) -> DataFrame:
    """Number all rows of each group from 1, by a few coarse keys and a unique integer.

    Counts per distinct key give every key its offset, counts per chunk of the tie
    column every chunk its own, and only rows of one key and chunk are sorted together.
    No group, nor the whole table, passes one task; just the counts per key do. Runs a
    job for the counts.
    """
    parts = [f"_k{i}" for i in range(len(keys))]
    df = df.withColumns(dict(zip(parts, keys))).withColumn(
        "_chunk", F.floor(F.col(tie) / chunk))
    # Null keys are equal here, as in a sort; the joins below need null-safe equality.
    # The counts are read twice and far smaller than the rows, so they are written once.
    per_chunk = checkpointed(df.groupBy(*group, *parts, "_chunk").agg(F.count("*").alias("_n")))
    per_key = per_chunk.groupBy(*group, *parts).agg(F.sum("_n").alias("_n"))

    def running(frame, partition, order):
        w = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        w = w.partitionBy(*partition) if partition else w.partitionBy(F.lit(0))
        return F.coalesce(F.sum("_n").over(w), F.lit(0))

    key_start = per_key.withColumn("_key_start", running(per_key, group, parts)).drop("_n")
    chunk_start = per_chunk.withColumn(
        "_chunk_start", running(per_chunk, [*group, *parts], ["_chunk"])).drop("_n")
    starts = _null_safe_join(chunk_start, key_start, [*group, *parts])
    within = F.row_number().over(W.partitionBy(*group, *parts, "_chunk").orderBy(tie))
    numbered = df.withColumn("_row", within)
    out = _null_safe_join(numbered, starts, [*group, *parts, "_chunk"])
    return (out.withColumn(name, (F.col("_key_start") + F.col("_chunk_start") + F.col("_row"))
                           .cast("bigint"))
            .drop(*parts, "_chunk", "_key_start", "_chunk_start", "_row"))


def number_all(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number all rows from 1 in an order that ends in a unique column.

    The rows are dealt out by ranges of the order and written; each range is numbered alone
    and starts after the counts of those before it, one count per range.
    """
    parts = {f"_o{i}": c for i, c in enumerate(order)}
    dealt = checkpointed(df.withColumns(parts).repartitionByRange(*parts).withColumn("_range", F.spark_partition_id()))
    before = W.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*parts))
    return (dealt.join(F.broadcast(starts), "_range").withColumn(name, F.col("_before") + inside)
            .drop("_range", "_before", *parts))


def _null_safe_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    right = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    cond = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    return left.join(right, cond).drop(*[f"_r_{c}" for c in on])


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
