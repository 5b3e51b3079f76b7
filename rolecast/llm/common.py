"""Tables, stored steps and chunking shared by the operators of this subpackage."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rolecast.operators.common import BROADCAST_ROWS, HOT_SHARE, HOT_SPLITS, shared_dir

MB = 1 << 20
#: Text of one chunk and of one bucket of routed keys; both fit a Python worker many times.
CHUNK_BYTES = 8 * MB
BUCKET_BYTES = 48 * MB
#: Narrow rows that one task takes of one key, and links whose minima are broadcast.
HOT_ROWS = BROADCAST_ROWS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and read it back: later steps and lost executors
    start from the files. Folders are new for each call and stay for the caller to remove."""
    path = f"{shared_dir(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def parts_of(size: int, each: int, least: int = 8) -> int:
    """How many parts of about `each` bytes; from the data, so parts stay alike at any size."""
    return max(least, -(-size // each))


def chunk_of(ids: Column, chunks: int) -> Column:
    return F.pmod(F.xxhash64(ids), F.lit(chunks)).cast("int")


def fold_of(ids: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(ids.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def dealt_join(left: DataFrame, right: DataFrame, key: str, by: str, counts: DataFrame, floor: int | None = None,
               splits: int = HOT_SPLITS) -> DataFrame:
    """Inner join with a right side of one row a key, where one key may hold most of the left rows.

    `counts` (key, n) are the left rows of each key. The most frequent keys of more than `floor` rows, 255
    at most, so all with over 1/256 of the rows, are dealt over `splits` tasks by the hash of column `by`,
    which differs within a key; just their right rows are repeated.
    """
    often = counts.where((F.col("n") > (HOT_ROWS if floor is None else floor)) & F.col(key).isNotNull())
    hot = [r[0] for r in often.orderBy(F.desc("n"), key).limit(HOT_SHARE - 1).select(key).collect()]
    if not hot:
        return left.join(right, key)
    is_hot = F.col(key).isin(hot)
    left = left.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(splits)).cast("int")).otherwise(0))
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(splits - 1))).otherwise(F.array(F.lit(0)))
    return left.join(right.withColumn("_salt", F.explode(every)), [key, "_salt"]).drop("_salt")


def key_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over `links` (a, b), itself included.

    Alternating large and small stars: each round shortens every path, so the rounds grow
    with the logarithm of the longest one. Each round is a grouped minimum and a join; the
    links are written after each round and never meet the driver. The minima of at most HOT_ROWS
    links, two narrow rows each, are broadcast; beyond, the centers of large stars are dealt over tasks.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    before = None
    # Stars are steady: the links no longer change.
    while (now := _digest(links)) != before:
        before, few = now, now[0] <= HOT_ROWS
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Large star: neighbours above u go to the smallest neighbour.
        large = _with_minimum(both.where("v > u"), low, few).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large if few else stored(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # Small star: u and its neighbours below it go to the smallest of them.
        small = _with_minimum(large, low, few).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stored(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
    root = links.groupBy("u").agg(F.min("v").alias("component"))
    return (nodes.join(root, nodes["node"] == root["u"], "left")
            .select("node", F.coalesce("component", "node").alias("component")))


def _with_minimum(pairs: DataFrame, low: DataFrame, few: bool) -> DataFrame:
    """The pairs (u, v) with the minimum m of u."""
    return pairs.join(F.broadcast(low), "u") if few else dealt_join(pairs, low, "u", "v", key_counts(pairs, "u"))


def _digest(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
