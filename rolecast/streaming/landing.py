"""Continuous landing: files of several sources, read once each, as one table of postings.

Every source is a file stream of JSON texts; the streams run as one query, so one checkpoint holds
the files that each has read. A micro-batch becomes one run of a ledger with two tables: the
postings of all sources, and the records that could not be read, with their source. A batch that is
run again after a crash replaces its own rows in both, and nothing of it is seen before both are
written, so each file counts exactly once whatever breaks.
"""

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from rolecast.operators import ledger
from rolecast.sources import boards
from rolecast.sources.listing import LISTING

POSTINGS, REJECTED = "postings", "rejected"
_FIELDS = [n for n in LISTING if n != "raw"]
POSTING_SCHEMA = ", ".join(f"{n} {LISTING[n]}" for n in _FIELDS) + ", source_label string, batch long"
REJECTED_SCHEMA = "source_label string, record string, batch long"


@dataclass(frozen=True)
class Landed:
    """Where the files of a source land, the shape of their records, and what makes postings of them."""
    path: str
    schema: str
    postings: Callable[[DataFrame], DataFrame]


def land(spark: SparkSession, sources: dict[str, Landed], root: str, checkpoint: str,
         files_per_batch: int | None = None, trigger: dict | None = None):
    """Starts the stream into the ledger at `root`; by default it reads what has landed and stops.

    The checkpoint belongs to one set of sources: their number and order must stay."""
    def lines(label: str, source: Landed) -> DataFrame:
        reader = spark.readStream if files_per_batch is None else spark.readStream.option("maxFilesPerTrigger", files_per_batch)
        return reader.text(source.path).select(F.lit(label).alias("source_label"), "value")

    def take(batch: DataFrame, n: int) -> None:
        good, bad = [], []
        for label, source in sources.items():
            rows = boards.payloads(batch.where(F.col("source_label") == label).select("value"), source.schema)
            whole, broken = boards.split_corrupt(rows)
            tags = [F.lit(label).alias("source_label"), F.lit(n).cast("long").alias("batch")]
            good.append(source.postings(whole).select(*_FIELDS, *tags))
            bad.append(broken.select(tags[0], F.col(boards.CORRUPT).alias("record"), tags[1]))
        union = lambda parts: reduce(DataFrame.unionByName, parts)
        log = batch.sparkSession
        ledger.replace_run(log, root, n, {POSTINGS: union(good), REJECTED: union(bad)}, run_column={POSTINGS: "batch", REJECTED: "batch"})
        for name, schema in ((POSTINGS, POSTING_SCHEMA), (REJECTED, REJECTED_SCHEMA)):
            ledger.compact(log, root, name, schema, lambda df: df)

    stream = reduce(DataFrame.unionByName, [lines(label, s) for label, s in sources.items()])
    return (stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def postings(spark: SparkSession, root: str) -> DataFrame:
    return ledger.read(spark, root, POSTINGS, POSTING_SCHEMA)


def rejected(spark: SparkSession, root: str) -> DataFrame:
    return ledger.read(spark, root, REJECTED, REJECTED_SCHEMA)
