"""Report sinks: JSON lines that load again, and rendered cards as text."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from rolecast.functions.dates import iso_prefix_date
from rolecast.sources.listing import LISTING


def write_json(listings: DataFrame, path: str, generated) -> None:
    """Postings as JSON, verified dates before unverified ones, with a time stamp.
    Dates become ISO text."""
    bucket = (F.col("date_confidence") == "unverified").cast("int")
    plain = listings.drop("raw").withColumns({
        "generated": F.lit(generated).cast("string"), "_bucket": bucket})
    (plain.write.mode("overwrite").partitionBy("_bucket").json(path))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Reads a written report; a date that is none becomes null."""
    dates = ("posted_date", "deadline")
    fields = ", ".join(f"{n} {'string' if n in dates else t}"
                       for n, t in LISTING.items() if n != "raw")
    extra = ("key string, ingest_seq long, profile_id long, first_seen timestamp, "
             "live_status string, live_reason string, live_checked_at timestamp, "
             "eligible boolean, eligibility_reason string, match_score int, "
             "matched_keywords array<string>, missing_keywords array<string>, "
             "match_rationale string, also_seen string, n_merged long, generated string")
    rows = spark.read.schema(f"{fields}, {extra}").json(path)
    return rows.withColumns({d: iso_prefix_date(F.col(d)) for d in dates})


ORDER = ("profile_id", "part", "rank")


def write_report(parts: DataFrame, path: str, rows_per_file: int = 50_000) -> None:
    """The rows of `report.report_parts` as Parquet files in report order, with an index of files.

    A file holds a range of (profile_id, part, rank) and at most `rows_per_file` rows, however many
    profiles there are and however long one report is. The index has one row per file.
    """
    (parts.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
     .write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/parts"))
    rows = parts.sparkSession.read.schema(parts.schema).parquet(f"{path}/parts")
    (rows.groupBy(F.col("_metadata.file_name").alias("file"))
     .agg(F.min("profile_id").alias("first"), F.max("profile_id").alias("last"), F.count("*").alias("n"))
     .coalesce(1).write.mode("overwrite").parquet(f"{path}/index"))


def read_report(spark: SparkSession, path: str, profile_id: int | None = None) -> DataFrame:
    """The rows of a written report. For one profile only the files that hold its range are opened."""
    if profile_id is None:
        return spark.read.parquet(f"{path}/parts")
    held = spark.read.parquet(f"{path}/index").where(F.lit(profile_id).between(F.col("first"), F.col("last")))
    files = [f"{path}/parts/{r['file']}" for r in held.select("file").collect()]
    rows = spark.read.parquet(*files) if files else spark.read.parquet(f"{path}/parts").limit(0)
    return rows.where(F.col("profile_id") == profile_id)


def write_text(parts: DataFrame, path: str, rows_per_file: int = 50_000) -> None:
    """All reports as plain text, one after the other, in files that follow each other by name."""
    (parts.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select(F.col("markdown").alias("value"))
     .write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).text(path))


def write_cards(cards: DataFrame, path: str, form: str = "markdown", rows_per_file: int = 50_000) -> None:
    """Cards as text files, in order of profile, section and rank."""
    order = ("profile_id", "bucket", "rank")
    (cards.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(form).alias("value"))
     .write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).text(path))
