"""Profile texts from files."""

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_profiles(spark: SparkSession, path) -> DataFrame:
    """(profile_id, file, text): one profile per plain-text or markdown file.

    The id is a hash of the file's name. Bytes that are no UTF-8 become U+FFFD; a byte order mark goes.
    Spark does not list files of no bytes, so an empty file has no profile.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    body = F.make_valid_utf8(F.col("content").cast("string"))
    return (files.where(F.lower("path").rlike(r"\.(txt|md|text)$"))
            .select(F.xxhash64("path").alias("profile_id"), F.col("path").alias("file"),
                    F.regexp_replace(body, "^\ufeff", "").alias("text")))
