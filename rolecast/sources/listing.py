"""The posting record all sources end in."""

from pyspark.sql import Column, DataFrame, functions as F

from rolecast import values as V
from rolecast.operators.common import checkpointed

LISTING = {
    "company": "string", "title": "string", "location": "string", "apply_url": "string",
    "source": "string", "company_description": "string", "is_startup": "boolean",
    "funding_stage": "string", "level": "string", "work_mode": "string",
    "description_text": "string", "requirements": "array<string>", "posted_date": "date",
    "deadline": "date", "deadline_is_rolling": "boolean", "date_confidence": "string",
    "date_source": "string", "raw": "variant",
}

_DEFAULTS = {
    "is_startup": None, "posted_date": None, "deadline": None, "raw": None,
    "deadline_is_rolling": False, "date_confidence": V.UNVERIFIED, "requirements": None,
}


def normalize(df: DataFrame, *keep: str, **fields: Column) -> DataFrame:
    """Projects a parsed source to the posting record; unset fields take their default.

    Columns named in `keep` are carried along.
    """
    out = []
    for name, kind in LISTING.items():
        c = fields.get(name, F.lit(_DEFAULTS.get(name, "")))
        if kind == "string":
            c = F.coalesce(c, F.lit(""))
        if not (name == "raw" and name in fields):
            c = c.cast(kind)
        out.append(c.alias(name))
    return df.select(*keep, *out)


def raw_of(**fields: Column) -> Column:
    """Passthrough fields as a variant."""
    return F.to_variant_object(F.struct(*[c.alias(n) for n, c in fields.items()]))


def with_requirements(listings: DataFrame, lexicon: DataFrame, seq: str = "ingest_seq",
                      limit: int | None = None) -> DataFrame:
    """Fills empty requirement lists from the description text, by a unique row id; `limit`
    (usually `V.REQUIREMENTS`) bounds a list, if given."""
    from rolecast.operators.terms import requirements

    bare = F.coalesce(F.array_size("requirements"), F.lit(0)) == 0
    found = (requirements(listings.where(bare & (F.col("description_text") != "")), lexicon, seq,
                          "description_text", limit)
             .withColumnRenamed("requirements", "_found"))
    return (listings.join(found, seq, "left")
            .withColumn("requirements", F.when(bare, F.coalesce(
                "_found", F.array().cast("array<string>"))).otherwise(F.col("requirements")))
            .drop("_found"))


def with_sequence(listings: DataFrame) -> DataFrame:
    """Adds ingest_seq, a unique id that settles ties. Runs a job.

    The numbered rows are written to the shared folder, so the ids stay the same for
    every later reader, whatever task or executor is lost.
    """
    return checkpointed(listings.withColumn("ingest_seq", F.monotonically_increasing_id()))
