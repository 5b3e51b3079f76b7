"""All sources as one table."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from rolecast.functions.text import source_head
from rolecast.operators.common import checkpointed


def union_sources(sources: dict[str, DataFrame], allow: list[str] | None = None) -> DataFrame:
    """Union of the posting records of every source, `source_label` telling which.

    `allow` names the sources to take; the others are never read. A source with no rows
    adds none.
    """
    picked = {k: v for k, v in sources.items() if allow is None or k in allow}
    if not picked:
        raise ValueError(f"no source left of {sorted(sources)}")
    tagged = [df.withColumn("source_label", F.lit(k)) for k, df in picked.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def union_softly(sources: dict[str, Callable[[], DataFrame]],
                 allow: list[str] | None = None) -> tuple[DataFrame | None, list[tuple[str, int, str]]]:
    """Union of the sources that can be read, and (source_label, rows, error) of every one.

    Each source is a function that gives its postings. It is read to its end, into the shared
    folder, before it joins the union, so one that fails costs only its own rows; its error is
    the first line of the message, and -1 stands for its rows.
    """
    good, status = {}, []
    for label, load in sources.items():
        if allow is not None and label not in allow:
            continue
        try:
            good[label] = checkpointed(load())
            status.append((label, good[label].count(), ""))
        except Exception as e:  # whatever a source does wrong stays with it
            status.append((label, -1, str(e).strip().split("\n")[0]))
    return (union_sources(good) if good else None), status


def with_source_head(listings: DataFrame) -> DataFrame:
    """Adds source_head, the partition column of landed postings."""
    return listings.withColumn("source_head", source_head(F.col("source")))
