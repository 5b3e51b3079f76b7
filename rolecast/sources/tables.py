"""Curated markdown lists: find the tables, carry companies down, read the rows."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from rolecast import values as V
from rolecast.functions.dates import list_date
from rolecast.functions.roles import (best_apply_url, company_cell, detect_work_mode, infer_level,
                                      is_closed_row, is_continuation)
from rolecast.functions.text import clean_location, first_filled, let, lines, strip, strip_markdown, text
from rolecast.operators.common import computed
from rolecast.sources.listing import normalize

_CUT = "\x01"
_SEPARATOR = r"^\s*\|?[\s:|-]+\|[\s:|-]*$"


def read_documents(spark: SparkSession, path) -> DataFrame:
    """(doc_id, text): one row per file."""
    return (spark.read.text(path, wholetext=True)
            .select(F.input_file_name().alias("doc_id"), F.col("value").alias("text")))


def _is_row(line: Column) -> Column:
    return line.rlike(r"^\s*\|[^|]*\|")


def _is_separator(line: Column) -> Column:
    return line.contains("-") & line.rlike(_SEPARATOR)


def _cells(line: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(strip(line), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(inner, r"\|"), strip)


def _column_map(header: Column) -> Column:
    """Struct of 0-based columns per role; every column serves the first free role
    whose words it contains."""
    def take(acc: Column, cell: Column) -> Column:
        low, fits = F.lower(cell["name"]), None
        for role, words in V.TABLE_COLUMNS.items():
            hit = reduce(lambda a, b: a | b, [low.contains(w) for w in words]) & acc[role].isNull()
            fits = F.when(hit, role) if fits is None else fits.when(hit, role)
        return let(fits, lambda role: F.struct(*[
            F.when(role == r, cell["at"]).otherwise(acc[r]).alias(r) for r in V.TABLE_COLUMNS]))

    cells = F.transform(header, lambda h, i: F.struct(h.alias("name"), i.alias("at")))
    free = F.struct(*[F.lit(None).cast("int").alias(r) for r in V.TABLE_COLUMNS])
    return F.reduce(cells, free, take)


def _runs(body: Column) -> Column:
    """array<string>: the stretches of table rows of a text, each line as
    "number<tab>line". A separator under a row belongs to its stretch."""
    def kept(all_lines: Column) -> Column:
        def line(x: Column, i: Column) -> Column:
            under = _is_separator(x) & F.coalesce(_is_row(F.get(all_lines, i - 1)), F.lit(False))
            return F.when(_is_row(x) | under, F.concat(i.cast("string"), F.lit("\t"), x)).otherwise(_CUT)
        return F.transform(all_lines, line)

    joined = F.array_join(let(lines(text(body)), kept), "\n")
    return F.filter(F.split(joined, _CUT), lambda r: r.contains("\t"))


def table_rows(docs: DataFrame, doc: str = "doc_id", body: str = "text") -> DataFrame:
    """(doc, line_no, cells, cols): the body rows of every table with a role column.

    A table starts at the first row followed by a separator whose cells name a role,
    and lasts to the end of its stretch of rows. All found inside the document's own
    cell: nothing is shuffled.
    """
    runs = docs.select(doc, F.explode(_runs(F.col(body))).alias("_run"))
    runs = runs.select(doc, F.filter(F.split("_run", "\n"), lambda x: x != "").alias("_rows"))
    bare = lambda x: F.substr(x, F.instr(x, "\t") + 1)

    def header(x: Column, i: Column) -> Column:
        under = F.get(F.col("_rows"), i + 1)
        cols = F.when(_is_separator(bare(under)) & _is_row(bare(x)), _column_map(_cells(bare(x))))
        return F.struct(i.alias("at"), cols.alias("cols"))

    found = F.get(F.filter(F.transform("_rows", header),
                           lambda h: h["cols"]["role"].isNotNull()), F.lit(0))
    tables = computed(runs, _head=found).where("_head is not null")
    rows = tables.select(doc, "_head.cols", F.explode(F.slice(
        "_rows", F.col("_head.at") + 3, F.size("_rows"))).alias("_row"))
    # Cut into cells once, not again in every filter on them.
    rows = computed(rows, cells=_cells(bare(F.col("_row"))))
    return rows.select(doc, F.split_part("_row", F.lit("\t"), F.lit(1)).cast("int").alias("line_no"), "cells", "cols")


def list_postings(docs: DataFrame, as_of, doc: str = "doc_id", body: str = "text") -> DataFrame:
    """Postings of curated lists; `doc` names the list.

    Closed rows go first, so they never set the company of the rows below. A company
    and its link are carried together, across the tables of one document.
    """
    def cell(role):
        return text(F.get(F.col("cells"), F.col(f"cols.{role}")))

    rows = table_rows(docs, doc, body).where(~is_closed_row(F.col("cells")))
    rows = computed(rows, _named=company_cell(cell("company")))
    starts = (F.col("_named.name") != "") & ~is_continuation(cell("company"))
    # A document is one cell, which one task has read already; its rows fit one, too.
    above = W.partitionBy(doc).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_company", F.last(F.when(starts, F.col("_named")), True).over(above))
    rows = computed(rows, _role=strip_markdown(cell("role")), _place=clean_location(cell("location")),
                    _link=best_apply_url(cell("link")), _posted=list_date(cell("date"), as_of))
    rows = rows.where(F.col("_company").isNotNull() & (F.col("_role") != ""))
    return normalize(
        rows, doc, "line_no", company=F.col("_company.name"), title=F.col("_role"),
        location=F.col("_place"), apply_url=first_filled(F.col("_link"), F.col("_company.url")),
        source=F.concat(F.lit("github:"), F.col(doc).cast("string")),
        level=infer_level(F.col("_role")), work_mode=detect_work_mode(F.col("_place")),
        posted_date=F.col("_posted.posted_date"), date_confidence=F.col("_posted.date_confidence"),
        date_source=F.col("_posted.date_source"))
