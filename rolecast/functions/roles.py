"""Predicates and classifiers on posting fields."""

from pyspark.sql import Column, functions as F

from rolecast import values as V
from rolecast.functions.text import let, strip_markdown, text


def has_role_signal(title: Column, body: Column | None = None,
                    lead_chars: int | None = None) -> Column:
    """Is it a student role, by its title and the lead of its text?

    A title with "internal" needs the signal in the text itself. The whole text counts;
    `lead_chars` (usually `V.ROLE_LEAD_CHARS`) takes only its lead, since far down a
    full-time posting may mention interns.
    """
    body = text(body) if body is not None else F.lit("")
    lead = body if lead_chars is None else F.substring(body, 1, lead_chars)
    return (F.when(text(title).rlike(r"(?i)\binternal\b"), body.rlike(V.ROLE_SIGNAL))
            .otherwise(F.concat(text(title), F.lit("\n"), lead).rlike(V.ROLE_SIGNAL)))


def infer_level(title: Column) -> Column:
    t = F.lower(text(title))
    return (F.when(t.contains("co-op") | t.contains("coop"), "co-op")
            .when(t.contains("intern"), "intern")
            .when(t.contains("new grad") | t.contains("new-grad")
                  | t.contains("university graduate"), "new grad")
            .otherwise("intern"))


def detect_work_mode(*fields: Column) -> Column:
    blob = F.lower(F.concat_ws(" ", *[F.nullif(f, F.lit("")) for f in fields]))
    return let(blob, lambda b: F.when(b.rlike(V.REMOTE_STRONG), "remote")
               .when(b.contains("hybrid"), "hybrid")
               .when(b.rlike(V.ONSITE), "onsite")
               .when(b.rlike(V.REMOTE_WEAK), "remote")
               .otherwise("unknown"))


def is_closed_row(cells: Column) -> Column:
    """A marker sign or the word "closed" in any cell, company names included."""
    row = F.array_join(cells, " ")
    hit = row.rlike(r"(?i)\bclosed\b")
    for sign in V.CLOSED_MARKERS:
        hit = hit | row.contains(sign)
    return hit


def is_continuation(cell: Column) -> Column:
    """Blank, or only arrow signs: the row belongs to the company above."""
    bare = F.regexp_replace(text(cell), r"^[\s*]+|[\s*]+$", "")
    return bare.rlike(f"^[{V.CONTINUATION_CHARS}]*$")


_LINK = r"\[([^\]]+)\]\(([^)]+)\)"


def company_cell(cell: Column) -> Column:
    """Struct (name, url) of a company cell; the url is empty without a link."""
    name = F.when(cell.rlike(_LINK), F.regexp_extract(cell, _LINK, 1)).otherwise(cell)
    return F.struct(strip_markdown(name).alias("name"),
                    F.regexp_extract(text(cell), _LINK, 2).alias("url"))


def best_apply_url(cell: Column) -> Column:
    """First direct link of a cell, else the first link, else the empty string.

    Images, badges and assets never count; aggregator and code-host links come last.
    """
    c = text(cell)
    urls = F.concat(F.regexp_extract_all(c, F.lit(r'href="([^"]+)"'), F.lit(1)),
                    F.regexp_extract_all(c, F.lit(_LINK), F.lit(2)))
    links = F.filter(urls, lambda u: u.startswith("http")
                     & ~u.rlike(r"(?i)\.(png|svg|gif|jpg|jpeg)(\?|$)")
                     & ~u.contains("shields.io") & ~u.contains("/assets/"))
    direct = F.filter(links, lambda u: ~u.contains("simplify.jobs") & ~u.contains("github.com"))
    return F.coalesce(F.get(direct, F.lit(0)), F.get(links, F.lit(0)), F.lit(""))
