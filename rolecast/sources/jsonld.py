"""Postings in the JSON-LD blocks of web pages."""

from pyspark.sql import Column, DataFrame, functions as F

from rolecast import values as V
from rolecast.functions.dates import day, parse_date_loose
from rolecast.functions.html import html_to_text
from rolecast.functions.roles import detect_work_mode, has_role_signal, infer_level
from rolecast.functions.text import blank_to_null, first_filled, let, strip, text
from rolecast.operators.common import computed
from rolecast.sources.listing import normalize

_BLOCK = (r"""(?is)<script\b[^>]*\btype\s*=\s*["']?application/ld\+json["']?[^>]*>"""
          r"""(.*?)</script\s*>""")
_CDATA = r"^//<!\[CDATA\[|//\]\]>$"
DEPTH = 12   # steps that every row takes; only deeper lists and graphs go on in a loop


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _opened(e: Column) -> Column:
    """One step of the walk: a list gives its members, an object with a @graph the members of
    that and itself, any other value itself. `done` marks what needs no further step."""
    def waiting(items: Column) -> Column:
        return F.transform(items, lambda x: F.struct(x.alias("v"), F.lit(False).alias("done")))

    v = e["v"]
    itself = F.array(F.struct(v.alias("v"), F.lit(True).alias("done")))
    listed, graph = get(v, "$", "array<variant>"), get(v, "$['@graph']", "array<variant>")
    return (F.when(e["done"], F.array(e)).when(listed.isNotNull(), waiting(listed))
            .when(graph.isNotNull(), F.concat(waiting(graph), itself)).otherwise(itself))


def _walked(html: Column, depth: int) -> Column:
    blocks = F.regexp_extract_all(text(html), F.lit(_BLOCK), F.lit(1))
    blocks = F.filter(blocks, lambda b: b.contains("JobPosting"))
    found = F.transform(blocks, lambda b: F.struct(
        F.try_parse_json(strip(F.regexp_replace(strip(b), _CDATA, ""))).alias("v"), F.lit(False).alias("done")))
    found = F.filter(found, lambda e: e["v"].isNotNull())
    for _ in range(depth):
        found = F.flatten(F.transform(found, _opened))
    return found


def json_objects(html: Column, depth: int = DEPTH) -> Column:
    """array<variant>: the values of all JSON-LD blocks that name a posting.

    Lists and @graph members are opened wherever they stand, nested as deep as they are:
    what is left after `depth` steps is opened as often as the page has opening brackets.
    """
    brackets = F.length(text(html)) - F.length(F.replace(text(html), F.lit("["), F.lit("")))

    def rest(found: Column) -> Column:
        left = F.exists(found, lambda e: ~e["done"])
        steps = F.when(left, F.sequence(F.lit(0), brackets)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, found, lambda all_, _: F.flatten(F.transform(all_, _opened)))

    return F.transform(let(_walked(html, depth), rest), lambda e: e["v"])


def unopened(html: Column, depth: int = DEPTH) -> Column:
    """How many values of a page's JSON-LD `json_objects` leaves to its loop."""
    return F.size(F.filter(_walked(html, depth), lambda e: ~e["done"]))


def is_posting(o: Column) -> Column:
    kinds = F.coalesce(get(o, "$['@type']", "array<string>"),
                       F.array(text(get(o, "$['@type']"))))
    return F.exists(kinds, lambda k: F.coalesce(k.contains("JobPosting"), F.lit(False)))


def _location(o: Column) -> Column:
    loc = get(o, "$.jobLocation", "variant")
    first = F.coalesce(get(loc, "$[0]", "variant"), loc)
    addr = F.coalesce(get(first, "$.address", "variant"), first)
    parts = [F.coalesce(get(addr, f"$.{p}.name"), get(addr, f"$.{p}"))
             for p in ("addressLocality", "addressRegion", "addressCountry")]
    joined = F.concat_ws(", ", *[blank_to_null(p) for p in parts])
    is_object = F.schema_of_variant(addr).startswith("OBJECT")
    remote = ((get(o, "$.jobLocationType") == "TELECOMMUTE")
              | get(o, "$.applicantLocationRequirements", "variant").isNotNull())
    return (F.when(is_object, joined)
            .when(F.coalesce(remote, F.lit(False)), "Remote").otherwise(""))


def _title(o: Column) -> Column:
    return strip(text(get(o, "$.title")))


def _employment(o: Column) -> Column:
    return F.upper(text(F.coalesce(get(o, "$.employmentType"),
                                   F.to_json(get(o, "$.employmentType", "variant")))))


def _wanted(o: Column, title_filter: bool) -> Column:
    keep = is_posting(o) & (_title(o) != "")
    if not title_filter:
        return keep
    role = let(html_to_text(get(o, "$.description")), lambda d: has_role_signal(_title(o), d))
    return keep & (_employment(o).contains("INTERN") | role)


def posting_objects(html: Column, title_filter: bool = True) -> Column:
    return F.filter(json_objects(html), lambda o: _wanted(o, title_filter))


def open_flag(html: Column, as_of, title_filter: bool = True) -> Column:
    """False when any posting of the page has expired, true when it has postings, else
    null. Read inside the row: no page is taken apart and gathered again."""
    ends = F.transform(posting_objects(html, title_filter),
                       lambda o: parse_date_loose(get(o, "$.validThrough"), as_of))
    verdict = let(ends, lambda e: F.when(
        F.exists(e, lambda d: F.coalesce(d < day(as_of), F.lit(False))), F.lit(False))
        .when(F.size(e) > 0, F.lit(True)))
    return F.when(text(html).contains("JobPosting"), verdict)


def page_postings(pages: DataFrame, title_filter: bool = True, as_of=None) -> DataFrame:
    """Postings of pages (url, html)."""
    rows = (pages.where(F.col("html").contains("JobPosting"))
            .select("url", F.explode(json_objects(F.col("html"))).alias("_o")))
    o = F.col("_o")
    rows = computed(rows.where(is_posting(o)), _title=_title(o), _loc=_location(o),
                    _text=html_to_text(get(o, "$.description"))).where("_title <> ''")
    if title_filter:
        rows = rows.where(has_role_signal(F.col("_title"), F.col("_text"))
                          | _employment(o).contains("INTERN"))
    org = F.coalesce(get(o, "$.hiringOrganization.name"), get(o, "$.hiringOrganization"))
    is_object = F.schema_of_variant(get(o, "$.hiringOrganization", "variant")).startswith("OBJECT")
    org = F.when(F.coalesce(is_object, F.lit(False)), get(o, "$.hiringOrganization.name")).otherwise(org)
    link = F.coalesce(*[blank_to_null(c) for c in (get(o, "$.url"), get(o, "$.directApply"),
                                                   F.col("url"))])
    link = F.when(link.isin("true", "false"), F.col("url")).otherwise(link)
    return normalize(
        rows, company=first_filled(org, F.lit("(unknown)")), title=F.col("_title"),
        location=F.col("_loc"), apply_url=link, source=F.lit("schemaorg"),
        description_text=F.col("_text"), level=infer_level(F.col("_title")),
        work_mode=detect_work_mode(F.col("_loc"), F.col("_text")),
        posted_date=parse_date_loose(get(o, "$.datePosted"), as_of),
        deadline=parse_date_loose(get(o, "$.validThrough"), as_of),
        date_confidence=F.lit(V.VERIFIED), date_source=F.lit("schema.org datePosted"),
        raw=o)
