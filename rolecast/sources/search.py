"""Search results, and the grid of queries that a crawler should ask."""

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from rolecast import values as V
from rolecast.functions.dates import parse_relative_date
from rolecast.functions.roles import detect_work_mode, has_role_signal, infer_level
from rolecast.functions.text import first_filled, first_n, let, shortened, strip, text
from rolecast.operators.common import computed
from rolecast.sources.listing import normalize, raw_of

SEARCH_SCHEMA = (
    "query_pos int, query string, location string, page int, startup_query boolean, "
    "next_page_token string, jobs_results array<struct<title:string,company_name:string,"
    "location:string,description:string,via:string,share_link:string,"
    "detected_extensions:struct<posted_at:string>,apply_options:array<struct<link:string>>>>")


USUAL_CAPS, USUAL_GRID = V.SEARCH_CAPS, V.GRID_CAPS


def search_postings(pages: DataFrame, as_of, max_results: int | None = None,
                    max_per_query: int | None = None, max_pages: int | None = None,
                    about_chars: int | None = None) -> DataFrame:
    """Postings of landed result pages.

    `pages` has query_pos, query, location, page (from 1), startup_query, jobs_results.
    A crawl may keep so many rows per query and in all, in the order it asked: pass caps,
    usually `USUAL_CAPS`. Without, every row stays.
    """
    if max_pages is not None:
        pages = pages.where(F.col("page") <= max_pages)
    jobs = (pages.select("query_pos", "query", F.col("location").alias("_asked"), "page",
                    "startup_query", F.posexplode("jobs_results").alias("_pos", "j")))
    jobs = computed(jobs, _title=strip(text(F.col("j.title"))), _text=text(F.col("j.description")))
    jobs = jobs.where(has_role_signal(F.col("_title"), F.col("_text")))
    if max_per_query is not None:
        per_query = W.partitionBy("query_pos", "query", "_asked").orderBy("page", "_pos")
        jobs = (jobs.withColumn("_nth", F.row_number().over(per_query))
                .where(F.col("_nth") <= max_per_query))
    if max_results is not None:
        jobs = jobs.orderBy("query_pos", "_asked", "query", "page", "_pos").limit(max_results)
    startup = F.coalesce("startup_query", F.lit(False))
    phrase = text(F.col("j.detected_extensions.posted_at"))
    posted = parse_relative_date(phrase, as_of)
    links = F.filter(F.transform("j.apply_options", lambda o: o["link"]), lambda u: text(u) != "")
    place = first_filled(F.col("j.location"), F.col("_asked"))
    via = F.coalesce("j.via", F.lit("google_jobs"))
    return normalize(
        jobs, company=F.coalesce("j.company_name", F.lit("(unknown)")), title=F.col("_title"),
        location=place, apply_url=first_filled(F.get(links, F.lit(0)), F.col("j.share_link")),
        source=F.concat(F.lit("serpapi:"), F.when(startup, "startup:").otherwise(""), via),
        description_text=F.col("_text"), company_description=shortened(F.col("_text"), about_chars),
        is_startup=F.when(startup, F.lit(True)), level=infer_level(F.col("_title")),
        work_mode=detect_work_mode(place, F.col("_text")), posted_date=posted,
        date_confidence=F.when(posted.isNotNull(), V.APPROXIMATE).otherwise(V.UNVERIFIED),
        date_source=F.when(posted.isNotNull(), F.concat(F.lit("google jobs '"), phrase, F.lit("'")))
        .otherwise(""),
        raw=raw_of(query=F.col("query"), location=F.col("_asked"), page=F.col("page"),
                   startup_query=startup))


def focus_terms(target_role: Column, priority_keywords: Column, max_role_parts: int | None = None,
                max_keywords: int | None = None) -> Column:
    """The parts of the stated role, else the priority keywords; so many of them at most."""
    clean = lambda a: F.filter(F.transform(a, strip), lambda t: t != "")
    role = first_n(clean(F.split(text(target_role), "[,/]")), max_role_parts)
    words = clean(first_n(F.coalesce(priority_keywords, F.array().cast("array<string>")), max_keywords))
    return F.when(strip(text(target_role)) != "", role).otherwise(words)


def query_grid(config: DataFrame, phrases: dict[str, list[str]] | None = None,
               board_breadth: bool = True, startup_breadth: bool = False,
               max_locations: int | None = None, max_role_parts: int | None = None,
               max_keywords: int | None = None) -> DataFrame:
    """(profile_id, query_pos, query, startup_query, location_pos, location).

    `config` has profile_id, target_role, priority_keywords, term, remote_preference and
    locations. Each profile yields each query text once, ignoring case, at its first
    place. The phrase lists are constants, so all is made inside the row. The limits are
    usually `USUAL_GRID`; without, all parts, keywords and locations are used.
    """
    phrases = phrases or V.QUERY_PHRASES
    classes = ["general"] + ["board"] * board_breadth + ["startup"] * startup_breadth
    listed = [(p.strip(), c == "startup") for c in classes for p in phrases.get(c, []) if p.strip()]
    mode = F.lower(strip(text(F.col("remote_preference"))))
    suffix_word = F.lit("")
    for k, v in V.WORK_MODE_SUFFIX.items():
        suffix_word = F.when(mode == k, v).otherwise(suffix_word)
    # Each step is worked out once per row: inside lambdas Spark would repeat it for every phrase.
    config = computed(config.select("profile_id", "locations", "target_role", "priority_keywords", "term", "remote_preference"),
                      _focus=F.array_join(focus_terms(
                          F.col("target_role"), F.col("priority_keywords"), max_role_parts, max_keywords), " "),
                      _term=strip(text(F.col("term"))), _mode=suffix_word)
    focus, term, suffix_word = F.col("_focus"), F.col("_term"), F.col("_mode")

    def query(phrase):
        parts = [phrase, term, suffix_word]
        if phrase != V.QUERY_FALLBACK or listed:
            parts = [focus, *parts]
        return strip(F.concat_ws(" ", *[F.nullif(p if isinstance(p, Column) else F.lit(p),
                                                 F.lit("")) for p in parts]))

    rows = listed or [(V.QUERY_FALLBACK, False)]
    asked = F.array(*[F.struct(query(p).alias("query"), F.lit(s).alias("startup_query"))
                      for p, s in rows])
    config = computed(config, _asked=asked)
    config = computed(config, _low=F.transform("_asked", lambda a: F.lower(a["query"])))
    # A query is kept where its text stands for the first time.
    once = F.filter("_asked", lambda a, i: F.array_position(F.col("_low"), F.get(F.col("_low"), i)) == i + 1)
    places = first_n(F.filter(F.transform(F.coalesce("locations", F.array().cast("array<string>")),
                                          strip), lambda p: p != ""), max_locations)
    places = let(places, lambda p: F.when(F.size(p) > 0, p).otherwise(
        F.array(F.lit(V.DEFAULT_LOCATION))))
    rows = computed(config.select("profile_id", "locations", "_asked", "_low"), _once=once, _places=places).drop(
        "locations", "_asked", "_low")
    return (rows.select("profile_id", "_places", F.posexplode("_once").alias("query_pos", "_q"))
            .select("profile_id", "query_pos", "_q.query", "_q.startup_query",
                    F.posexplode("_places").alias("location_pos", "location")))
