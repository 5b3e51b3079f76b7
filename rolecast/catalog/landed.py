"""From landed sources to reported pairs: boards, an export and pages that hold copies of the same
postings, one source that cannot be read, prior state, closed and expired pages."""

from pyspark.sql import functions as F

from rolecast import values as V
from rolecast.catalog.base import (AS_OF, key_sql, present_sql, profile_terms_ctes, query, quoted, table, texts,
                                   top_ctes)
from rolecast.catalog.freshness import LIVE, PHRASE_SQL, crawl
from rolecast.catalog.ingest import _PLACE, LD, ld_pages, parsed, place
from rolecast.catalog.match import profiles
from rolecast.functions.text import dedup_key
from rolecast.operators import profile as P, state as ST, terms as T
from rolecast.operators.common import checkpointed
from rolecast.plans.run import Settings, land, run
from rolecast.sources import boards as B, jsonld as J

RUN_AT, BEFORE = f"{AS_OF} 08:00:00", "1998-05-01"
CLOSED = "Sorry, this position has been filled."


def _docs(spark, d):
    n = F.col("doc_id")
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url")
    rows = texts(spark, d, "documents").join(pages, "doc_id", "left")
    return rows.select(
        n, F.concat("lang", F.lit(" Intern "), n).alias("title"), "source", "text", place().alias("place"),
        F.coalesce("url", F.concat(F.lit("https://b/"), n)).alias("link"),
        F.date_add(F.lit(AS_OF).cast("date"), -(F.col("n_chars") % 120).cast("int")).alias("day"))


def _company():
    return F.concat(F.upper(F.substring("source", 1, 1)), F.expr("substr(source, 2)"))


def nested(spark, d):
    n = F.col("doc_id")
    job = F.struct(n.alias("id"), "title", F.concat(F.lit("<p>About "), n, F.lit("</p>")).alias("content"),
                   F.struct(F.col("place").alias("name")).alias("location"), F.col("link").alias("absolute_url"),
                   F.concat(F.col("day").cast("string"), F.lit("T08:30:00-04:00")).alias("updated_at"))
    payload = F.struct(F.col("source").alias("slug"), F.array(job).alias("jobs"))
    return B.nested_board(parsed(_docs(spark, d).where(n % 3 != 2), payload, B.NESTED_SCHEMA)).drop("slug")


def epoch(spark, d):
    n = F.col("doc_id")
    record = F.struct(F.col("source").alias("slug"), n.cast("string").alias("id"), F.col("title").alias("text"),
                      F.col("text").alias("descriptionPlain"), F.struct(F.col("place").alias("location")).alias("categories"),
                      F.col("link").alias("hostedUrl"),
                      F.when(n % 4 > 0, F.unix_millis(F.col("day").cast("timestamp"))).alias("createdAt"))
    return B.epoch_board(parsed(_docs(spark, d).where(n % 3 != 0), record, B.EPOCH_SCHEMA)).drop("slug")


def export(spark, d):
    n = F.col("doc_id")
    item = F.struct(_company().alias("company"), "title", F.col("place").alias("location"), F.col("link").alias("url"),
                    F.concat(F.lit("Tag "), n).alias("tagline"), F.lit("Exported").alias("description"))
    return B.user_export(parsed(_docs(spark, d).where(n % 5 == 0), item, B.EXPORT_SCHEMA))


def unreadable(spark, d):
    return B.user_export(B.split_corrupt(B.read_payloads(spark, f"{d}/no_such_file", B.EXPORT_SCHEMA))[0])


def landed(spark, d):
    return land({"nested": lambda: nested(spark, d), "epoch": lambda: epoch(spark, d),
                 "export": lambda: export(spark, d), "missing": lambda: unreadable(spark, d),
                 "pages": lambda: J.page_postings(ld_pages(spark, d))},
                T.seed_lexicon(spark), V.REQUIREMENTS)


def known_state(spark, d):
    """Every fifth document's posting, seen in an earlier run."""
    rows = _docs(spark, d).where("doc_id % 5 = 1").select(
        dedup_key(_company(), F.col("title"), F.col("place")).alias("key"),
        F.lit(BEFORE).cast("timestamp").alias("first_seen"), F.lit(BEFORE).cast("timestamp").alias("last_seen"))
    return spark.createDataFrame([], ST.STATE_SCHEMA).unionByName(rows, allowMissingColumns=True)


def crawled(spark, d):
    """Pages with their JSON-LD, some of it expired; one in eleven says that it is closed."""
    pages = ld_pages(spark, d).select("page_id", F.when(F.col("page_id") % 11 == 0, F.concat("html", F.lit(CLOSED)))
                                      .otherwise(F.col("html")).alias("body"))
    return crawl(spark, d).drop("body").join(pages, "page_id").where("requested_url is not null")


def result(spark, d):
    listings, _ = landed(spark, d)
    terms = checkpointed(P.profile_terms(profiles(spark, d), T.seed_lexicon(spark), T.seed_synonyms(spark),
                                         top_n=V.TOP_TERMS))
    return run(listings, terms, crawled(spark, d), known_state(spark, d), AS_OF, RUN_AT, Settings(min_score=1))


_SAID = "CASE " + " ".join(f"WHEN contains(lower(html), {quoted([p])}) THEN {quoted([p])}" for p in V.CLOSURE_PHRASES) + " END"
_JUDGED = (LIVE.replace(PHRASE_SQL, _SAID).replace("html FROM pages)", "html FROM pg)")
           .replace("FROM landed)", "FROM landed LEFT JOIN opened USING (page_id))")
           .replace("WHEN redirected AND is_landing",
                    "WHEN is_open = false THEN 'dead#schema.org validThrough indicates expired' WHEN redirected AND is_landing"))

LANDED = f"""{LD},
opened AS (SELECT page_id, until >= DATE '{AS_OF}' AS is_open FROM kept),
pg AS (SELECT page_id, url, html || CASE WHEN page_id % 11 = 0 THEN '{CLOSED}' ELSE '' END AS html FROM pages),
{_JUDGED},
verdicts AS (SELECT requested, min(CASE split_part(v, '#', 1) WHEN 'dead' THEN '0' WHEN 'live' THEN '1'
  ELSE '2' END || '#' || v) AS v FROM verdict GROUP BY requested),
d0 AS (SELECT doc_id AS n, lang || ' Intern ' || doc_id AS title, upper(source[1]) || substr(source, 2) AS company,
  coalesce({_PLACE}, '') AS place, source AS src, text, coalesce(url, 'https://b/' || doc_id) AS link,
  DATE '{AS_OF}' - (n_chars % 120)::INT AS day FROM documents LEFT JOIN pages ON page_id = doc_id),
land AS (
  SELECT company, title, place, 'About ' || n AS body, 'greenhouse:' || src AS source, day AS posted, 0 AS conf,
    0 AS tier, NULL::BOOLEAN AS startup, NULL AS about, NULL::DATE AS deadline, link, n % 5 = 1 AS old
    FROM d0 WHERE n % 3 <> 2
  UNION ALL SELECT company, title, place, text, 'lever:' || src, CASE WHEN n % 4 > 0 THEN day END,
    CASE WHEN n % 4 > 0 THEN 0 ELSE 1 END, 0, NULL, NULL, NULL, link, n % 5 = 1 FROM d0 WHERE n % 3 <> 0
  UNION ALL SELECT company, title, place, 'Exported', 'wellfound:export', NULL, 1, 2, true, 'Tag ' || n, NULL,
    link, n % 5 = 1 FROM d0 WHERE n % 5 = 0
  UNION ALL SELECT 'Org ' || page_id, title, 'Austin, TX', 'About ' || page_id, 'schemaorg', DATE '1998-06-01', 0, 0,
    NULL, NULL, until, url, false FROM (SELECT * FROM kept UNION ALL SELECT * FROM kept WHERE f = 4)),
keyed AS (SELECT *, {key_sql("company", "title", "place")} AS key FROM land),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY conf, tier, -length(body), source) AS r FROM keyed),
best AS (SELECT * FROM ranked WHERE r = 1),
more AS (SELECT key, count(*) AS n_merged, bool_or(ranked.startup) AS startup, max(ranked.about) AS about,
  coalesce(string_agg(ranked.source, ', ' ORDER BY ranked.r) FILTER (ranked.source <> best.source), '') AS also_seen
  FROM ranked JOIN best USING (key) GROUP BY key),
merged AS (SELECT best.* EXCLUDE (startup, about), more.* EXCLUDE (key),
  coalesce(posted, CASE WHEN old THEN DATE '{BEFORE}' ELSE DATE '{AS_OF}' END) AS on_day
  FROM best JOIN more USING (key)),
windows AS (SELECT *, DATE '{AS_OF}' - on_day AS age, deadline - DATE '{AS_OF}' AS ahead,
  coalesce(split_part(v, '#', 2), 'unknown') AS live_status FROM merged LEFT JOIN verdicts ON requested = link),
eligible AS (SELECT * FROM windows WHERE age <= 60 OR coalesce(ahead BETWEEN 0 AND 90, false)),
retained AS MATERIALIZED (SELECT * FROM eligible WHERE live_status <> 'dead'),
prof AS (SELECT item_id AS profile_id, text FROM benchmark),
{profile_terms_ctes("pt", "prof", "profile_id", "text")},
{top_ctes("rq", "retained", "key", "body", 36)},
said_terms AS (SELECT key, term, -length(term) AS pl FROM retained, seed_lex WHERE {present_sql("term", "lower(body)")}
  UNION ALL SELECT key, term, 1000000 + term_rank FROM rq),
placed AS (SELECT key, term, min(pl) AS pl FROM said_terms GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pl, term) AS pos FROM placed),
wanted AS (SELECT key, string_agg(term, ' ' ORDER BY pos) AS spaced, string_agg(term, '|' ORDER BY pos) AS requirements
  FROM numbered WHERE pos <= 18 GROUP BY key),
hay AS MATERIALIZED (SELECT key, lower(title) AS t, lower(body || ' ' || coalesce(spaced, '')) AS b, body <> '' AS has_text
  FROM retained LEFT JOIN wanted USING (key)),
vocab AS (SELECT DISTINCT term FROM pt),
hit AS (SELECT key, term, {present_sql("term", "t")} AS in_title, {present_sql("term", "b")} AS in_body, has_text
  FROM hay JOIN vocab ON contains(t, term) OR contains(b, term)),
pair AS (SELECT profile_id, key, bool_or(has_text) AS has_text,
  sum((round(weight * 1000000)::BIGINT) * CASE WHEN in_title THEN 8 ELSE 5 END) / 5000000.0 AS s,
  string_agg(term, '|' ORDER BY term_rank) AS matched
  FROM hit JOIN pt USING (term) WHERE in_title OR in_body GROUP BY profile_id, key),
reported AS (SELECT *, round_even(CASE WHEN has_text THEN 100 * (1 - exp(-s / 7))
  ELSE least(100 * (1 - exp(-s / 7)), 70) END, 0)::BIGINT AS match_score FROM pair)"""


@query("landed_run", f"""
WITH {LANDED}
SELECT profile_id, md5(key) AS key_md5, match_score, live_status, source, also_seen, n_merged, startup AS is_startup,
  coalesce(about, '') AS company_description, on_day::VARCHAR AS posted_date, deadline::VARCHAR AS deadline,
  CASE WHEN posted IS NULL THEN 'approximate' ELSE 'verified' END AS date_confidence,
  concat_ws('; ', CASE WHEN age <= 60 THEN 'posted ' || age || 'd ago (≤60d)' END,
    CASE WHEN ahead BETWEEN 0 AND 90 THEN 'deadline in ' || ahead || 'd (≤90d)' END) AS eligibility_reason,
  coalesce(requirements, '') AS requirements, matched
FROM reported JOIN retained USING (key) LEFT JOIN wanted USING (key) WHERE match_score >= 1""")
def landed_run(spark, d):
    """Land, number, fill requirements, observe, merge, window, check, match and report."""
    return result(spark, d).reported.select(
        "profile_id", F.md5("key").alias("key_md5"), F.col("match_score").cast("bigint"), "live_status", "source",
        "also_seen", "n_merged", "is_startup", "company_description", F.col("posted_date").cast("string"),
        F.col("deadline").cast("string"), "date_confidence", "eligibility_reason",
        F.array_join("requirements", "|").alias("requirements"),
        F.array_join("matched_keywords", "|").alias("matched"))


@query("landed_requirements", f"""
WITH {LD},
b AS (SELECT 'nested' AS label, doc_id AS n, 'About ' || doc_id AS body FROM documents WHERE doc_id % 3 <> 2
  UNION ALL SELECT 'epoch', doc_id, text FROM documents WHERE doc_id % 3 <> 0
  UNION ALL SELECT 'export', doc_id, 'Exported' FROM documents WHERE doc_id % 5 = 0
  UNION ALL SELECT 'pages', page_id, 'About ' || page_id FROM (SELECT * FROM kept UNION ALL SELECT * FROM kept WHERE f = 4)),
src AS (SELECT label || '#' || n AS k, any_value(label) AS label, any_value(body) AS body, count(*) AS copies FROM b GROUP BY 1),
prof AS (SELECT item_id AS profile_id, text FROM benchmark), {profile_terms_ctes("pt", "prof", "profile_id", "text")},
{top_ctes("rq", "src", "k", "body", 36)},
t AS (SELECT k, term, -length(term) AS pl FROM src, seed_lex WHERE {present_sql("term", "lower(body)")}
  UNION ALL SELECT k, term, 1000000 + term_rank FROM rq),
p AS (SELECT k, term, min(pl) AS pl FROM t GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pl, term) AS pos FROM p),
w AS (SELECT k, string_agg(term, '|' ORDER BY pos) AS requirements FROM o WHERE pos <= 18 GROUP BY k)
SELECT label AS source_label, coalesce(requirements, '') AS requirements, sum(copies)::BIGINT AS n
FROM src LEFT JOIN w USING (k) GROUP BY ALL""")
def landed_requirements(spark, d):
    """Postings of every source that could be read, counted by their requirements."""
    rows, _ = landed(spark, d)
    return rows.groupBy("source_label", F.array_join("requirements", "|").alias("requirements")).agg(F.count("*").alias("n"))
