"""The whole flow over the given tables."""

from pyspark.sql import functions as F

from rolecast import values as V
from rolecast.catalog.base import AS_OF, key_sql, profile_terms_ctes, query, table, texts
from rolecast.catalog.freshness import LIVE, PHRASE_SQL, crawl
from rolecast.catalog.match import profiles
from rolecast.operators import profile as P, state as ST, terms as T
from rolecast.operators.common import checkpointed
from rolecast.plans.run import Settings, run

RUN_AT = f"{AS_OF} 08:00:00"


def listings(spark, d):
    """Documents as landed postings that link to the crawled pages."""
    n = F.col("doc_id")
    day = F.date_add(F.lit(AS_OF).cast("date"), -(F.col("n_chars") % 120).cast("int"))
    pages = table(spark, d, "pages").select(F.col("page_id").alias("_p"),
                                            F.col("url").alias("apply_url"))
    rows = texts(spark, d, "documents").select(
        n.alias("ingest_seq"), F.col("lang").alias("company"), F.col("text").alias("title"),
        F.col("source").alias("location"), F.concat(F.lit("greenhouse:"), "source").alias("source"),
        F.lit("").alias("company_description"), F.lit(None).cast("boolean").alias("is_startup"),
        F.lit("").alias("funding_stage"), F.lit("intern").alias("level"),
        F.lit("unknown").alias("work_mode"), F.lit("").alias("description_text"),
        F.array().cast("array<string>").alias("requirements"),
        F.when(n % 4 > 0, day).alias("posted_date"), F.lit(None).cast("date").alias("deadline"),
        F.lit(False).alias("deadline_is_rolling"),
        F.lit(V.VERIFIED).alias("date_confidence"), F.lit("landed").alias("date_source"),
        n.alias("_p"))
    return rows.join(pages, "_p", "left").drop("_p")


def result(spark, d):
    terms = checkpointed(P.profile_terms(profiles(spark, d), T.seed_lexicon(spark),
                                         T.seed_synonyms(spark), top_n=V.TOP_TERMS))
    crawled = crawl(spark, d).where("requested_url is not null")
    empty = spark.createDataFrame([], ST.STATE_SCHEMA)
    return run(listings(spark, d), terms, crawled, empty, AS_OF, RUN_AT,
               Settings(min_score=1))


FLOW = f"""{LIVE.replace(PHRASE_SQL, "NULL::VARCHAR")},
verdicts AS (SELECT requested, min(CASE split_part(v, '#', 1) WHEN 'dead' THEN '0' WHEN 'live' THEN '1'
  ELSE '2' END || '#' || v) AS v FROM verdict GROUP BY requested),
landed_docs AS (SELECT doc_id AS seq, text, {key_sql("lang", "text", "source")} AS key, doc_id % 4 > 0 AS dated,
  DATE '{AS_OF}' - CASE WHEN doc_id % 4 > 0 THEN n_chars % 120 ELSE 0 END::INT AS posted, url
  FROM documents LEFT JOIN pages ON page_id = doc_id),
merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY NOT dated, seq) AS r
  FROM landed_docs) WHERE r = 1),
eligible AS (SELECT *, DATE '{AS_OF}' - posted AS age,
  CASE WHEN url IS NULL THEN 'unknown' ELSE split_part(v, '#', 2) END AS live_status
  FROM merged LEFT JOIN verdicts ON requested = url WHERE DATE '{AS_OF}' - posted <= 60),
retained AS (SELECT * FROM eligible WHERE live_status <> 'dead'),
prof AS (SELECT item_id AS profile_id, text FROM benchmark),
{profile_terms_ctes("pt", "prof", "profile_id", "text")},
vocab AS (SELECT DISTINCT term FROM pt),
near AS MATERIALIZED (SELECT key, term, lower(text) AS body FROM retained
  JOIN vocab ON contains(lower(text), term)),
hit AS (SELECT key, term FROM near WHERE regexp_matches(body,
  '(^|[^a-z0-9+#])' || regexp_escape(term) || '($|[^a-z0-9+#])')),
pair AS (SELECT profile_id, key, sum(round(weight * 1000000)::BIGINT * 8) / 5000000.0 AS s,
  list(term ORDER BY term_rank) AS terms FROM hit JOIN pt USING (term) GROUP BY profile_id, key),
reported AS (SELECT *, round_even(least(100 * (1 - exp(-s / 7)), 70), 0)::BIGINT AS match_score FROM pair
  WHERE round_even(least(100 * (1 - exp(-s / 7)), 70), 0) >= 1)"""


@query("full_run", f"""
WITH {FLOW}
SELECT profile_id, seq AS ingest_seq, md5(key) AS key_md5, match_score, live_status,
  CASE WHEN dated THEN 'verified' ELSE 'approximate' END AS date_confidence,
  posted::VARCHAR AS posted_date, 'posted ' || age || 'd ago (≤60d)' AS eligibility_reason,
  array_to_string(terms, '|') AS matched FROM reported JOIN retained USING (key)""")
def full_run(spark, d):
    """Observe, resolve, merge, window, check, match and rank in one go."""
    return result(spark, d).reported.select(
        "profile_id", "ingest_seq", F.md5("key").alias("key_md5"),
        F.col("match_score").cast("bigint"), "live_status", "date_confidence",
        F.col("posted_date").cast("string"), "eligibility_reason",
        F.array_join("matched_keywords", "|").alias("matched"))


@query("full_run_counters", f"""
WITH {FLOW}
SELECT (SELECT count(*) FROM documents) AS n_fetched, (SELECT count(*) FROM merged) AS n_listings,
  (SELECT count(*) FROM eligible) AS n_eligible, (SELECT count(*) FROM retained) AS n_retained,
  (SELECT count(*) FROM eligible WHERE live_status = 'dead') AS n_dead,
  (SELECT count(DISTINCT key) FROM reported) AS n_reported""")
def full_run_counters(spark, d):
    return result(spark, d).counters
