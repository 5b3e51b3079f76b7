"""Queries that match profiles (benchmark items) with postings (documents)."""

from pyspark.sql import functions as F

from rolecast import values as V
from rolecast.catalog.base import (NL, body_of, body_sql, joined, present_sql,
                                   profile_terms_ctes, query, texts, title_of, title_sql)
from rolecast.operators import match as M, profile as P, terms as T
from rolecast.operators.common import checkpointed


def postings(spark, d):
    return texts(spark, d, "documents").select(
        F.col("doc_id").alias("posting_id"), F.col("lang").alias("company"),
        title_of(F.col("text")).alias("title"), F.col("source").alias("location"),
        body_of(F.col("text")).alias("description_text"))


def profiles(spark, d):
    return texts(spark, d, "benchmark").select(F.col("item_id").alias("profile_id"), "text")


def terms(spark, d):
    """Terms are read several times by a match, so they are written once."""
    return checkpointed(P.profile_terms(profiles(spark, d), T.seed_lexicon(spark),
                                        T.seed_synonyms(spark), top_n=V.TOP_TERMS))


PAIRS = f"""
prof AS (SELECT item_id AS profile_id, text FROM benchmark),
{profile_terms_ctes("pt", "prof", "profile_id", "text")},
post AS (SELECT doc_id AS posting_id, lang AS company, {title_sql("text")} AS title,
  source AS location, {body_sql("text")} AS description_text FROM documents),
vocab AS (SELECT DISTINCT term FROM pt),
hit AS (SELECT posting_id, term, {present_sql("term", "lower(title)")} AS in_title,
  {present_sql("term", "lower(description_text)")} AS in_body, description_text <> '' AS has_text
  FROM post JOIN vocab ON contains(lower(title), term) OR contains(lower(description_text), term)),
pair AS (SELECT profile_id, posting_id, bool_or(has_text) AS has_text,
  sum((round(weight * 1000000)::BIGINT) * CASE WHEN in_title THEN 8 ELSE 5 END) / 5000000.0 AS s,
  list(term_rank ORDER BY term_rank) AS ranks
  FROM hit JOIN pt USING (term) WHERE in_title OR in_body GROUP BY profile_id, posting_id),
pairs AS (SELECT profile_id, posting_id, ranks, round_even(CASE WHEN has_text
  THEN 100 * (1 - exp(-s / 7)) ELSE least(100 * (1 - exp(-s / 7)), 70) END, 0)::BIGINT
  AS match_score FROM pair)"""

BEST = f"""{PAIRS},
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile_id
  ORDER BY match_score DESC, posting_id) AS pair_rank FROM pairs) WHERE pair_rank <= 10),
named AS (SELECT b.profile_id, posting_id, match_score, pair_rank,
  list(term ORDER BY term_rank) FILTER (list_contains(ranks, term_rank)) AS m,
  coalesce(list(term ORDER BY term_rank) FILTER (weight >= 1.4
    AND NOT list_contains(ranks, term_rank)), []) AS g
  FROM best b JOIN pt ON pt.profile_id = b.profile_id GROUP BY ALL)"""


@query("match_pairs", f"""
WITH {PAIRS} SELECT profile_id, posting_id, match_score, len(ranks) AS n_matched,
  array_to_string(ranks, '|') AS ranks FROM pairs""")
def match_pairs(spark, d):
    out = M.match_pairs(postings(spark, d), terms(spark, d))
    return out.select("profile_id", "posting_id", F.col("match_score").cast("bigint"),
                      F.size("matched_ranks").cast("bigint").alias("n_matched"),
                      joined(F.col("matched_ranks").cast("array<string>")).alias("ranks"))


@query("match_pairs_unbounded_terms", f"""
WITH {PAIRS} SELECT profile_id, posting_id, match_score FROM pairs""")
def match_pairs_unbounded_terms(spark, d):
    """The way without broadcast, for profile terms over the size bound."""
    out = M.match_pairs(postings(spark, d), terms(spark, d), small=False)
    return out.select("profile_id", "posting_id", F.col("match_score").cast("bigint"))


@query("match_topk", f"""
WITH {BEST} SELECT profile_id, posting_id, match_score, pair_rank,
  array_to_string(m[1:20], '|') AS matched, array_to_string(g[1:6], '|') AS missing,
  'Keyword match on: ' || array_to_string(m[1:8], ', ')
    || CASE WHEN len(m) > 8 THEN ' ...' ELSE '' END AS match_rationale
FROM named""")
def match_topk(spark, d):
    pt = terms(spark, d)
    best = M.top_pairs(postings(spark, d), pt, 10)
    return M.with_term_lists(best, pt, V.MATCHED_SHOWN, V.MISSING_SHOWN, named=V.RATIONALE_SHOWN).select(
        "profile_id", "posting_id", F.col("match_score").cast("bigint"),
        F.col("pair_rank").cast("bigint"), joined("matched_keywords").alias("matched"),
        joined("missing_keywords").alias("missing"), "match_rationale")


MISSING_PROFILES = f"""
WITH src AS (SELECT doc_id AS profile_id, text FROM documents),
tagged AS (SELECT profile_id, unnest(['alpha ' || lang, 'beta ' || source]) AS term,
           unnest([1.8, 1.5]) AS weight, unnest([1, 2]) AS term_rank
           FROM (SELECT doc_id AS profile_id, lang, source FROM documents)),
pairs AS (SELECT doc_id AS profile_id, doc_id AS posting_id, CASE WHEN quality = 1 THEN 1 ELSE 2 END
          AS hit FROM documents JOIN labels USING (doc_id))
SELECT t.profile_id, posting_id, term, 0::BIGINT AS missing_rank
FROM pairs JOIN tagged t USING (profile_id) WHERE term_rank <> hit"""


@query("missing_terms", MISSING_PROFILES)
def missing_terms(spark, d):
    """Heavy terms of each document as a profile against the one its label matched."""
    docs, labels = texts(spark, d, "documents"), texts(spark, d, "labels")
    tagged = docs.select(F.col("doc_id").alias("profile_id"), F.posexplode(F.array(
        F.struct(F.concat(F.lit("alpha "), "lang").alias("term"), F.lit(1.8).alias("weight")),
        F.struct(F.concat(F.lit("beta "), "source").alias("term"), F.lit(1.5).alias("weight")),
    )).alias("p", "t")).select("profile_id", "t.*", (F.col("p") + 1).alias("term_rank"))
    pairs = docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("profile_id"), F.col("doc_id").alias("posting_id"),
        F.array(F.when(F.col("quality") == 1, 1).otherwise(2)).alias("matched_ranks"))
    return M.missing_terms(pairs, tagged).select(
        "profile_id", "posting_id", "term", F.col("missing_rank").cast("bigint"))


@query("score_floor", f"""
WITH {PAIRS} SELECT profile_id, posting_id, match_score FROM pairs WHERE match_score >= 25""")
def score_floor(spark, d):
    out = M.at_least(M.match_pairs(postings(spark, d), terms(spark, d)), 25)
    return out.select("profile_id", "posting_id", F.col("match_score").cast("bigint"))


@query("score_prompts", f"""
WITH {PAIRS} SELECT profile_id, posting_id, md5('CANDIDATE PROFILE:' || {NL} || 'Item '
  || profile_id || {NL} || 'STATED TARGET ROLES/FIELD: (not specified - infer from the resume)'
  || {NL} || {NL} || 'INTERNSHIP:' || {NL} || 'Company: ' || company || {NL} || 'Title: ' || title
  || {NL} || 'Location: ' || location || {NL} || 'Description:' || {NL}
  || CASE WHEN description_text = '' THEN '(no description available; score from the title)'
     ELSE description_text END || {NL} || {NL} || 'Score the fit.') AS prompt_md5
FROM pairs JOIN post USING (posting_id)""")
def score_prompts(spark, d):
    people = profiles(spark, d).select(
        "profile_id", F.concat(F.lit("Item "), "profile_id").alias("summary"),
        F.lit("").alias("target_role"))
    posts = postings(spark, d)
    pairs = M.match_pairs(posts, terms(spark, d))
    return M.score_prompts(pairs, people, posts).select(
        "profile_id", "posting_id", F.md5("prompt").alias("prompt_md5"))


ANSWERS = f"""answers AS (SELECT doc_id, quality * 130 - toxic * 40 AS score,
  'why ' || doc_id AS rationale FROM labels)"""


def answers(spark, d):
    """One landed answer per label: in a code fence, bare, in other words, or broken."""
    body = F.concat(F.lit('{"score": '), (F.col("quality") * 130 - F.col("toxic") * 40).cast("string"),
                    F.lit(', "rationale": "why '), "doc_id",
                    F.lit('", "matched_skills": ["a'), "doc_id", F.lit('"], "missing_skills": []}'))
    form = F.col("doc_id") % 4
    return texts(spark, d, "labels").select(
        "doc_id", F.when(form == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(form == 1, body).when(form == 2, F.concat(F.lit("Sure: "), body, F.lit(" Done.")))
        .otherwise("no answer").alias("answer"))


@query("parse_scores", f"""
WITH {ANSWERS} SELECT doc_id, score::BIGINT AS score, rationale, 'a' || doc_id AS matched
FROM answers WHERE doc_id % 4 <> 3""")
def parse_scores(spark, d):
    return M.parse_scores(answers(spark, d)).select(
        "doc_id", F.col("score").cast("bigint"), "rationale",
        joined("matched_skills").alias("matched"))


@query("score_override", f"""
WITH {ANSWERS}
SELECT doc_id, greatest(0, least(100, CASE WHEN a.doc_id IS NOT NULL AND a.doc_id % 4 <> 3
    THEN a.score ELSE n_chars % 101 END))::BIGINT AS match_score,
  CASE WHEN a.doc_id % 4 <> 3 THEN a.rationale ELSE 'own' END AS match_rationale,
  CASE WHEN a.doc_id % 4 <> 3 THEN 'a' || doc_id ELSE lang || '|' || source END AS matched,
  lang AS missing
FROM documents LEFT JOIN answers a USING (doc_id)""")
def score_override(spark, d):
    pairs = texts(spark, d, "documents").select(
        "doc_id", (F.col("n_chars") % 101).cast("int").alias("match_score"),
        F.lit("own").alias("match_rationale"), F.array("lang", "source").alias("matched_keywords"),
        F.array("lang").alias("missing_keywords"))
    out = M.override_scores(pairs, M.parse_scores(answers(spark, d)), ["doc_id"])
    return out.select("doc_id", F.col("match_score").cast("bigint"), "match_rationale",
                      joined("matched_keywords").alias("matched"),
                      joined("missing_keywords").alias("missing"))
