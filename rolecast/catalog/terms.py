"""Queries on terms and profiles."""

import uuid

from pyspark.sql import functions as F

from rolecast import values as V
from rolecast.catalog.base import (NL, counts_ctes, joined, present_sql, profile_terms_ctes, query, sections_cte, table, texts,
                                   top_ctes, with_headers, with_headers_sql)
from rolecast.operators import profile as P, terms as T
from rolecast.operators.common import checkpointed, shared_dir
from rolecast.sources.profiles import read_profiles


def bench_lexicon(spark, d):
    """The salient terms of the benchmark items, as a lexicon."""
    items = texts(spark, d, "benchmark")
    terms = T.top_terms(items, "item_id", top_n=V.TOP_TERMS).select("term").distinct()
    return checkpointed(terms.withColumn("is_tool", F.length("term") > 8))


LEX_CTE = top_ctes("bt", "benchmark", "item_id", "text", 40) + """,
lex AS (SELECT DISTINCT term, length(term) > 8 AS is_tool FROM bt),
low AS (SELECT doc_id, lower(text) AS body FROM documents),
near AS MATERIALIZED (SELECT doc_id, term, body FROM low JOIN lex ON contains(body, term)),
known AS (SELECT doc_id, term FROM near WHERE regexp_matches(body,
  '(^|[^a-z0-9+#])' || regexp_escape(term) || '($|[^a-z0-9+#])'))"""


@query("term_counts", f"""
WITH {counts_ctes("c", "documents", "doc_id", "text")}
SELECT doc_id, term, n, contains(term, ' ') AS is_phrase FROM c_n""")
def term_counts(spark, d):
    return T.term_counts(texts(spark, d, "documents")).select("doc_id", "term", "n", "is_phrase")


@query("top_terms", f"""
WITH {top_ctes("t", "documents", "doc_id", "text", 40)}
SELECT doc_id, term, n, weight, term_rank FROM t""")
def top_terms(spark, d):
    return T.top_terms(texts(spark, d, "documents"), top_n=V.TOP_TERMS).select(
        "doc_id", "term", "n", "weight", F.col("term_rank").cast("bigint").alias("term_rank"))


@query("known_terms", f"""
WITH {LEX_CTE}
SELECT doc_id, term FROM known""")
def known_terms(spark, d):
    return T.known_terms(texts(spark, d, "documents"), bench_lexicon(spark, d))


@query("known_terms_unbounded_lexicon", f"""
WITH {LEX_CTE}
SELECT doc_id, term FROM known""")
def known_terms_unbounded_lexicon(spark, d):
    """The way without broadcast, for a lexicon over the size bound."""
    return T.known_terms(texts(spark, d, "documents"), bench_lexicon(spark, d), small=False)


@query("requirements", f"""
WITH {LEX_CTE},
k AS (SELECT doc_id, term, 0 AS class, -length(term) AS r FROM known),
{top_ctes("g", "documents", "doc_id", "text", 36)},
u AS (SELECT * FROM k UNION ALL SELECT doc_id, term, 1, term_rank FROM g),
o AS (SELECT doc_id, term, min(class * 1000000 + r) AS pl FROM u GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pl, term) AS pos FROM o)
SELECT doc_id, string_agg(term, '|' ORDER BY pos) AS requirements
FROM p WHERE pos <= 18 GROUP BY doc_id""")
def requirements(spark, d):
    out = T.requirements(texts(spark, d, "documents"), bench_lexicon(spark, d), limit=V.REQUIREMENTS)
    return out.select("doc_id", joined("requirements").alias("requirements"))


PART_WORDS = "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS term FROM part"
PART_EDGES = f"""
e AS (SELECT DISTINCT w.term AS a, lower(p_type) AS b FROM ({PART_WORDS}) w
      JOIN part p ON p.p_partkey = w.p_partkey),
syn AS (SELECT DISTINCT * FROM (SELECT a AS src, b AS dst FROM e UNION ALL SELECT b, a FROM e)
        WHERE src <> dst),
tools AS (SELECT DISTINCT term FROM ({PART_WORDS}) WHERE length(term) > 4)"""
PART_EXPANDED = f"""
x AS (SELECT p_partkey, term, 1.0 AS b FROM ({PART_WORDS})
      UNION ALL SELECT p_partkey, dst, 0.6 FROM ({PART_WORDS}) JOIN syn ON src = term),
expanded AS (SELECT p_partkey, x.term, round(max(b) * max(CASE WHEN t.term IS NULL THEN 1.0
             ELSE 1.3 END), 6)::DOUBLE AS weight
             FROM x LEFT JOIN tools t ON t.term = x.term GROUP BY ALL)"""


def part_words(spark, d):
    return texts(spark, d, "part").select(
        "p_partkey", "p_type", F.explode(F.split("p_name", " ")).alias("term"))


def part_vocabulary(spark, d):
    words = part_words(spark, d)
    edges = T.symmetric(words.select(F.col("term").alias("src"),
                                     F.lower("p_type").alias("dst")).distinct())
    lexicon = words.select("term").distinct().withColumn("is_tool", F.length("term") > 4)
    return words, edges, lexicon


@query("synonym_expand", f"""
WITH {PART_EDGES}, {PART_EXPANDED} SELECT p_partkey, term, weight FROM expanded""")
def synonym_expand(spark, d):
    words, edges, lexicon = part_vocabulary(spark, d)
    return T.expand_synonyms(words, edges, lexicon, "p_partkey")


@query("weight_merge", f"""
WITH {PART_EDGES}, {PART_EXPANDED},
layers AS (SELECT * FROM expanded
  UNION ALL SELECT p_partkey, lower(p_brand), 1.8 FROM part
  UNION ALL SELECT p_partkey, lower(p_type), 1.4 FROM part),
best AS (SELECT p_partkey, term, max(weight) AS weight FROM layers GROUP BY ALL)
SELECT p_partkey, term, weight,
       row_number() OVER (PARTITION BY p_partkey ORDER BY weight DESC, term) AS term_rank
FROM best""")
def weight_merge(spark, d):
    words, edges, lexicon = part_vocabulary(spark, d)
    part = texts(spark, d, "part")
    out = T.merge_weights([
        T.expand_synonyms(words, edges, lexicon, "p_partkey"),
        part.select("p_partkey", F.lower("p_brand").alias("term"), F.lit(1.8).alias("weight")),
        part.select("p_partkey", F.lower("p_type").alias("term"), F.lit(1.4).alias("weight")),
    ], "p_partkey")
    return out.withColumn("term_rank", F.col("term_rank").cast("bigint"))


@query("vocabulary_union", f"""
WITH {PART_EDGES},
u AS (SELECT DISTINCT term, length(term) > 4 AS is_tool FROM ({PART_WORDS})
      UNION ALL SELECT src, false FROM syn
      UNION ALL SELECT DISTINCT lower(p_brand), false FROM part)
SELECT term, bool_or(is_tool) AS is_tool FROM u GROUP BY term""")
def vocabulary_union(spark, d):
    _, edges, lexicon = part_vocabulary(spark, d)
    brands = table(spark, d, "part").select(F.col("p_brand").alias("term"))
    return T.vocabulary(lexicon, edges, brands)


@query("tool_terms", f"""
WITH {PART_EDGES}
SELECT p_partkey, term FROM ({PART_WORDS}) w WHERE term IN (SELECT term FROM tools)""")
def tool_terms(spark, d):
    words, _, lexicon = part_vocabulary(spark, d)
    return T.tools_of(words.select("p_partkey", "term"), lexicon)


@query("ordered_distinct", f"""
SELECT p_type, term, min(p_partkey) AS p_partkey
FROM (SELECT p_type, p_partkey, unnest(string_split(p_name, ' ')) AS term FROM part)
GROUP BY ALL""")
def ordered_distinct(spark, d):
    return T.first_of_each(part_words(spark, d), "p_type", "term", "p_partkey")


@query("section_label", f"""
WITH src AS (SELECT doc_id, {with_headers_sql("text")} AS text FROM documents),
{sections_cte("s", "src", "doc_id", "text")}
SELECT doc_id, section, md5(text) AS text_md5, length(text) AS n_chars FROM s WHERE text <> ''""")
def section_label(spark, d):
    docs = texts(spark, d, "documents").select("doc_id", with_headers(F.col("text")).alias("text"))
    parts = P.split_sections(docs)
    names = [*V.SECTION_HEADERS, P.PREAMBLE]
    rows = F.array(*[F.struct(F.lit(n).alias("section"), F.col(n).alias("text")) for n in names])
    return (parts.select("doc_id", F.explode(rows).alias("s")).where("s.text <> ''")
            .select("doc_id", "s.section", F.md5("s.text").alias("text_md5"),
                    F.length("s.text").cast("bigint").alias("n_chars")))


@query("profile_terms", f"""
WITH src AS (SELECT doc_id AS profile_id, {with_headers_sql("text")} AS text FROM documents),
{profile_terms_ctes("pt", "src", "profile_id", "text")}
SELECT profile_id, term, weight, term_rank FROM pt""")
def profile_terms(spark, d):
    docs = texts(spark, d, "documents").select(F.col("doc_id").alias("profile_id"),
                                               with_headers(F.col("text")).alias("text"))
    out = P.profile_terms(docs, T.seed_lexicon(spark), T.seed_synonyms(spark), top_n=V.TOP_TERMS)
    return out.withColumn("term_rank", F.col("term_rank").cast("bigint"))


FACT_WORDS = {"that": "B.S. in marketing", "with": "data science", "for": "research intern",
              "was": "product manager", "les": "teaching assistant", "und": "software developer"}
_MAJOR = (r"(?i)\b(?:in|of)\s+([A-Za-z][A-Za-z&/ ]{3,60}?(?:" + "|".join(V.MAJOR_FIELDS) + r"))\b")
_TITLES = (r"(?i)\b((?:" + "|".join(V.TITLE_QUALIFIERS) + r")\s+(?:" + "|".join(V.TITLE_NOUNS)
           + ")|" + "|".join(V.TITLE_SHORT) + r")\b")


def _facts_sql(x):
    for w, to in FACT_WORDS.items():
        x = f"regexp_replace({x}, ' {w} ', ' {to} ', 'g')"
    return x


@query("profile_facts", f"""
WITH src AS (SELECT doc_id AS profile_id, {_facts_sql("text")} AS text FROM documents),
f AS (SELECT profile_id, text,
  upper(replace(regexp_extract(text, '{V.DEGREE.replace("'", "''")}', 1), '.', '')) AS degree,
  trim(regexp_replace(regexp_extract(text, '{_MAJOR}', 1), '\\s+', ' ', 'g')) AS major,
  [lower(regexp_replace(t, '\\s+', ' ', 'g')) for t in regexp_extract_all(text, '{_TITLES}')] AS ts
  FROM src),
g AS (SELECT profile_id, t, row_number() OVER (PARTITION BY profile_id ORDER BY min(i)) AS r FROM (
  SELECT profile_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM f) GROUP BY profile_id, t)
SELECT f.profile_id, degree, major, coalesce(titles, '') AS titles FROM f LEFT JOIN (
  SELECT profile_id, string_agg(t, '|' ORDER BY r) AS titles FROM g
  GROUP BY profile_id) USING (profile_id)""")
def profile_facts(spark, d):
    body = F.col("text")
    for w, to in FACT_WORDS.items():
        body = F.regexp_replace(body, f" {w} ", f" {to} ")
    docs = texts(spark, d, "documents").select(F.col("doc_id").alias("profile_id"),
                                               body.alias("text"))
    return docs.select("profile_id", P.degree(F.col("text")).alias("degree"),
                       P.major(F.col("text")).alias("major"),
                       F.lower(joined(P.experience_titles(F.col("text")))).alias("titles"))


@query("profile_summary", f"""
WITH src0 AS (SELECT doc_id AS profile_id, {with_headers_sql("text")} AS text FROM documents),
{LEX_CTE.replace("SELECT doc_id, lower(text) AS body FROM documents", "SELECT profile_id AS doc_id, lower(text) AS body FROM src0")},
{sections_cte("sec", "src0", "profile_id", "text")},
part AS (SELECT profile_id, any_value(text) FILTER (section = '_preamble') AS pre,
  any_value(text) FILTER (section = 'education') AS edu, any_value(text) FILTER (section = 'experience') AS exp,
  any_value(text) FILTER (section = 'coursework') AS cw FROM sec GROUP BY profile_id),
src AS (SELECT profile_id, coalesce(pre, '') AS pre, coalesce(cw, '') AS cw, coalesce(nullif(edu, ''), text) AS edu,
  coalesce(nullif(exp, ''), text) AS exp FROM src0 LEFT JOIN part USING (profile_id)),
facts AS (SELECT profile_id, coalesce(list_filter([trim(x, E' \\t\\r') FOR x IN string_split(pre, {NL})], lambda x: NOT contains(x, '@')
    AND NOT regexp_matches(x, '\\p{{Nd}}') AND regexp_full_match(x, '\\p{{Lu}}\\S*(?:\\s+\\p{{Lu}}\\S*){{1,3}}'))[1], '') AS name,
  upper(replace(regexp_extract(edu, '{V.DEGREE.replace("'", "''")}', 1), '.', '')) AS degree,
  trim(regexp_replace(regexp_extract(edu, '{_MAJOR}', 1), '\\s+', ' ', 'g')) AS major,
  [array_to_string([upper(w[1]) || lower(substr(w, 2)) FOR w IN string_split(regexp_replace(t, '\\s+', ' ', 'g'), ' ')], ' ')
    FOR t IN regexp_extract_all(exp, '{_TITLES}')] AS ts FROM src),
titled AS (SELECT profile_id, string_agg(t, ', ' ORDER BY i) AS titles FROM (SELECT profile_id, t, min(i) AS i FROM (
  SELECT profile_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM facts) GROUP BY ALL) GROUP BY profile_id),
found AS (SELECT doc_id AS profile_id, term, is_tool, {present_sql("term", "lower(cw)")} AS in_cw
  FROM known JOIN lex USING (term) JOIN src ON profile_id = doc_id),
lists AS (SELECT profile_id, string_agg(term, '|' ORDER BY term) AS skills,
  string_agg(term, '|' ORDER BY term) FILTER (is_tool) AS tools, string_agg(term, ', ' ORDER BY term) FILTER (is_tool) AS tools_said,
  string_agg(term, ', ' ORDER BY term) FILTER (NOT is_tool) AS others,
  string_agg(term, ', ' ORDER BY -length(term), term) FILTER (in_cw) AS course FROM found GROUP BY profile_id)
SELECT profile_id, name, degree, major, coalesce(skills, '') AS skills, coalesce(tools, '') AS tools_languages,
  concat_ws(' ', CASE WHEN degree <> '' OR major <> '' THEN 'Candidate pursuing '
      || concat_ws(' ', nullif(degree, ''), nullif(major, '')) || '.' END,
    'Tools/languages: ' || tools_said || '.', 'Skills/concepts: ' || others || '.', 'Coursework: ' || course || '.',
    'Prior roles: ' || titles || '.') AS summary
FROM facts LEFT JOIN lists USING (profile_id) LEFT JOIN titled USING (profile_id)""")
def profile_summary(spark, d):
    """Whole parse of every document as a profile, with its summary text."""
    docs = texts(spark, d, "documents").select(F.col("doc_id").alias("profile_id"),
                                               with_headers(F.col("text")).alias("text"))
    return P.parse_profiles(docs, bench_lexicon(spark, d)).select(
        "profile_id", "name", "degree", "major", joined("skills").alias("skills"),
        joined("tools_languages").alias("tools_languages"), "summary")


@query("profile_files", f"""
WITH src AS (SELECT item_id AS profile_id, coalesce(text, '') || {NL} AS text FROM benchmark)
SELECT profile_id, md5(text) AS text_md5,
  upper(replace(regexp_extract(text, '{V.DEGREE.replace("'", "''")}', 1), '.', '')) AS degree FROM src""")
def profile_files(spark, d):
    """Benchmark items written as one file each, then read as profile files are."""
    path = f"{shared_dir(spark)}/profiles-{uuid.uuid4()}"
    items = texts(spark, d, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("value"))
    items.write.partitionBy("item_id").text(path)
    rows = read_profiles(spark, path)
    return rows.select(F.regexp_extract("file", r"item_id=(\d+)", 1).cast("bigint").alias("profile_id"),
                       F.md5("text").alias("text_md5"), P.degree(F.col("text")).alias("degree"))
