"""Queries on sources. Payloads are derived row by row from the given tables: every
document is a board record, every page carries a JSON-LD block, and so on."""

import uuid

from pyspark.sql import functions as F

from rolecast import values as V
from rolecast.catalog.base import AS_OF, NL, joined, query, table, texts
from rolecast.functions.roles import is_closed_row
from rolecast.operators.common import shared_dir
from rolecast.sources import boards as B, companies as C, jsonld as J, search as S, tables as M
from rolecast.sources.union import union_softly, union_sources, with_source_head

# Titles of the derived postings: two of five carry a role signal.
TITLE = ("concat(' ', lang, CASE doc_id % 5 WHEN 0 THEN ' Intern ' WHEN 1 THEN ' Co-op' "
         "WHEN 2 THEN ' internal audit' ELSE ' engineer' END, ' ', source)")
POSTED = f"date_add(DATE '{AS_OF}', -(n_chars % 300)::INT)"


def docs(spark, d):
    day = F.date_add(F.lit(AS_OF).cast("date"), -(F.col("n_chars") % 300).cast("int"))
    return texts(spark, d, "documents").withColumn("title", F.expr(TITLE)).withColumn("day", day)


def parsed(df, body, schema):
    """Parses derived JSON texts as a landed file would be."""
    return df.select(F.from_json(F.to_json(body), schema).alias("r")).select("r.*")


def shown(listings, *more):
    """The checked columns of normalised postings."""
    return listings.select(
        "company", "title", "location", "apply_url", "source", "level", "work_mode",
        F.md5("description_text").alias("text_md5"), F.col("posted_date").cast("string"),
        "date_confidence", "date_source", *more)


DOCS = f"""docs AS (SELECT *, {TITLE} AS raw_title, trim({TITLE}) AS title,
  DATE '{AS_OF}' - (n_chars % 300)::INT AS day FROM documents)"""
STRIPPED = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


def role_sql(title, body):
    return (f"CASE WHEN regexp_matches({title}, '(?i)\\binternal\\b') THEN "
            f"regexp_matches({body}, '{V.ROLE_SIGNAL}') ELSE regexp_matches({title} || chr(10) || "
            f"{body}, '{V.ROLE_SIGNAL}') END")


def level_sql(title):
    return (f"CASE WHEN contains(lower({title}), 'co-op') THEN 'co-op' "
            f"WHEN contains(lower({title}), 'intern') THEN 'intern' ELSE 'intern' END")


def mode_sql(*fields):
    blob = "lower(concat_ws(' ', " + ", ".join(f"nullif({f}, '')" for f in fields) + "))"
    return (f"CASE WHEN regexp_matches({blob}, '{V.REMOTE_STRONG}') THEN 'remote' "
            f"WHEN contains({blob}, 'hybrid') THEN 'hybrid' "
            f"WHEN regexp_matches({blob}, '{V.ONSITE}') THEN 'onsite' "
            f"WHEN regexp_matches({blob}, '{V.REMOTE_WEAK}') THEN 'remote' ELSE 'unknown' END")


_PLACE = "CASE doc_id % 3 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Hybrid, ' || lang ELSE NULL END"


def place():
    return (F.when(F.col("doc_id") % 3 == 0, "Remote")
            .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Hybrid, "), "lang")))


_UNTAGGED = "regexp_replace(text, '[<>&]', ' ', 'g')"


@query("board_nested", f"""
WITH {DOCS}, b AS (SELECT *, {_PLACE} AS place, regexp_replace(regexp_replace(
    replace({_UNTAGGED}, chr(10), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'),
    '^\\s+|\\s+$', '', 'g') AS body FROM docs)
SELECT CASE WHEN length(source) > 4 THEN 'Board & ' || source ELSE upper(source[1]) || substr(source, 2) END
    AS company, title, coalesce(place, '') AS location, 'https://b/' || doc_id AS apply_url,
  'greenhouse:' || source AS source, {level_sql("title")} AS level,
  {mode_sql("place", "body")} AS work_mode, md5(body) AS text_md5, day::VARCHAR AS posted_date,
  'verified' AS date_confidence, 'greenhouse updated_at' AS date_source, doc_id AS id
FROM b WHERE {role_sql("title", "body")}""")
def board_nested(spark, d):
    clean = F.regexp_replace("text", "[<>&]", " ")
    job = F.struct(
        F.col("doc_id").alias("id"), "title",
        F.concat(F.lit("&lt;p&gt;"), clean, F.lit("</p>")).alias("content"),
        F.struct(place().alias("name")).alias("location"),
        F.concat(F.lit("https://b/"), "doc_id").alias("absolute_url"),
        F.concat(F.col("day").cast("string"), F.lit("T08:30:00-04:00")).alias("updated_at"))
    rows = docs(spark, d)
    payload = F.struct(F.col("source").alias("slug"), F.array(job).alias("jobs"))
    # Longer source names have a stated name, the others go by their slug.
    meta = rows.select(F.col("source").alias("slug"), F.when(
        F.length("source") > 4, F.concat(F.lit("Board & "), "source")).otherwise("").alias("name"))
    out = B.nested_board(parsed(rows, payload, B.NESTED_SCHEMA), meta)
    return shown(out, F.expr("try_variant_get(raw, '$.id', 'bigint')").alias("id"))


@query("board_epoch", f"""
WITH {DOCS}, b AS (SELECT *, coalesce({_PLACE}, '') AS place, CASE doc_id % 4 WHEN 0 THEN 'Internship'
  WHEN 1 THEN 'Full-time' ELSE '' END AS com FROM docs)
SELECT upper(source[1]) || substr(source, 2) AS company, title, place AS location,
  CASE WHEN doc_id % 2 = 0 THEN 'https://h/' ELSE 'https://a/' END || doc_id AS apply_url,
  'lever:' || source AS source, {level_sql("title || ' ' || com")} AS level,
  CASE doc_id % 7 WHEN 0 THEN 'onsite' WHEN 1 THEN 'unknown' ELSE {mode_sql("place", "text", "com")} END
    AS work_mode, md5(text) AS text_md5, day::VARCHAR AS posted_date, 'verified' AS date_confidence,
  'lever createdAt' AS date_source
FROM b WHERE {role_sql("title || ' ' || com", "text")}""")
def board_epoch(spark, d):
    n = F.col("doc_id")
    record = F.struct(
        F.col("source").alias("slug"), n.cast("string").alias("id"), F.col("title").alias("text"),
        F.col("text").alias("descriptionPlain"),
        F.struct(F.when(n % 4 == 0, "Internship").when(n % 4 == 1, "Full-time").alias("commitment"),
                 place().alias("location"), F.col("lang").alias("team")).alias("categories"),
        F.when(n % 7 == 0, "OnSite").when(n % 7 == 1, "moon").alias("workplaceType"),
        F.when(n % 2 == 0, F.concat(F.lit("https://h/"), n)).alias("hostedUrl"),
        F.concat(F.lit("https://a/"), n).alias("applyUrl"),
        F.unix_millis(F.col("day").cast("timestamp")).alias("createdAt"))
    return shown(B.epoch_board(parsed(docs(spark, d), record, B.EPOCH_SCHEMA)))


@query("board_listed", f"""
WITH {DOCS}, b AS (SELECT *, coalesce({_PLACE}, '') AS place, doc_id % 7 = 0 AS typed FROM docs
  WHERE doc_id % 6 <> 0)
SELECT upper(source[1]) || substr(source, 2) AS company, title, place AS location,
  'https://j/' || doc_id AS apply_url, 'ashby:' || source AS source,
  CASE WHEN typed THEN 'intern' ELSE {level_sql("title")} END AS level,
  CASE WHEN doc_id % 5 = 1 THEN 'remote' ELSE {mode_sql("place", "text")} END AS work_mode,
  md5(text) AS text_md5, day::VARCHAR AS posted_date, 'verified' AS date_confidence,
  'ashby publishedAt' AS date_source FROM b WHERE typed OR {role_sql("title", "text")}""")
def board_listed(spark, d):
    n = F.col("doc_id")
    job = F.struct(
        n.cast("string").alias("id"), "title",
        F.when(n % 7 == 0, "Intern").otherwise("FullTime").alias("employmentType"),
        F.when(n % 6 == 0, False).when(n % 6 == 1, True).alias("isListed"),
        (n % 5 == 1).alias("isRemote"), place().alias("location"), F.col("lang").alias("department"),
        F.col("text").alias("descriptionPlain"),
        F.concat(F.lit("https://j/"), n).alias("jobUrl"),
        F.concat(F.date_format("day", "MMMM d, yyyy")).alias("publishedAt"))
    payload = F.struct(F.col("source").alias("slug"), F.array(job).alias("jobs"))
    return shown(B.listed_board(parsed(docs(spark, d), payload, B.LISTED_SCHEMA)))


@query("user_export", f"""
WITH {DOCS}
SELECT lang AS company, title, '' AS location, 'https://w/' || doc_id AS apply_url,
  'wellfound:export' AS source, {level_sql("title")} AS level, {mode_sql("text")} AS work_mode,
  md5(text) AS text_md5, day::VARCHAR AS posted_date, 'approximate' AS date_confidence,
  'wellfound export' AS date_source, true AS is_startup, 'tag ' || lang AS company_description
FROM docs WHERE doc_id % 9 <> 0 AND {role_sql("title", "text")}""")
def user_export(spark, d):
    n = F.col("doc_id")
    item = F.struct(
        F.col("lang").alias("company"), F.when(n % 9 == 0, "  ").otherwise(F.col("title")).alias("title"),
        F.concat(F.lit("https://w/"), n).alias("url"), F.date_format("day", "MM/dd/yyyy").alias("posted_date"),
        F.col("text").alias("description"), F.concat(F.lit("tag "), "lang").alias("tagline"))
    out = B.user_export(parsed(docs(spark, d), item, B.EXPORT_SCHEMA))
    return shown(out, "is_startup", "company_description")


def ld_pages(spark, d):
    """Pages with a JSON-LD block before their own HTML: an object, a list, a graph,
    a typed list, or broken JSON."""
    n = F.col("page_id")
    role = F.concat(F.when(n % 3 == 0, "Data Intern ").when(n % 3 == 1, "Engineer ").otherwise("Co-op "), n)
    until = F.date_add(F.lit(AS_OF).cast("date"), (n % 41 - 20).cast("int")).cast("string")
    fields = [role.alias("title"), F.lit("1998-06-01").alias("datePosted"), until.alias("validThrough"),
              F.when(n % 5 == 1, "FULL_TIME, INTERN").alias("employmentType"),
              F.struct(F.concat(F.lit("Org "), n).alias("name")).alias("hiringOrganization"),
              F.struct(F.struct(F.lit("Austin").alias("addressLocality"),
                                F.lit("TX").alias("addressRegion")).alias("address")).alias("jobLocation"),
              F.concat(F.lit("<p>About "), n, F.lit("</p>")).alias("description")]
    plain = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), *fields))
    typed = F.to_json(F.struct(F.array(F.lit("Thing"), F.lit("JobPosting")).alias("@type"), *fields))
    block = (F.when(n % 5 == 0, plain).when(n % 5 == 1, F.concat(F.lit("["), plain, F.lit("]")))
             .when(n % 5 == 2, F.concat(F.lit('{"@graph": ['), typed, F.lit("]}")))
             .when(n % 5 == 3, F.concat(F.lit("{bad "), plain))
             .otherwise(F.concat(F.lit("[["), plain, F.lit("], "), plain, F.lit("]"))))
    html = F.concat(F.lit('<script type="application/ld+json">'), block, F.lit("</script>"), "html")
    return texts(spark, d, "pages").select("page_id", "url", html.alias("html"))


LD = f"""ld AS (SELECT *, page_id % 5 AS f, CASE page_id % 3 WHEN 0 THEN 'Data Intern '
  WHEN 1 THEN 'Engineer ' ELSE 'Co-op ' END || page_id AS title,
  DATE '{AS_OF}' + (page_id % 41 - 20)::INT AS until FROM pages),
kept AS (SELECT * FROM ld WHERE f <> 3 AND (page_id % 3 <> 1 OR f = 1))"""


@query("page_postings", f"""
WITH {LD}, twice AS (SELECT * FROM kept UNION ALL SELECT * FROM kept WHERE f = 4)
SELECT 'Org ' || page_id AS company, title, 'Austin, TX' AS location, url AS apply_url,
  'schemaorg' AS source, CASE WHEN page_id % 3 = 2 THEN 'co-op' ELSE 'intern' END AS level,
  'unknown' AS work_mode, md5('About ' || page_id) AS text_md5, '1998-06-01' AS posted_date,
  'verified' AS date_confidence, 'schema.org datePosted' AS date_source,
  until::VARCHAR AS deadline FROM twice""")
def page_postings(spark, d):
    return shown(J.page_postings(ld_pages(spark, d)), F.col("deadline").cast("string"))


@query("open_flag", f"""
WITH {LD} SELECT ld.page_id, CASE WHEN kept.page_id IS NOT NULL THEN kept.until >= DATE '{AS_OF}' END
  AS is_open FROM ld LEFT JOIN kept USING (page_id)""")
def open_flag(spark, d):
    return ld_pages(spark, d).select("page_id", J.open_flag(F.col("html"), AS_OF).alias("is_open"))


def list_docs(spark, d):
    """Every document as a curated list: each of its lines is a table row."""
    def row(x, i):
        company = (F.when(i % 4 == 1, "↳").when(i % 4 == 2, "")
                   .otherwise(F.concat(F.lit("**[Co "), i, F.lit("](https://co/"), i, F.lit(")**"))))
        note = F.when(i % 5 == 3, "🔒").otherwise(F.concat(
            F.lit('<a href="https://job/'), i, F.lit('"><img src="x.png"></a>')))
        age = F.concat((i % 9).cast("string"), F.lit("d"))
        role = F.regexp_replace(F.regexp_replace(x, r"[|<>\[\]()*`!]", " "), "(?i)closed", "open")
        return F.concat(F.lit("| "), company, F.lit(" | "), role, F.lit(" | Remote<br>NYC | "), note,
                        F.lit(" | "), age, F.lit(" |"))

    rows = F.transform(F.split("text", "\n"), lambda x, i: row(x, i))
    head = "Intro\n| Company | Role | Location | Apply | Age |\n| --- | --- | --- | --- | --- |\n"
    return texts(spark, d, "documents").select("doc_id", F.concat(
        F.lit(head), F.array_join(rows, "\n"), F.lit("\n\n| Name | Value |\n|---|---|\n| a | b |")
    ).alias("text"))


@query("list_postings", f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, {NL})) AS x,
  generate_subscripts(string_split(text, {NL}), 1) - 1 AS i FROM documents),
r AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(x, '[|<>\\[\\]()*`!]', ' ', 'g'),
  '(?i)closed', 'open', 'g'), '\\s+', ' ', 'g')) AS role FROM l WHERE i % 5 <> 3),
c AS (SELECT *, last_value(CASE WHEN i % 4 IN (0, 3) THEN i END IGNORE NULLS)
  OVER (PARTITION BY doc_id ORDER BY i) AS co FROM r)
SELECT doc_id, i + 3 AS line_no, 'Co ' || co AS company, md5(role) AS title_md5,
  'Remote; NYC' AS location, 'https://job/' || i AS apply_url, 'github:' || doc_id AS source,
  'remote' AS work_mode, (DATE '{AS_OF}' - (i % 9)::INT)::VARCHAR AS posted_date,
  'approximate' AS date_confidence, 'curated list age' AS date_source
FROM c WHERE role <> '' AND co IS NOT NULL""")
def list_postings(spark, d):
    out = M.list_postings(list_docs(spark, d), AS_OF)
    return out.select("doc_id", F.col("line_no").cast("bigint"), "company",
                      F.md5("title").alias("title_md5"), "location", "apply_url", "source",
                      "work_mode", F.col("posted_date").cast("string"), "date_confidence", "date_source")


@query("closed_rows", f"""
SELECT doc_id, regexp_matches(text || ' ' || source || CASE WHEN doc_id % 7 = 1 THEN ' Closed'
  WHEN doc_id % 7 = 2 THEN '❌' ELSE '' END, '(?i)\\bclosed\\b|🔒|❌|🚫') AS is_closed FROM documents""")
def closed_rows(spark, d):
    n = F.col("doc_id")
    cells = F.array("text", F.concat("source", F.when(n % 7 == 1, " Closed").when(n % 7 == 2, "❌")
                                     .otherwise("")))
    return texts(spark, d, "documents").select("doc_id", is_closed_row(cells).alias("is_closed"))


def suppliers(spark, d):
    """Suppliers as a company dataset; each is listed by two selector files."""
    n = F.col("s_suppkey")
    sup = table(spark, d, "supplier").join(
        table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return sup.select(
        F.when(n % 10 > 0, n.cast("string")).otherwise("").alias("id"),
        F.concat(F.lit("src"), n % 25).alias("slug"),
        F.concat("s_name", F.when(n % 3 == 0, " Labs").when(n % 3 == 1, " Inc.").otherwise(""))
        .alias("name"),
        F.concat(F.lit("https://www.src"), n % 30, F.lit(".co/careers")).alias("website"),
        F.lit("").alias("url"),
        F.when(n % 8 == 0, "Inactive").otherwise("Active").alias("status"),
        F.when(n % 6 == 0, False).when(n % 6 < 5, True).alias("isHiring"),
        F.when(n % 7 > 0, F.floor(F.col("s_acctbal") / 100).cast("string")).alias("team_size"),
        F.when(n % 5 > 0, F.concat(F.lit("Winter "), 2016 + n % 9)).alias("batch"),
        F.col("n_name").alias("one_liner"), F.lit("").alias("long_description"),
        F.explode(F.sequence(F.lit(0), F.lit(1))).alias("selector_pos")
    ).withColumn("one_liner", F.concat_ws(" ", "one_liner", "selector_pos"))


def companies(spark, d):
    return C.distinct_companies(suppliers(spark, d))


COMPANIES = """sup AS (SELECT s_suppkey AS n, 'src' || (s_suppkey % 25) AS slug,
  s_name || CASE s_suppkey % 3 WHEN 0 THEN ' Labs' WHEN 1 THEN ' Inc.' ELSE '' END AS name,
  'src' || (s_suppkey % 30) AS site, s_suppkey % 8 <> 0 AS active, s_suppkey % 6 NOT IN (0, 5) AS hiring,
  CASE WHEN s_suppkey % 7 > 0 THEN floor(s_acctbal / 100)::INT END AS team,
  CASE WHEN s_suppkey % 5 > 0 THEN (2016 + s_suppkey % 9)::INT END AS year,
  n_name || ' 0' AS one_liner, CASE WHEN s_suppkey % 10 > 0 THEN s_suppkey::VARCHAR
    ELSE 'src' || (s_suppkey % 25) END AS company_key
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
comp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_key ORDER BY name, slug) AS r
  FROM sup) WHERE r = 1)"""


@query("distinct_companies", f"WITH {COMPANIES} SELECT company_key, name, slug, one_liner FROM comp")
def distinct_companies(spark, d):
    return companies(spark, d).select("company_key", "name", "slug", "one_liner")


@query("company_files", """
WITH sup AS (SELECT s_suppkey // 40 AS selector_pos, -s_suppkey AS file_pos, 'src' || (s_suppkey % 25) AS slug, s_name AS name FROM supplier
  UNION ALL SELECT 1 + s_suppkey // 40, -s_suppkey, 'src' || (s_suppkey % 25), s_name || ' again' FROM supplier)
SELECT slug AS company_key, name, selector_pos FROM (SELECT *, row_number() OVER (PARTITION BY slug
  ORDER BY selector_pos, file_pos, name) AS r FROM sup) WHERE r = 1""")
def company_files(spark, d):
    """Suppliers in selector files of forty, the last ones first: the first of a file wins, not the first by name."""
    n = F.col("s_suppkey")
    sup = table(spark, d, "supplier").select(
        n, F.explode(F.array(F.lit(""), F.lit(" again"))).alias("more"), "s_name")
    rows = sup.select(
        (F.floor(n / 40) + F.when(F.col("more") == "", 0).otherwise(1)).alias("selector_pos"), F.struct(
            (-n).alias("at"), F.concat("s_name", "more").alias("name"), F.lit("").alias("id"),
            F.concat(F.lit("src"), n % 25).alias("slug")).alias("c"))
    files = rows.groupBy("selector_pos").agg(F.to_json(F.sort_array(F.collect_list("c"))).alias("body"))
    found = C.distinct_companies(C.company_rows(files, "id string, slug string, name string"))
    return found.select("company_key", "name", F.col("selector_pos").cast("bigint"))


FILTERED = "active AND hiring AND coalesce(team <= 50, true) AND coalesce(year >= 2020, true)"


@query("filter_companies", f"WITH {COMPANIES} SELECT company_key FROM comp WHERE {FILTERED}")
def filter_companies(spark, d):
    return C.filter_companies(companies(spark, d)).select("company_key")


@query("company_rank", f"""
WITH {COMPANIES} SELECT company_key, row_number() OVER (ORDER BY
  NOT coalesce(team <= 50, false), NOT coalesce(year >= 2020, false), -coalesce(year, 0),
  coalesce(team, 1000000), lower(name), company_key) AS company_rank
FROM comp WHERE {FILTERED} ORDER BY company_rank LIMIT 40""")
def company_rank(spark, d):
    """The 40 companies worth probing; the cap is the feature."""
    out = C.rank_companies(C.filter_companies(companies(spark, d)), V.MAX_COMPANIES)
    return out.select("company_key", F.col("company_rank").cast("bigint"))


@query("company_rank_all", f"""
WITH {COMPANIES} SELECT company_key, row_number() OVER (ORDER BY
  NOT coalesce(team <= 50, false), NOT coalesce(year >= 2020, false), -coalesce(year, 0),
  coalesce(team, 1000000), lower(name), company_key) AS company_rank
FROM comp WHERE {FILTERED}""")
def company_rank_all(spark, d):
    out = C.rank_companies(C.filter_companies(companies(spark, d)))
    return out.select("company_key", F.col("company_rank").cast("bigint"))


@query("slug_candidates", """
WITH s AS (SELECT s_suppkey, 'src' || (s_suppkey % 25) AS own,
  s_name || CASE s_suppkey % 3 WHEN 0 THEN ' Labs' WHEN 1 THEN ' Inc.' ELSE '' END AS name,
  'src' || (s_suppkey % 30) AS site FROM supplier),
b AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS bare,
  trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS hyphen FROM s),
t AS (SELECT s_suppkey, unnest([own, bare, hyphen, regexp_replace(bare,
  '(inc|llc|corp|labs|technologies|technology|systems)$', ''), site]) AS slug,
  unnest([1, 2, 3, 4, 5]) AS p FROM b)
SELECT s_suppkey, string_agg(slug, '|' ORDER BY p) AS slugs
FROM (SELECT s_suppkey, slug, min(p) AS p FROM t GROUP BY ALL) GROUP BY s_suppkey""")
def slug_candidates(spark, d):
    n = F.col("s_suppkey")
    name = F.concat("s_name", F.when(n % 3 == 0, " Labs").when(n % 3 == 1, " Inc.").otherwise(""))
    site = F.concat(F.lit("https://www.src"), n % 30, F.lit(".co/careers"))
    return table(spark, d, "supplier").select("s_suppkey", joined(C.slug_candidates(
        F.concat(F.lit("src"), n % 25), name, site)).alias("slugs"))


def board_rows(spark, d):
    """Every document on the boards of two families, in the second one ten slugs on."""
    rows = docs(spark, d)
    later = F.concat(F.lit("src"), F.regexp_replace("source", "src", "").cast("int") + 10)

    def board(slug):
        job = F.struct(F.col("doc_id").alias("id"), F.lit("Data Intern").alias("title"),
                       F.col("text").alias("content"), F.struct(F.col("lang").alias("name")).alias("location"),
                       F.concat(F.lit("https://b/"), "doc_id").alias("absolute_url"),
                       F.col("day").cast("string").alias("updated_at"))
        return B.nested_board(parsed(rows, F.struct(slug.alias("slug"), F.array(job).alias("jobs")),
                                     B.NESTED_SCHEMA))

    return {"greenhouse": board(F.col("source")), "lever": board(later)}


@query("company_postings", f"""
WITH {COMPANIES}, cand AS (SELECT company_key, name, one_liner, team, year,
    unnest([slug, site]) AS s, unnest([1, 5]) AS p FROM comp),
src AS (SELECT source AS slug, doc_id, 'greenhouse' AS fam, 0 AS fp FROM documents
  UNION ALL SELECT 'src' || (replace(source, 'src', '')::INT + 10), doc_id, 'lever', 1 FROM documents),
place AS (SELECT DISTINCT slug AS source, fam, fp FROM src),
pick AS (SELECT * FROM (SELECT c.*, source, fam, row_number() OVER (PARTITION BY company_key
  ORDER BY p, fp) AS r FROM cand c JOIN place ON source = s) WHERE r = 1)
SELECT company_key, name AS company, 'yc:' || pick.fam || ':' || pick.source AS source,
  'https://b/' || doc_id AS apply_url, one_liner AS company_description,
  concat_ws(' · ', 'YC Winter ' || year, CASE WHEN team <> 0 THEN team || '-person team' END)
    AS funding_stage
FROM pick JOIN src ON src.slug = pick.source AND src.fam = pick.fam""")
def company_postings(spark, d):
    out = C.company_postings(companies(spark, d), board_rows(spark, d))
    return out.select("company_key", "company", "source", "apply_url", "company_description",
                      "funding_stage")


def profile_pages(spark, d):
    """Pages that carry a company payload with two jobs, one of them incomplete."""
    n = F.col("page_id")
    job = lambda title, done: F.struct(
        n.cast("string").alias("id"), title.alias("title"),
        F.concat(F.lit("/jobs/"), n).alias("url"), F.lit("Remote").alias("location"),
        F.lit("Internship").alias("type"), F.array(F.lit("Python"), F.lit("")).alias("skills"),
        F.concat(F.lit("about "), n % 9 + 2, F.lit(" days")).alias("createdAt"),
        F.lit(not done).alias("isIncomplete"))
    body = F.to_json(F.struct(F.struct(
        F.struct(F.concat(F.lit("Acme "), n).alias("name"), F.lit("W26").alias("batch"),
                 F.lit("9").alias("team_size"), F.lit("R&D \"tools\"").alias("one_liner")).alias("company"),
        F.array(job(F.concat(F.lit(" Intern "), n), True),
                job(F.lit("Draft Intern"), False)).alias("jobPostings")).alias("props")))
    escaped = F.replace(F.replace(body, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    page = texts(spark, d, "pages").select(
        n, "url", F.concat(F.lit('<div data-page="'), escaped, F.lit('"></div>'), "html").alias("html"))
    comp = texts(spark, d, "pages").select(
        n.cast("string").alias("company_key"), n.cast("string").alias("id"),
        F.concat(F.lit("c"), n).alias("slug"), F.lit("").alias("name"), "url",
        F.lit("").alias("batch"), F.lit("").alias("one_liner"), F.lit("").alias("long_description"),
        F.lit("").alias("team_size"))
    return comp, page


@query("profile_jobs", f"""
SELECT page_id::VARCHAR AS company_key, 'Acme ' || page_id AS company, 'Intern ' || page_id AS title,
  'https://www.ycombinator.com/jobs/' || page_id AS apply_url, 'yc:profile:c' || page_id AS source,
  'R&D "tools"' AS company_description, 'YC W26 · 9-person team' AS funding_stage,
  'Intern ' || page_id || ' Internship R&D "tools" Python' AS description_text, 'Python' AS requirements,
  'remote' AS work_mode, (DATE '{AS_OF}' - (page_id % 9 + 2)::INT)::VARCHAR AS posted_date,
  'approximate' AS date_confidence, 'YC job created about ' || (page_id % 9 + 2) || ' days' AS date_source
FROM pages""")
def profile_jobs(spark, d):
    rows, _ = C.profile_jobs(*profile_pages(spark, d), AS_OF)
    return rows.select("company_key", "company", "title", "apply_url", "source", "company_description",
                       "funding_stage", "description_text", joined("requirements").alias("requirements"),
                       "work_mode", F.col("posted_date").cast("string"), "date_confidence", "date_source")


def search_pages(spark, d):
    """Every document is a result page with one hit; its source is the query."""
    n = F.col("doc_id")
    hit = F.struct(
        F.col("title").alias("title"), F.col("lang").alias("company_name"),
        F.when(n % 2 == 0, "Austin").alias("location"), F.col("text").alias("description"),
        F.concat(F.lit("https://share/"), n).alias("share_link"),
        F.struct(F.when(n % 3 > 0, F.concat(n % 20, F.lit(" days ago"))).alias("posted_at"))
        .alias("detected_extensions"),
        F.when(n % 4 == 0, F.array(F.struct(F.lit("").alias("link")),
                                   F.struct(F.concat(F.lit("https://apply/"), n).alias("link"))))
        .alias("apply_options"))
    page = F.struct(
        F.regexp_replace("source", "src", "").cast("int").alias("query_pos"),
        F.col("source").alias("query"), F.lit("United States").alias("location"),
        (n + 1).cast("int").alias("page"), (n % 6 == 0).alias("startup_query"),
        F.array(hit).alias("jobs_results"))
    return parsed(docs(spark, d), page, S.SEARCH_SCHEMA)


def _search_sql(caps="", order=""):
    return f"""
WITH {DOCS}, hit AS (SELECT *, replace(source, 'src', '')::INT AS qp FROM docs
  WHERE {role_sql("title", "text")}),
nth AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM hit)
SELECT lang AS company, title, CASE WHEN doc_id % 2 = 0 THEN 'Austin' ELSE 'United States' END AS location,
  CASE WHEN doc_id % 4 = 0 THEN 'https://apply/' ELSE 'https://share/' END || doc_id AS apply_url,
  'serpapi:' || CASE WHEN doc_id % 6 = 0 THEN 'startup:' ELSE '' END || 'google_jobs' AS source,
  CASE WHEN doc_id % 6 = 0 THEN true END AS is_startup,
  CASE WHEN doc_id % 3 > 0 THEN (DATE '{AS_OF}' - (doc_id % 20)::INT)::VARCHAR END AS posted_date,
  CASE WHEN doc_id % 3 > 0 THEN 'approximate' ELSE 'unverified' END AS date_confidence,
  CASE WHEN doc_id % 3 > 0 THEN 'google jobs ''' || (doc_id % 20) || ' days ago''' ELSE '' END AS date_source
FROM nth {caps} {order}"""


def _search(spark, d, per_query, total):
    out = S.search_postings(search_pages(spark, d), AS_OF, total, per_query, None)
    return out.select("company", "title", "location", "apply_url", "source", "is_startup",
                      F.col("posted_date").cast("string"), "date_confidence", "date_source")


@query("search_postings", _search_sql())
def search_postings(spark, d):
    return _search(spark, d, None, None)


@query("search_caps", _search_sql("WHERE nth <= 5", "ORDER BY qp, doc_id LIMIT 60"))
def search_caps(spark, d):
    """The caps of a search: five rows per query, sixty in all."""
    return _search(spark, d, 5, 60)


@query("query_grid", f"""
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE replace(p_name, ' ', '/') END AS role,
  p_type, CASE p_partkey % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'on-site' WHEN 2 THEN 'hybrid' ELSE '' END
  AS suffix, CASE WHEN p_partkey % 2 = 0 THEN 'Fall 2026' ELSE '' END AS term FROM part),
f AS (SELECT *, CASE WHEN role = '' THEN p_type ELSE replace(role, '/', ' ') END AS focus FROM p),
q AS (SELECT p_partkey, pos, trim(regexp_replace(concat_ws(' ', focus, phrase, term, suffix),
  ' +', ' ', 'g')) AS query, st FROM f, (SELECT unnest([{", ".join(f"'{p}'" for c in ("general", "board", "startup") for p in V.QUERY_PHRASES[c])}])
  AS phrase, unnest(range({sum(map(len, V.QUERY_PHRASES.values()))})) AS pos,
  unnest(range({sum(map(len, V.QUERY_PHRASES.values()))})) >= {len(V.QUERY_PHRASES["general"] + V.QUERY_PHRASES["board"])} AS st))
SELECT p_partkey AS profile_id, pos AS query_pos, query, st AS startup_query, l.location_pos, l.location
FROM q, (VALUES (0, 'Boston'), (1, 'Remote'), (2, 'Paris')) l(location_pos, location)""")
def query_grid(spark, d):
    n = F.col("p_partkey")
    config = texts(spark, d, "part").select(
        n.alias("profile_id"),
        F.when(n % 3 == 0, "").otherwise(F.regexp_replace("p_name", " ", "/")).alias("target_role"),
        F.array("p_type").alias("priority_keywords"),
        F.when(n % 2 == 0, "Fall 2026").otherwise("").alias("term"),
        F.when(n % 4 == 0, "Remote").when(n % 4 == 1, "onsite").when(n % 4 == 2, "hybrid")
        .otherwise("any").alias("remote_preference"),
        F.array(F.lit(" Boston"), F.lit(""), F.lit("Remote"), F.lit("Paris")).alias("locations"))
    out = S.query_grid(config, startup_breadth=True)
    return out.select("profile_id", F.col("query_pos").cast("bigint"), "query", "startup_query",
                      F.col("location_pos").cast("int"), "location")


@query("union_sources", f"""
WITH {DOCS}, hit AS (SELECT * FROM docs WHERE {role_sql("title", "text")})
SELECT 'search' AS source_label, 'serpapi' AS source_head, count(*) AS n FROM hit
UNION ALL SELECT 'export', 'wellfound', count(*) FROM hit WHERE doc_id % 9 <> 0""")
def union_of_sources(spark, d):
    """Three sources, of which two are asked for."""
    n = F.col("doc_id")
    item = F.struct("lang", F.when(n % 9 == 0, "  ").otherwise(F.col("title")).alias("title"),
                    F.col("text").alias("description"))
    export = B.user_export(parsed(docs(spark, d), item, B.EXPORT_SCHEMA))
    search = S.search_postings(search_pages(spark, d), AS_OF, None, None, None)
    out = union_sources({"search": search, "export": export,
                         "pages": J.page_postings(ld_pages(spark, d))}, allow=["search", "export"])
    return (with_source_head(out).groupBy("source_label", "source_head")
            .agg(F.count("*").alias("n")))


@query("source_status", f"""
WITH {DOCS}, hit AS (SELECT * FROM docs WHERE {role_sql("title", "text")})
SELECT 'search' AS source_label, count(*) AS n, true AS ok FROM hit
UNION ALL SELECT 'missing', -1, false
UNION ALL SELECT 'export', count(*), true FROM hit WHERE doc_id % 9 <> 0
UNION ALL SELECT 'all', (SELECT count(*) FROM hit) + (SELECT count(*) FROM hit WHERE doc_id % 9 <> 0), true""")
def source_status(spark, d):
    """Three sources of which one cannot be read; the last row counts what is left."""
    item = F.struct("lang", F.when(F.col("doc_id") % 9 == 0, "  ").otherwise(F.col("title")).alias("title"),
                    F.col("text").alias("description"))
    rows, status = union_softly({
        "search": lambda: S.search_postings(search_pages(spark, d), AS_OF),
        "missing": lambda: B.user_export(B.split_corrupt(B.read_payloads(spark, f"{d}/no_such_file", B.EXPORT_SCHEMA))[0]),
        "export": lambda: B.user_export(parsed(docs(spark, d), item, B.EXPORT_SCHEMA))})
    status.append(("all", rows.count(), ""))
    return spark.createDataFrame([(s, n, not e) for s, n, e in status], "source_label string, n long, ok boolean")


@query("landed_exports", f"""
WITH {DOCS} SELECT doc_id % 7 = 3 AS corrupt, count(*) AS n,
  count(*) FILTER (doc_id % 7 <> 3 AND {role_sql("title", "text")}) AS postings FROM docs GROUP BY 1""")
def landed_exports(spark, d):
    """Documents landed as JSON lines, one in seven of them broken off, and read as files are."""
    path = f"{shared_dir(spark)}/landed-{uuid.uuid4()}"
    item = F.to_json(F.struct("lang", F.col("title").alias("title"), F.col("text").alias("description")))
    broken = F.substring(item, 1, F.length(item) - 1)
    docs(spark, d).select(F.when(F.col("doc_id") % 7 == 3, broken).otherwise(item).alias("value")).write.text(path)
    good, bad = B.split_corrupt(B.read_payloads(spark, path, B.EXPORT_SCHEMA))
    counted = [(good, False, 0), (bad, True, 0), (B.user_export(good), False, 1)]
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(c).alias("corrupt"), F.col("n") * (1 - p), F.col("n") * p)
            for df, c, p in counted]
    return rows[0].union(rows[1]).union(rows[2]).toDF("corrupt", "n", "postings").groupBy("corrupt").agg(
        F.sum("n").alias("n"), F.sum("postings").alias("postings"))
