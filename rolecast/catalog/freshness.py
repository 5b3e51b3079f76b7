"""Queries on dates, merging, eligibility and liveness."""

from pyspark.sql import functions as F

from rolecast import values as V
from rolecast.catalog.base import (AS_OF, SEEN_AS_OF, key_sql, query, quoted, table, texts)
from rolecast.functions import dates as D
from rolecast.functions.html import html_to_text
from rolecast.functions.roles import detect_work_mode, has_role_signal, infer_level
from rolecast.functions.text import dedup_key
from rolecast.operators import freshness as FR, live as L, report as R
from rolecast.operators.common import forward_fill

HEADS = ["greenhouse", "github", "wellfound", "serpapi", "other"]


def copies(spark, d):
    """Documents as postings from several sources; the whole text is the title."""
    docs, n = texts(spark, d, "documents"), F.col("doc_id")
    head = F.element_at(F.array(*[F.lit(h) for h in HEADS]), (n % 5 + 1).cast("int"))
    day = F.date_add(F.lit(AS_OF).cast("date"), -(F.col("n_chars") % 200).cast("int"))
    return docs.select(
        n.alias("ingest_seq"), F.col("lang").alias("company"), F.col("text").alias("title"),
        F.lit("Remote, CA").alias("location"),
        F.concat_ws(":", head, F.col("source")).alias("source"),
        F.when(n % 3 > 0, day).alias("posted_date"),
        F.when(n % 3 > 0, F.element_at(F.array(F.lit(V.VERIFIED), F.lit(V.APPROXIMATE)),
                                       (n % 2 + 1).cast("int"))).otherwise(V.UNVERIFIED)
        .alias("date_confidence"), F.lit("landed").alias("date_source"),
        F.when(n % 4 == 1, F.date_add(day, 30)).alias("deadline"),
        (n % 8 == 1).alias("deadline_is_rolling"),
        F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("about "), n)).alias("description_text"),
        F.when(n % 6 == 1, F.array(F.lit("r"), n.cast("string")))
        .otherwise(F.array().cast("array<string>")).alias("requirements"),
        F.when(n % 5 == 2, F.concat(F.lit("co "), n)).otherwise("").alias("company_description"),
        F.when(n % 7 == 3, True).when(n % 7 == 4, False).alias("is_startup"))


COPIES = f"""src AS (SELECT doc_id AS seq, lang AS company, text AS title,
  list_extract([{quoted(HEADS)}], (doc_id % 5 + 1)::INT) || ':' || source AS source, source AS s0,
  CASE WHEN doc_id % 3 > 0 THEN DATE '{AS_OF}' - (n_chars % 200)::INT END AS posted_date,
  CASE WHEN doc_id % 3 > 0 THEN list_extract(['verified', 'approximate'], (doc_id % 2 + 1)::INT)
    ELSE 'unverified' END AS conf,
  CASE WHEN doc_id % 4 = 1 THEN DATE '{AS_OF}' - (n_chars % 200)::INT + 30 END AS deadline,
  doc_id % 8 = 1 AS rolling,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'about ' || doc_id END AS body,
  CASE WHEN doc_id % 6 = 1 THEN ['r', doc_id::VARCHAR] ELSE [] END AS reqs,
  CASE WHEN doc_id % 5 = 2 THEN 'co ' || doc_id ELSE '' END AS about,
  CASE WHEN doc_id % 7 = 3 THEN true WHEN doc_id % 7 = 4 THEN false END AS startup,
  {key_sql("lang", "text", "'Remote, CA'")} AS key,
  doc_id % 5 AS h FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY
  CASE conf WHEN 'verified' THEN 0 WHEN 'approximate' THEN 1 ELSE 2 END,
  CASE h WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 5 END,
  -length(body), -len(reqs), seq) AS r FROM src)"""


@query("dedup_key", f"""
SELECT doc_id, md5({key_sql("lang", "text", "source || ' Remote CA'")}) AS key_md5
FROM documents""")
def dedup_keys(spark, d):
    return texts(spark, d, "documents").select("doc_id", F.md5(dedup_key(
        F.col("lang"), F.col("text"), F.concat("source", F.lit(" Remote CA")))).alias("key_md5"))


@query("dedupe_merge", f"""
WITH {COPIES},
p AS (SELECT * FROM ranked WHERE r = 1),
f AS (SELECT key, count(*) AS n_merged,
  min(r) FILTER (deadline IS NOT NULL) AS rd, min(r) FILTER (body <> '') AS rb,
  min(r) FILTER (about <> '') AS ra, min(r) FILTER (startup IS NOT NULL) AS rs
  FROM ranked GROUP BY key)
SELECT md5(p.key) AS key_md5, p.seq AS ingest_seq, p.source, p.posted_date::VARCHAR AS posted_date,
  p.conf AS date_confidence, d.deadline::VARCHAR AS deadline,
  CASE WHEN p.deadline IS NULL AND d.seq IS NOT NULL THEN d.rolling ELSE p.rolling END
    AS deadline_is_rolling,
  coalesce(b.body, p.body) AS description_text,
  array_to_string(CASE WHEN p.body <> '' OR b.seq IS NULL OR len(b.reqs) = 0 THEN p.reqs
    ELSE b.reqs END, '|') AS requirements,
  coalesce(a.about, p.about) AS company_description, s.startup AS is_startup, n_merged
FROM p JOIN f USING (key)
LEFT JOIN ranked d ON d.key = p.key AND d.r = rd LEFT JOIN ranked b ON b.key = p.key AND b.r = rb
LEFT JOIN ranked a ON a.key = p.key AND a.r = ra LEFT JOIN ranked s ON s.key = p.key AND s.r = rs""")
def dedupe_merge(spark, d):
    out = FR.dedupe_merge(FR.with_key(copies(spark, d)))
    return out.select(
        F.md5("key").alias("key_md5"), "ingest_seq", "source",
        F.col("posted_date").cast("string"), "date_confidence", F.col("deadline").cast("string"),
        "deadline_is_rolling", "description_text",
        F.array_join("requirements", "|").alias("requirements"), "company_description",
        "is_startup", "n_merged")


@query("also_seen", f"""
WITH {COPIES} SELECT md5(key) AS key_md5, source, count(*) AS n FROM ranked WHERE r > 1 GROUP BY ALL""")
def also_seen(spark, d):
    rows = FR.with_key(copies(spark, d))
    return FR.also_seen(rows, FR.dedupe_merge(rows)).select(F.md5("key").alias("key_md5"),
                                                            "source", "n")


@query("best_copy", f"""
WITH {COPIES} SELECT md5(key) AS key_md5, seq AS ingest_seq FROM ranked WHERE r = 1""")
def best_copy(spark, d):
    rows = FR.with_key(copies(spark, d))
    best = rows.groupBy("key").agg(F.min_by("ingest_seq", FR.quality()).alias("ingest_seq"))
    return best.select(F.md5("key").alias("key_md5"), "ingest_seq")


def orders(spark, d):
    """Orders as postings, due at their last shipment."""
    due = (table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
           .agg(F.max("l_shipdate").cast("date").alias("deadline")))
    n = F.col("o_orderkey")
    return table(spark, d, "orders").join(due, "o_orderkey", "left").select(
        n.alias("ingest_seq"), "o_custkey",
        F.when(n % 11 > 0, F.col("o_orderdate").cast("date")).alias("posted_date"), "deadline",
        (n % 9 == 0).alias("deadline_is_rolling"),
        F.when(n % 11 == 0, V.UNVERIFIED).when(n % 2 == 0, V.VERIFIED).otherwise(V.APPROXIMATE)
        .alias("date_confidence"),
        F.lit("order book").alias("date_source"),
        (F.col("o_totalprice") % 101).cast("int").alias("match_score"),
        F.lower(F.regexp_replace("o_orderpriority", "^[0-9]-", "")).alias("work_mode"),
        F.when(F.col("o_orderstatus") == "O", V.LIVE).when(F.col("o_orderstatus") == "F", "")
        .otherwise(V.UNKNOWN).alias("live_status"))


ORDERS = f"""ord AS (SELECT o_orderkey AS seq, o_custkey,
  CASE WHEN o_orderkey % 11 > 0 THEN o_orderdate::DATE END AS posted, due AS deadline,
  o_orderkey % 9 = 0 AS rolling,
  CASE WHEN o_orderkey % 11 = 0 THEN 'unverified' WHEN o_orderkey % 2 = 0 THEN 'verified'
    ELSE 'approximate' END AS conf,
  trunc(o_totalprice % 101)::BIGINT AS score,
  lower(regexp_replace(o_orderpriority, '^[0-9]-', '')) AS work_mode,
  CASE o_orderstatus WHEN 'O' THEN 'live' WHEN 'F' THEN '' ELSE 'unknown' END AS live_status
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate)::DATE AS due FROM lineitem
  GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"""


@query("eligibility", f"""
WITH {ORDERS},
m AS (SELECT seq, DATE '{AS_OF}' - posted AS age, deadline - DATE '{AS_OF}' AS dleft, conf, rolling,
  posted, deadline FROM ord),
f AS (SELECT *, posted IS NOT NULL AND conf <> 'unverified' AND age BETWEEN 0 AND 60 AS a,
  posted IS NOT NULL AND conf <> 'unverified' AND age < 0 AS b,
  deadline IS NOT NULL AND NOT rolling AND dleft BETWEEN 0 AND 90 AS c FROM m)
SELECT seq, a OR b OR c OR conf = 'unverified' AS eligible,
  CASE WHEN a AND c THEN 'posted ' || age || 'd ago (≤60d); deadline in ' || dleft || 'd (≤90d)'
  WHEN a THEN 'posted ' || age || 'd ago (≤60d)'
  WHEN b AND c THEN 'posted date in the future (treated as fresh); deadline in ' || dleft || 'd (≤90d)'
  WHEN b THEN 'posted date in the future (treated as fresh)'
  WHEN c THEN 'deadline in ' || dleft || 'd (≤90d)'
  WHEN conf = 'unverified' THEN 'date unverified (included, flagged, sorted below verified)'
  ELSE 'outside recency/deadline windows' END AS eligibility_reason FROM f""")
def eligibility(spark, d):
    return FR.mark_eligibility(orders(spark, d), AS_OF).select(
        F.col("ingest_seq").alias("seq"), "eligible", "eligibility_reason")


@query("eligible_only", f"""
WITH {ORDERS} SELECT seq FROM ord WHERE
  (posted IS NOT NULL AND conf <> 'unverified' AND DATE '{AS_OF}' - posted <= 21)
  OR (deadline IS NOT NULL AND NOT rolling AND deadline - DATE '{AS_OF}' BETWEEN 0 AND 14)""")
def eligible_only(spark, d):
    """Narrow windows, undated rows left out."""
    marked = FR.mark_eligibility(orders(spark, d), AS_OF, 21, 14, include_unverified=False)
    return FR.eligible_only(marked).select(F.col("ingest_seq").alias("seq"))


def seen_events(spark, d):
    """Events as undated postings, first seen at their time."""
    n = F.col("event_id")
    return table(spark, d, "events").select(
        n, F.when(n % 5 == 0, F.date_add(F.col("ts").cast("date"), -3)).alias("posted_date"),
        F.when(n % 3 == 0, V.VERIFIED).when(n % 3 == 1, V.UNVERIFIED).otherwise("")
        .alias("date_confidence"),
        F.when(n % 2 == 0, "landed").otherwise("").alias("date_source"),
        F.when(n % 7 > 0, F.col("ts").cast("timestamp")).alias("first_seen"))


def _resolved_sql(seen):
    return f"""
WITH e AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN ts::DATE - 3 END AS posted,
  event_id % 3 AS m, event_id % 2 = 0 AS landed, {seen} AS seen FROM events)
SELECT event_id, coalesce(posted, seen::DATE)::VARCHAR AS posted_date,
  CASE WHEN posted IS NOT NULL AND m = 0 THEN 'verified'
    WHEN posted IS NOT NULL OR seen IS NOT NULL THEN 'approximate' ELSE 'unverified' END
    AS date_confidence,
  CASE WHEN posted IS NOT NULL THEN CASE WHEN landed THEN 'landed' ELSE '' END
    WHEN seen IS NOT NULL THEN 'cache first-seen (this tool)'
    WHEN landed THEN 'landed' ELSE 'no determinable date' END AS date_source FROM e"""


@query("resolve_dates", _resolved_sql("CASE WHEN event_id % 7 > 0 THEN ts END"))
def resolve_dates(spark, d):
    return FR.resolve_dates(seen_events(spark, d)).select(
        "event_id", F.col("posted_date").cast("string"), "date_confidence", "date_source")


@query("resolve_dates_strict", _resolved_sql(
    "CASE WHEN event_id % 7 > 0 AND ts < TIMESTAMP '2024-01-20' THEN ts END"))
def resolve_dates_strict(spark, d):
    """First seen in the current run does not count as a date."""
    return FR.resolve_dates(seen_events(spark, d), current_run_start="2024-01-20").select(
        "event_id", F.col("posted_date").cast("string"), "date_confidence", "date_source")


@query("recent_first_seen", f"""
SELECT event_id FROM events WHERE event_id % 7 > 0
  AND ts >= TIMESTAMP '{SEEN_AS_OF}' - INTERVAL 10 DAY""")
def recent_first_seen(spark, d):
    return FR.recent_first_seen(seen_events(spark, d), SEEN_AS_OF, 10).select("event_id")


@query("fresh_sources", f"""
WITH meta AS (SELECT source, DATE '{AS_OF}' - (min(doc_id) * 3 % 40)::INT AS last
  FROM documents GROUP BY source)
SELECT doc_id FROM documents JOIN meta USING (source) WHERE DATE '{AS_OF}' - last <= 14""")
def fresh_sources(spark, d):
    docs = texts(spark, d, "documents").select("doc_id", "source")
    meta = docs.groupBy("source").agg(F.concat(F.date_add(
        F.lit(AS_OF).cast("date"), -(F.min("doc_id") * 3 % 40).cast("int")).cast("string"),
        F.lit("T10:00:00Z")).alias("last_commit"))
    return FR.fresh_sources(docs, meta, AS_OF).select("doc_id")


PHRASES = ["thin the", "onth the", "en la", "und der", "de la"]
CRAWL = f"""crawl AS (SELECT page_id, url AS requested,
  list_extract([200, 200, 200, 404, 403, 500, 302, 200, 0, 301], (page_id % 10 + 1)::INT) AS status,
  CASE page_id % 4 WHEN 0 THEN regexp_replace(url, '[^/]*$', '') WHEN 1 THEN 'https://x.org/careers/'
    ELSE url END AS final, page_id % 4 < 2 AS redirected,
  CASE WHEN page_id % 13 = 5 THEN 'timeout' ELSE '' END AS error, html FROM pages)"""
_PATH = "regexp_extract({0}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
_CUT = "regexp_replace(" + _PATH + ", '/+$', '')"
LANDING = f"""paths AS (SELECT *, {_CUT.format("requested")} AS rp, {_CUT.format("final")} AS fp,
  {_PATH.format("final")} AS full_path FROM crawl),
landed AS (SELECT *, rp <> '' AND fp <> rp AND (regexp_matches(CASE WHEN fp = '' THEN '/' ELSE fp END,
  '(?i)^/?({"|".join(V.LANDING_PATHS)})?/?$') OR (fp <> '' AND starts_with(rp, fp || '/')))
  AS is_landing FROM paths)"""


def crawl(spark, d):
    n = F.col("page_id")
    codes = F.array(*[F.lit(c) for c in (200, 200, 200, 404, 403, 500, 302, 200, 0, 301)])
    return texts(spark, d, "pages").select(
        n, F.col("url").alias("requested_url"),
        F.element_at(codes, (n % 10 + 1).cast("int")).alias("status"),
        F.when(n % 4 == 0, F.regexp_replace("url", "[^/]*$", ""))
        .when(n % 4 == 1, "https://x.org/careers/").otherwise(F.col("url")).alias("final_url"),
        (n % 4 < 2).alias("redirected"),
        F.when(n % 13 == 5, "timeout").otherwise("").alias("error"), F.col("html").alias("body"))


@query("landing_test", f"WITH {CRAWL}, {LANDING} SELECT page_id, is_landing FROM landed")
def landing_test(spark, d):
    return crawl(spark, d).select("page_id", L.is_generic_landing(
        F.col("final_url"), F.col("requested_url")).alias("is_landing"))


PHRASE_SQL = "CASE " + " ".join(f"WHEN contains(lower(html), '{p}') THEN '{p}'" for p in PHRASES) + " END"


@query("closure_phrase", f"SELECT page_id, {PHRASE_SQL} AS phrase FROM pages")
def closure_phrase(spark, d):
    return texts(spark, d, "pages").select(
        "page_id", L.closure_phrase(F.col("html"), PHRASES).alias("phrase"))


LIVE = f"""{CRAWL}, {LANDING},
said AS (SELECT *, {PHRASE_SQL} AS phrase FROM landed),
verdict AS (SELECT page_id, requested, CASE
  WHEN status = 404 THEN 'dead#HTTP 404 (removed)'
  WHEN status = 0 OR error <> '' THEN 'unknown#unreachable ('
    || CASE WHEN error <> '' THEN error ELSE 'no response' END || ') — kept, unverified'
  WHEN status IN (403, 500) THEN 'unknown#HTTP ' || status
    || ' (blocked/transient) — kept, could not verify live'
  WHEN phrase IS NOT NULL THEN 'dead#closure signal: ''' || phrase || ''''
  WHEN redirected AND is_landing THEN 'dead#redirected to generic page ('
    || CASE WHEN full_path = '' THEN '/' ELSE full_path END || ')'
  ELSE 'live#verified live' END AS v FROM said)"""


@query("live_classify", f"""
WITH {LIVE} SELECT page_id, split_part(v, '#', 1) AS live_status, split_part(v, '#', 2) AS live_reason
FROM verdict""")
def live_classify(spark, d):
    c = crawl(spark, d)
    v = L.classify_live(F.col("status"), F.col("final_url"), F.col("requested_url"),
                        F.col("body"), F.col("redirected"), F.col("error"),
                        F.lit(None).cast("boolean"), PHRASES)
    return c.select("page_id", v.alias("v")).select("page_id", "v.*")


def linked(spark, d):
    """Documents as postings; a third of them share one page, some have no link."""
    docs = texts(spark, d, "documents")
    pages = table(spark, d, "pages").select("page_id", F.col("url").alias("apply_url"))
    page = F.when(F.col("doc_id") % 3 == 0, 2).when(F.col("doc_id") % 17 == 1, -1).otherwise(
        F.col("doc_id"))
    return docs.select("doc_id", page.alias("page_id")).join(pages, "page_id", "left")


LINKED = """link AS (SELECT doc_id, url FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 2
  WHEN doc_id % 17 = 1 THEN -1 ELSE doc_id END AS p FROM documents)
  LEFT JOIN pages ON page_id = p),
best AS (SELECT requested, min(CASE split_part(v, '#', 1) WHEN 'dead' THEN '0' WHEN 'live' THEN '1'
  ELSE '2' END || '#' || v) AS v FROM verdict GROUP BY requested)"""


@query("live_check", f"""
WITH {LIVE}, {LINKED}
SELECT doc_id, CASE WHEN url IS NULL THEN 'unknown' ELSE split_part(v, '#', 2) END AS live_status,
  CASE WHEN url IS NULL THEN 'no application URL to verify' ELSE split_part(v, '#', 3) END
  AS live_reason FROM link LEFT JOIN best ON requested = url""")
def live_check(spark, d):
    out = L.live_check(linked(spark, d), crawl(spark, d), AS_OF, None, PHRASES)
    return out.select("doc_id", "live_status", "live_reason")


@query("drop_dead", f"""
WITH {LIVE}, {LINKED}
SELECT doc_id FROM link LEFT JOIN best ON requested = url
WHERE url IS NULL OR split_part(v, '#', 2) <> 'dead'""")
def drop_dead(spark, d):
    return L.drop_dead(L.live_check(linked(spark, d), crawl(spark, d), AS_OF, None, PHRASES)).select(
        "doc_id")


_ENTITIES = {"&amp;": "&", "&copy;": "©", "&middot;": "·", "&quot;": '"', "&lt;": "<", "&gt;": ">"}


def _decode_sql(x):
    """All references of the pages are among these; '&amp;' goes last."""
    for ref, sign in [*list(_ENTITIES.items())[1:], ("&amp;", "&")]:
        x = f"replace({x}, '{ref}', '{sign}')"
    return f"regexp_replace({x}, '&amp([^;]|$)', '&\\1', 'g')"


@query("html_text", f"""
WITH a AS (SELECT page_id, {_decode_sql("html")} AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
  '(?is)<script\\b[^>]*>.*?</script\\s*>', chr(1), 'g'),
  '(?is)<style\\b[^>]*>.*?</style\\s*>', chr(1), 'g'), '(?s)<!--.*?-->', chr(1), 'g'),
  '<[A-Za-z/!?](?:[^>"'']+|"[^"]*"|''[^'']*'')*>', chr(1), 'g'), '\\x01+', chr(10), 'g') AS t FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace({_decode_sql("t")}, '\\n{{3,}}',
  chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM b)
SELECT page_id, md5(t) AS text_md5, length(t) AS n_chars FROM c""")
def html_text(spark, d):
    out = texts(spark, d, "pages").select("page_id", html_to_text(F.col("html")).alias("t"))
    return out.select("page_id", F.md5("t").alias("text_md5"),
                      F.length("t").cast("bigint").alias("n_chars"))


# Each order writes its date in one of several forms.
_FORMS = {0: ("yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ"), 1: ("MMM d, yyyy", "%b %-d, %Y"),
          2: ("d MMMM yyyy", "%-d %B %Y"), 3: ("MM/dd/yyyy", "%m/%d/%Y"), 4: ("yyyyMMdd", "%Y%m%d"),
          5: ("MMM d", "%b %-d")}


@query("parse_dates", f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 5
    THEN (CASE WHEN strftime(o_orderdate, '%m%d') = '0229' THEN NULL
      ELSE (substr('{AS_OF}', 1, 4) || strftime(o_orderdate, '-%m-%d')) END)
  WHEN o_orderkey % 8 = 7 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS loose,
  CASE WHEN o_orderkey % 8 <> 5 THEN NULL WHEN strftime(o_orderdate, '%m%d') = '0229' THEN NULL
    WHEN (substr('{AS_OF}', 1, 4) || strftime(o_orderdate, '-%m-%d'))::DATE > DATE '{AS_OF}' + 7
    THEN '1997' || strftime(o_orderdate, '-%m-%d')
    ELSE '1998' || strftime(o_orderdate, '-%m-%d') END AS no_year
FROM orders""")
def parse_dates(spark, d):
    day, form = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 8
    written = F.when(form == 6, F.unix_millis(day).cast("string")).when(form == 7, "soon")
    for k, (pattern, _) in _FORMS.items():
        written = written.when(form == k, F.date_format(day, pattern))
    rows = table(spark, d, "orders").select("o_orderkey", form.alias("form"), written.alias("w"))
    return rows.select(
        "o_orderkey", D.parse_date_loose(F.col("w"), AS_OF).cast("string").alias("loose"),
        F.when(F.col("form") == 5, D.parse_explicit_date(F.col("w"), AS_OF)).cast("string")
        .alias("no_year"))


@query("relative_dates", f"""
WITH a AS (SELECT o_orderkey AS k, o_orderkey % 40 AS n, o_orderkey % 4 AS u FROM orders),
b AS (SELECT k, n, u, list_extract([0, 1, 7, 30], u::INT + 1) AS rel,
  list_extract([365, 1, 7, 30], u::INT + 1) AS age FROM a)
SELECT k, (DATE '{AS_OF}' - (n * rel)::INT)::VARCHAR AS relative,
  lower('Posted ' || n || '+ ' || list_extract(['hours', 'day', 'weeks', 'months'], u::INT + 1) || ' ago')
    AS phrase,
  (DATE '{AS_OF}' - ((CASE WHEN n < 2 THEN 1 ELSE n END) * age)::INT)::VARCHAR AS loose,
  (DATE '{AS_OF}' - (n * rel)::INT)::VARCHAR AS compact FROM b""")
def relative_dates(spark, d):
    k = F.col("o_orderkey")
    n, u = k % 40, (k % 4 + 1).cast("int")
    pick = lambda *w: F.element_at(F.array(*[F.lit(x) for x in w]), u)
    rows = table(spark, d, "orders").select(
        k.alias("k"),
        F.concat(F.lit("New! Posted "), n, F.lit("+ "), pick("hours", "day", "weeks", "months"),
                 F.lit(" ago.")).alias("rel"),
        F.concat(F.lit("about "), F.when(n == 0, "a").when(n == 1, "an").otherwise(n.cast("string")),
                 F.lit(" "), pick("year", "days", "week", "month")).alias("age"),
        F.concat(n, pick("h", "d", "wk", "mo")).alias("short"))
    return rows.select(
        "k", D.parse_relative_date(F.col("rel"), AS_OF).cast("string").alias("relative"),
        F.lower(D.relative_phrase(F.col("rel"))).alias("phrase"),
        D.parse_loose_age(F.col("age"), AS_OF).cast("string").alias("loose"),
        D.parse_compact_age(F.col("short"), AS_OF).cast("string").alias("compact"))


_ROLE = ("concat(lang, CASE doc_id % 6 WHEN 0 THEN ' Intern' WHEN 1 THEN ' internal audit' "
         "WHEN 2 THEN ' New Grad' WHEN 3 THEN ' co-op' ELSE ' engineer' END)")
_MODE = ("CASE doc_id % 5 WHEN 0 THEN 'Hybrid ' WHEN 1 THEN 'on-site ' WHEN 2 THEN 'remote-first ' "
         "WHEN 3 THEN 'remote ' ELSE '' END || text")
_SIGNAL = V.ROLE_SIGNAL


@query("role_flags", f"""
WITH r AS (SELECT doc_id, {_ROLE} AS title, {_MODE} AS body, text FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(title, '(?i)\\binternal\\b') THEN regexp_matches(body, '{_SIGNAL}')
    ELSE regexp_matches(title || chr(10) || body, '{_SIGNAL}') END AS is_role,
  CASE WHEN contains(lower(title), 'co-op') THEN 'co-op' WHEN contains(lower(title), 'intern')
    THEN 'intern' WHEN contains(lower(title), 'new grad') THEN 'new grad' ELSE 'intern' END AS level,
  CASE WHEN regexp_matches(lower(body), '{V.REMOTE_STRONG}') THEN 'remote'
    WHEN contains(lower(body), 'hybrid') THEN 'hybrid'
    WHEN regexp_matches(lower(body), '{V.ONSITE}') THEN 'onsite'
    WHEN regexp_matches(lower(body), '{V.REMOTE_WEAK}') THEN 'remote' ELSE 'unknown' END AS work_mode
FROM r""")
def role_flags(spark, d):
    docs = texts(spark, d, "documents").select("doc_id", F.expr(_ROLE).alias("title"),
                                               F.expr(_MODE).alias("body"))
    return docs.select(
        "doc_id", has_role_signal(F.col("title"), F.col("body"), None).alias("is_role"),
        infer_level(F.col("title")).alias("level"), detect_work_mode(F.col("body")).alias("work_mode"))


@query("forward_fill", """
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN role || ':' || md5(text) END IGNORE NULLS)
  OVER (PARTITION BY conv_id ORDER BY turn) AS carried FROM conversations""")
def carry_forward(spark, d):
    """The last user turn at or before each turn; tiny chunks exercise the carrying."""
    said = F.when(F.col("role") == "user", F.concat_ws(":", "role", F.md5("text")))
    out = forward_fill(texts(spark, d, "conversations"), ["conv_id"], "turn", said, "carried", 3)
    return out.select("conv_id", "turn", "carried")


@query("urgency_order", f"""
WITH {ORDERS}
SELECT seq, row_number() OVER (ORDER BY (deadline IS NULL OR rolling),
  CASE WHEN deadline IS NULL OR rolling THEN 1000000 ELSE deadline - DATE '{AS_OF}' END,
  score DESC, seq) AS rank FROM ord""")
def urgency_order(spark, d):
    return R.urgency_rank(orders(spark, d), AS_OF).select(F.col("ingest_seq").alias("seq"), "rank")
