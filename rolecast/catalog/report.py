"""Queries on ordering, facets, metrics and cards of results."""

import uuid

from pyspark.sql import functions as F

from rolecast import values as V
from rolecast.catalog.base import AS_OF, query, table
from rolecast.catalog.freshness import ORDERS, orders
from rolecast.functions import dates as D
from rolecast.operators import report as R
from rolecast.operators.common import number_rows, shared_dir
from rolecast.sources.report_files import read_json, read_report, write_json, write_report


def results(spark, d):
    """Orders as scored postings of their customers."""
    cust = table(spark, d, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("company"),
        F.concat_ws(":", F.lower("c_mktsegment"), "c_nationkey").alias("source"))
    return orders(spark, d).join(cust, "o_custkey", "left").withColumn(
        "title", F.concat(F.lit("Order <"), "ingest_seq", F.lit(">")))


RESULTS = f"""{ORDERS},
res AS (SELECT ord.*, c_name AS company, lower(c_mktsegment) || ':' || c_nationkey AS source,
  'Order <' || seq || '>' AS title, CASE WHEN deadline IS NULL OR rolling THEN 1000000
  ELSE deadline - DATE '{AS_OF}' END AS dleft FROM ord LEFT JOIN customer ON c_custkey = o_custkey)"""
_FACET = "coalesce(nullif({0}, ''), '—')"


@query("facet_counts", f"""
WITH {RESULTS}, f AS (SELECT unnest(['source', 'work_mode', 'date_confidence', 'live_status']) AS facet,
  unnest([{_FACET.format("split_part(source, ':', 1)")}, {_FACET.format("work_mode")},
    {_FACET.format("conf")}, {_FACET.format("live_status")}]) AS value FROM res)
SELECT facet, value, count(*) AS n FROM f GROUP BY ALL""")
def facet_counts(spark, d):
    return R.facet_counts(results(spark, d))


@query("faceted_filter", f"""
WITH {RESULTS} SELECT seq FROM res
WHERE contains(lower(company || ' ' || title), '7') AND score >= 20 AND dleft <= 365
  AND split_part(source, ':', 1) IN ('building', 'machinery') AND {_FACET.format("live_status")} IN ('—', 'live')""")
def faceted_filter(spark, d):
    out = R.faceted_filter(results(spark, d), AS_OF, " 7 ", 20, True,
                           source=["building", "machinery"], live_status=["—", "live"])
    return out.select(F.col("ingest_seq").alias("seq"))


@query("result_metrics", f"""
WITH {RESULTS} SELECT count(*) AS shown, count(*) FILTER (conf = 'verified') AS verified_date,
  count(*) FILTER (live_status = 'live') AS live_confirmed FROM res""")
def result_metrics(spark, d):
    return R.result_metrics(results(spark, d))


@query("score_order", f"""
WITH {ORDERS} SELECT seq, row_number() OVER (ORDER BY score DESC, seq) AS rank FROM ord""")
def score_order(spark, d):
    """Place of every row by score; small chunks exercise the carrying of offsets."""
    out = number_rows(orders(spark, d), [], [-F.col("match_score")], "ingest_seq", "rank", 1000)
    return out.select(F.col("ingest_seq").alias("seq"), "rank")


@query("posted_order", f"""
WITH {ORDERS} SELECT seq, row_number() OVER (ORDER BY posted DESC NULLS LAST, seq) AS rank FROM ord""")
def posted_order(spark, d):
    newest = -F.coalesce(F.unix_date("posted_date"), F.lit(-10**6))
    out = number_rows(orders(spark, d), [], [newest], "ingest_seq", "rank")
    return out.select(F.col("ingest_seq").alias("seq"), "rank")


@query("sorted_results", f"""
WITH {RESULTS} SELECT seq, dleft::BIGINT AS days_left FROM res""")
def sorted_results(spark, d):
    """The result in deadline order, as a reader gets it."""
    out = R.sorted_by(results(spark, d), "deadline", AS_OF)
    return out.select(F.col("ingest_seq").alias("seq"),
                      R.days_to_deadline(AS_OF).cast("bigint").alias("days_left"))


@query("section_rank", f"""
WITH {RESULTS} SELECT seq, o_custkey, CASE WHEN conf = 'unverified' THEN 'unverified' ELSE 'verified' END
  AS bucket, row_number() OVER (PARTITION BY o_custkey, conf = 'unverified' ORDER BY
  (deadline IS NULL OR rolling), dleft, score DESC, seq) AS rank FROM res""")
def section_rank(spark, d):
    out = R.section_rank(results(spark, d), AS_OF, owner=("o_custkey",))
    return out.select(F.col("ingest_seq").alias("seq"), "o_custkey", "bucket", "rank")


def card_input(spark, d):
    n = F.col("ingest_seq")
    return results(spark, d).withColumns({
        "profile_id": F.col("o_custkey"), "location": F.lit(""), "apply_url": F.concat(F.lit("https://o/"), n),
        "company_description": F.when(n % 2 == 0, "R&D").otherwise(""),
        "is_startup": F.when(n % 3 == 0, True).when(n % 3 == 1, False),
        "funding_stage": F.when(n % 2 == 0, "Seed").otherwise(""), "level": F.lit("intern"),
        "requirements": F.array(F.lit("sql"), F.lit("a<b")),
        "live_reason": F.lit("HTTP 403"), "live_checked_at": F.lit(f"{AS_OF} 12:30:00").cast("timestamp"),
        "eligibility_reason": F.lit("in time"), "match_rationale": F.lit("Keyword match on: sql"),
        "matched_keywords": F.array(F.lit("sql")),
        "missing_keywords": F.when(n % 5 == 0, F.array(F.lit("etl"))).otherwise(
            F.array().cast("array<string>"))})


CARD = f"""{RESULTS},
rk AS (SELECT *, CASE WHEN conf = 'unverified' THEN 'unverified' ELSE 'verified' END AS bucket,
  row_number() OVER (PARTITION BY o_custkey, conf = 'unverified' ORDER BY
  (deadline IS NULL OR rolling), dleft, score DESC, seq) AS rank,
  CASE WHEN seq % 3 = 0 THEN 'Startup' || CASE WHEN seq % 2 = 0 THEN ' · Seed' ELSE '' END
    WHEN seq % 3 = 1 THEN 'Established / non-startup' ELSE 'Unknown' END AS st,
  CASE WHEN rolling THEN 'rolling' ELSE coalesce(deadline::VARCHAR, '—') END AS due,
  CASE live_status WHEN 'live' THEN '✅ verified live as of {AS_OF} 12:30 UTC'
    WHEN 'unknown' THEN '⚠️ could not verify (HTTP 403) — checked {AS_OF} 12:30 UTC'
    ELSE '— not live-checked (disabled)' END AS lv,
  CASE WHEN conf = 'verified' AND posted IS NOT NULL
    THEN posted || '  _(verified — order book)_' WHEN conf = 'approximate' AND posted IS NOT NULL
    THEN '~' || posted || '  _(approximate — order book)_' ELSE '**[unverified]**  _(order book)_' END AS pt
  FROM res)"""


CARD_TEXT = """concat_ws(chr(10),
  '### ' || rank || '. ' || company || ' — ' || title || '  ·  Match ' || score || '/100', '',
  CASE WHEN seq % 2 = 0 THEN '> R&D' || chr(10) END, '- **Startup:** ' || st,
  '- **Level / mode:** intern · ' || work_mode, '- **Location:** —', '- **Posted:** ' || pt,
  '- **Deadline:** ' || due, '- **Live check:** ' || lv, '- **Source:** ' || source,
  '- **Apply:** https://o/' || seq, '- **Tech stack / requirements:** sql, a<b',
  '- **Eligibility:** in time', '- **Match ' || score || '/100** — Keyword match on: sql',
  '  - Matched: sql', CASE WHEN seq % 5 = 0 THEN '  - Missing: etl' END, '')"""


@query("markdown_cards", f"""
WITH {CARD} SELECT o_custkey AS profile_id, bucket, rank, md5({CARD_TEXT}) AS card_md5 FROM rk""")
def markdown_cards(spark, d):
    out = R.cards(card_input(spark, d), AS_OF)
    return out.select("profile_id", "bucket", "rank", F.md5("markdown").alias("card_md5"))


@query("html_cards", f"""
WITH {CARD} SELECT o_custkey AS profile_id, bucket, rank, md5(concat_ws(chr(10),
  '<div class="card"><div class="card-head">',
  '<span class="rank">' || rank || '</span> <span class="company">' || company
    || '</span> — <span class="title">Order &lt;' || seq || '&gt;</span> <span class="score">Match '
    || score || '/100</span></div>',
  '<p class="desc">' || CASE WHEN seq % 2 = 0 THEN 'R&amp;D' ELSE '' END || '</p><ul>',
  '<li><b>Startup:</b> ' || st || '</li>', '<li><b>Level / mode:</b> intern · ' || work_mode || '</li>',
  '<li><b>Location:</b> —</li>', '<li class="' || CASE conf WHEN 'verified' THEN 'conf-verified'
    WHEN 'approximate' THEN 'conf-approx' ELSE 'conf-unverified' END || '"><b>Posted:</b> '
    || coalesce(posted::VARCHAR, '—') || ' (' || conf || ' — order book)</li>',
  '<li><b>Deadline:</b> ' || due || '</li>', '<li class="' || CASE live_status WHEN 'live' THEN 'live-ok'
    WHEN 'unknown' THEN 'live-unknown' ELSE '' END || '"><b>Live check:</b> ' || lv || '</li>',
  '<li><b>Source:</b> ' || source || '</li>', '<li><b>Apply:</b> <a href="https://o/' || seq
    || '" target="_blank" rel="noopener">https://o/' || seq || '</a></li>',
  '<li><b>Tech stack:</b> sql, a&lt;b</li>', '<li><b>Eligibility:</b> in time</li>',
  '<li><b>Rationale:</b> Keyword match on: sql</li>', '<li><b>Matched:</b> sql</li>',
  '<li><b>Missing:</b> ' || CASE WHEN seq % 5 = 0 THEN 'etl' ELSE '—' END || '</li>',
  '</ul></div>')) AS card_md5 FROM rk""")
def html_cards(spark, d):
    out = R.cards(card_input(spark, d), AS_OF)
    return out.select("profile_id", "bucket", "rank", F.md5("html").alias("card_md5"))


@query("display_dates", f"""
WITH {ORDERS} SELECT seq, coalesce(posted::VARCHAR, '—') AS posted,
  CASE WHEN rolling THEN 'rolling' ELSE coalesce(deadline::VARCHAR, '—') END AS due FROM ord""")
def display_dates(spark, d):
    return orders(spark, d).select(
        F.col("ingest_seq").alias("seq"), D.posted_display(F.col("posted_date")).alias("posted"),
        D.deadline_display(F.col("deadline"), F.col("deadline_is_rolling")).alias("due"))


@query("report_totals", f"""
WITH {ORDERS} SELECT 'totals' AS section, '**Totals:** ' || count(*) FILTER (conf <> 'unverified')
  || ' verified-date  ·  ' || count(*) FILTER (conf = 'unverified') || ' unverified-date  ·  '
  || count(*) || ' retained' AS text FROM ord""")
def report_totals(spark, d):
    return R.report_totals(orders(spark, d))


@query("json_report", f"""
WITH {RESULTS} SELECT seq, company, title, posted::VARCHAR AS posted_date, deadline::VARCHAR AS deadline,
  conf AS date_confidence, score AS match_score FROM res""")
def json_report(spark, d):
    """Written as JSON to the shared folder and read back."""
    path = f"{shared_dir(spark)}/report-{uuid.uuid4()}"
    write_json(results(spark, d), path, f"{AS_OF}T12:00:00Z")
    return read_json(spark, path).select(
        F.col("ingest_seq").alias("seq"), "company", "title", F.col("posted_date").cast("string"),
        F.col("deadline").cast("string"), "date_confidence", F.col("match_score").cast("bigint"))


RECENT, AHEAD = 60, 90
HEAD_SQL = f"""concat_ws(chr(10), '# Results', '', '_Generated {AS_OF} 12:00 UTC_', '',
  '**Windows:** posted ≤ {RECENT}d  ·  deadline ≤ {AHEAD}d  ·  live-check ON', '',
  '**Totals:** ' || (n - u) || ' verified-date  ·  ' || u || ' unverified-date  ·  ' || n
    || ' retained (all live-checked this run)', '',
  '**Since last run:** ' || n_new || ' new  ·  ' || n_closed || ' no longer listed', '',
  '<details><summary>Candidate profile used for matching</summary>', '',
  CASE WHEN degree <> '' OR major <> '' THEN '- **Background:** ' ||
    concat_ws(' ', nullif(degree, ''), nullif(major, '')) END,
  CASE WHEN len(tools) > 0 THEN '- **Tools/languages:** ' || array_to_string(tools[1:14], ', ') END,
  '</details>', '')"""


def report_profiles(spark, d):
    """Customers as profiles; some without degree, major or tools, some without any posting."""
    n = F.col("c_custkey")
    tools = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.concat(F.lit("tool"), i))
    return table(spark, d, "customer").select(
        n.alias("profile_id"), F.when(n % 3 > 0, F.lower("c_mktsegment")).alias("degree"),
        F.when(n % 4 > 0, F.concat(F.lit("area "), "c_nationkey")).otherwise("").alias("major"),
        F.when(n % 5 > 0, F.slice(tools, 1, (n % 16 + 1).cast("int"))).alias("tools_languages"))


@query("report_parts", f"""
WITH {CARD},
own AS (SELECT c_custkey AS profile_id, CASE WHEN c_custkey % 3 > 0 THEN lower(c_mktsegment) ELSE '' END AS degree,
  CASE WHEN c_custkey % 4 > 0 THEN 'area ' || c_nationkey ELSE '' END AS major,
  CASE WHEN c_custkey % 5 > 0 THEN ['tool' || i FOR i IN range(1, c_custkey % 16 + 2)] ELSE [] END AS tools,
  count(seq) AS n, count(seq) FILTER (conf = 'unverified') AS u
  FROM customer LEFT JOIN res ON o_custkey = c_custkey GROUP BY ALL),
ch AS (SELECT count(*) FILTER (seq % 7 = 0) AS n_new, count(*) FILTER (seq % 7 = 1) AS n_closed FROM res),
parts AS (SELECT profile_id, 0 AS part, 0 AS rank, {HEAD_SQL} AS text FROM own, ch
  UNION ALL SELECT profile_id, 1, 0, concat_ws(chr(10), '---', '', '{V.DATED_HEADING}', '',
    CASE WHEN n = u THEN '_None this run._' || chr(10) END) FROM own
  UNION ALL SELECT profile_id, 2, 0, concat_ws(chr(10), '---', '', '{V.UNDATED_HEADING}', '', '{V.UNDATED_NOTE}', '',
    CASE WHEN u = 0 THEN '_None this run._' || chr(10) END) FROM own
  UNION ALL SELECT o_custkey, CASE bucket WHEN 'verified' THEN 1 ELSE 2 END, rank, {CARD_TEXT} FROM rk)
SELECT profile_id, part, rank, md5(text) AS text_md5 FROM parts""")
def report_parts(spark, d):
    """Whole reports of all profiles, written in ordered files and read back."""
    rows = card_input(spark, d)
    changes = rows.select(F.when(F.col("ingest_seq") % 7 == 0, "new").when(F.col("ingest_seq") % 7 == 1, "closed")
                          .alias("change"))
    parts = R.report_parts(rows, report_profiles(spark, d), AS_OF, f"{AS_OF} 12:00 UTC", RECENT, AHEAD, True,
                           changes, tools=V.TOOLS_IN_HEAD)
    path = f"{shared_dir(spark)}/report-{uuid.uuid4()}"
    write_report(parts, path)
    return read_report(spark, path).select("profile_id", "part", "rank", F.md5("markdown").alias("text_md5"))
