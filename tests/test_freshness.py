from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rolecast.operators import freshness as FR, live as L, state as ST
from rolecast.plans import run as R
from rolecast.operators import profile as P, report as RP, terms as T
from rolecast.sources import report_files as RF

AS_OF = date(2026, 7, 1)
POSTING = ("ingest_seq long, company string, title string, location string, apply_url string, "
           "source string, description_text string, requirements array<string>, "
           "company_description string, is_startup boolean, posted_date date, deadline date, "
           "deadline_is_rolling boolean, date_confidence string, date_source string, "
           "first_seen timestamp, funding_stage string, level string, work_mode string")


def posting(seq, **kw):
    base = dict(company="Acme", title="Data Intern", location="", apply_url="", source="x",
                description_text="", requirements=[], company_description="", is_startup=None,
                posted_date=None, deadline=None, deadline_is_rolling=False,
                date_confidence="unverified", date_source="", first_seen=None, funding_stage="",
                level="intern", work_mode="unknown")
    return {"ingest_seq": seq, **base, **kw}


@pytest.fixture(scope="module")
def table(spark):
    names = [f.split()[0] for f in POSTING.split(", ")]
    return lambda *rows: spark.createDataFrame([tuple(r[n] for n in names) for r in rows], POSTING)


def days(n):
    return AS_OF + timedelta(days=n)


def test_date_chain(table):
    seen = datetime(2026, 6, 20, 5)
    got = FR.resolve_dates(table(
        posting(0, posted_date=days(-3), date_confidence="verified", date_source="s"),
        posting(1, posted_date=days(-3)), posting(2, first_seen=seen, date_confidence="verified"),
        posting(3), posting(4, date_source="why"))).orderBy("ingest_seq").collect()
    assert [r["date_confidence"] for r in got] == [
        "verified", "approximate", "approximate", "unverified", "unverified"]
    assert got[2]["posted_date"] == date(2026, 6, 20)
    assert [r["date_source"] for r in got] == [
        "s", "", "cache first-seen (this tool)", "no determinable date", "why"]


def test_strict_chain_ignores_the_current_run(table):
    row = table(posting(0, first_seen=datetime(2026, 7, 1, 9)))
    r = FR.resolve_dates(row, current_run_start="2026-07-01 08:00:00").first()
    assert r["date_confidence"] == "unverified" and r["posted_date"] is None


def test_eligibility(table):
    rows = table(
        posting(0, posted_date=days(-5), date_confidence="verified"),
        posting(1, posted_date=days(-90), date_confidence="verified"),
        posting(2, posted_date=days(-90), date_confidence="verified", deadline=days(7)),
        posting(3), posting(4, posted_date=days(400), date_confidence="approximate"),
        posting(5, deadline=days(7), deadline_is_rolling=True, date_confidence="verified"),
        posting(6, deadline=days(-1), date_confidence="verified"))
    mark = lambda **kw: [(r["eligible"], r["eligibility_reason"]) for r in FR.mark_eligibility(
        rows, AS_OF, 21, 14, **kw).orderBy("ingest_seq").collect()]
    got = mark()
    assert [e for e, _ in got] == [True, False, True, True, True, False, False]
    assert got[0][1] == "posted 5d ago (≤21d)" and got[2][1] == "deadline in 7d (≤14d)"
    assert got[1][1] == "outside recency/deadline windows"
    assert not mark(include_unverified=False)[3][0]


def test_merge_fills_gaps_from_the_next_best(table):
    rows = FR.with_key(table(
        posting(0, source="serpapi:x", deadline=days(9), is_startup=True, company_description="about"),
        posting(1, source="greenhouse:a", posted_date=AS_OF, date_confidence="verified"),
        posting(2, source="github:b", posted_date=AS_OF, date_confidence="approximate",
                description_text="long", requirements=["r"], is_startup=False),
        posting(3, source="github:b", company="ACME!"), posting(4, company="Other")))
    merged = FR.dedupe_merge(rows)
    m = merged.where("key like 'acme%'").first()
    assert (m["ingest_seq"], m["source"], m["date_confidence"]) == (1, "greenhouse:a", "verified")
    assert (m["deadline"], m["description_text"], m["requirements"]) == (days(9), "long", ["r"])
    assert (m["is_startup"], m["company_description"], m["n_merged"]) == (False, "about", 4)
    also = sorted((r["source"], r["n"]) for r in FR.also_seen(rows, merged).collect())
    assert also == [("github:b", 2), ("serpapi:x", 1)]


def test_merge_twice_changes_nothing(table):
    rows = FR.with_key(table(*[posting(i, company=f"c{i % 3}", source=f"lever:{i}") for i in range(12)]))
    once = FR.dedupe_merge(rows).drop("n_merged")
    again = FR.dedupe_merge(once).drop("n_merged")
    assert sorted(map(str, once.collect())) == sorted(map(str, again.collect()))


CRAWL = "requested_url string, final_url string, status int, redirected boolean, error string, body string"
LD = '<script type="application/ld+json">{"@type":"JobPosting","title":"X Intern","validThrough":"%s"}</script>'


def test_live_verdicts(spark, table):
    crawled = spark.createDataFrame([
        ("http://c/404", "", 404, False, "", ""),
        ("http://c/closed", "http://c/closed", 200, False, "", "<p>Position is NO LONGER available; job not found"),
        ("http://c/exp", "http://c/exp", 200, False, "", LD % "2000-01-01"),
        ("http://c/jobs/123", "http://c/careers/", 200, True, "", "ok"),
        ("http://c/jobs/1234", "http://c/jobs", 200, True, "", "ok"),
        ("http://c/x/123", "http://c/x/12", 200, True, "", "ok"),
        ("http://c/ok", "http://c/ok", 200, False, "", LD % "2099-01-01"),
        ("http://c/403", "", 403, False, "", ""), ("http://c/0", "", 0, False, "timeout", ""),
        ("http://c/late", "", 200, False, "", "x" * 50000 + "this job has expired")], CRAWL)
    urls = [r["requested_url"] for r in crawled.collect()] + ["", "ftp://x", "http://c/none"]
    got = {r["apply_url"]: (r["live_status"], r["live_reason"]) for r in L.live_check(
        table(*[posting(i, apply_url=u) for i, u in enumerate(urls)]), crawled, AS_OF).collect()}
    assert {u: s for u, (s, _) in got.items()} == {
        "http://c/404": "dead", "http://c/closed": "dead", "http://c/exp": "dead",
        "http://c/jobs/123": "dead", "http://c/jobs/1234": "dead", "http://c/x/123": "live",
        "http://c/ok": "live", "http://c/403": "unknown", "http://c/0": "unknown",
        "http://c/late": "dead", "": "unknown", "ftp://x": "unknown", "http://c/none": "unknown"}
    # The first phrase of the list counts, not the first of the page.
    assert got["http://c/closed"][1] == "closure signal: 'position is no longer available'"
    assert got["http://c/0"][1] == "unreachable (timeout) — kept, unverified"


def test_first_seen_never_moves(spark, table):
    def batch(at, **kw):
        return FR.with_key(table(posting(0, **kw))).withColumn("seen_at", F.lit(at).cast("timestamp"))

    s1 = ST.observe(spark.createDataFrame([], ST.STATE_SCHEMA),
                    batch("2026-06-01", apply_url="u1", posted_date=AS_OF))
    s2 = ST.observe(s1, batch("2026-06-05", apply_url="u2", company="ACME"))
    r = s2.first()
    assert (r["first_seen"].day, r["last_seen"].day, r["url"]) == (1, 5, "u2")
    assert (r["company"], r["posted_date"]) == ("Acme", AS_OF)
    ok = ST.record_verdicts(s2, spark.createDataFrame(
        [("acme|data intern|", "live", datetime(2026, 6, 5))],
        "key string, live_status string, live_checked_at timestamp")).first()
    assert ok["last_status"] == "live"


def test_run_log_and_difference(spark, tmp_path):
    root, at = str(tmp_path), datetime(2026, 6, 1)
    keys = lambda *k: spark.createDataFrame([(x, x != "hidden", "live") for x in k],
                                            "key string, reported boolean, live_status string")
    one = ST.start_run(spark, root, at)
    ST.record_run_listings(keys("a", "b"), root, one)
    ST.record_run_listings(keys("a", "b", "hidden"), root, one)  # again: replaced
    ST.finish_run(spark, root, one, at, 3, 2)
    broken = ST.start_run(spark, root, at)
    ST.record_run_listings(keys("z"), root, broken)
    three = ST.start_run(spark, root, at)
    assert (one, broken, three) == (1, 2, 3)
    before = ST.previous_reported(ST.read_runs(spark, root), ST.read_run_listings(spark, root), three)
    current = keys("b", "c").select("key")
    got = sorted(map(tuple, ST.diff_keys(current, before).collect()))
    assert got == [("a", "closed"), ("c", "new")]
    swapped = sorted(map(tuple, ST.diff_keys(before, current).collect()))
    assert swapped == [("a", "new"), ("c", "closed")]


def test_two_whole_runs(spark, table, tmp_path):
    lex, syn = T.seed_lexicon(spark), T.seed_synonyms(spark)
    people = spark.createDataFrame([(7, "SKILLS: Violin, Viola")], "profile_id long, text string")
    terms = P.profile_terms(people, lex, syn)
    rows = [posting(0, company="Shut Stage", title="Violin Intern", apply_url="http://shut/4"),
            posting(1, company="Loft Quartet", title="Viola  intern", source="serpapi:x"),
            posting(2, company="Loft Quartet", title="Viola Intern", source="lever:loft", apply_url="http://loft/2",
                    posted_date=days(-12), date_confidence="verified", description_text="Violin parts"),
            posting(3, company="Long Ago", title="Viola Intern", posted_date=days(-61), date_confidence="verified"),
            posting(4, company="Quiet Hall", title="Strings Intern", description_text="fiddle")]
    crawled = spark.createDataFrame([("http://loft/2", "http://loft/2", 200, False, "", "open"),
                                     ("http://shut/4", "", 410, False, "", "")], CRAWL)

    def go(listings, state, at):
        return R.run(table(*listings).drop("first_seen"), terms, crawled, state, AS_OF, at)

    root = str(tmp_path)
    one = ST.start_run(spark, root, datetime(2026, 7, 1))
    first = go(rows, ST.state_view(spark, root), "2026-07-01 08:00:00")
    shown = {r["company"]: r for r in first.reported.collect()}
    assert set(shown) == {"Loft Quartet", "Quiet Hall"} and shown["Loft Quartet"]["match_score"] > 30
    assert shown["Loft Quartet"]["n_merged"] == 2 and shown["Quiet Hall"]["date_confidence"] == "approximate"
    counts = first.counters.first().asDict()
    assert counts == {"n_fetched": 5, "n_listings": 4, "n_eligible": 3, "n_dead": 1,
                      "n_retained": 2, "n_reported": 2}
    assert {r["change"] for r in R.record(first, root, one, datetime(2026, 7, 1)).collect()} == {"new"}
    two = ST.start_run(spark, root, datetime(2026, 7, 2))
    second = go([rows[4], posting(9, company="Fresh Reed", title="Viola Intern")],
                ST.state_view(spark, root), "2026-07-02 08:00:00")
    change = {r["key"]: r["change"] for r in R.record(second, root, two, datetime(2026, 7, 2)).collect()}
    assert change == {"fresh reed|viola intern|": "new", "loft quartet|viola intern|": "closed"}
    state = ST.state_view(spark, root)
    assert {r["key"]: r["first_seen"].day for r in state.collect()}["quiet hall|strings intern|"] == 1

    cards = RP.cards(first.reported, AS_OF).collect()
    assert any("### 1. Loft Quartet — Viola Intern" in c["markdown"] for c in cards)
    RF.write_cards(RP.cards(first.reported, AS_OF), f"{root}/cards")
    assert spark.read.text(f"{root}/cards").where("value like '### 1.%'").count() == 1
    RF.write_json(first.reported, f"{root}/json", "now")
    assert {r["posted_date"] for r in RF.read_json(spark, f"{root}/json").collect()} == {days(-12), AS_OF}


def test_tie_order_and_sections(table):
    rows = table(posting(0, deadline=days(5)), posting(1), posting(2, deadline=days(-2)),
                 posting(3, deadline=days(1), deadline_is_rolling=True)).withColumn(
        "match_score", F.col("ingest_seq").cast("int")).withColumn("live_status", F.lit("live"))
    assert [r["ingest_seq"] for r in RP.by_urgency(rows, AS_OF).collect()] == [2, 0, 3, 1]
    ranked = RP.urgency_rank(rows, AS_OF).orderBy("rank").collect()
    assert [r["ingest_seq"] for r in ranked] == [2, 0, 3, 1]
    late = RP.faceted_filter(rows, AS_OF, deadline_only=True).collect()
    assert {r["ingest_seq"] for r in late} == {0, 2}
