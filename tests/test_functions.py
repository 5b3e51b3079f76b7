import html
import random
import re
from datetime import date

from pyspark.sql import functions as F

from rolecast import values as V
from rolecast.functions import dates as D, html as H, roles as R, text as X

AS_OF = "2026-07-01"


def test_normalisers(values):
    assert values(X.norm_token, "  A-B  c!", None) == ["a b c", ""]
    assert values(X.norm_location, "San Francisco, CA, USA", "Remote US", "Area 51") == [
        "san francisco", "", "51"]
    assert values(X.slug_to_name, "acme-labs_co", "web3labs") == ["Acme Labs Co", "Web3Labs"]
    assert values(X.normalize_term, " A \t B ") == ["a b"]
    assert values(X.source_head, "github:a/b", "x", None) == ["github", "x", ""]
    assert values(lambda c: X.safe_int(c), " 12 ", "x", "") == [12, None, None]
    assert values(X.batch_year, "Winter 2024", "S19") == [2024, None]


def test_key_keeps_its_three_parts(values):
    key = lambda c: X.dedup_key(c, F.lit("Data Intern"), F.lit("Remote, NY"))
    assert values(key, "Acme, Inc.", None) == ["acme inc|data intern|", "|data intern|"]


def test_url_path(values):
    assert values(X.url_path, "https://a.b/c/d?x#y", "u", "https://a.b", "//h/p") == [
        "/c/d", "u", "", "/p"]


def test_dates(values):
    loose = lambda c: D.parse_date_loose(c, AS_OF)
    got = values(loose, "2026-06-01T12:00:00Z", "1780272000000", "1780272000", "20260601",
                 "Jun 1, 2026", "1 June 2026", "06/01/2026", "31/05/2026", "soon", "", None, "2026-13-40")
    day = date(2026, 6, 1)
    assert got == [day, day, day, day, day, day, day, date(2026, 5, 31), None, None, None, None]


def test_relative_dates(values):
    rel = lambda c: D.parse_relative_date(c, AS_OF)
    assert values(rel, "Posted 5 days ago", "30+ days ago", "2 weeks ago", "1 month ago",
                  "3 hours ago", "Yesterday", "just posted", "never") == [
        date(2026, 6, 26), date(2026, 6, 1), date(2026, 6, 17), date(2026, 6, 1),
        date(2026, 7, 1), date(2026, 6, 30), date(2026, 7, 1), None]
    assert values(D.relative_phrase, "x Posted 5 days ago!") == ["Posted 5 days ago"]
    age = lambda c: D.parse_loose_age(c, AS_OF)
    assert values(age, "about a month", "2 years", "an hour", "today") == [
        date(2026, 6, 1), date(2024, 7, 1), None, date(2026, 7, 1)]


def test_list_dates(values):
    cell = lambda c: D.list_date(c, AS_OF)
    got = values(cell, "3d", "2w", "1mo", "5h", "4 days ago", "Oct 15", "**2026-06-18**", "", "TBD")
    assert [r["posted_date"] for r in got] == [
        date(2026, 6, 28), date(2026, 6, 17), date(2026, 6, 1), date(2026, 7, 1),
        date(2026, 6, 27), date(2025, 10, 15), date(2026, 6, 18), None, None]
    assert [r["date_confidence"] for r in got][5:8] == ["verified", "verified", "approximate"]


def test_html_text(values):
    text = ("<div>A &amp;amp; B<script>x<1</script></div><!-- no --><p>C&nbsp;&#8364;&#x41;"
            "</p>\n\n\n\n<p title='a>b'>D &bogus; &lt</p>")
    assert values(H.html_to_text, text) == ["A & B\nC\xa0€A\n\nD &bogus; <"]


def test_unescape_equals_the_standard_library(values):
    rng = random.Random(3)
    parts = ["&amp;", "&lt", "&eacute;", "&#233;", "&#xe9;", "&", ";", "a", " ", "&nope;", "&Alpha;", "&copy", "&apos;",
             "&#146;", "&#x80", "&hyphen;", "&NotEqualTilde;", "&notin;", "&not", "&#0;", "&#55296;", "&#1114112;",
             "&#00000000000065;", "&#99999999999999;", "&#x;", "&#8;", "&#127;", "&#xFFFE;", "&#13;", "#", "<", "&AMPs"]
    samples = ["".join(rng.choice(parts) for _ in range(8)) for _ in range(400)] + parts
    assert values(H.unescape, *samples) == [html.unescape(s) for s in samples]


def test_role_signal(spark):
    rows = [("Data Intern", "", True), ("Internal Audit Intern", "", False),
            ("Internal Audit", "an internship", True), ("Engineer", "x" * 500 + " intern", True),
            ("Engineer", "a co-op role", True), ("New Grad Engineer", None, True)]
    df = spark.createDataFrame(rows, "t string, b string, want boolean")
    got = df.select(R.has_role_signal(F.col("t"), F.col("b")).alias("g"), "want").collect()
    assert [r["g"] for r in got] == [r["want"] for r in got]
    lead = df.where("t = 'Engineer'").orderBy("b").select(
        R.has_role_signal(F.col("t"), F.col("b"), V.ROLE_LEAD_CHARS)).collect()
    assert [r[0] for r in lead] == [True, False]


def test_classifiers(values):
    assert values(R.infer_level, "Co-op", "Intern", "New Grad", "Engineer") == [
        "co-op", "intern", "new grad", "intern"]
    assert values(lambda c: R.detect_work_mode(c), "Remote-first, hybrid", "Hybrid remote",
                  "On-site", "remote ok", "") == ["remote", "hybrid", "onsite", "remote", "unknown"]
    assert values(R.is_continuation, "↳", " ** ", "Acme") == [True, True, False]
    assert values(R.best_apply_url, '<a href="https://j/a.png">x</a> [y](https://github.com/z)',
                  "[a](https://simplify.jobs/1) [b](https://co/2)", "none") == [
        "https://github.com/z", "https://co/2", ""]


def test_marked_text_equals_the_boundary_regex(spark):
    rng = random.Random(7)
    alphabet = ["a", "b", "c+", "#", "+", ".", "-", " ", "é", "1", "B", "/", "\n"]
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(rng.randint(1, n)))
    pairs = []
    for _ in range(4000):
        term = word(5).lower().strip()
        if term:
            pairs.append((word(14) + rng.choice(["", term]) + word(4), term))
    df = spark.createDataFrame(pairs, "x string, t string")
    got = df.select(X.stands_in(X.mark(F.col("x")), X.mark(F.col("t")), X.sign_pattern(F.col("t")))
                    .alias("g"), F.array_contains(X.anchors(F.col("x")), X.term_anchor(F.col("t")))
                    .alias("a"), X.is_anchor(F.col("t")).alias("sure")).collect()
    edge = "[A-Za-z0-9+#]"
    for (x, t), r in zip(pairs, got):
        want = re.search(f"(?<!{edge})" + re.escape(t) + f"(?!{edge})", x, re.I) is not None
        assert r["g"] == want, (x, t)
        if want:
            assert r["a"], (x, t)
        if r["sure"]:
            assert r["a"] == want, (x, t)


def test_more_date_forms(values):
    loose = lambda c: D.parse_date_loose(c, AS_OF)
    assert values(loose, "06/01/26", "31.12.99", "June 2026", "2026-06", "Jun 1", "20260601T101500Z", "1780272000.5",
                  "1780272000500", "Feb 2025", "see 2026-06-03 or so", "13/13/26", "2026") == [
        date(2026, 6, 1), date(1999, 12, 31), date(2026, 6, 1), date(2026, 6, 1), date(2026, 6, 1), date(2026, 6, 1),
        date(2026, 6, 1), date(2026, 6, 1), date(2025, 2, 1), date(2026, 6, 3), None, date(1970, 1, 1)]
    late = lambda c: D.parse_date_loose(c, "2026-01-31")
    assert values(late, "Feb 2026", "2026-04") == [date(2026, 2, 28), date(2026, 4, 30)]
    age = lambda c: D.parse_loose_age(c, AS_OF)
    assert values(age, "300000 days", "99999999999 years") == [date(1205, 2, 15), None]
