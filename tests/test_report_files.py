"""Reports as ordered rows in files, and profiles read from files."""

import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from rolecast import values as V
from rolecast.operators import report as R
from rolecast.sources import report_files as RF
from rolecast.sources.profiles import read_profiles

AS_OF = "2026-07-01"
CARD = ("profile_id long, ingest_seq long, company string, title string, match_score int, posted_date date, "
        "deadline date, deadline_is_rolling boolean, date_confidence string, date_source string, live_status string")
REST = {"location": "", "apply_url": "", "company_description": "", "funding_stage": "", "level": "intern",
        "work_mode": "", "source": "x", "live_reason": "", "eligibility_reason": "", "match_rationale": ""}


@pytest.fixture(scope="module")
def cards(spark):
    def make(*rows):
        got = [(p, s, f"Co {s}", "Intern", 50, date(2026, 6, 20), None, False, c, "board", "live") for p, s, c in rows]
        out = spark.createDataFrame(got, CARD).withColumns({k: F.lit(v) for k, v in REST.items()})
        lists = {k: F.array().cast("array<string>") for k in ("requirements", "matched_keywords", "missing_keywords")}
        return out.withColumns({**lists, "is_startup": F.lit(None).cast("boolean"),
                                "live_checked_at": F.lit(None).cast("timestamp")})
    return make


def people(spark, *rows):
    return spark.createDataFrame(list(rows), "profile_id long, degree string, major string, tools_languages array<string>")


def test_whole_report(spark, cards, tmp_path):
    rows = cards((1, 10, "verified"), (1, 11, "unverified"), (1, 12, "approximate"), (3, 13, "unverified"), (None, 14, "verified"))
    who = people(spark, (1, "BS", None, ["a", "b", "c"]), (2, None, "", None))
    changes = spark.createDataFrame([("k", "new"), ("l", "new"), ("m", "closed")], "key string, change string")
    parts = R.report_parts(rows, who, AS_OF, "now", 60, 90, False, changes, "Finds", tools=2)
    got = {(r["profile_id"], r["part"], r["rank"]): r["markdown"] for r in parts.collect()}
    assert {(p, s) for p, s, k in got if k > 0} == {(1, 1), (1, 2), (3, 2)}
    assert {k[0] for k in got} == {1, 2, 3} and len(got) == 9 + 4
    head = got[1, 0, 0]
    assert head.startswith("# Finds\n\n_Generated now_\n") and "live-check OFF" in head and "all live-checked" not in head
    assert "2 verified-date  ·  1 unverified-date  ·  3 retained" in head and "2 new  ·  1 no longer" in head
    assert "- **Background:** BS\n- **Tools/languages:** a, b\n</details>" in head
    assert "Background" not in got[2, 0, 0] and V.NONE_THIS_RUN in got[2, 1, 0] and V.NONE_THIS_RUN in got[2, 2, 0]
    assert V.NONE_THIS_RUN in got[3, 1, 0] and V.NONE_THIS_RUN not in got[3, 2, 0]
    text = "\n".join(got[k] for k in sorted(got) if k[0] == 1)
    assert text.index(V.DATED_HEADING) < text.index("### 1. Co 10") < text.index("### 2. Co 12") < text.index(V.UNDATED_HEADING)

    RF.write_text(parts, str(tmp_path / "text"))
    names = sorted(f for f in os.listdir(tmp_path / "text") if f.startswith("part"))
    whole = "".join((tmp_path / "text" / f).read_text() for f in names)
    assert whole == "".join(got[k] + "\n" for k in sorted(got))


def test_empty_report(spark, cards):
    none = cards((1, 10, "verified")).limit(0)
    assert R.report_parts(none, people(spark, (1, "", "", [])), AS_OF, "now").count() == 3
    assert R.report_parts(none, people(spark, (1, "", "", [])).limit(0), AS_OF, "now").count() == 0


def test_files_are_bounded_and_found(spark, cards, tmp_path):
    """One profile holds most rows: its report is cut over files, and a reader opens only those it needs."""
    rows = cards(*[(7 if i % 3 else i % 40, i, "verified") for i in range(300)])
    parts = R.report_parts(rows, people(spark, (99, "", "", [])), AS_OF, "now")
    path = str(tmp_path / "report")
    RF.write_report(parts, path, rows_per_file=25)
    index = spark.read.parquet(f"{path}/index").collect()
    assert max(r["n"] for r in index) <= 25 and sum(r["n"] for r in index) == parts.count()
    want = parts.where("profile_id = 7").select("part", "rank").collect()
    one = RF.read_report(spark, path, 7)
    assert sorted(one.select("part", "rank").collect()) == sorted(want)
    assert len(RF.read_report(spark, path, 99).inputFiles()) <= 2 < len(index)
    assert RF.read_report(spark, path, 1000).count() == 0 and RF.read_report(spark, path).count() == parts.count()


def test_profiles_from_files(spark, tmp_path):
    for name, body in {"a.txt": "Ann\nSkills: piano", "b.MD": "", "c.pdf": "no", "d.text": "x\ny"}.items():
        (tmp_path / name).write_text(body)
    (tmp_path / "b.MD").write_bytes(b"\xef\xbb\xbf\xffz")
    got = {os.path.basename(r["file"]): r for r in read_profiles(spark, str(tmp_path)).collect()}
    assert {k: r["text"] for k, r in got.items()} == {
        "a.txt": "Ann\nSkills: piano", "b.MD": "\ufffdz", "d.text": "x\ny"}
    assert len({r["profile_id"] for r in got.values()}) == 3
