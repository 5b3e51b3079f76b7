"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
QUICK = ["top_terms", "known_terms", "weight_merge", "dedupe_merge", "eligibility", "urgency_order",
         "live_classify", "html_text", "observe", "run_diff", "board_nested", "page_postings",
         "list_postings", "company_postings", "facet_counts", "markdown_cards", "stream_observe", "full_run",
         "report_parts", "landed_run", "profile_summary", "company_files",
         "run_log", "landed_exports", "source_status", "open_flag", "parse_scores", "company_rank_all"]


def test_names():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert len(entry(spark).take(3)) == 3


@pytest.mark.parametrize("name", QUICK)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("nation customer supplier part orders lineitem events documents pages benchmark labels").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    cur = con.execute(oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(map(repr, cur.fetchall()))
    assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == want
