import html
import json
from datetime import date

from pyspark.sql import functions as F

from rolecast.operators import terms as T
from rolecast.operators.common import shared_dir
from rolecast.sources import boards as B, companies as C, jsonld as J, search as S, tables as M
from rolecast.sources.listing import with_requirements, with_sequence
from rolecast.sources.union import union_sources
from rolecast.streaming.observe import dedupe_stream

AS_OF = "2026-07-01"


def landed(spark, tmp_path, schema, *records, multi_line=False):
    path = tmp_path / "in.json"
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records))
    return B.split_corrupt(B.read_payloads(spark, str(path), schema, multi_line))


def test_nested_board_and_corrupt_records(spark, tmp_path):
    good, bad = landed(spark, tmp_path, B.NESTED_SCHEMA, {"slug": "acme-co", "jobs": [
        {"id": 1, "title": " Data Intern ", "content": "&lt;p&gt;Use Oboe&lt;/p&gt;",
         "location": {"name": "Remote"}, "absolute_url": "u", "updated_at": "2026-06-01T10:00:00-04:00"},
        {"id": 2, "title": "Engineer", "content": "full time"}]}, "{broken")
    r = B.nested_board(good, spark.createDataFrame([("zed", "Zed")], "slug string, name string")).collect()
    assert len(r) == 1 and bad.count() == 1
    r = r[0]
    assert (r["company"], r["title"], r["description_text"]) == ("Acme Co", "Data Intern", "Use Oboe")
    assert (r["posted_date"], r["work_mode"], r["source"]) == (date(2026, 6, 1), "remote", "greenhouse:acme-co")


def test_epoch_board(spark, tmp_path):
    good, _ = landed(
        spark, tmp_path, B.EPOCH_SCHEMA,
        {"slug": "z", "text": "Engineer", "categories": {"commitment": "Internship"}, "applyUrl": "a",
         "descriptionPlain": "", "description": "<b>hybrid</b>", "createdAt": 1780272000000},
        {"slug": "z", "text": "Intern", "workplaceType": "Orbit", "hostedUrl": "h", "applyUrl": "a"},
        {"slug": "z", "text": "Engineer", "categories": {"commitment": "Full"}})
    a, b = B.epoch_board(good).orderBy("title").collect()
    assert (a["posted_date"], a["work_mode"], a["apply_url"]) == (date(2026, 6, 1), "hybrid", "a")
    assert (b["work_mode"], b["apply_url"], b["posted_date"]) == ("unknown", "h", None)


def test_listed_board(spark, tmp_path):
    job = lambda **k: {"title": "Engineer", "employmentType": "Intern", **k}
    good, _ = landed(spark, tmp_path, B.LISTED_SCHEMA, {"slug": "q", "jobs": [
        job(id="1", isListed=False), job(id="2", isRemote=True), job(id="3", employmentType="Full")]})
    r = B.listed_board(good).collect()
    assert len(r) == 1 and r[0]["work_mode"] == "remote" and r[0]["level"] == "intern"


def test_user_export(spark, tmp_path):
    good, _ = landed(spark, tmp_path, B.EXPORT_SCHEMA, json.dumps([
        {"title": "Design Intern", "company": "Q", "posted_date": "Jun 1, 2026", "tagline": "t"},
        {"title": " ", "description": "intern"}, {"title": "Engineer"}]), multi_line=True)
    r = B.user_export(good).collect()
    assert len(r) == 1 and r[0]["is_startup"] and r[0]["posted_date"] == date(2026, 6, 1)


def test_nested_json_ld(spark):
    def one(title, **more):
        return {"@type": "JobPosting", "title": title, **more}

    deep = one("Deep Intern")
    for _ in range(9):
        deep = [deep]
    rows = [("graph in graph", {"@graph": [{"@graph": [one("A Intern"), {"@graph": [one("B Intern")]}]}]}),
            ("list in graph", {"@graph": [[one("C Intern")], [[one("D Intern")]]]}), ("nine lists", deep),
            ("posting with graph", one("E Intern", **{"@graph": [one("F Intern", validThrough="2026-01-01")]})),
            ("graph of no list", one("G Intern", **{"@graph": {"x": 1}}))]
    pages = spark.createDataFrame([(u, ld(json.dumps(b))) for u, b in rows], "url string, html string")
    got = sorted((r["apply_url"], r["title"][0]) for r in J.page_postings(pages).collect())
    assert got == [("graph in graph", "A"), ("graph in graph", "B"), ("graph of no list", "G"), ("list in graph", "C"),
                   ("list in graph", "D"), ("nine lists", "D"), ("posting with graph", "E"), ("posting with graph", "F")]
    flags = dict(pages.select("url", J.open_flag(F.col("html"), AS_OF)).collect())
    assert flags["posting with graph"] is False and flags["graph in graph"] is True
    assert pages.select(F.sum(J.unopened(F.col("html")))).first()[0] == 0
    assert pages.select(F.sum(J.unopened(F.col("html"), 3))).first()[0] > 0


def test_json_ld_nested_deeper_than_the_usual_steps(spark):
    lists, graphs = ({"@type": "JobPosting", "title": f"{x} Intern", "validThrough": "2026-01-01"} for x in "AB")
    for _ in range(40):
        lists, graphs = [lists], {"@graph": [graphs]}
    pages = spark.createDataFrame([("lists", ld(json.dumps(lists))), ("graphs", ld(json.dumps(graphs)))], "url string, html string")
    assert sorted((r["apply_url"], r["title"]) for r in J.page_postings(pages).collect()) == [("graphs", "B Intern"), ("lists", "A Intern")]
    assert [r[0] for r in pages.select(J.open_flag(F.col("html"), AS_OF)).collect()] == [False, False]


def ld(body):
    return f'<html><script type="application/ld+json">{body}</script></html>'


def test_json_ld(spark):
    one = {"@type": "JobPosting", "title": "Gallery Intern", "datePosted": "2026-05-04",
           "validThrough": "2026-11-20", "hiringOrganization": {"name": "Museo Lago", "url": "https://lago.example"},
           "jobLocation": {"address": {"addressLocality": "Lugano", "addressRegion": "TI", "addressCountry": "CH"}},
           "description": "Hang &lt;em&gt;prints&lt;/em&gt;"}
    rows = [("a", ld(json.dumps(one))), ("b", ld(json.dumps([[one]]))),
            ("c", ld(json.dumps({"@graph": [dict(one, **{"@type": ["X", "JobPosting"]}), {"@type": "Org"}]}))),
            ("d", ld('{"@type":"JobPosting", bad')), ("e", "no data"),
            ("f", ld(json.dumps({"@type": "JobPosting", "title": "Restorer", "employmentType": ["INTERN"],
                                 "hiringOrganization": "Atelier Nord", "jobLocationType": "TELECOMMUTE"}))),
            ("g", ld(json.dumps(dict(one, validThrough="2025-02-03")))),
            ("h", ld(json.dumps({"@type": "JobPosting", "title": "Registrar"})))]
    pages = spark.createDataFrame(rows, "url string, html string")
    got = {r["apply_url"]: r for r in J.page_postings(pages).collect()}
    assert set(got) == set("abcfg")
    a = got["a"]
    assert (a["company"], a["location"], a["deadline"]) == ("Museo Lago", "Lugano, TI, CH", date(2026, 11, 20))
    assert a["description_text"] == "Hang \nprints"
    assert (got["f"]["company"], got["f"]["location"]) == ("Atelier Nord", "Remote")
    flags = {r["url"]: r["x"] for r in pages.select(
        "url", J.open_flag(F.col("html"), AS_OF).alias("x")).collect()}
    assert flags == {"a": True, "b": True, "c": True, "d": None, "e": None, "f": True, "g": False, "h": None}
    loose = {r["apply_url"] for r in J.page_postings(pages, title_filter=False).collect()}
    assert loose == set("abcfgh")


MD = """# List
| Company | Role | Location | Application/Link | Date Posted |
| ------- | ---- | -------- | ---------------- | ----------- |
| [Fjord Ovens](https://fjord.example) | Glaze Intern | Bergen<br>Turku | <a href="https://simplify.jobs/q">q</a> <a href="https://kiln/7"><img src="k.svg"></a> | Jun 18 |
|  | Kiln Intern | Turku | soon | 3d |
| [Shut Kiln](https://shut.example) | Clay Intern | Bergen | ❌ | Jun 2 |
| ⤷ | Wheel Intern | Remote | [Go](https://kiln/9) | |
a line between
| Name | Colour |
|---|---|
| Fjord Ovens | blue |

| Company | Position |
|:--|--:|
| ↳ | Night firing |
| Lone Potter | Shop help |
"""


def test_markdown_tables(spark, tmp_path):
    (tmp_path / "l.md").write_text(MD)
    docs = M.read_documents(spark, str(tmp_path / "*.md")).withColumn("doc_id", F.lit("d/r"))
    got = M.list_postings(docs, AS_OF).orderBy("line_no").collect()
    assert [(r["company"], r["title"], r["apply_url"]) for r in got] == [
        ("Fjord Ovens", "Glaze Intern", "https://kiln/7"), ("Fjord Ovens", "Kiln Intern", "https://fjord.example"),
        ("Fjord Ovens", "Wheel Intern", "https://kiln/9"), ("Fjord Ovens", "Night firing", "https://fjord.example"),
        ("Lone Potter", "Shop help", "")]
    assert got[0]["location"] == "Bergen; Turku" and got[0]["source"] == "github:d/r"
    assert [r["posted_date"] for r in got][:3] == [date(2026, 6, 18), date(2026, 6, 28), None]


COMPANIES = [("Quill", "Acquired", True, "11", "Fall 2025"), ("Lumen", "Active", None, "17", "Fall 2025"),
             ("Harbor", "Active", True, "51", "Spring 2026"), ("Reed", "Active", True, "19", "Spring 2019"),
             ("Petal", "Active", True, "31", "Spring 2026"), ("Orchid", "Active", True, "50", "Fall 2025"),
             ("Moss", "Active", True, "many", "Fall 2021"), ("Fern", "Active", True, "2", None),
             ("Aspen", "Active", True, "31", "Spring 2026")]


def company_table(spark, rows):
    cols = "id string, slug string, name string, website string, url string, status string, " \
           "isHiring boolean, team_size string, batch string, one_liner string, long_description string, " \
           "selector_pos int"
    return spark.createDataFrame([(None, n.lower(), n, f"https://www.{n.lower()}.ai", "", s, h, t, b,
                                   f"about {n}", "", 0) for n, s, h, t, b in rows], cols)


def test_company_rank_and_slugs(spark):
    comp = C.distinct_companies(company_table(spark, COMPANIES + COMPANIES[4:5]))
    assert comp.count() == 9
    ranked = C.rank_companies(C.filter_companies(comp), 40).orderBy("company_rank").collect()
    assert [r["name"] for r in ranked] == ["Aspen", "Petal", "Orchid", "Fern", "Moss"]
    row = spark.createDataFrame([("north_kiln", "North Kiln Technologies", "http://www.northkiln.example/jobs")],
                                "s string, n string, w string")
    got = row.select(C.slug_candidates(F.col("s"), F.col("n"), F.col("w"))).first()[0]
    assert got == ["northkiln", "northkilntechnologies", "north-kiln-technologies"]


def test_profiles_and_boards(spark):
    comp = C.distinct_companies(company_table(spark, [COMPANIES[4], COMPANIES[5], COMPANIES[6]])).withColumn(
        "url", F.concat(F.lit("https://p/"), "slug"))
    payload = lambda *jobs: '<div data-page="%s"></div>' % html.escape(json.dumps(
        {"props": {"company": {"name": "Petal Press", "batch": "S25", "team_size": 31}, "jobPostings": list(jobs)}}))
    job = {"title": "Eng Intern", "url": "/j/1", "createdAt": "5 days", "skills": ["Go"], "location": "Remote"}
    pages = spark.createDataFrame([
        ("https://p/petal", payload(job, dict(job, isIncomplete=True))),
        ("https://p/orchid", payload({"title": "Engineer"})), ("https://p/moss", "<p>none</p>")],
        "url string, html string")
    profiles = C.profile_jobs(comp, pages, AS_OF)
    r = profiles[0].first()
    assert (r["company"], r["funding_stage"]) == ("Petal Press", "YC S25 · 31-person team")
    assert (r["apply_url"], r["posted_date"]) == ("https://www.ycombinator.com/j/1", date(2026, 6, 26))
    board = B.nested_board(spark.createDataFrame(
        [(s, [(1, "Data Intern", "", None, "u", None)]) for s in ("petal", "orchid", "moss")], B.NESTED_SCHEMA))
    ask = lambda **k: {(x["company"], x["source"]) for x in C.company_postings(
        comp, {"greenhouse": board}, profiles, **k).collect()}
    assert ask() == {("Petal Press", "yc:profile:petal"), ("Moss", "yc:greenhouse:moss")}
    assert ("Orchid", "yc:greenhouse:orchid") in ask(skip_boards_when_profile_has_jobs=False)
    assert ask(profile_first=False) == {(n, f"yc:greenhouse:{n.lower()}") for n in ("Petal", "Orchid", "Moss")}


def test_postings_come_out_company_by_company(spark):
    comp = C.distinct_companies(company_table(spark, COMPANIES[:4])).withColumn("slug", F.lit("shared"))
    jobs = [(i, "Data Intern", f"text {i}", None, f"u{i}", None) for i in range(50)]
    board = B.nested_board(spark.createDataFrame(
        [("shared", jobs[:30]), ("shared", jobs[30:]), (None, jobs[:2]), ("other", jobs[:3])], B.NESTED_SCHEMA))
    got = [(r["company_key"], r["apply_url"], r["company"], r["company_description"], r["funding_stage"])
           for r in C.company_postings(comp, {"greenhouse": board}).collect()]
    assert sorted(got) == sorted((n.lower(), f"u{i}", n, f"about {n}", f"YC {b} · {t}-person team")
                                 for n, _, _, t, b in COMPANIES[:4] for i in range(50))
    keys = [r[0] for r in got]
    assert 1 + sum(a != b for a, b in zip(keys, keys[1:])) == 4


def test_search_pages(spark):
    hit = lambda t, **k: dict({"title": t, "company_name": "F", "description": "intern"}, **k)
    pages = [{"query_pos": 0, "query": "q", "location": "US", "page": p, "startup_query": st, "jobs_results": js}
             for p, st, js in [(1, False, [hit("A", apply_options=[{"link": ""}, {"link": "l"}]), hit("B")]),
                               (2, False, [hit("C", share_link="s", detected_extensions={"posted_at": "3 days ago"})]),
                               (3, False, [hit("D")])]]
    pages.append(dict(pages[0], query_pos=1, query="q2", startup_query=True, jobs_results=[hit("E")]))
    df = spark.read.schema(S.SEARCH_SCHEMA).json(spark.sparkContext.parallelize(map(json.dumps, pages)))
    got = {r["title"]: r for r in S.search_postings(df, AS_OF).collect()}
    assert set(got) == set("ABCDE") and got["A"]["apply_url"] == "l" and got["C"]["apply_url"] == "s"
    assert got["C"]["posted_date"] == date(2026, 6, 28) and got["A"]["date_confidence"] == "unverified"
    assert got["A"]["is_startup"] is None and got["E"]["is_startup"]
    assert got["E"]["source"] == "serpapi:startup:google_jobs"
    assert {r["title"] for r in S.search_postings(df, AS_OF, 250, 2).collect()} == set("ABE")
    assert S.search_postings(df, AS_OF, 3).count() == 3
    assert {r["title"] for r in S.search_postings(df, AS_OF, **S.USUAL_CAPS).collect()} == set("ABCE")


def test_query_grid(spark):
    cfg = spark.createDataFrame([(1, "", [], "", "any", None), (2, "finance/ops", ["x"], "Fall", "Remote", ["A", "B", "C"])],
                                "profile_id long, target_role string, priority_keywords array<string>, "
                                "term string, remote_preference string, locations array<string>")
    assert {r["location"] for r in S.query_grid(cfg).collect() if r["profile_id"] == 2} == {"A", "B", "C"}
    grid = S.query_grid(cfg, **S.USUAL_GRID).collect()
    one = [r["query"] for r in sorted(grid, key=lambda r: r["query_pos"]) if r["profile_id"] == 1]
    assert one[0] == "internship" and "linkedin internship" in one and "startup internship" not in one
    assert {r["location"] for r in grid if r["profile_id"] == 2} == {"A", "B"}
    small = S.query_grid(cfg, {"general": ["Internship", "internship"], "startup": ["startup internship"]},
                         board_breadth=False, startup_breadth=True, max_locations=1)
    two = [(r["query"], r["startup_query"]) for r in small.where("profile_id = 2").orderBy("query_pos").collect()]
    assert two == [("finance ops Internship Fall remote", False), ("finance ops startup internship Fall remote", True)]


def test_union_sequence_and_requirements(spark):
    board = B.nested_board(spark.createDataFrame(
        [("a", [(1, "Data Intern", "Use Oboe and Piano", None, "u", None)])], B.NESTED_SCHEMA)).drop("slug")
    both = union_sources({"one": board, "two": board, "three": board}, allow=["one", "two"])
    rows = with_sequence(both)
    assert rows.select("ingest_seq").distinct().count() == 2
    got = with_requirements(rows, T.seed_lexicon(spark)).first()
    assert got["requirements"][:2] == ["piano", "oboe"]


def test_stream_dedupe(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(i % 5, f"2026-06-01 00:00:0{i % 10}") for i in range(20)], "key int, ts string"
                          ).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(src)
    stream = dedupe_stream(spark.readStream.schema("key int, ts timestamp").parquet(src), ["key"])
    out = str(tmp_path / "out")
    (stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", out)
     .trigger(availableNow=True).start().awaitTermination())
    assert sorted(r["key"] for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == shared_dir(spark)


def test_first_in_the_file_wins(spark):
    files = spark.createDataFrame([
        (0, '[{"id": "", "slug": "a", "name": "Zither"}, {"slug": "a", "name": "Alto"}, {"name": ""}]'),
        (1, '[{"slug": "a", "name": "Aaa"}, {"slug": "b", "name": "Bass"}]'), (2, "{broken"), (3, None)],
        "selector_pos long, body string")
    rows = C.company_rows(files, "id string, slug string, name string")
    got = {r["company_key"]: r["name"] for r in C.distinct_companies(rows).collect()}
    assert got == {"a": "Zither", "b": "Bass"}
    assert {r["name"] for r in C.distinct_companies(rows.drop("file_pos")).where("slug = 'a'").collect()} == {"Alto"}


def test_land_keeps_what_can_be_read(spark):
    from rolecast.plans.run import land

    board = B.nested_board(spark.createDataFrame(
        [("a", [(1, "Data Intern", "Use Oboe and Piano", None, "u", None)])], B.NESTED_SCHEMA)).drop("slug")

    def broken():
        raise OSError("gone")

    rows, status = land({"one": lambda: board, "two": broken}, T.seed_lexicon(spark), 3)
    assert status == [("one", 1, ""), ("two", -1, "gone")]
    assert [r["requirements"][:2] for r in rows.collect()] == [["piano", "oboe"]]
    assert land({"two": broken}, T.seed_lexicon(spark))[0] is None
    assert land({"one": lambda: board.limit(0)}, T.seed_lexicon(spark))[0].count() == 0


def test_query_grid_uses_all_cores_on_one_file(spark, tmp_path):
    from rolecast.catalog import QUERIES
    rows = [(i, "hot bolt", "Brand#1", "SMALL", 1, 1.0) for i in range(40)]
    (spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
     .coalesce(1).write.parquet(f"{tmp_path}/part.parquet"))
    grid = QUERIES["query_grid"](spark, str(tmp_path))
    assert grid.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert {r["n"] for r in grid.groupBy("profile_id").agg(F.count("*").alias("n")).collect()} == {54}


def test_query_grid_keeps_a_repeated_query_at_its_first_place(spark):
    cfg = spark.createDataFrame([(1, "Ops", None, None, None, [" A ", "", None])],
                                "profile_id long, target_role string, priority_keywords array<string>, "
                                "term string, remote_preference string, locations array<string>")
    grid = S.query_grid(cfg, {"general": ["x", "Y", "X", "y", "z"]}, board_breadth=False)
    assert [(r["query_pos"], r["query"], r["location"]) for r in grid.orderBy("query_pos").collect()] == [
        (0, "Ops x", "A"), (1, "Ops Y", "A"), (2, "Ops z", "A")]
