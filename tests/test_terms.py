import math
import re

import pytest
from pyspark.sql import functions as F

from rolecast import values as V
from rolecast.functions import text as X
from rolecast.operators import match as M, profile as P, terms as T

RESUME = """Robin Vale
robin@example.org | 555-0101

EDUCATION
B.S. in Mechanical Engineering, State College

RELEVANT COURSEWORK
Ear Training, Sight Reading

TECHNICAL SKILLS: Violin, G#
Piano, lab work

EXPERIENCE
Hardware Engineering Intern at Acme
Research Assistant, robotics lab

PROJECTS
Viola video filter
"""


@pytest.fixture(scope="module")
def vocab(spark):
    return T.seed_lexicon(spark), T.seed_synonyms(spark)


@pytest.fixture(scope="module")
def profiles(spark):
    return spark.createDataFrame([(1, RESUME, "Stage Sound", ["Strings"]), (2, "", "", [])],
                                 "profile_id long, text string, target_role string, "
                                 "priority_keywords array<string>")


@pytest.fixture(scope="module")
def weighted(profiles, vocab):
    return P.profile_terms(profiles, *vocab, stopwords=[*V.STOPWORDS, "intern"], top_n=V.TOP_TERMS).cache()


def test_synonyms_go_both_ways(spark):
    e = T.symmetric(spark.createDataFrame([("A ", "b"), ("c", "C")], "src string, dst string"))
    assert sorted(map(tuple, e.collect())) == [("a", "b"), ("b", "a")]


def test_exact_beats_synonym(spark, vocab):
    terms = spark.createDataFrame([(1, "violin")], "profile_id long, term string")
    w = {r["term"]: r["weight"] for r in T.expand_synonyms(terms, vocab[1], vocab[0]).collect()}
    assert w["violin"] == 1.3 and w["strings"] == 0.6 and w["viola"] == 0.78


def test_known_terms(spark, vocab):
    docs = spark.createDataFrame([(1, "Sight  reading"), (2, "sight reading in G#, not in G+."),
                                  (3, "Hi-hat cores")], "doc_id long, text string")
    got = sorted(map(tuple, T.known_terms(docs, vocab[0]).collect()))
    assert got == [(2, "g#"), (2, "sight reading"), (3, "hi-hat")]


def test_top_terms_order_and_weight(spark):
    docs = spark.createDataFrame([(1, "alpha beta\nalpha beta gamma")], "doc_id long, text string")
    got = [(r["term"], r["n"], r["weight"]) for r in T.top_terms(docs).orderBy("term_rank").collect()]
    assert got == [("alpha beta", 2, 0.81), ("alpha", 2, 0.69), ("beta", 2, 0.69),
                   ("beta gamma", 1, 0.69), ("gamma", 1, 0.57)]


def test_requirements(spark, vocab):
    docs = spark.createDataFrame([(1, "Own social media campaigns and choral singing with Harp")],
                                 "doc_id long, text string")
    got = T.requirements(docs, vocab[0], limit=18).first()["requirements"]
    assert got[:2] == ["choral singing", "harp"] and "social media" in got and len(got) <= 18


def test_profile_facts(profiles, vocab):
    p = P.parse_profiles(profiles, vocab[0]).orderBy("profile_id").collect()
    assert p[0]["name"] == "Robin Vale" and p[0]["degree"] == "BS"
    assert p[0]["major"].lower() == "mechanical engineering"
    assert "violin" in p[0]["tools_languages"] and "sight reading" in p[0]["coursework"]
    assert any("Intern" in t for t in p[0]["experience_titles"])
    assert p[0]["summary"].startswith("Candidate pursuing BS Mechanical Engineering.")
    assert p[1]["summary"] == "" and p[1]["skills"] == []


def test_header_line_keeps_what_follows_the_colon(profiles):
    r = P.split_sections(profiles).where("profile_id = 1").first()
    assert r["skills"] == "Violin, G#\nPiano, lab work"
    assert r["projects"] == "Viola video filter"


def test_profile_term_weights(weighted):
    w = {r["term"]: r["weight"] for r in weighted.where("profile_id = 1").collect()}
    assert w["stage sound"] == V.WEIGHT_ROLE and w["strings"] == V.WEIGHT_PRIORITY
    assert w["violin"] == V.WEIGHT_SECTION and w["fiddle"] == 0.6
    assert weighted.where("profile_id = 2").count() == 0


POSTS = [("a", "Strings Design Intern", "Violin on Viola boards.", []),
         ("b", "Marketing Intern", "Copywriting and branding.", []),
         ("c", "Strings Intern", "", []), ("d", "Intern", "Work in Fiddle", ["g#"])]


@pytest.fixture(scope="module")
def posts(spark):
    return spark.createDataFrame(POSTS, "posting_id string, title string, description_text string, "
                                        "requirements array<string>")


def brute(term, text):
    edge = "[A-Za-z0-9+#]"
    return re.search(f"(?<!{edge}){re.escape(term)}(?!{edge})", text, re.I) is not None


@pytest.mark.parametrize("small", [True, False])
def test_scores_equal_brute_force(weighted, posts, small):
    got = {r["posting_id"]: r for r in M.match_pairs(posts, weighted, small=small).collect()}
    terms = weighted.where("profile_id = 1").orderBy("term_rank").collect()
    for key, title, body, req in POSTS:
        s, ranks = 0.0, []
        for t in terms:
            hit_t, hit_b = brute(t["term"], title), brute(t["term"], body + " " + " ".join(req))
            if hit_t or hit_b:
                ranks.append(t["term_rank"])
                s += t["weight"] * (1.6 if hit_t else 1.0)
        score = 100 * (1 - math.exp(-s / 7))
        if not ranks:
            assert key not in got
            continue
        assert got[key]["match_score"] == round(min(score, 70.0) if not body else score)
        assert got[key]["matched_ranks"] == ranks


def test_relevant_beats_irrelevant(weighted, posts):
    pairs = M.match_pairs(posts, weighted)
    every = {r["posting_id"]: r["match_score"] for r in M.score_all_for(posts, pairs, 1).collect()}
    assert every["a"] > every["d"] > every["b"] and every["b"] == 0 and len(every) == 4


def test_term_lists(weighted, posts):
    rows = M.with_term_lists(M.match_pairs(posts, weighted), weighted, missing=6)
    r = rows.where("posting_id = 'c'").first()
    assert r["matched_keywords"] == ["strings"] and len(r["missing_keywords"]) <= 6
    assert "stage sound" in r["missing_keywords"]
    assert r["match_rationale"] == "Keyword match on: strings"


def test_external_scores(spark):
    raw = spark.createDataFrame([
        (1, "a", '```json\n{"score": 180, "rationale": " good ", "matched_skills": ["x"]}\n```'),
        (1, "b", 'Well: {"score": -4, "missing_skills": ["y"]} ok'), (1, "c", "sorry")],
        "profile_id long, key string, answer string")
    pairs = spark.createDataFrame([(1, k, 50, "own", ["m"], ["n"]) for k in "abcd"],
                                  "profile_id long, key string, match_score int, match_rationale string, "
                                  "matched_keywords array<string>, missing_keywords array<string>")
    got = {r["key"]: r for r in M.override_scores(pairs, M.parse_scores(raw), ["profile_id", "key"]).collect()}
    assert [got[k]["match_score"] for k in "abcd"] == [100, 0, 50, 50]
    assert got["a"]["match_rationale"] == "good" and got["a"]["matched_keywords"] == ["x"]
    assert got["b"]["missing_keywords"] == ["y"] and got["b"]["match_rationale"] == "own"


def test_scores_in_any_form(spark):
    answers = ["{\"score\": 85.0}", "{\"score\": \"85\"}", "{\"score\": 85.9}", "{\"score\": -3.7}", "{\"score\": null}",
               "{\"score\": \"high\"}", "{\"score\": bad}", "no answer", None, "{\"score\": 1e300}"]
    raw = spark.createDataFrame(list(enumerate(answers)), "i long, answer string")
    assert dict(M.parse_scores(raw).select("i", "score").collect()) == {
        0: 85, 1: 85, 2: 85, 3: -3, 4: None, 5: None, 9: None}
    assert sorted(r["i"] for r in M.unread_scores(raw).collect()) == [6, 7, 8]


def test_part_words_use_all_cores_on_one_file(spark, tmp_path):
    from rolecast.catalog import terms as CT
    rows = [(i, "hot bolt", "Brand#1", "SMALL") for i in range(40)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert CT.part_words(spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_anchors_are_left_out_in_their_cell(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "")], "doc_id long, text string")
    among = T.sketch(spark.createDataFrame([("waa",), ("wba wca",), (None,)], "term string"))
    got = {r[0]: r[1] for r in docs.select("doc_id", X.anchors(F.col("text"), among)).collect()}
    assert {"waa", "wba wca"} <= set(got[1]) and len(got[1]) < 60 and got[2] == got[3] == []
    for small in (True, False):
        lex = spark.createDataFrame([("waa",), ("wba wca",), ("wca wba",), ("wca wda wea",)], "term string")
        hits = T.known_terms(docs, lex, small=small).collect()
        assert sorted(map(tuple, hits)) == [(1, "waa"), (1, "wba wca"), (1, "wca wda wea")]


def test_counts_by_odd_lines_and_letters(spark):
    text = "Red Fox\u2028red fox\r\n\x85The FO\u212a fox-. \x1cred"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r["term"]: (r["n"], r["first_pos"]) for r in T.term_counts(docs, stopwords=["the"]).collect()}
    line, pair = 1 << 32, 1 << 31
    assert got == {"red": (3, 0), "fox": (3, 1), "red fox": (2, pair), "fok": (1, 3 * line), "fok fox": (1, 3 * line + pair)}
    ranked = [(r["term"], r["term_rank"]) for r in T.top_terms(docs, top_n=3, stopwords=["the"]).orderBy("term_rank").collect()]
    assert ranked == [("red", 1), ("fox", 2), ("red fox", 3)]


def test_pairs_are_summed_where_they_are_made(spark):
    posts = spark.createDataFrame([(1, "violin", "drum")], "posting_id long, title string, description_text string")
    terms = spark.createDataFrame([(7, "violin", 1.0, 1), (7, "drum", 0.5, 2)], "profile_id long, term string, weight double, term_rank int")
    pairs = M.match_pairs(posts, terms, small=True)
    assert "hashpartitioning(profile_id" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert [r["matched_ranks"] for r in pairs.collect()] == [[1, 2]]
