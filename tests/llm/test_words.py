"""Ranked search, spelling variants and personal data against brute force: nulls, empty and long
texts, ties, repeated rows, empty tables and further columns of clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from rolecast.llm import common, personal, search, spelling
from rolecast.operators import common as operators

SCHEMA = "doc_id long, text string, row string, word string, spans string, item string, score string"
REST = ("r", "w", "s", "i", "x")
TERM = re.compile(search.TERM)


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def lowered(text):
    return (text or "").encode().lower().decode()


# ---- ranked search ---------------------------------------------------------------------------

def _corpus():
    rng = random.Random(11)
    rare = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(400)]
    often = ["the", "of", "and", "In", "ÜBER", "über", "x1", "日本"]
    say = lambda n: " ".join(rng.choice(often if rng.random() < 0.7 else rare) for _ in range(n))
    texts = [say(rng.randint(1, 90)) for _ in range(500)] + [say(5000)]
    texts += [texts[3]] * 40 + ["the of and"] * 30 + ["", None, "!!! ...", "the", "THE the The"]
    rows = [(i, t, *REST) for i, t in enumerate(texts)] + [(None, texts[7], *REST), (5, texts[5], *REST), (None, None, *REST)]
    items = [(i, " ".join(rng.sample(texts[rng.randrange(500)].split() * 3, 3)) + " " + say(6), "c") for i in range(25)]
    items += [(90, "the of", "c"), (91, "", "c"), (92, None, "c"), (93, "qqqq unknown", "c"), (94, texts[3], "c"),
              (94, texts[3], "c"), (None, "über 日本", "c"), (95, say(400), "c")]
    rng.shuffle(rows)
    return rows, items


def _ranked(rows, items, k=10):
    docs = [(d, TERM.findall(lowered(t))) for d, t, *_ in rows]
    docs = [(d, w, Counter(w)) for d, w in docs if w]
    n, length = len(docs), sum(len(w) for _, w, _ in docs)
    df = Counter(t for _, _, c in docs for t in c)
    out = []
    for item, text, *_ in items:
        asked, scored = set(TERM.findall(lowered(text))), []
        for d, w, c in docs:
            m = 10 + 90 * len(w) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
                    for t in asked if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("group_terms", [search.GROUP_TERMS, 150])
def test_ranked_search(spark, group_terms):
    rows, items = _corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string, term string")
    got = search.search(docs, asked, group_terms=group_terms).select("item_id", "rank", "doc_id", "score").collect()
    same(got, _ranked(rows, items))


def test_ranked_search_of_nothing(spark):
    rows, items = _corpus()
    docs, asked = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string, term string")
    assert search.search(docs.limit(0), asked).count() == 0
    assert search.search(docs, asked.limit(0)).count() == 0


def test_pair_bound_is_a_bound_and_tighter():
    rng = random.Random(2)
    docs = [{t: rng.randint(1, 100) for t in range(8) if rng.random() < 0.4} for _ in range(60)]
    tops = {t: max(d.get(t, 0) for d in docs) for t in range(8)}
    joints = {(a, b): max((d[a] + d[b] for d in docs if a in d and b in d), default=0) for a in range(8) for b in range(a + 1, 8)}
    tighter = 0
    for n in range(1, 9):
        for _ in range(20):
            some = rng.sample(range(8), n)
            bound = search.combined_bound(tops, joints, some)
            assert max(sum(d.get(t, 0) for t in some) for d in docs) <= bound <= sum(tops[t] for t in some)
            tighter += bound < sum(tops[t] for t in some)
    assert tighter > 50


def test_documents_are_skipped(spark):
    """Bounds leave most documents out, and pairs leave out more than single terms do."""
    rows, items = _corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    asked = spark.createDataFrame(items[:20], "item_id long, text string, term string")
    seen = []
    whole = search._Group.scores

    def counting(self, pairs):
        seen.append(pairs.count())
        return whole(self, pairs)

    search._Group.scores = counting
    try:
        search.search(docs, asked).collect()
    finally:
        search._Group.scores = whole
    assert seen[-1] < 20 * len(rows) / 2


# ---- spelling variants -----------------------------------------------------------------------

def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _variants(counts):
    near = {w: [v for v in counts if _near(w, v)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def _counted(rows):
    counts = Counter()
    for d, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def _typos(rng, word, letters):
    i = rng.randrange(len(word) + 1)
    return rng.choice([word[:i] + rng.choice(letters) + word[i:], word[:i] + word[i + 1:],
                       word[:i] + rng.choice(letters) + word[i + 1:]])


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_variants_of_documents(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abÉéñß") for _ in range(rng.randint(6, 9))) for _ in range(120)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa"]
    words = base + [_typos(rng, rng.choice(base), "abÉéñßÿ×") for _ in range(300)]
    weights = [rng.choice([1, 2, 10, 80, 400]) for _ in words]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(0, 200))) for _ in range(300)]
    texts += [texts[0]] * 30 + ["Aaaaaa AAAAAA aaaaaa-aaaaaa_aaaaaa1aaaaaa"] * 3 + ["", None, "q" * 5000 + " " + "q" * 4999] * 6
    rows = [(i, t, *REST) for i, t in enumerate(texts)] + [(None, texts[1], *REST), (4, texts[4], *REST), (None, None, *REST)]
    got = spelling.variants(spelling.words_of(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert got.columns == COLUMNS
    want = _variants(_counted(rows))
    assert sum(w[4] > 0 for w in want) > 50 and any(w[1] is not None and w[2] != w[1] for w in want)
    same(got.collect(), want)
    assert spelling.variants(spelling.words_of(spark.createDataFrame([], SCHEMA))).count() == 0
    assert spelling.variants(spelling.words_of(spark.createDataFrame([(1, "short", *REST)], SCHEMA))).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_variants_of_random_words(spark, seed):
    """Short alphabets give dense tries; any least length, hot prefixes and suffixes."""
    rng = random.Random(seed)
    letters = "ab" if seed % 2 else "abcde"
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(150)}
    words |= {"prefix" + w for w in rng.sample(sorted(words), 40)} | {w + "suffix" for w in rng.sample(sorted(words), 40)}
    counts = {w: rng.choice([5, 6, 30, 150, 1000]) for w in words}
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    same(got.collect(), _variants(counts))


def test_hot_nodes_are_spread(spark, monkeypatch):
    """The join of a table too large to broadcast gives the same."""
    rng = random.Random(9)
    words = {"hotprefix" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(200)}
    counts = {w: rng.choice([5, 50, 500]) for w in words}
    monkeypatch.setattr(spelling, "is_small", lambda df: False)
    same(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect(), _variants(counts))


def test_large_sides_are_not_broadcast(spark, monkeypatch):
    """Spark sizes a table by its compressed files and leaves an explode out: it would send the trie's prefixes whole
    through the driver. Only the bounded lists of hot keys may go there, all on the right of left joins."""
    plans = []
    monkeypatch.setattr(spelling, "is_small", lambda df: False)
    monkeypatch.setattr(operators, "is_small", lambda df: False)

    def stored(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return common.stored(df, name)

    monkeypatch.setattr(spelling, "stored", stored)
    counts = {"variant": 500, "varant": 5, "varianta": 50, "other": 7, "others": 90, "single": 5}
    out = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    plans.append(("out", out._jdf.queryExecution().executedPlan().toString()))
    same(out.collect(), _variants(counts))
    assert {"steps", "states", "near", "forms", "roots", "out"} <= {name for name, _ in plans}
    for name, plan in plans:
        for join in re.findall(r"BroadcastHashJoin (.*)", plan):
            assert "LeftOuter, BuildRight" in join and "_salt" not in join and "[word#" not in join, (name, join)


def test_trie_leaves_out_first_halves(spark):
    """Prefixes that no walk meets are no steps, and starts without other words below are none."""
    words = spark.createDataFrame([("abcdefgh", 9), ("abcdefgx", 9), ("xbcdefgh", 5), ("qrstuvwx", 5)], "word string, n long")
    steps, edges = spelling.trie(words)
    rows = steps.collect()
    assert all(r["depth"] >= (r["size"] - 1) // 2 for r in rows)
    assert {r["word"] for r in rows if r["depth"] == 4} == {"abcdefgh", "abcdefgx", "hgfedcba", "hgfedcbx"}
    assert sorted(r["label"] for r in edges.collect()) == ["a", "dcb", "efg", "h", "x", "x"]
    got = {(r["word"], r["near"]) for r in spelling.neighbours(words).collect()}
    assert got == {("abcdefgh", "abcdefgx"), ("abcdefgx", "abcdefgh"), ("abcdefgh", "xbcdefgh"), ("xbcdefgh", "abcdefgh")}


# ---- personal data ---------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(text):
    d = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def _base(text):
    text = text or ""
    n = lambda m: sum(c.isdigit() for c in m.group())
    found = {"email": list(EMAIL.finditer(text)),
             "ip": [m for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))],
             "card": [m for m in CARD.finditer(text) if 12 <= n(m) <= 19 and _luhn(m.group()) % 10 == 0],
             "phone": [m for m in PHONE.finditer(text) if 9 <= n(m) <= 15]}
    spans = sorted((m.start(), personal.KINDS.index(k), f"{k}:{m.start()}:{m.end()}") for k, ms in found.items() for m in ms)
    return [len(found[k]) for k in personal.BASE], [s[2] for s in spans]


def _odd_texts():
    rng = random.Random(4)
    parts = ["a.b@c.de", "x@y", "@", "a@b.c@d.e", "é@b.cc", "+1 (555) 010-9999", "+49 30 1234", "+1", "++12 345 678 901", "1.2.3.4",
             "1.2.3.4.5.6.7.8", "256.1.1.1", "0255.01.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111",
             "12", " ", "  ", "-", ".", "..", "日本", "\n", "http://u:p@h.example/x", "ssn: 123-45-6789", "iban DE89 3704 0044 0532 0130 00",
             "account no. 00123456", "x" * 50, "9" * 30, "+99999999999999999999", "(12)", "é", "0", "@@", "%+-@-.-", "\x00"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(1500)] + parts + [None, "", "+" * 3000 + "1" * 3000, "a" * 100000 + "@b.c"]


def test_personal_data(spark, tmp_path):
    texts = _odd_texts()
    rows = [(i, t, *REST) for i, t in enumerate(texts)] + [(None, "a@b.cd", *REST), (0, texts[0], *REST)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = personal.op13_personal(spark, str(tmp_path)).collect()
    want = []
    for d, t, *_ in rows:
        n, spans = _base(t)
        want.append((d, *n, hashlib.sha256(",".join(spans).encode()).hexdigest()))
    same([tuple(r)[:6] for r in got], want)
    for r in got:
        mine = [s for s in r["spans"].split(",") if s.split(":")[0] in personal.BASE]
        assert hashlib.sha256(",".join(mine).encode()).hexdigest() == r["base_sha256"]
    empty = spark.createDataFrame([], SCHEMA)
    assert personal.personal_data(empty, ["doc_id", "spans"]).count() == 0


def test_added_spans_and_masks(spark):
    text = "É see ftp://ann:pw@h.example:21/x, IBAN: DE89 3704 0044 0532 0130 00, passport no. X1234567, accountant 123456789, ssn 12."
    wrong = "iban DE89 3704 0044 0532 0130 01 accounts 12345678 http://plain.example/a"
    docs = spark.createDataFrame([(1, text), (2, wrong), (3, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in personal.personal_data(docs, ["doc_id", "text"], with_text=True).collect()}
    found = [(s["kind"], text[s["start"]:s["end"]]) for s in rows[1]["spans"]]
    assert found == [("login", "ftp://ann:pw@h.example:21"), ("email", "pw@h.example"), ("iban", "DE89 3704 0044 0532 0130 00"), ("account", "X1234567")]
    assert rows[1]["masked_text"] == "É see [login]/x, IBAN: [iban], passport no. [account], accountant 123456789, ssn 12."
    assert [s["kind"] for s in rows[2]["spans"]] == [] and rows[2]["masked_text"] == wrong
    assert rows[3]["spans"] == [] and rows[3]["masked_text"] is None
