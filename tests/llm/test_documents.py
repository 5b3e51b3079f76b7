"""Document operators against brute force: nulls, empty and long texts, ties, repeated rows,
empty tables and further columns of clashing names."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rolecast.llm import leaks, packing, passages, ppm, shingles, suffixes, toxicity
from rolecast.llm import common
from rolecast.llm.common import components, dealt_join, fold_of, key_counts

SCHEMA = "doc_id long, text string, chunk string, score string, _row string, n string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _texts() -> list[tuple]:
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, long_passage, base = say(60), say(300), say(200)
    texts = [say(rng.randint(1, 120)) for _ in range(30)]
    texts += [f"{say(20)} {passage}\t{say(30)}" for _ in range(6)] + [passage, f"{passage} {passage}"]
    texts += [base, base, base.replace(" ", "\n", 3), base + " one more", base.upper(), say(5) + " " + base[:400]]
    words = base.split()
    for k in range(8):
        edited = list(words)
        for _ in range(k):
            edited[rng.randrange(len(edited))] = "zz"
        texts.append(" ".join(edited))
    texts += [say(4000) + " " + long_passage, long_passage + say(3000), "ab " * 500, "x" * 450, "y" * 99, "é ß 日本語 " * 40]
    texts += ["", None, None, "   ", "one", "two words", "a b c d", "a b c d", "\x0b\x0c tab\tbed", "<|endoftext|> Don't, STOP."]
    rows = [(i, t, "c", "s", "r", "n") for i, t in enumerate(texts)]
    rows += [rows[3], rows[31], (None, base, None, None, None, None), (None, None, None, None, None, None), (7, say(50), "", "", "", "")]
    rng.shuffle(rows)
    return rows


ROWS = _texts()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def data(text) -> bytes:
    return (text or "").encode()


def test_bytes_that_start_earlier(docs, nothing):
    order = lambda d: math.inf if d is None else d
    first = {}
    for d, t, *_ in ROWS:
        for i in range(len(data(t)) - 99):
            w = data(t)[i:i + 100]
            first[w] = min(first.get(w, (math.inf, math.inf)), (order(d), i))
    want = []
    for d, t, *_ in ROWS:
        b = data(t)
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if first[b[i:i + 100]] < (order(d), i):
                gone[i:i + 100] = b"\1" * 100
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        want.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    same(suffixes.without_repeats(docs).collect(), want)
    assert suffixes.without_repeats(nothing).collect() == []


def test_a_hot_passage_is_dealt_over_shards(spark):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8)
    own = lambda n: bytes(rng.choice(letters, n)).decode()
    passage, turns = own(400), [own(60) for _ in range(5)]
    texts = [own(120 + i % 7) + passage + turns[i % 5] + own(90) if i % 3 == 0 else own(300) for i in range(900)]
    first, want = {}, []
    for d, t in enumerate(texts):
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if first.setdefault(b[i:i + 100], (d, i)) != (d, i):
                gone[i:i + 100] = b"\1" * 100
        want.append((d, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))),
                     hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    same(suffixes.without_repeats(frame, hot=20).collect(), want)

    ids = pa.array(range(len(texts)), pa.int64())
    docs = pa.table({"chunk": pa.array([0] * len(texts), pa.int32()), "doc": ids, "row": ids, "doc_id": ids,
                     "text": pa.array([t.encode() for t in texts])})
    runs = pa.Table.from_batches(suffixes._runs(100, 1)(docs.select(["chunk", "doc", "row", "text"]).to_batches()))
    largest = {}
    for hot in (20, 10**9):
        shards = Counter()
        for r in suffixes._settle(100, 64)(docs, suffixes._judge(hot)(runs)).to_pylist():
            if r["kind"] == 2:
                shards[r["shard"]] += sum(r["s_n"])
        largest[hot] = max(shards.values()) / shards.total()
    assert largest[20] < 0.1 < largest[10**9]


def test_levels_find_what_a_dictionary_finds():
    import numpy as np

    rng = np.random.default_rng(1)
    levels, seen = suffixes.Levels(48), {}
    for batch in range(9):
        windows = np.repeat(rng.integers(0, 3, (300, 1), np.uint8), 48, 1)
        windows[:, 47] = rng.integers(0, 60, 300)
        doc, pos = np.full(300, batch), np.arange(300)
        later = levels.add(windows, doc, pos)
        for w, p, l in zip(windows, pos, later):
            assert l == (seen.setdefault(w.tobytes(), (batch, p)) < (batch, p))
    sizes = [len(x[0]) for x in levels.levels]
    assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))


def test_windows_that_occur_elsewhere(docs, nothing):
    words = [WORD.findall(data(t)) for _, t, *_ in ROWS]
    count = Counter(tuple(w[i:i + 35]) for w in words for i in range(len(w) - 34))
    want, texts = [], []
    for (d, t, *_), w in zip(ROWS, words):
        gone = bytearray(len(w))
        for i in range(len(w) - 34):
            if count[tuple(w[i:i + 35])] > 1:
                gone[i:i + 35] = b"\1" * 35
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
        texts.append((d, kept.decode() if sum(gone) else t or ""))
    out = passages.without_passages(docs, ["doc_id"], with_text=True)
    same(out.select("doc_id", "n_words", "n_removed", "kept_sha256").collect(), want)
    same(out.select("doc_id", "kept_text").collect(), texts)
    assert any(r["n_removed"] for r in out.collect())
    assert passages.without_passages(nothing, ["doc_id"]).collect() == []


def shingle_sets(texts, words):
    low = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    for t in texts:
        w = WORD.findall(data(t).translate(low))
        yield {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


@pytest.mark.parametrize("words,per_cent", [(4, 85), (5, 80)])
def test_similar_documents(docs, nothing, words, per_cent):
    sets = list(shingle_sets([t for _, t, *_ in ROWS], words))
    group = list(range(len(ROWS)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if shared and 100 * shared >= per_cent * (len(a) + len(sets[j]) - shared):
                group[find(i)] = find(j)
    low = defaultdict(list)
    for i, (d, *_) in enumerate(ROWS):
        low[find(i)].append(d)
    smallest = {g: min((d for d in ids if d is not None), default=None) for g, ids in low.items()}
    want = [(d, len(s), smallest[find(i)] if s else d) for i, ((d, *_), s) in enumerate(zip(ROWS, sets))]
    same(shingles.similar_documents(docs, words, per_cent).collect(), want)
    assert shingles.similar_documents(nothing, words, per_cent).collect() == []


def test_tokens_travel_by_bucket_not_by_chunk():
    """A block of texts of many chunks sends a row a bucket at most, and every chunk gets its shared tokens back."""
    texts = [t for _, t, *_ in ROWS]
    chunks, buckets, bits = list(range(len(ROWS))), 4, 40
    batch = pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array([data(t) for t in texts])], names=["chunk", "text"])
    rows = pa.Table.from_batches(shingles._send(4, bits, buckets)([batch]))
    assert 0 < rows.num_rows <= buckets and len(set(rows["bucket"].to_pylist())) == rows.num_rows
    owner, tokens = shingles._sets([data(t) for t in texts], 4)
    mine = defaultdict(set)
    for d, token in zip(owner.tolist(), tokens.tolist()):
        mine[d].add(token >> 64 - bits)
    seen = Counter(t for m in mine.values() for t in m)
    got = defaultdict(dict)
    for b in range(buckets):
        part = rows.filter(pa.array([x == b for x in rows["bucket"].to_pylist()]))
        for r in shingles._classes(part).to_pylist():
            keys = shingles.inflated(r["tokens"], r["n"], np.uint64).tolist()
            got[r["chunk"]].update(zip(keys, shingles.inflated(r["classes"], r["n"], np.uint8).tolist()))
    assert got == {d: {t: int(math.log2(seen[t])) for t in m if seen[t] > 1} for d, m in mine.items() if any(seen[t] > 1 for t in m)}


def test_one_document_of_each_group_stays(docs):
    kept = shingles.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = [tuple(r) for r in kept.collect()]
    sets = [s for s in shingle_sets([r[1] for r in rows], 5)]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            shared = len(a & b)
            assert not shared or 100 * shared < 80 * (len(a) + len(b) - shared)
    assert sum(not s for s in sets) == sum(not s for s in shingle_sets([t for _, t, *_ in ROWS], 5))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 102), (102, 101)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(61), 100, 101, 102, 500]], "node long")
    got = dict(components(nodes, links).collect())
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100, 500: 500}


def test_hot_keys_are_dealt_over_tasks(spark, monkeypatch):
    """A key with a third of the rows, and stars whose centers hold all links, low and high ids."""
    rows = spark.createDataFrame([(1 if i % 3 == 0 else i, i) for i in range(300)] + [(None, 5)], "k long, i long")
    right = spark.createDataFrame([(k, f"v{k}") for k in range(250)] + [(None, "none")], "k long, v string")
    joined = dealt_join(rows, right, "k", "i", key_counts(rows, "k"), floor=10, splits=8)
    same(joined.select("k", "i", "v").collect(),
         [(k, i, f"v{k}") for k, i in ((1 if i % 3 == 0 else i, i) for i in range(300)) if k < 250])
    salts = dealt_join(rows, right, "k", "i", key_counts(rows, "k"), floor=10, splits=8)._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in salts and "_salt" not in dealt_join(
        rows, right, "k", "i", key_counts(rows, "k"))._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    stars = [(0, i) for i in range(1, 40)] + [(i, 999) for i in range(100, 140)] + [(139, 200), (200, 201)]
    got = dict(components(spark.createDataFrame([(i,) for i in {x for p in stars for x in p}], "node long"),
                          spark.createDataFrame(stars, "a long, b long")).collect())
    assert got == {x: 0 if x < 40 else 100 for p in stars for x in p}


def test_groups_of_unlike_sets_are_dealt_in_blocks(spark, monkeypatch):
    """All texts share frequent shingles without being alike, and some few of them are: every block of a
    group meets every other one."""
    for name, value in (("GROUP_ROWS", 7), ("BODY_ROWS", 3), ("STARS", 0)):
        monkeypatch.setattr(shingles, name, value)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rng = random.Random(11)
    shared = [" ".join(f"s{k}w{j}" for j in range(4)) for k in range(12)]
    texts = [" ".join(rng.sample(shared, 9)) for _ in range(60)]
    texts += [t + " end" for t in texts[:20]]
    sets, group = list(shingle_sets(texts, 4)), list(range(80))
    for i, a in enumerate(sets):
        for j in range(i):
            shared_n = len(a & sets[j])
            if 100 * shared_n >= 85 * (len(a) + len(sets[j]) - shared_n):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    low = {g: min(i for i in range(80) if group[i] == g) for g in group}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    same(shingles.similar_documents(docs).collect(), [(i, len(s), low[group[i]]) for i, s in enumerate(sets)])
    assert 20 <= 80 - len(low)


def test_packing(docs, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(packing.tokenizer_json())
    rows = packing.packed_documents(docs, size=512).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append(r)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    want = Counter()
    for d, t, *_ in ROWS:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        for s in range(0, len(ids), 512):
            part = raw[4 * s:4 * (s + 512)]
            want[d, s, len(part) // 4, zlib.crc32(part), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    assert sum(r.length for r in rows) >= 0.9 * 512 * len(sequences)
    assert packing.packed_documents(nothing).collect() == []


def test_shortest_pack_first():
    assert packing.shortest_pack_first({8: 2, 5: 1, 3: 2, 1: 1}, 8) == [(1, [3, 1]), (1, [5, 3]), (2, [8])]
    assert packing.shortest_pack_first({}, 8) == []


@pytest.mark.parametrize("hot", [1, 300, 400, 800])
def test_a_hot_length_fills_packs(hot):
    counts = Counter({n: 1 + n % 3 for n in range(1, 3000, 7)})
    counts[hot] += counts.total() // 2
    packs = packing.shortest_pack_first(counts, 4096)
    placed = Counter()
    for times, lengths in packs:
        assert sum(lengths) <= 4096
        for n in lengths:
            placed[n] += times
    assert placed == counts
    tokens = sum(n * k for n, k in counts.items())
    assert tokens >= 0.95 * 4096 * sum(times for times, _ in packs)
    # One length alone: every pack but the last is full.
    assert sum(times for times, _ in packing.shortest_pack_first({hot: 10_000}, 4096)) == -(-10_000 // (4096 // hot))


@pytest.mark.parametrize("order", [2, 5])
def test_code_lengths(docs, nothing, order):
    low = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    words = [WORD.findall(data(t).translate(low)) for _, t, *_ in ROWS]
    train = [zlib.crc32(b"" if d is None else str(d).encode()) % 5 != 1 for d, *_ in ROWS]
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    tokens = Counter()
    raw = [b"\xfe" * order + b" ".join(w) + b"\xff" for w in words]
    for s, w, use in zip(raw, words, train):
        if use:
            tokens.update([*w, None])
            for i in range(order, len(s)):
                for k in range(order + 1):
                    counts[k][s[i - k:i]][s[i]] += 1
    total, distinct = sum(tokens.values()), len(tokens)

    def score(context, symbol):
        out, gone = 0.0, set()
        for k in range(order, -1, -1):
            seen = {s: n for s, n in counts[k].get(context[order - k:], {}).items() if s not in gone}
            if seen:
                n, d = sum(seen.values()), len(seen)
                if symbol in seen:
                    return out + math.log10(ppm.share(seen[symbol], n, d))
                out += math.log10(ppm.escape(n, d))
                gone |= set(seen)
        return out - math.log10(256 - len(gone))

    got = ppm.code_lengths(docs, fold_of(docs["doc_id"]) != 1, order).collect()
    want = []
    for (d, *_), s, w, use in zip(ROWS, raw, words, train):
        base = sum(math.log10((tokens[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in [*w, None])
        known = sum(tokens[x] > 0 for x in [*w, None])
        want.append((d, not use, len(w) + 1, known, total, base, sum(score(s[i - order:i], s[i]) for i in range(order, len(s)))))
    rank = lambda r: (r[0] is None, r[0] or 0, r[2], r[3], r[6])
    for a, b in zip(sorted(map(tuple, got), key=rank), sorted(want, key=rank), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-5)
    # The bytes after any context share a probability of one.
    for context in (b"\xfe" * order, b"ab" * order, b"qqqqqq"):
        assert sum(10 ** score(context[-order:], s) for s in range(256)) == pytest.approx(1)
    assert ppm.code_lengths(nothing, fold_of(nothing["doc_id"]) != 1).collect() == []


def test_items_in_documents(spark, docs, nothing):
    base = next(t for _, t, *_ in ROWS if t and len(t.split()) == 200)
    some = base.split()
    items = [(1, " ".join(some[20:60])), (2, " ".join(some[20:60]) + " other words that are not there " * 2), (3, "TWO words!"),
             (4, None), (5, ""), (6, "zz never seen at all in here"), (7, " ".join(some[:30]).upper()), (1, " ".join(some[20:60])),
             (8, " ".join(some[100:103])), (9, some[7]), (10, some[8] + " " + some[7] + " never")]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, row string")

    def cut(t):
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    def every(t):
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        return {tuple(w[i:i + n]) for n in range(1, 6) for i in range(len(w) - n + 1)}

    held, asked = [every(t) for _, t, *_ in ROWS], [cut(x) for _, x in items]
    want = [(r[0], i, len(h & a), len(a), len(h & a) / len(a)) for r, h in zip(ROWS, held) for (i, _), a in zip(items, asked)
            if a and 100 * len(h & a) >= 80 * len(a)]
    same(leaks.leaks(docs, table).collect(), want)
    assert {r[1] for r in want} >= {1, 3, 7, 8, 9} and 10 not in {r[1] for r in want}
    assert any(r[1] == 8 and len(every(t)) > 20 for r in want for d, t, *_ in ROWS if d == r[0])
    assert leaks.leaks(nothing, table).collect() == [] and leaks.leaks(docs, table.limit(0)).collect() == []
    clean = leaks.without_leaks(docs, table)
    assert clean.columns == docs.columns
    same(clean.collect(), [r for r, h in zip(ROWS, held) if not any(a and 100 * len(h & a) >= 80 * len(a) for a in asked)])


def test_toxicity_learns_pairs_of_terms(spark, nothing):
    rng = random.Random(3)
    plain = ["river", "stone", "tree", "road", "house", "lamp", "door"]
    rows, labels = [], []
    for i in range(1200):
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        words = rng.sample(plain, 4) + ["Wretch!"] * insult + ["townsfolk"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(insult and group)))
    rows += [(9000, None, "x"), (9001, "", "x"), (None, "wretch townsfolk", "x"), (5, rows[5][1], "x")]
    labels += [(None, 1), (9001, None), (7, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.fit(docs.select("doc_id", "text"), known, fold_of(known["doc_id"]) != 0)
    got = toxicity.scored(docs, machine, ["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 9000 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    wrong = sum(r.predicted != truth[r.doc_id] for r in held)
    assert wrong <= 0.02 * len(held)
    empty = [r for r in got if r.doc_id in (9000, 9001)]
    assert len({r.score for r in empty}) == 1 and all(0 <= r.score <= 1 for r in got)
    assert machine.score(*toxicity._terms([b"Wretch! townsfolk"], 18), 1)[0] > 0.5
    untaught = toxicity.fit(nothing.select("doc_id", "text"), known.limit(0), fold_of(known["doc_id"]) != 0)
    assert [r.predicted for r in toxicity.scored(docs.limit(3), untaught, ["doc_id"]).collect()] == [0, 0, 0]
    assert toxicity.scored(nothing, machine, ["doc_id"]).collect() == []


def _machine_of(texts, labels):
    owner, place = toxicity._terms(texts, 18)
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return toxicity.Machine(1 << 18).fit([place[i:j].astype(np.int32) for i, j in zip(cuts[:-1], cuts[1:])], labels)


def test_toxicity_of_exactly_one_of_two_words():
    """Neither word says anything alone, so only the pairwise part can learn it; chance labels keep nothing."""
    rng = np.random.default_rng(3)
    has = rng.random((4000, 2)) < 0.5
    texts = [" ".join([*rng.permutation([*(f"w{i}" for i in rng.integers(0, 400, 30)), *np.array(["alpha", "beta"])[h]])]).encode()
             for h in has]
    labels = (has[:, 0] != has[:, 1]).astype(float)
    machine = _machine_of(texts[:3000], labels[:3000])
    got = machine.score(*toxicity._terms(texts[3000:], 18), 1000) >= 0.5
    assert len(machine.w) < 10 and (got == (labels[3000:] > 0)).mean() > 0.98
    assert len(_machine_of(texts, (rng.random(4000) < 0.2).astype(float)).w) == 0


def test_fitting_takes_little_memory_beside_its_terms(monkeypatch):
    """The driver holds the terms once, and few copies of them while it counts; they reach it compressed."""
    rng = np.random.default_rng(4)
    terms = [np.sort(rng.choice(1 << 11, 600, replace=False)).astype(np.int32) for _ in range(6000)]
    toxic = (rng.random(6000) < 0.3).astype(float)
    monkeypatch.setattr(toxicity, "PAIR_TERMS", 64)
    tracemalloc.start()
    toxicity.Machine(1 << 11, 3).fit(terms, toxic, epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * sum(t.nbytes for t in terms)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 4000, 400)) for _ in range(200)]
    rows = pa.RecordBatch.from_arrays([pa.array([0] * 200, pa.int32()), pa.array([t.encode() for t in texts])], ["toxic", "text"])
    sent = sum(len(x.as_py()) for b in toxicity._features(18)([rows]) for x in b.column(b.num_columns - 1))
    assert sent < 2.5 * len(toxicity._terms([t.encode() for t in texts], 18)[1])


def test_sample_meets_in_one_order(spark):
    """Terms and labels come back whole and in one order, empty and repeated ones too, however the rows were dealt."""
    texts = [(0, "b a"), (1, "a"), (1, ""), (0, None), (1, "a b"), (0, "a"), (0, " ".join(f"w{i}" for i in range(900))), (1, "a")]
    got = []
    for parts in (1, 5):
        rows = spark.createDataFrame(texts, "toxic int, text string").repartition(parts)
        rows = rows.select("toxic", F.col("text").cast("binary").alias("text"))
        terms, toxic = toxicity._collected(rows.mapInArrow(toxicity._features(18), "toxic int, n int, terms binary"))
        got.append([(t.tobytes(), y) for t, y in zip(terms, toxic.tolist())])
    want = [(toxicity._terms([(t or "").encode()], 18)[1].astype(np.int32).tobytes(), float(y)) for y, t in texts]
    assert got[0] == got[1] == sorted(want)


def test_pairs_and_scores_against_brute_force(monkeypatch):
    """Pairs that tell more together, by a table of their four cells; scores, by the sum over all pairs."""
    rng = np.random.default_rng(9)
    has = rng.random((1500, 12)) < 0.4
    toxic = (has[:, 2] != has[:, 9]).astype(float)
    terms = [np.flatnonzero(row).astype(np.int32) for row in has]
    df, hits = has.sum(0), (has * toxic[:, None]).sum(0)

    def told(cells):
        total = 0.0
        for cell in cells:
            for value, share in ((1, toxic.mean()), (0, 1 - toxic.mean())):
                seen = (toxic[cell] == value).sum()
                total += 2 * seen * math.log(seen / (cell.sum() * share)) if seen else 0
        return total

    least = max(toxicity.PAIR_EVIDENCE, toxicity.PAIR_SHARE * -2 * sum(
        1500 * p * math.log(p) for p in (toxic.mean(), 1 - toxic.mean())))
    want = set()
    for i in range(12):
        for j in range(i):
            a, b = has[:, i], has[:, j]
            # A term alone counts the documents that hold it.
            if told([a & b, a & ~b, b & ~a, ~a & ~b]) - told([a]) - told([b]) >= least:
                want |= {i, j}
    for strip in (1, 5, 512):
        monkeypatch.setattr(toxicity, "STRIP", strip)
        assert set(toxicity._telling_together(terms, toxic, df, hits, 5).tolist()) == want == {2, 9}
    machine = toxicity.Machine(12, 3)
    machine.kept, machine.bias = np.array([0, 1, -1, 2, 3, -1, 4, 5, 6, 7, 8, 9], np.int32), -0.3
    machine.w, machine.v = rng.normal(size=10), rng.normal(size=(10, 3))
    owner, place = np.repeat(np.arange(100), [len(t) for t in terms[:100]]), np.concatenate(terms[:100])
    for got, t in zip(machine.score(owner, place, 100), terms):
        k = [x for x in machine.kept[t] if x >= 0]
        z = machine.bias + sum(machine.w[x] for x in k) + sum(
            machine.v[a] @ machine.v[b] for n, a in enumerate(k) for b in k[:n])
        assert got == pytest.approx(1 / (1 + math.exp(-max(-50, min(50, z)))))


def test_ids_of_all_code_points():
    """Ids by words are those of the tokenizer for every code point, beside marks and punctuation."""
    from tokenizers import Tokenizer

    tokenizer, seen = Tokenizer.from_str(packing.tokenizer_json()), {}
    points = [chr(c) for c in range(32, 0x20000) if not 0xD800 <= c < 0xE000]
    texts = [f.format(c) for f in ("a{}\u0327\u0301", "{}.", "x{}\u0323\u0301 y") for c in points]
    for at in range(0, len(texts), 5000):
        some = texts[at:at + 5000]
        words = [packing._words(t.encode()) for t in some]
        packing._learn(set().union(*words), tokenizer, seen)
        want = tokenizer.encode_batch_fast(some, add_special_tokens=False)
        wrong = [t for t, w, e in zip(some, words, want) if b"".join(seen[x] for x in w) != np.array(e.ids, "<u4").tobytes()]
        assert not wrong, [[hex(ord(c)) for c in t] for t in wrong[:5]]
