"""Vectors, pages, conversations, the pipeline, and the registered queries."""

import gzip
import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rolecast.llm import chat, vectors, warc
from rolecast.llm.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def _vectors() -> list[tuple]:
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, 16))
    rows = []
    for i in range(400):
        c = centers[i % 12] + rng.normal(size=16) * (0.02 if i % 3 else 0.25)
        rows.append((i, c.tolist(), i % 12 % 5))
    rows += [(1000 + i, rows[0][1], 0) for i in range(40)] + [(1100, (2 * np.array(rows[0][1])).tolist(), 0)]
    rows += [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 0), (2003, [None] * 16, 0), (2004, [1.0], 0),
             (2005, rows[0][1], None), (2006, [], 0), (2007, [float("inf")] + [1.0] * 15, 0), (0, rows[0][1], 0), (None, rows[0][1], 0)]
    # Other lengths, in the band of the most common one and in others: compared among themselves.
    rows += [(3000, [1.0, 2.0, 3.0], 0), (3001, [2.0, 4.0, 6.0], 0), (3002, [1.0, 2.0, 3.0], 1), (3003, rows[0][1][:12], 0),
             (3004, rows[0][1][:12], 0), (3005, [1.0, 2.0], 0), (3006, [1.0], 0)]
    return rows


def test_near_vectors(spark):
    rows = _vectors()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, part string, id int")
    good = [i for i, (_, e, l) in enumerate(rows) if l is not None and e and None not in e
            and np.isfinite(e).all() and np.any(e)]
    x = np.array([rows[i][1] + [0.0] * (16 - len(rows[i][1])) for i in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.array([rows[i][2] * 100 + len(rows[i][1]) for i in good])
    near = (x @ x.T >= vectors.THRESHOLD) & (labels[:, None] == labels[None]) & ~np.eye(len(good), dtype=bool)
    group = {i: i for i in range(len(good))}

    def find(a):
        while group[a] != a:
            a = group[a]
        return a

    for a, b in zip(*np.nonzero(near)):
        group[find(a)] = find(b)
    low = {}
    for k, i in enumerate(good):
        if rows[i][0] is not None:
            low[find(k)] = min(low.get(find(k), 10 ** 9), rows[i][0])
    want = [(rows[i][0], int(near[k].sum()), low.get(find(k)), rows[i][0] == low.get(find(k))) for k, i in enumerate(good)]
    want += [(r[0], 0, r[0], True) for i, r in enumerate(rows) if i not in set(good)]
    got = [tuple(r) for r in vectors.near_vectors(table, margin=16.0).collect()]
    assert Counter(got) == Counter(want)
    # With the usual margin at least nine of ten links are found, and none is made up.
    usual = vectors.near_vectors(table).agg({"n_links": "sum"}).first()[0]
    assert 0.9 * near.sum() <= usual <= near.sum()
    assert vectors.near_vectors(table.limit(0)).collect() == []


def test_records_are_written_and_read_back(spark, tmp_path):
    rng = random.Random(1)
    big, page = "".join(rng.choice("abc\r\n é") for _ in range(5000)), "<html>" + "p" * 200
    rows = [(3, "http://x/ü\r\n", page), (1, None, page), (2, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""),
            (7, "u", big), (8, "u", big), (1, None, page), (None, "u", big), (9, "u", "WARC/1.1\r\n\r\n" * 20)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_id string").repartition(3)
    typed = warc.typed(table, "page_id", "url", "html")
    manifest = warc.write_archives(typed, str(tmp_path), chunk=1000, archive_bytes=2000)
    chunks = warc.read_chunks(manifest, chunk=700)
    payload = lambda h: (h or "").encode()
    first = {}
    for i, _, h in rows:
        if len(payload(h)) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    want = [(i, "revisit" if h in first and first[h] != i else "response", first[h] if h in first and first[h] != i else None,
             len(payload(h)), hashlib.sha256(payload(h)).hexdigest()) for i, _, h in rows]
    assert Counter(map(tuple, warc.records(chunks).collect())) == Counter(want)
    assert manifest.count() > 1 and manifest.agg({"n_records": "sum"}).first()[0] == len(rows)
    # A payload comes in chunks, each with the digest so far.
    parts = sorted((r.chunk_no, r.data, r.payload_digest) for r in chunks.where("record_id = 7").collect())
    assert [len(d) for _, d, _ in parts[:-1]] == [700] * (len(parts) - 1)
    so_far = b""
    for _, d, digest in parts:
        so_far += d
        assert hashlib.sha256(so_far).hexdigest() == digest
    assert so_far == big.encode()
    raw = gzip.decompress(open(manifest.first()["path"], "rb").read())
    assert raw.startswith(b"WARC/1.1\r\n") and b"WARC-Type: " in raw
    empty = warc.write_archives(warc.typed(table.limit(0), "page_id", "url", "html"), str(tmp_path))
    assert warc.records(warc.read_chunks(empty)).collect() == []


def test_chunks_out_of_order_are_refused(spark, tmp_path):
    table = spark.createDataFrame([(1, "u", "a" * 3000)], "page_id long, url string, html string").coalesce(1)
    rows = warc.chunked(warc.typed(table, "page_id", "url", "html"), 1000).coalesce(1).orderBy("chunk_no").collect()
    rows[1], rows[2] = rows[2], rows[1]

    changed = [r.asDict() for r in rows]
    changed[1]["data"] = b"b" * 1000
    with pytest.raises(ValueError, match="digest"):
        list(warc._writer(str(tmp_path), 1 << 20, warc.DATE)([pa.RecordBatch.from_pylist(changed)]))


def _blocks():
    ask, say = "Where is the old mill by the water?", "It stands below the bridge. You can walk there in an hour."
    rows = []
    for c in range(60):
        rows += [(c, 0, "system", "System: Keep to the point.")] * (c % 2)
        rows += [(c, 1, "user", f"User: {ask}"), (c, 2, "assistant", f"Assistant: {say}\nMind the gate."),
                 (c, 3, "user", ask if c % 7 == 0 else f"[user] {ask}"), (c, 4, "assistant", f"### Assistant\n{say}")]
    return rows


def test_roles_are_recovered(spark):
    rows = _blocks()
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, block long, role string, text string, segment string")
    model = chat.counted(table)
    got = chat.turns(table.drop("role"), model).collect()
    assert sorted((int(r.conv), r.turn, r.role) for r in got) == sorted((c, b - (c % 2 == 0), role) for c, b, role, _ in rows)
    second = next(r for r in got if r.conv == "3" and r.turn == 2)
    assert second.rendered == "<|assistant|>\nIt stands below the bridge. You can walk there in an hour.\nMind the gate.\n<|end|>"
    assert second.n_lines == 2
    # Nulls, blank texts, markers in the text, one cell with a whole transcript.
    odd = spark.createDataFrame([(None, None, "User: Where is the <|end|> of the road?"), (None, 1, "System: Keep to the point."), (8, 0, None), (9, 0, " \n\n"),
                                 (10, 0, "User: Where is the old mill by the water?\nAssistant: It stands below the bridge, an hour on foot."
                                  "\n\nHuman: Where is the bridge by the water?")],
                                "conv_id long, block long, text string")
    out = {(r.conv, r.turn): (r.role, r.rendered) for r in chat.turns(odd, model).collect()}
    assert out["", 1] == ("user", "<|user|>\nWhere is the < |end|> of the road?\n<|end|>") and out["", 0][0] == "system"
    assert [out["10", t][0] for t in range(3)] == ["user", "assistant", "user"]
    assert {k[0] for k in out} == {"", "10"}
    # Blank lines inside a turn are text; those around it are not.
    gaps = spark.createDataFrame([(1, 0, "\n\nUser: Where is the mill by the water?\n\n\nAssistant: It stands below the bridge.\n\n"
                                   "  if x:\n\n\n  y\nMind the gate.\n\n")], "conv_id long, block long, text string")
    spaced = chat.counted(table.withColumn("text", F.replace("text", F.lit("\nMind"), F.lit("\n\nand\n\nso\nMind"))))
    out = {r.turn: r.text for r in chat.turns(gaps, spaced).collect()}
    assert out == {0: "Where is the mill by the water?", 1: "It stands below the bridge.\n\n  if x:\n\n\n  y\nMind the gate."}
    assert chat.turns(odd.limit(0), model).collect() == []


def test_best_path_against_all_paths():
    """Viterbi, whole and over segments joined by their matrices, against every path of states."""
    rng = np.random.default_rng(4)
    n, log = chat.STATES, lambda a: np.log(a / a.sum(-1, keepdims=True))
    model = chat.Model(log(rng.random(n)), log(rng.random((n, n))), log(rng.random((n, chat.SYMBOLS))))

    def score(path, symbols):
        total = model.start[path[0]] + model.emit[path[0], symbols[0]]
        for a, b, x in zip(path, path[1:], symbols[1:]):
            total += model.move[a, b] + model.emit[b, x]
        return total

    for length in (1, 2, 5):
        symbols = rng.integers(0, chat.SYMBOLS, length)
        best = max(itertools.product(range(n), repeat=length), key=lambda p: score(p, symbols))
        assert model.states(symbols, -1, -1).tolist() == list(best)
        cut = length // 2
        if not cut:
            continue
        parts = [symbols[:cut], symbols[cut:]]
        table = pa.table({"conv": ["c", "c"], "segment": pa.array([1, 0], pa.int64()),
                          "matrix": [model.matrix(p, False).tobytes() for p in parts[::-1]],
                          "opening": [model.matrix(p, True).tobytes() for p in parts[::-1]]})
        border = chat._borders(model)(table).to_pylist()
        joined = [int(s) for p, b in zip(parts, border) for s in model.states(p, b["first"], b["last"])]
        assert joined == list(best)


def test_segments_decode_as_one(spark, monkeypatch):
    rows = [(1, i, "user" if i % 2 else "assistant", f"line {i}" if i % 5 == 0 else ("Q: hm?" if i % 2 else "A: yes it is\nand more"))
            for i in range(120)]
    table = spark.createDataFrame(rows, "conv_id long, block long, role string, text string")
    model = chat.counted(table)
    whole = sorted(map(tuple, chat.turns(table, model).collect()))
    monkeypatch.setattr(chat, "SEGMENT_BLOCKS", 7)
    assert sorted(map(tuple, chat.turns(table, model).collect())) == whole


def test_null_ids_and_blocks_are_cut_into_segments(spark, tmp_path):
    rows = [(None, None if i % 2 else i % 3, "user" if i % 3 else "assistant", f"User: is it {i:04}?" if i % 3 else f"It is {i:04}.")
            for i in range(1700)]
    table = spark.createDataFrame(rows, "conv_id long, block long, role string, text string")
    sizes = chat._keyed(table.drop("role")).groupBy("conv", "segment").count().collect()
    assert sum(r["count"] for r in sizes) == 1700 and max(r["count"] for r in sizes) <= chat.SEGMENT_BLOCKS
    known = [(c, t, role, text) for c in range(40) for t, (role, text) in enumerate(
        [("user", "Where is the old mill?"), ("assistant", "It stands below the bridge."), ("user", "And the inn?")])]
    known += [(None, t, role, text) for t, (role, text) in enumerate([("user", "Is it late?"), ("assistant", "It is.")])]
    spark.createDataFrame(known, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = chat.op7_chat(spark, str(tmp_path)).collect()
    assert {r.conv_id for r in got} == {None, *range(40)}


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = docs
    # Names that the operators use themselves, and names that need quotes.
    for c in ("predicted", "score", "null_text", "_row", "c3", "a.b", "rest", "doc id", "component_id"):
        docs = docs.withColumn(c, F.concat(F.lit(f"{c} of "), "doc_id"))
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), name)
        assert docs.columns == columns
        assert docs.where("`a.b` <> concat('a.b of ', doc_id) OR score <> concat('score of ', doc_id)").isEmpty()
        plain = corpus_pipeline.stored(stage(spark, plain, SF), name)
        assert Counter(map(tuple, plain.collect())) == Counter(map(tuple, docs.select(plain.columns).collect()))
        after = docs.count()
        assert 0 < after <= before
        before = after
    pieces = corpus_pipeline.packed(spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == after
    assert pieces.groupBy("sequence_id").sum("length").selectExpr("max(`sum(length)`)").first()[0] <= 4096
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == []


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_agree_with_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(map(tuple, df.select(*names).collect())) == Counter(cursor.fetchall())
