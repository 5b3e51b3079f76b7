"""Prediction by partial matching over byte contexts, and the add-half word model beside it.

The byte model is a trie of contexts of up to `order` bytes, counted over all training
documents. Of n symbols with d distinct ones after a context, one seen c times has probability
(c - 1/2) / n, and any other escapes with d / 2n to the next shorter context, where the symbols
of the longer one are excluded. Since counts of a shorter context are sums over longer ones,
exclusion needs three numbers per context, n, d and x (how often its symbols follow the next
shorter context), and the code length of a byte depends on the last `order` bytes alone. So
each distinct gram of order + 1 bytes is scored once, by joins, and each chunk of documents gets
the scores of its own grams; the trie is never broadcast or held by one task.

The text that is scored: words [^\\x20\\x09-\\x0D]+ after A-Z are lower-cased, joined by one space, with an
end symbol (byte 255) after them; the contexts of the first bytes start with bytes 254. Neither
byte occurs in UTF-8. Where a context of no order was seen, the remaining bytes are equally
likely. Null and empty texts are the end alone. Words are compared by 64-bit hashes; scores of
grams travel as 32-bit floats.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rolecast.llm.common import BUCKET_BYTES, MB, chunk_of, fold_of, parts_of, stored, table, text_bytes
from rolecast.llm.kernels import (Lookup, U, blocks, bucket_slices, deflated, inflated, joined, mixed,
                                  packed, word_hashes)

ORDER = 5
CHUNK = 12 * MB
ASKED = "words boolean, bucket int, chunk int, n int, tokens long, keys binary, counts binary"
GIVEN = "chunk int, words boolean, n int, distinct long, keys binary, found binary"
_END, _PAD = b"\xff", b"\xfe"


def share(c, n, d):
    """The probability of a symbol seen c times, of n symbols with d distinct ones."""
    return (c - 0.5) / n


def escape(n, d):
    return d / (2 * n)


def _plain(text: bytes | None) -> bytes:
    return b" ".join((text or b"").lower().split())


def _grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram of order + 1 bytes that ends at each byte of each text, and at its end symbol;
    and where each text's grams start."""
    pad = _PAD * order
    buffer = np.frombuffer(b"".join(x for t in texts for x in (pad, t, _END)), np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    value = buffer.astype(U)
    gram = value[:len(value) - order].copy() if len(value) > order else value[:0]
    for i in range(1, order + 1):
        gram = (gram << U(8)) | value[i:len(value) - order + i]
    # Grams that end in the padding of the next text do not count.
    starts = np.concatenate(([0], np.cumsum(lengths + order)[:-1]))
    at = np.ones(len(gram), bool)
    for i in range(order):
        at[(starts[1:] - order + i)] = False
    return gram[at], np.concatenate(([0], np.cumsum(lengths)[:-1]))


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def _spread(grams: np.ndarray) -> np.ndarray:
    return mixed(grams + U(1))


def _ask(order: int, buckets: int):
    def run(docs: pa.Table) -> pa.Table:
        chunk, train = docs.column("chunk")[0].as_py(), np.array(docs.column("train").to_pylist(), bool)
        texts = [_plain(t) for t in docs.column("text").to_pylist()]
        words, grams, tokens = [], [], int(train.sum())
        for a, b in blocks(texts):
            mine = train[a:b]
            buffer, starts, ends = joined(texts[a:b])
            at, _, h = word_hashes(buffer)
            use = np.repeat(mine, np.searchsorted(at, ends) - np.searchsorted(at, starts))
            tokens += int(use.sum())
            g, first = _grams(texts[a:b], order)
            learnt = np.repeat(mine, np.diff(np.append(first, len(g))))
            for keys, some, out in ((h, use, words), (g, learnt, grams)):
                seen, n = np.unique(keys[some], return_counts=True)
                asked = np.unique(keys[~some])
                out += [(seen, n.astype(np.int64)), (asked, np.zeros(len(asked), np.int64))]
            if len(words) > 16:
                words, grams = [_counted(words)], [_counted(grams)]
        rows = []
        for is_word, parts in ((True, words), (False, grams)):
            keys, n = _counted(parts)
            if not is_word:
                spread = _spread(keys)
                order_ = np.argsort(spread)
                spread, keys, n = spread[order_], keys[order_], n[order_]
            else:
                spread = keys
            for b, s in bucket_slices(spread, buckets):
                # A bucket's grams go in their own order, whose differences are small.
                by = np.argsort(keys[s])
                rows.append((is_word, b, chunk, len(by), tokens, deflated(keys[s][by]), deflated(n[s][by])))
                tokens = 0
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 7, [
            pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()])],
            names=[x.split()[0] for x in ASKED.split(", ")])

    return run


def _open(t: pa.Table, column: str, kind) -> list[np.ndarray]:
    return [inflated(x, n, kind) for x, n in zip(t.column(column).to_pylist(), t.column("n").to_pylist())]


def _given(t: pa.Table, found: list[np.ndarray], distinct: int) -> pa.Table:
    size = t.num_rows
    return pa.table({"chunk": t.column("chunk"), "words": t.column("words"), "n": t.column("n"),
                     "distinct": pa.array([distinct] + [0] * (size - 1), pa.int64()), "keys": t.column("keys"),
                     "found": pa.array([pa.compress(packed(f), codec="zstd", asbytes=True) for f in found], pa.binary())})


def _word_counts(t: pa.Table) -> pa.Table:
    keys, counts = _open(t, "keys", U), _open(t, "counts", np.int64)
    known, n = _counted(list(zip(keys, counts)))
    return _given(t, [n[np.searchsorted(known, k)] for k in keys], int((n > 0).sum()))


def _gram_counts(t: pa.Table) -> pa.Table:
    keys, n = _counted(list(zip(_open(t, "keys", U), _open(t, "counts", np.int64))))
    return pa.table({"bucket": pa.array([t.column("bucket")[0].as_py()] * len(keys), pa.int32()),
                     "gram": pa.array(keys.astype(np.int64)), "c": pa.array(n)})


def _gram_scores(asked: pa.Table, scores: pa.Table) -> pa.Table:
    known = scores.column("gram").to_numpy().astype(U)
    order = np.argsort(known)
    known, score = known[order], scores.column("score").to_numpy()[order].astype(np.float32)
    return _given(asked, [score[np.searchsorted(known, k)] for k in _open(asked, "keys", U)], 0)


def gram_scores(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(bucket, gram, score): log10 of each gram's last byte after the others, for grams with
    training counts c (0: not in training)."""
    def low(c: str, k: int) -> Column:
        return F.col(c).bitwiseAND((1 << (8 * (k + 1))) - 1)

    counts, nodes = {}, {}
    counts[order] = stored(grams.where("c > 0").select(F.col("gram").alias("g"), "c"), "trie")
    for k in range(order - 1, -1, -1):
        counts[k] = stored(counts[k + 1].groupBy(low("g", k).alias("g")).agg(F.sum("c").alias("c")), "trie")
    for k in range(order + 1):
        rows = counts[k]
        if k:
            shorter = counts[k - 1].select(F.col("g").alias("s"), F.col("c").alias("x"))
            rows = rows.withColumn("s", low("g", k - 1)).join(shorter, "s")
        else:
            rows = rows.withColumn("x", F.lit(0).cast("long"))
        nodes[k] = stored(rows.groupBy(F.shiftrightunsigned("g", 8).alias("node")).agg(
            F.sum("c").alias("n"), F.count("*").alias("d"), F.sum("x").alias("x")), "nodes")
    rows = grams.withColumnRenamed("c", f"c{order}")
    for k in range(order, -1, -1):
        if k < order:
            rows = (rows.withColumn("g", low("gram", k))
                    .join(counts[k].withColumnRenamed("c", f"c{k}"), "g", "left").drop("g"))
        node = nodes[k].withColumnsRenamed({"n": f"n{k}", "d": f"d{k}", "x": f"x{k}"})
        rows = rows.withColumn("node", F.shiftrightunsigned(low("gram", k), 8)).join(node, "node", "left").drop("node")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    score = -F.log10(256 - zero("d0"))
    for k in range(order + 1):
        gone, known = (zero(f"x{k + 1}"), zero(f"d{k + 1}")) if k < order else (F.lit(0), F.lit(0))
        n, d = zero(f"n{k}") - gone, zero(f"d{k}") - known
        score = F.when(zero(f"c{k}") > 0, F.log10(share(F.col(f"c{k}"), n, d))).otherwise(
            F.when(d > 0, F.log10(escape(n, d))).otherwise(0.0) + score)
    return rows.select("bucket", "gram", score.alias("score"))


RESULT = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double")


def _score(order: int, total: int, distinct: int, ends: int):
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    below = np.log10(total + 0.5 * (distinct + 1))
    end_score, end_known = np.log10(ends + 0.5) - below, int(ends > 0)

    def run(docs: pa.Table, given: pa.Table) -> pa.Table:
        tables = {}
        for is_word, kind, missing in ((True, np.int64, 0), (False, np.float32, np.nan)):
            t = given.filter(pa.array([w is is_word for w in given.column("words").to_pylist()], pa.bool_()))
            keys = np.concatenate([np.zeros(0, U), *_open(t, "keys", U)])
            found = [np.frombuffer(pa.decompress(f, decompressed_size=n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)
                     for f, n in zip(t.column("found").to_pylist(), t.column("n").to_pylist())]
            tables[is_word] = Lookup(keys, np.concatenate([np.zeros(0, kind), *found]), missing)
        texts = [_plain(t) for t in docs.column("text").to_pylist()]
        out = []
        for a, b in blocks(texts):
            buffer, starts, ends_ = joined(texts[a:b])
            at, _, h = word_hashes(buffer)
            first = np.searchsorted(at, starts)
            c = tables[True](h)
            n = np.searchsorted(at, ends_) - first
            sums = np.concatenate(([0.0], np.cumsum(np.log10(c + 0.5) - below)))
            known = np.concatenate(([0], np.cumsum(c > 0)))
            g, start = _grams(texts[a:b], order)
            score = np.add.reduceat(tables[False](g).astype(np.float64), start)
            out.append((n + 1, known[first + n] - known[first] + end_known, sums[first + n] - sums[first] + end_score, score))
        n, known, base, score = (np.concatenate(x) for x in zip(*out))
        columns = [docs.column("doc_id"), docs.column("held_out"), n, known, np.full(len(n), total), base, score]
        return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c, t) for c, t in zip(columns, types)],
                        names=[x.split()[0] for x in RESULT.split(", ")])

    return run


def code_lengths(docs: DataFrame, train: Column, order: int = ORDER) -> DataFrame:
    """Scores of all documents by models of those where `train` holds; see `RESULT`."""
    if not 1 <= order <= 6:
        raise ValueError("order is 1 to 6, so that a gram fits 8 bytes")
    size = text_bytes(docs)
    chunks, buckets = parts_of(size, CHUNK), parts_of(size, BUCKET_BYTES)
    train = F.coalesce(train, F.lit(False))
    rows = docs.select(chunk_of(F.struct("doc_id", "text"), chunks).alias("chunk"), train.alias("train"),
                       F.col("text").cast("binary").alias("text"))
    asked = stored(rows.groupBy("chunk").applyInArrow(_ask(order, buckets), ASKED), "asked")
    words = stored(asked.where("words").groupBy("bucket").applyInArrow(_word_counts, GIVEN), "words")
    grams = asked.where("not words")
    counts = stored(grams.groupBy("bucket").applyInArrow(_gram_counts, "bucket int, gram long, c long"), "grams")
    scores = gram_scores(counts, order)
    given = grams.groupBy("bucket").cogroup(scores.groupBy("bucket")).applyInArrow(_gram_scores, GIVEN)
    ends = docs.where(train).count()
    total = asked.agg(F.sum("tokens")).first()[0] or 0
    distinct = (words.agg(F.sum("distinct")).first()[0] or 0) + (ends > 0)
    full = docs.select(chunk_of(F.struct("doc_id", "text"), chunks).alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"),
                       (~train).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return full.groupBy("chunk").cogroup(words.union(given).groupBy("chunk")).applyInArrow(
        _score(order, total, distinct, ends), RESULT)


def op4_ppm(spark, sf_dir):
    return code_lengths(table(spark, sf_dir, "documents"), fold_of(F.col("doc_id")) != 1)
