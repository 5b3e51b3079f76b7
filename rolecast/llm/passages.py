"""Repeated passages: windows of words that occur elsewhere are found, and removed.

1. Every window chooses its smallest word gram; equal windows choose equal grams. Grams
   chosen anywhere are routed by their hash, and those that recur go back to their chunk.
2. Windows over a recurring gram are routed by the hash of the whole window: the confirmed
   ones recur. A maximal run of confirmed windows is a recurring passage.
3. Each chunk compiles its passages, as windows that tile them, into Aho-Corasick automata
   over word numbers, a bounded number of words in each, and streams all its documents through
   them; what the automata locate is removed.

A chunk holds a bounded amount of text, so memory does not grow with the table; texts are
shuffled twice, keys as packed arrays. Word and window identity is a 64-bit hash.

Words are [^\\x20\\x09-\\x0D]+, unchanged; null and empty texts have none. A text shorter than
a window keeps all its words. Repeated rows are separate documents, so they remove each other.
"""

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rolecast.llm.common import BUCKET_BYTES, CHUNK_BYTES, chunk_of, parts_of, table, text_bytes
from rolecast.llm.kernels import Rolling, U, among, blocks, joined, mixed, ranges, window_minima, word_hashes
from rolecast.llm.routing import ROUTED, ROUTED_ARROW, even, recurring, returned, route

WINDOW = 35
SHARD_WORDS = 200_000   # words of the patterns in one automaton
RESULT = "n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string, kept_sha256 string"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


class _Block:
    """The words, chosen grams and windows of a block of documents."""

    def __init__(self, texts: list[bytes], window: int):
        self.window, self.gram = window, max(1, window // 3)
        buffer, starts, ends = joined(texts)
        at, _, self.words = word_hashes(buffer)
        self.first, self.last = np.searchsorted(at, starts), np.searchsorted(at, ends)
        self.rolling = Rolling(self.words)
        counts = np.maximum(0, self.last - self.first - window + 1)
        self.windows = ranges(self.first, counts)
        self.owner = np.repeat(np.arange(len(texts)), counts)

    def choose(self):
        i = np.arange(max(0, len(self.words) - self.gram + 1))
        grams = self.rolling.of(i, i + self.gram)
        self.chosen = window_minima(grams, self.window - self.gram + 1)[self.windows]
        # Chosen hashes are small, which would crowd a few buckets.
        self.grams = even(mixed(grams + U(1)))
        new = np.ones(len(self.chosen), bool)
        new[1:] = self.chosen[1:] != self.chosen[:-1]
        return self.chosen[new], self.owner[new]

    def window_keys(self, which: np.ndarray) -> np.ndarray:
        return even(self.rolling.of(which, which + self.window))


def _choose_grams(window: int, buckets: int):
    def run(batches):
        for batch in batches:
            texts, chunks = [t or b"" for t in batch.column(1).to_pylist()], batch.column(0).to_numpy()
            for a, b in blocks(texts):
                block = _Block(texts[a:b], window)
                at, owner = block.choose()
                if len(at):
                    yield route(block.grams[at], chunks[a:b][owner], buckets)

    return run


def _window_keys(window: int, buckets: int):
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        keys, out = returned(back), []
        texts = [t or b"" for t in docs.column("text").to_pylist()] if len(keys) else []
        for a, b in blocks(texts):
            block = _Block(texts[a:b], window)
            at, _ = block.choose()
            hit = np.zeros(len(block.grams), bool)
            hit[at] = among(block.grams[at], keys)
            which = block.windows[hit[block.chosen]]
            if len(which):
                chunk = np.full(len(which), docs.column("chunk")[0].as_py())
                out.append(route(block.window_keys(which), chunk, buckets))
        return pa.Table.from_batches(out, schema=ROUTED_ARROW)

    return run


def _tiles(confirmed: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """Windows that cover each run of confirmed windows: every `window`-th and the last."""
    new = np.ones(len(confirmed), bool)
    new[1:] = (confirmed[1:] != confirmed[:-1] + 1) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(confirmed)) - 1
    steps = (end - start) // window + 1
    inner = np.repeat(confirmed[start], steps) + window * ranges(np.zeros(len(steps), np.int64), steps)
    return np.union1d(inner, confirmed[end])


def _locate(words: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """Which of the words (0: part of no pattern) lie in an occurrence of a pattern (rows)."""
    import ahocorasick

    edge, text = np.zeros(len(words) + 1, np.int64), tuple(words.tolist())
    step = max(1, SHARD_WORDS // patterns.shape[1])
    for at in range(0, len(patterns), step):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        for p in patterns[at:at + step].tolist():
            automaton.add_word(tuple(p))
        automaton.make_automaton()
        for end, length in automaton.iter(text):
            edge[end - length + 1] += 1
            edge[end + 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def _remove(window: int, keep: list[str], schema: pa.Schema, with_text: bool):
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        keys = returned(back)
        texts = [t or b"" for t in docs.column("text").to_pylist()]
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        if len(keys):
            parts, patterns, seen = [], [], np.zeros(0, U)
            for a, b in blocks(texts):
                block = _Block(texts[a:b], window)
                all_keys = block.window_keys(block.windows)
                hit = among(all_keys, keys)
                tiles = _tiles(block.windows[hit], block.owner[hit], window)
                fresh, where = np.unique(block.window_keys(tiles), return_index=True)
                new = ~among(fresh, seen)
                seen = np.union1d(seen, fresh[new])
                if new.any():
                    patterns.append(block.words[tiles[where[new]][:, None] + np.arange(window)])
                # A separator after each document, so that nothing is found across two.
                parts.append((a, block.words, block.first, block.last))
            if patterns:
                patterns = np.concatenate(patterns)
                known = np.unique(patterns)
                patterns = np.searchsorted(known, patterns) + 1
                flat, places, size = [], [], 0
                for a, words, first, last in parts:
                    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                    numbers = np.where(known[at] == words, at + 1, 0)
                    for i, (f, e) in enumerate(zip(first.tolist(), last.tolist())):
                        flat += [numbers[f:e], [0]]
                        places.append((a + i, size, e - f))
                        size += e - f + 1
                covered = _locate(np.concatenate(flat).astype(np.int64), patterns)
                for i, at, n in places:
                    d = np.flatnonzero(np.diff(covered[at:at + n].astype(np.int8), prepend=0, append=0))
                    spans[i] = list(zip(d[0::2].tolist(), d[1::2].tolist()))
        rows = []
        for text, found in zip(texts, spans):
            words = text.split()
            n, gone = len(words), sum(e - s for s, e in found)
            if gone:
                left = np.ones(n, bool)
                for s, e in found:
                    left[s:e] = False
                words = list(compress(words, left.tolist()))
            kept = b" ".join(words)
            rows.append((n, gone, [{"start": s, "end": e} for s, e in found],
                         (kept if gone else text).decode("utf-8", "replace") if with_text else None,
                         hashlib.sha256(kept).hexdigest()))
        columns = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5,
                   [pa.int64(), pa.int64(), pa.list_(_SPAN), pa.string(), pa.string()])]
        return pa.table([*[docs.column(f"keep_{i}") for i in range(len(keep))], *columns], schema=schema)

    return run


def without_passages(docs: DataFrame, keep: list[str], window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """The `keep` columns of each document, then n_words, n_removed, spans (removed runs of
    words), kept_text (if asked for; the text as it is where nothing was removed) and kept_sha256."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    size = text_bytes(docs)
    chunks, buckets = parts_of(size, CHUNK_BYTES), parts_of(size // 4, BUCKET_BYTES // 4)
    chunk = chunk_of(F.struct("doc_id", "text"), chunks).alias("chunk")
    text = F.col("text").cast("binary").alias("text")
    plain = docs.select(chunk, text)
    grams = recurring(plain.mapInArrow(_choose_grams(window, buckets), ROUTED))
    keys = recurring(plain.groupBy("chunk").cogroup(grams.groupBy("chunk"))
                     .applyInArrow(_window_keys(window, buckets), ROUTED))
    full = docs.select(chunk, text, *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])
    schema = StructType([*docs.select(*keep).schema, *StructType.fromDDL(RESULT)])
    return full.groupBy("chunk").cogroup(keys.groupBy("chunk")).applyInArrow(
        _remove(window, keep, to_arrow_schema(schema), with_text), schema)


def op2_substring(spark, sf_dir):
    out = without_passages(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", "spans")
