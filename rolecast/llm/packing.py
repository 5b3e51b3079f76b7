"""Shortest-pack-first packing over the length histogram.

Documents are tokenised and cut into pieces of at most `size` tokens; the histogram of piece
lengths (at most `size` rows, whatever the corpus) is packed on the driver: lengths from the
longest to the shortest, each into the least filled packs that still have room, with counts
instead of pieces. The patterns that come out say which ranks of a length go to which
sequence and offset; pieces are ranked within their length by counts per part, and meet their
place by rank. Only the narrow piece rows are shuffled, never texts or token ids.

An empty or null text is its end token alone. Repeated rows are packed as often as they come.
"""

import heapq
import unicodedata
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from rolecast.llm.common import parts_of, stored, table

SIZE = 4096
END = 2
PART_ROWS = 50_000
WORDS_KEPT = 400_000   # tokenised words a worker remembers; no effect on results
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_MARKS = '!"#$%&()*+,-./:;=?@[]^_`{}~'
#: How byte-level tokenizers write bytes: printable Latin-1 as it is, the others from U+0100 on.
_BYTE_UNITS = dict(zip([b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)], range(256, 512)))
_SEEN: dict[int, dict] = {}  # by tokenizer


def tokenizer_json(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


@lru_cache(1 << 16)
def _young(c: str) -> bool:
    """A code point that is unknown here, or a mark that came after Unicode 3.2."""
    return unicodedata.category(c) == "Cn" or (
        unicodedata.combining(c) > 0 and unicodedata.ucd_3_2_0.category(c) == "Cn")


def _words(text: bytes | None) -> list[bytes]:
    """White space only separates words for this tokenizer, and it composes and lower-cases
    letter by letter; done here for a whole text, words are fewer. Special tokens are matched before
    that, and a final sigma is lower-cased by its place, so such texts are left as they are."""
    text = text or b""
    if b"<|" in text or b"\xce\xa3" in text:
        return text.split()
    if text.isascii():
        return text.lower().split()
    said = text.decode("utf-8", "replace")
    low = unicodedata.normalize("NFC", said).lower()
    # Where lower-casing takes a letter apart beside further marks, composing again would change it, and
    # marks younger than the tokenizer's tables are ordered otherwise. Both are its own to read.
    if not unicodedata.is_normalized("NFC", low) or any(map(_young, set(said))):
        return text.split()
    return low.encode().split()


def _parts(word: str) -> tuple[str, str]:
    """Letters and the marks after them are separate units; an apostrophe may begin a unit of letters."""
    letters = word.rstrip(_MARKS)
    return (letters, word[len(letters):]) if letters.isalpha() else (word, "")


def _learn(words: set[bytes], tokenizer, seen: dict[bytes, bytes]) -> None:
    """Puts the ids of words into `seen`. A word's ids do not depend on its neighbours, so a
    word met again costs a look-up."""
    new = [w for w in words if w not in seen]
    if len(seen) + len(new) > WORDS_KEPT:
        seen.clear()
        new = list(words)
    cut = [(w, *_parts(w.decode("utf-8", "replace"))) for w in new]
    ids, others, model = {}, [], tokenizer.model
    for p in {p for _, a, b in cut for p in (a, b)}:
        if p.isalpha() and p == p.lower() and (p.isascii() or unicodedata.is_normalized("NFC", p)):
            # One unit for the tokenizer already: nothing to normalise or split.
            units = p if p.isascii() else p.encode().decode("latin-1").translate(_BYTE_UNITS)
            ids[p] = array("I", [t.id for t in model.tokenize(units)]).tobytes()
        else:
            others.append(p)
    for p, c in zip(others, tokenizer.encode_batch_fast(others, add_special_tokens=False)):
        ids[p] = array("I", c.ids).tobytes()
    for w, a, b in cut:
        seen[w] = ids[a] + ids[b] if b else ids[a]


def _pieces(model, name: int, size: int, end: int):
    last = np.array([end], "<u4").tobytes()

    def cut(batches):
        import gc
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        gc.disable()  # many small objects, no cycles

        tokenizer, seen = Tokenizer.from_str(model.value), _SEEN.setdefault(name, {})
        step = 4 * size
        for batch in batches:
            rows = []
            texts = batch.column(1)
            for at in range(0, len(texts), 256):
                words = [_words(t) for t in texts.slice(at, 256).to_pylist()]
                _learn(set().union(*words), tokenizer, seen)
                for doc, w in zip(batch.column(0).slice(at, 256).to_pylist(), words):
                    data = b"".join(map(seen.__getitem__, w)) + last
                    n = len(data) // 4
                    rows += [(doc, s // 4, min(step, len(data) - s) // 4, zlib.crc32(data[s:s + step]), n)
                             for s in range(0, len(data), step)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                                 names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return cut


def pieces(docs: DataFrame, model: str, size: int = SIZE, end: int = END) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document cut into pieces."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return rows.mapInArrow(_pieces(spark.sparkContext.broadcast(model), zlib.crc32(model.encode()), size, end), PIECES)


def shortest_pack_first(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """[(number of sequences, lengths)]: lengths longest first, each to the emptiest packs."""
    packs = []  # (-room, number, times, pattern), a pattern being (lengths before, length) pairs
    number = 0
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if packs and -packs[0][0] >= length:
                room, _, times, pattern = heapq.heappop(packs)
                room = -room
            else:
                # As few as hold the rest of this length; the loop fills them up.
                room, times, pattern = size, -(-n // (size // length)), None
            used = min(n, times)
            if used < times:
                heapq.heappush(packs, (-room, number, times - used, pattern))
                number += 1
            heapq.heappush(packs, (length - room, number, used, (pattern, length)))
            number += 1
            n -= used
    out = []
    for _, _, times, pattern in packs:
        lengths = []
        while pattern:
            pattern, length = pattern
            lengths.append(length)
        out.append((times, lengths[::-1]))
    return sorted(out, key=lambda x: (x[1], x[0]))


def _slots(patterns: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: runs of ranks, sorted by length and first rank."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for times, lengths in patterns:
        offset = 0
        for length in lengths:
            rank = used.get(length, 0)
            rows.append(((length << 48) | rank, base, offset))
            used[length], offset = rank + times, offset + length
        base += times
    key, first, offset = (np.array(c, np.int64) for c in zip(*sorted(rows))) if rows else [np.zeros(0, np.int64)] * 3
    return {"key": key, "first": first, "offset": offset}


def _place(slots):
    def place(batches):
        s = slots.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            key = (length << 48) | rank
            at = np.searchsorted(s["key"], key, "right") - 1
            keep = batch.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield pa.RecordBatch.from_arrays(
                [*keep.columns, pa.array(s["first"][at] + key - s["key"][at]), pa.array(s["offset"][at])],
                names=[*keep.schema.names, "sequence_id", "offset"])

    return place


def pack(found: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to stored pieces; each sequence is filled from 0 on."""
    spark = found.sparkSession
    # At most `size` rows come here.
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(shortest_pack_first(counts, size)))
    parts = parts_of(sum(counts.values()), PART_ROWS, 1)
    part = F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts)).cast("int")
    found = found.withColumn("part", part)
    per_part = found.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    per_part = per_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = W.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = (found.withColumn("row", F.row_number().over(within) - 1)
              .join(per_part, ["length", "part"])
              .withColumn("rank", (F.col("before") + F.col("row")).cast("long")))
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(
        _place(slots), PIECES + ", sequence_id long, offset long")


def packed_documents(docs: DataFrame, model: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    return pack(stored(pieces(docs, model or tokenizer_json(), size, end), "pieces"), size)


def op8_packing(spark, sf_dir):
    return packed_documents(table(spark, sf_dir, "documents"))
