"""Byte strings that start earlier elsewhere, by sparse suffix arrays in a logarithmic index.

Suffixes are indexed at sampled places only: every window of `width` bytes chooses its
smallest 32-byte gram, and neighbouring windows with one choice form a run. Equal windows
choose equal grams, so a window can only be repeated inside runs of the same gram.

1. Runs travel to buckets by gram as fixed-size entries (gram, hash of the run's whole text,
   place). A run whose whole text starts earlier is removed at once. Copies inside one block
   are settled there, so a hot run costs one entry per block.
2. What is left are first runs of a gram with several surroundings that agree on one side, the
   edges of matches.
   Their text goes to shards by gram. A gram with many edges is dealt by the bytes beside it
   too, which a window holds on one side at least, and where many edges agree on that side, window
   by window, by the whole window; equal windows meet all the same.
   A shard takes them in document order, batch by batch:
   each batch gets a suffix array of its windows (sorted, cut at `width` bytes), which is
   merge-scanned against the existing levels for matches of full length; then it becomes a
   level, and levels of equal size merge, so each suffix is merged a logarithmic number of times.
   Only first occurrences matter, since the earliest place of a window lies in a first run.
3. Marked windows go back to their documents.

Every byte of a window that starts at a smaller (doc_id, start) is removed; windows are judged
on the input. Rows with one doc_id are one document in this order, so repeated rows do not
remove each other; a null id sorts last. Null texts are empty; texts shorter than a window
keep all their bytes. Whole runs are compared by 64-bit hashes, edges byte by byte.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rolecast.llm.common import BUCKET_BYTES, CHUNK_BYTES, MB, chunk_of, parts_of, stored, table, text_bytes
from rolecast.llm.kernels import (BLOCK_BYTES, Rolling, U, blocks, byte_values, gram_hashes, joined, merged, mixed,
                                  packed, ranges, window_minima)

WIDTH = 100
GRAM_DOUBLINGS = 5
BATCH_WINDOWS = 1 << 16
#: Edges of a gram, or of a gram and one side, that go to one shard; no effect on results.
HOT_EDGES = 2048
_PLACE = {"chunk": np.int32, "row": np.int64, "doc": np.int64, "pos": np.uint32, "n": np.uint8, "off": np.uint8}
_ENTRY = {"key": np.uint32, "whole": U, "left": np.uint16, "right": np.uint16, "known": np.uint8, **_PLACE}
_BACK = {"row": np.int64, "pos": np.uint32, "n": np.uint8, "off": np.uint8, "kind": np.uint8}
_SUFFIX = {"row": np.int64, "doc": np.int64, "pos": np.uint32, "n": np.uint8}
REPEATED, EDGE = 1, 2
#: Added to EDGE: the gram has many edges; many have the same left side, the same right side.
HOT, HOT_LEFT, HOT_RIGHT = 4, 8, 16


def _ddl(fields, *first):
    return ", ".join([*first, *(f"{c} binary" for c in fields)])


def _rows(groups: np.ndarray, arrays: dict[str, np.ndarray], key: str) -> pa.Table:
    """One row per group, with each array's part as bytes; rows keep their order in a group."""
    order = np.argsort(groups, kind="stable")
    groups = groups[order]
    ids, at = np.unique(groups, return_index=True)
    cuts = np.append(at, len(groups))
    out = {key: pa.array(ids.astype(np.int32), pa.int32())}
    for c, a in arrays.items():
        a = a[order]
        out[c] = pa.array([packed(a[i:j]) for i, j in zip(cuts[:-1], cuts[1:])], pa.binary())
    return pa.table(out)


def _read(t: pa.Table, kinds: dict) -> dict[str, np.ndarray]:
    return {c: np.concatenate([np.frombuffer(x, k) for x in t.column(c).to_pylist()] or [np.zeros(0, k)])
            for c, k in kinds.items()}


def _segments(texts: list[bytes], width: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts cut into overlapping segments of bounded size: (segments, owners, bases)."""
    cut, owner, base = [], [], []
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - width + 1), BLOCK_BYTES):
            cut.append(t[at:at + BLOCK_BYTES + width - 1] if len(t) > BLOCK_BYTES + width else t)
            owner.append(i)
            base.append(at)
            if len(t) <= BLOCK_BYTES + width:
                break
    return cut, np.array(owner, np.int64), np.array(base, np.int64)


def _runs(width: int, buckets: int):
    size = 1 << GRAM_DOUBLINGS

    def run(batches):
        for batch in batches:
            chunk, doc, row = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cut, owner, base = _segments([t or b"" for t in batch.column(3).to_pylist()], width)
            for a, b in blocks(cut, MB):
                buffer, starts, ends = joined(cut[a:b])
                counts = np.maximum(0, ends - starts - width + 1)
                windows = ranges(starts, counts)
                if not len(windows):
                    continue
                grams = gram_hashes(buffer, GRAM_DOUBLINGS)
                chosen = window_minima(grams, width - size + 1)[windows]
                new = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
                first, at = windows[new], chosen[new]
                n = np.diff(np.append(new, len(windows)))
                segment = np.repeat(np.arange(b - a), counts)[new]
                key = mixed(grams[at] + U(1))  # chosen ones are small, which would crowd a few buckets
                rolling = Rolling(byte_values(buffer))
                whole = rolling.of(first, first + n + width - 1) ^ mixed((at - first).astype(U))
                who = owner[a:b][segment]
                # The bytes beside the gram; a window has all of them on one side at least.
                beside = (width - size) // 2
                left = rolling.of(np.maximum(at - beside, starts[segment]), at)
                right = rolling.of(at + size, np.minimum(at + size + beside, ends[segment]))
                e = {"key": (key & U(0xFFFFFFFF)).astype(np.uint32), "whole": whole, "left": left >> U(48),
                     "right": right >> U(48), "chunk": chunk[who], "row": row[who],
                     "doc": doc[who], "pos": (first - starts[segment] + base[a:b][segment]).astype(np.uint32),
                     "n": n.astype(np.uint8), "off": (at - first).astype(np.uint8)}
                bucket = ((key >> U(32)) * U(buckets)) >> U(32)
                # Of equal runs in this block only the first goes on; the others are known.
                order = np.lexsort((e["pos"], e["doc"], whole, key))
                same = np.zeros(len(order), bool)
                same[1:] = (whole[order][1:] == whole[order][:-1]) & (key[order][1:] == key[order][:-1])
                head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
                later = (e["doc"][order] != e["doc"][order][head]) | (e["pos"][order] != e["pos"][order][head])
                known = np.zeros(len(order), np.uint8)
                known[order] = same & later
                e["known"] = known
                # Known ones only pass through, so they may go anywhere.
                bucket = np.where(known == 1, mixed(np.arange(len(known), dtype=U)) % U(buckets), bucket)
                yield from _rows(bucket.astype(np.int64), {c: e[c].astype(k) for c, k in _ENTRY.items()}, "bucket").to_batches()

    return run


def _judge(hot: int):
    return lambda t: _judged(t, hot)


def _judged(t: pa.Table, hot: int) -> pa.Table:
    e = _read(t, _ENTRY)
    order = np.lexsort((e["pos"], e["doc"], e["whole"], e["key"], e["known"]))
    e = {c: a[order] for c, a in e.items()}
    n = len(order)
    key_new, whole_new = np.ones(n, bool), np.ones(n, bool)
    key_new[1:] = (e["key"][1:] != e["key"][:-1]) | (e["known"][1:] != e["known"][:-1])
    whole_new[1:] = key_new[1:] | (e["whole"][1:] != e["whole"][:-1])
    head = np.maximum.accumulate(np.where(whole_new, np.arange(n), 0))
    later = (e["doc"] != e["doc"][head]) | (e["pos"] != e["pos"][head])
    group = np.cumsum(key_new) - 1
    several = (np.bincount(group, weights=whole_new) > 1)[group] if n else np.zeros(0, bool)
    several &= _shared(group, e["left"], ~later) | _shared(group, e["right"], ~later)
    kind = np.where((e["known"] == 1) | later, REPEATED, np.where(several, EDGE, 0)).astype(np.uint8)
    edge = kind == EDGE
    many = (np.bincount(group, weights=edge) > hot)[group] & edge if n else edge
    kind += (HOT * many + HOT_LEFT * (_sharing(group, e["left"], many) > hot)
             + HOT_RIGHT * (_sharing(group, e["right"], many) > hot)).astype(np.uint8)
    some = kind > 0
    return _rows(e["chunk"][some].astype(np.int64), {**{c: e[c][some] for c in _BACK if c != "kind"}, "kind": kind[some]}, "chunk")


def _shared(group: np.ndarray, side: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Whether some other entry of the group has the same bytes on this side."""
    return _sharing(group, side, some) > 1


def _sharing(group: np.ndarray, side: np.ndarray, some: np.ndarray) -> np.ndarray:
    """How many entries of the group have the same bytes on this side, among `some`."""
    out = np.zeros(len(group), np.int64)
    key = (group[some].astype(np.int64) << 16) | side[some]
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    out[some] = count[back]
    return out


def _result(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple:
    starts, ends = merged(starts, ends)
    gone = int((ends - starts).sum())
    digest = hashlib.sha256()
    at = 0
    view = memoryview(text)
    for s, e in zip(starts.tolist(), ends.tolist()):
        digest.update(view[at:s])
        at = e
    digest.update(view[at:])
    return len(text), gone, len(starts), digest.hexdigest()


_STEP = ("kind int, shard int, doc_id long, row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
         "text binary, spans binary, " + _ddl([f"s_{c}" for c in _SUFFIX]) + ", s_text binary")


def _settle(width: int, shards: int):
    names = [x.split()[0] for x in _STEP.split(", ")]
    types = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]]
             for x in _STEP.split(", ")]

    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        b = _read(back, _BACK)
        order = np.lexsort((b["pos"], b["row"]))
        b = {c: a[order] for c, a in b.items()}
        out: list[dict] = []
        edges = []
        ids, rows = docs.column("doc_id").to_pylist(), docs.column("row").to_numpy()
        docs_at = docs.column("doc").to_numpy()
        lo, hi = np.searchsorted(b["row"], rows), np.searchsorted(b["row"], rows, "right")
        for i, t in enumerate(docs.column("text").to_pylist()):
            t = t or b""
            s = slice(lo[i], hi[i])
            pos, n, kind = b["pos"][s].astype(np.int64), b["n"][s].astype(np.int64), b["kind"][s]
            flat = kind == REPEATED
            starts, ends = merged(pos[flat], (pos + n + width - 1)[flat])
            if (edge := np.flatnonzero(kind & EDGE)).size:
                edges.append((t, rows[i], docs_at[i], pos[edge], n[edge], b["off"][s][edge].astype(np.int64), kind[edge]))
                out.append({"kind": 1, "doc_id": ids[i], "row": int(rows[i]), "text": t,
                            "spans": packed(np.stack([starts, ends], 1).astype(np.int64))})
            else:
                out.append(dict(zip(("n_bytes", "n_removed", "n_spans", "kept_sha256"), _result(t, starts, ends)),
                                kind=0, doc_id=ids[i], row=int(rows[i])))
        for first, last in blocks([x[0] for x in edges]):
            out += _edges(edges[first:last], width, shards)
        columns = {n: [r.get(n) for r in out] for n in names}
        return pa.table([pa.array(columns[n], t) for n, t in zip(names, types)], names=names)

    return run


def _edges(found: list, width: int, shards: int) -> list[dict]:
    """Rows of edge runs for the shards, without windows that start earlier in this block."""
    buffer, starts, _ = joined([x[0] for x in found])
    each = [len(x[3]) for x in found]
    row, doc = (np.repeat(np.array([x[k] for x in found], np.int64), each) for k in (1, 2))
    pos, n, off, kind = (np.concatenate([x[k] for x in found]) for k in (3, 4, 5, 6))
    at = pos + np.repeat(starts, each)
    rolling = Rolling(byte_values(buffer))
    size = 1 << GRAM_DOUBLINGS
    beside = (width - size) // 2
    gram = rolling.of(at + off, at + off + size)
    windows, run = ranges(at, n), np.repeat(np.arange(len(at)), n)
    place = windows - at[run] + pos[run]
    # What equal windows have in common, and what goes to one shard together.
    on_left = (at + off)[run] - windows >= beside
    deal = gram[run]
    if (kind & HOT).any():
        hot, begin = (kind & HOT)[run] > 0, (at + off)[run]
        for side, lo, hi, one in ((on_left, begin - beside, begin + size, HOT_LEFT),
                                  (~on_left, begin, begin + size + beside, HOT_RIGHT)):
            i = np.flatnonzero(hot & side)
            single = (kind[run[i]] & one) > 0
            a, b = np.where(single, windows[i], lo[i]), np.where(single, windows[i] + width, hi[i])
            deal[i] = mixed(rolling.of(a, b) + U(one))
    order = np.lexsort((place, doc[run], rolling.of(windows, windows + width)))
    h = rolling.of(windows[order], windows[order] + width)
    new = np.ones(len(order), bool)
    new[1:] = h[1:] != h[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    d, p = doc[run][order], place[order]
    later = (d != d[head]) | (p != p[head])
    out = []
    # Windows known to start earlier go back at once (shard -1), the others on to a shard.
    gone = np.sort(order[later])
    if len(gone):
        for r in np.unique(row[run[gone]]):
            mine = place[gone[row[run[gone]] == r]]
            out.append({"kind": 3, "row": int(r), "spans": packed(np.stack(merged(mine, mine + width), 1).astype(np.int64))})
    left = np.ones(len(order), bool)
    left[gone] = False
    kept = np.flatnonzero(left)
    # Windows of one run that go together, as one text.
    first = np.ones(len(kept), bool)
    first[1:] = (run[kept][1:] != run[kept][:-1]) | (deal[kept][1:] != deal[kept][:-1])
    lead = kept[first]
    tail = kept[np.append(np.flatnonzero(first)[1:], len(kept)) - 1] if len(kept) else lead
    n = windows[tail] - windows[lead] + 1
    shard = (deal[lead] >> U(32)) * U(shards) >> U(32)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for who in np.split(order, cuts) if len(order) else []:
        e = {"row": row[run[lead[who]]], "doc": doc[run[lead[who]]], "pos": place[lead[who]], "n": n[who]}
        out.append({"kind": 2, "shard": int(shard[who[0]]),
                    "s_text": packed(buffer[ranges(windows[lead[who]], n[who] + width - 1)]),
                    **{f"s_{c}": packed(e[c].astype(k)) for c, k in _SUFFIX.items()}})
    return out


class Levels:
    """A logarithmic family of suffix arrays over windows of one width.

    A level holds the distinct windows of some batches in byte order, with the first place
    (doc, pos) of each. `add` returns which windows of a batch start earlier, in the batch or
    in a level, and makes the batch a new level; levels of about equal size merge.
    """

    def __init__(self, width: int):
        self.width, self.levels = width, []

    def add(self, windows: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """windows: an (n, width) matrix of bytes."""
        words = np.zeros((len(windows), -(-self.width // 8) * 8), np.uint8)
        words[:, :self.width] = windows
        # Big-endian words compare as the bytes do, and sort by columns.
        columns = words.view(">u8").astype(np.uint64)
        order = self._sorted(columns, doc, pos)
        columns, doc, pos = columns[order], doc[order], pos[order]
        new = np.ones(len(order), bool)
        new[1:] = (columns[1:] != columns[:-1]).any(1)
        group = np.cumsum(new) - 1
        first_doc, first_pos = doc[new], pos[new]
        distinct = columns[new]
        for level in self.levels:
            at = self._find(level[0], distinct)
            hit = at >= 0
            d, p = level[1][at], level[2][at]
            older = hit & ((d < first_doc) | ((d == first_doc) & (p < first_pos)))
            first_doc, first_pos = np.where(older, d, first_doc), np.where(older, p, first_pos)
        later = (doc > first_doc[group]) | ((doc == first_doc[group]) & (pos > first_pos[group]))
        out = np.zeros(len(order), bool)
        out[order] = later
        self._keep((distinct, first_doc, first_pos))
        return out

    @staticmethod
    def _sorted(columns, doc, pos):
        return np.lexsort((pos, doc, *columns.T[::-1]))

    def _find(self, level: np.ndarray, distinct: np.ndarray) -> np.ndarray:
        """The place of each window in a level, or -1: both are sorted, so this is a merge."""
        both = np.concatenate([level, distinct])
        side = np.repeat([0, 1], [len(level), len(distinct)])
        order = np.lexsort((side, *both.T[::-1]))
        same = np.zeros(len(order), bool)
        same[1:] = (both[order][1:] == both[order][:-1]).all(1)
        out = np.full(len(distinct), -1)
        mine = np.flatnonzero(same & (side[order] == 1))
        out[order[mine] - len(level)] = order[mine - 1]
        return out

    def _keep(self, level) -> None:
        while self.levels and len(self.levels[-1][0]) <= 2 * len(level[0]):
            level = self._merged(self.levels.pop(), level)
        self.levels.append(level)

    def _merged(self, a, b):
        columns, doc, pos = (np.concatenate(x) for x in zip(a, b))
        order = self._sorted(columns, doc, pos)
        columns, doc, pos = columns[order], doc[order], pos[order]
        new = np.ones(len(order), bool)
        new[1:] = (columns[1:] != columns[:-1]).any(1)
        return columns[new], doc[new], pos[new]


def _index(width: int):
    def run(t: pa.Table) -> pa.Table:
        e = _read(t.rename_columns([c.removeprefix("s_") for c in t.column_names]), _SUFFIX)
        text = np.concatenate([np.frombuffer(x, np.uint8) for x in t.column("s_text").to_pylist()])
        n = e["n"].astype(np.int64)
        base = np.concatenate(([0], np.cumsum(n + width - 1)[:-1]))
        order = np.lexsort((e["pos"], e["doc"]))
        cuts = np.flatnonzero(np.diff(np.cumsum(n[order]) // BATCH_WINDOWS)) + 1
        levels, starts, owners = Levels(width), [], []
        for part in np.split(order, cuts):
            at, run_ = ranges(base[part], n[part]), np.repeat(part, n[part])
            pos = at - base[run_] + e["pos"][run_].astype(np.int64)
            later = levels.add(text[at[:, None] + np.arange(width)], e["doc"][run_], pos)
            starts.append(pos[later])
            owners.append(e["row"][run_][later])
        starts, owners = np.concatenate(starts), np.concatenate(owners)
        order = np.lexsort((starts, owners))
        starts, owners = starts[order], owners[order]
        ids, at = np.unique(owners, return_index=True)
        cuts = np.append(at, len(owners))
        spans = [packed(np.stack(merged(starts[i:j], starts[i:j] + width), 1).astype(np.int64))
                 for i, j in zip(cuts[:-1], cuts[1:])]
        return pa.table({"row": pa.array(ids, pa.int64()), "spans": pa.array(spans, pa.binary())})

    return run


def _finish(batches):
    for batch in batches:
        rows = []
        for doc, text, own, more in zip(*(c.to_pylist() for c in batch.columns)):
            spans = np.concatenate([np.frombuffer(x, np.int64) for x in (own, *(more or []))]).reshape(-1, 2)
            rows.append((doc, *_result(text, spans[:, 0], spans[:, 1])))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if i == 4 else pa.int64()) for i, c in enumerate(zip(*rows))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def without_repeats(docs: DataFrame, width: int = WIDTH, hot: int = HOT_EDGES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document."""
    if not 48 <= width <= 255:
        raise ValueError("a window has 48 to 255 bytes")
    size = text_bytes(docs)
    chunks, buckets = parts_of(size, CHUNK_BYTES), parts_of(size, BUCKET_BYTES // 4)
    shards = parts_of(size, 2 * MB)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    row = F.xxhash64("doc_id", "text")
    text = F.col("text").cast("binary").alias("text")
    rows = docs.select(chunk_of(row, chunks).alias("chunk"), doc.alias("doc"), row.alias("row"), text)
    judged = (rows.mapInArrow(_runs(width, buckets), _ddl(_ENTRY, "bucket int"))
              .groupBy("bucket").applyInArrow(_judge(hot), _ddl(_BACK, "chunk int")))
    full = docs.select(chunk_of(row, chunks).alias("chunk"), doc.alias("doc"), row.alias("row"),
                       F.col("doc_id").cast("long").alias("doc_id"), text)
    step = stored(full.groupBy("chunk").cogroup(judged.groupBy("chunk"))
                  .applyInArrow(_settle(width, shards), _STEP), "edges")
    columns = ["shard", *[f"s_{c}" for c in _SUFFIX], "s_text"]
    late = (step.where("kind = 2").select(columns).groupBy("shard").applyInArrow(_index(width), "row long, spans binary")
            .union(step.where("kind = 3").select("row", "spans")))
    late = late.groupBy("row").agg(F.collect_list("spans").alias("more"))
    open_rows = step.where("kind = 1").select("doc_id", "row", "text", "spans").join(late, "row", "left")
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return (step.where("kind = 0").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
            .union(open_rows.select("doc_id", "text", "spans", "more").mapInArrow(_finish, result)))


def op1_suffix_array(spark, sf_dir):
    return without_repeats(table(spark, sf_dir, "documents"))
