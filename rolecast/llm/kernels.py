"""Vectorised byte and word hashing over blocks of documents, used inside Spark tasks."""

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_BYTE = mixed(np.arange(1, 257, dtype=U) * U(_BASE))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, U)
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
    return _POWERS["up"], _POWERS["down"]


class Rolling:
    """Hashes of any runs of a sequence of 64-bit values, from prefix sums."""

    def __init__(self, values: np.ndarray):
        up, self.down = _powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * up[:len(values)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mixed(h + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def byte_values(buffer: np.ndarray) -> np.ndarray:
    return _BYTE[buffer]


def gram_hashes(buffer: np.ndarray, doublings: int) -> np.ndarray:
    """A hash of the 2 ** doublings bytes at every position."""
    h, size, base = _BYTE[buffer], 1, _BASE
    for _ in range(doublings):
        h = h[:-size] * U(base) + h[size:] if len(h) > size else h[:0]
        size, base = 2 * size, pow(base, 2, 1 << 64)
    return mixed(h)


def word_spans(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+."""
    gap = np.ones(len(buffer) + 2, bool)
    gap[1:-1] = _SPACE[buffer]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and a 64-bit hash of each word."""
    starts, ends = word_spans(buffer)
    return starts, ends, Rolling(byte_values(buffer)).of(starts, ends)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """For every window of `width` hashes, the position of its smallest one, leftmost first.

    The choice depends on the window's content alone, so equal windows choose alike.
    """
    if len(h) < width:
        return np.zeros(0, np.int64)
    low = (h & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U)
    size = 1
    while 2 * size <= width:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    if size < width:
        low = np.minimum(low[:len(low) - (width - size)], low[width - size:])
    return (low & U(0xFFFFFFFF)).astype(np.int64)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one after the other."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return np.arange(total, dtype=np.int64) + shift


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching ranges."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate(([True], starts[1:] > ends[:-1])))
    return starts[new], ends[np.concatenate((new[1:] - 1, [len(ends) - 1]))]


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES):
    """(first, last + 1) of runs of documents of about `limit` bytes."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts with a space after each; each text's start and end."""
    buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    return buffer, ends - lengths, ends


def packed(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def deflated(a: np.ndarray, rising: bool = True) -> bytes:
    """Bytes of an array of whole numbers: differences if they are rising, byte planes, compressed."""
    steps = np.diff(a, prepend=a.dtype.type(0)) if rising and len(a) else a
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(len(a), a.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def inflated(data: bytes, n: int, kind, rising: bool = True) -> np.ndarray:
    kind = np.dtype(kind)
    raw = pa.decompress(data, decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True)
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T)
    steps = steps.view(kind).reshape(n)
    return np.cumsum(steps, dtype=kind) if rising else steps


def bucket_slices(keys: np.ndarray, buckets: int):
    """(bucket, slice) of sorted 64-bit keys, by their high bits."""
    cuts = [((b << 64) + buckets - 1) // buckets for b in range(1, buckets)]
    at = [0, *np.searchsorted(keys, np.array(cuts, U)).tolist(), len(keys)]
    return [(b, slice(at[b], at[b + 1])) for b in range(buckets) if at[b] < at[b + 1]]


def among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which values are among the sorted keys; a bit table drops most of the others first."""
    hit = np.zeros(len(values), bool)
    if not len(keys) or not len(values):
        return hit
    bits = max(10, min(24, int(len(keys)).bit_length() + 3))
    seen = np.zeros(1 << bits, bool)
    mask = U((1 << bits) - 1)
    seen[(keys & mask).astype(np.int64)] = True
    maybe = np.flatnonzero(seen[(values & mask).astype(np.int64)])
    at = np.minimum(np.searchsorted(keys, values[maybe]), len(keys) - 1)
    hit[maybe] = keys[at] == values[maybe]
    return hit


class Lookup:
    """Values of many 64-bit keys: a few hash tables, each holding the keys that found a free
    slot; a key absent from all gives `missing`."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing):
        self.missing, self.values, self.tables = missing, values, []
        todo, seed = np.arange(len(keys)), 0
        while len(todo):
            bits = max(4, int(2 * len(todo)).bit_length())
            slot = self._slot(keys[todo], seed, bits)
            table = np.full(1 << bits, -1, np.int32)
            table[slot] = todo
            self.tables.append((seed, bits, table))
            todo, seed = todo[table[slot] != todo], seed + 1
        self.keys = keys

    @staticmethod
    def _slot(keys, seed, bits):
        return ((keys ^ (keys >> U(29))) * U(_BASE + 2 * seed) >> U(64 - bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), self.missing, self.values.dtype)
        todo = None
        for seed, bits, table in self.tables:
            asked = keys if todo is None else keys[todo]
            at = table[self._slot(asked, seed, bits)]
            hit = (at >= 0) & (self.keys[at] == asked)
            where = np.flatnonzero(hit) if todo is None else todo[hit]
            out[where] = self.values[at[hit]]
            todo = np.flatnonzero(~hit) if todo is None else todo[~hit]
            if not len(todo):
                break
        return out
