"""Toxicity by a factorisation machine over hashed terms.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j) over the distinct terms of a
document, x = 1 for a term that is present. The pairwise part, learnt as `rank` factors per
term, scores pairs such as an insult with the mention of a group, which linear weights miss.

Terms are runs of letters and digits (ASCII ones lower-cased, all bytes from 128 up counted as
letters), hashed to 2 ** `bits` places. Fitting uses at most `sample` labelled documents, those
with the smallest hash of their id: a bounded sample, the documented limit. Terms in fewer
than `least` of them, or whose link to the labels may be chance, are left out. Every document is scored, whole, by one pass over the texts;
only the fitted weights, of fixed size, are broadcast.

A document counts as toxic if any of its labels is 1; null labels are ignored, and an id with a
null never has a label. Null and empty texts score as the bias alone. Without any label of
training the score is 0. Repeated rows score alike.
"""

from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rolecast.llm.common import fold_of, stored, table
from rolecast.llm.kernels import LOWER, Rolling, U, blocks, byte_values, deflated, inflated, joined

BITS, RANK, SAMPLE, LEAST = 18, 8, 20_000, 5
EPOCHS, BATCH, RATE, RIDGE = 150, 128, 0.3, 1e-5
EVIDENCE = 20.0           # a likelihood ratio that chance terms do not reach
PAIR_TERMS, PAIR_EVIDENCE = 4096, 100.0  # and one that chance does not reach among their 8 million pairs
PAIR_SHARE = 0.03         # what a pair must explain of the deviance of all labels
STRIP = 512               # terms whose pairs are counted at a time
BLOCK = 250               # documents whose terms are counted at a time
_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _terms(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of each text: owners and places, sorted by both."""
    owners, places = [], []
    for a, b in blocks(texts):
        buffer, starts, ends = joined(texts[a:b])
        letter = np.zeros(len(buffer) + 2, bool)
        letter[1:-1] = _LETTER[buffer]
        edges = np.flatnonzero(letter[1:] != letter[:-1])
        at, end = edges[0::2], edges[1::2]
        h = Rolling(byte_values(LOWER[buffer])).of(at, end) >> U(64 - bits)
        owner = np.searchsorted(starts, at, "right") - 1
        key = np.unique((owner.astype(np.int64) << bits) | h.astype(np.int64))
        owners.append((key >> bits) + a)
        places.append(key & ((1 << bits) - 1))
    return (np.concatenate(owners), np.concatenate(places)) if owners else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _features(bits: int):
    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            owner, place = _terms(texts, bits)
            cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
            data = [deflated(place[i:j].astype(np.int32)) for i, j in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(cuts).astype(np.int32)), pa.array(data, pa.binary())],
                                             names=["toxic", "n", "terms"])

    return run


def _views(every: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The lists of these sizes that stand one after the other; no list has memory of its own."""
    ends = np.cumsum(sizes)
    return [every[i:j] for i, j in zip((ends - sizes).tolist(), ends.tolist())]


def _mapped(terms: list[np.ndarray], column: np.ndarray) -> list[np.ndarray]:
    """The columns of each document's terms, without those of -1."""
    held, sizes = [], []
    for at in range(0, len(terms), BLOCK):
        some = terms[at:at + BLOCK]
        to = column[np.concatenate(some)]
        use = to >= 0
        held.append(to[use])
        sizes.append(np.bincount(np.repeat(np.arange(len(some)), [len(t) for t in some])[use], minlength=len(some)))
    return _views(np.concatenate(held), np.concatenate(sizes)) if held else []


def _collected(rows: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """The terms and labels of the sample, in one order whatever the order of the rows, for sums of floats
    depend on it. They travel compressed and lie in one array, so no copy of them stays in the driver."""
    found = rows.toArrow()
    toxic, sizes = found.column("toxic").to_numpy().astype(float), found.column("n").to_numpy().astype(np.int64)
    terms = _views(np.empty(sizes.sum(), np.int32), sizes)
    for t, data in zip(terms, found.column("terms")):
        if len(t):
            t[:] = inflated(data.as_py(), len(t), np.int32)
    del found
    pa.default_memory_pool().release_unused()

    def order(i: int, j: int) -> float:
        a, b = terms[i].tobytes(), terms[j].tobytes()
        return (a > b) - (a < b) or toxic[i] - toxic[j]

    at = sorted(range(len(terms)), key=cmp_to_key(order))
    return [terms[i] for i in at], toxic[at]


def _evidence(df: np.ndarray, hits: np.ndarray, share: float) -> np.ndarray:
    """The likelihood ratio statistic of each term against the share of toxic documents."""
    def part(n, expected):
        return np.where(n > 0, n * np.log(np.maximum(n, 1) / np.maximum(expected, 1e-9)), 0.0)

    return 2 * (part(hits, df * share) + part(df - hits, df * (1 - share)))


def _telling_together(terms: list[np.ndarray], toxic: np.ndarray, df: np.ndarray, hits: np.ndarray,
                      least: int) -> np.ndarray:
    """Places of the terms of pairs whose four cells (both, one, the other, none) tell more of the labels
    than the two terms do alone. Counts of pairs are sums of outer products over blocks of documents, for
    a strip of terms at a time, so that no matrix of all pairs is held."""
    docs, share = len(toxic), np.clip(toxic.mean(), 1e-6, 1 - 1e-6)
    varied = np.minimum(df, docs - df)
    some = np.flatnonzero((df >= least) & (varied >= least))
    some = np.sort(some[np.argsort(-varied[some], kind="stable")[:PAIR_TERMS]])
    column, n = np.full(len(df), -1, np.int32), len(some)
    column[some] = np.arange(n)
    d, h, alone = df[some], hits[some], _evidence(df[some], hits[some], share)
    kept = np.zeros(n, bool)
    whole = -2 * docs * (share * np.log(share) + (1 - share) * np.log(1 - share))
    least_told = max(PAIR_EVIDENCE, PAIR_SHARE * whole)
    held = _mapped(terms, column)
    for low in range(0, n, STRIP):
        both = np.zeros((min(STRIP, n - low), n - low), np.float32)
        bad = both.copy()
        for at in range(0, docs, BLOCK):
            block = [k[k >= low] - low for k in held[at:at + BLOCK]]
            x = np.zeros((len(block), n - low), np.float32)
            x[np.repeat(np.arange(len(block)), [len(k) for k in block]), np.concatenate(block)] = 1
            both += x[:, :STRIP].T @ x
            x = x[toxic[at:at + BLOCK] > 0]
            bad += x[:, :STRIP].T @ x
        for row in range(len(both)):
            i, at = low + row, row + 1 + np.flatnonzero(both[row, row + 1:] >= least)
            j, n11, h11 = low + at, both[row, at].astype(float), bad[row, at].astype(float)
            cells = ((n11, h11), (d[i] - n11, h[i] - h11), (d[j] - n11, h[j] - h11),
                     (docs - d[i] - d[j] + n11, toxic.sum() - h[i] - h[j] + h11))
            told = sum(_evidence(a, b, share) for a, b in cells) - alone[i] - alone[j]
            good = j[told >= least_told]
            kept[good] = True
            kept[i] |= len(good) > 0
    return some[kept]


class Machine:
    """A factorisation machine: `kept` maps places to weights (-1: left out)."""

    def __init__(self, places: int, rank: int = RANK):
        self.kept, self.bias = np.full(places, -1, np.int32), -50.0
        self.w, self.v = np.zeros(0), np.zeros((0, rank))

    def fit(self, terms: list[np.ndarray], toxic: np.ndarray, least: int = LEAST, epochs: int = EPOCHS) -> "Machine":
        """Logistic loss by AdaGrad over the terms that tell toxic documents from others."""
        if not len(toxic):
            return self
        share = np.clip(toxic.mean(), 1e-6, 1 - 1e-6)
        self.bias = float(np.log(share / (1 - share)))
        df, hits = np.zeros(len(self.kept), np.int64), np.zeros(len(self.kept))
        for at in range(0, len(terms), BLOCK):
            some = terms[at:at + BLOCK]
            every, owner = np.concatenate(some), np.repeat(toxic[at:at + BLOCK], [len(t) for t in some])
            df += np.bincount(every, minlength=len(df))
            hits += np.bincount(every, weights=owner, minlength=len(df))
        chosen = (df >= least) & (_evidence(df, hits, share) >= EVIDENCE)
        chosen[_telling_together(terms, toxic, df, hits, least)] = True
        rng = np.random.default_rng(7)
        n, rank = int(chosen.sum()), self.v.shape[1]
        self.kept[chosen] = np.arange(n)
        self.w, self.v = np.zeros(n), rng.normal(0, 0.01, (n, rank))
        w_sum, v_sum, b_sum = np.full(n, 1e-3), np.full((n, rank), 1e-3), 1e-3
        docs = _mapped(terms, self.kept)
        for _ in range(epochs if n else 0):
            order = rng.permutation(len(docs))
            for at in range(0, len(order), BATCH):
                some = order[at:at + BATCH]
                owner = np.repeat(np.arange(len(some)), [len(docs[i]) for i in some])
                place = np.concatenate([docs[i] for i in some])
                z, sums = self._margin(owner, place, len(some))
                g = (1 / (1 + np.exp(-z)) - toxic[some]) / len(some)
                used, back = np.unique(place, return_inverse=True)
                gw = np.bincount(back, weights=g[owner], minlength=len(used)) + RIDGE / len(some) * self.w[used]
                gv = np.zeros((len(used), rank))
                each = g[owner][:, None] * (sums[owner] - self.v[place])
                for f in range(rank):
                    gv[:, f] = np.bincount(back, weights=each[:, f], minlength=len(used))
                gv += RIDGE * self.v[used]
                gb = g.sum()
                b_sum += gb * gb
                self.bias -= RATE * gb / np.sqrt(b_sum)
                w_sum[used] += gw * gw
                step = RATE / np.sqrt(w_sum[used])
                self.w[used] -= step * gw
                v_sum[used] += gv * gv
                self.v[used] -= RATE / 4 / np.sqrt(v_sum[used]) * gv
        return self

    def _margin(self, owner: np.ndarray, place: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
        v = self.v[place]
        sums = np.stack([np.bincount(owner, weights=v[:, f], minlength=docs) for f in range(v.shape[1])], 1)
        alone = np.bincount(owner, weights=(v * v).sum(1), minlength=docs)
        z = self.bias + np.bincount(owner, weights=self.w[place], minlength=docs) + ((sums ** 2).sum(1) - alone) / 2
        return np.clip(z, -50, 50), sums

    def score(self, owner: np.ndarray, terms: np.ndarray, docs: int) -> np.ndarray:
        place = self.kept[terms]
        use = place >= 0
        z, _ = self._margin(owner[use], place[use], docs)
        return np.where(z <= -50, 0.0, 1 / (1 + np.exp(-z)))


def fit(docs: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE, bits: int = BITS) -> Machine:
    """The machine of a bounded sample of the labelled documents for which `train` holds."""
    known = (labels.where(train & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    known = stored(known, "labels")
    # At most `sample` narrow rows, so a broadcast has a bound; repeated documents count once.
    rows = docs.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(
        F.first("toxic").alias("toxic"), F.min("text").alias("text"))
    return Machine(1 << bits).fit(*_collected(rows.select("toxic", F.col("text").cast("binary").alias("text")).mapInArrow(
        _features(bits), "toxic int, n int, terms binary")))


def _score(machine, bits: int, width: int, text: int):
    """`width` columns are kept; the text stands at column `text`."""
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = [t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()]
                score = machine.value.score(*_terms(texts, bits), len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:width], pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                    names=[*batch.schema.names[:width], "score", "predicted"])

    return run


def scored(docs: DataFrame, machine: Machine, keep: list[str], text: str = "text", bits: int = BITS) -> DataFrame:
    """The `keep` columns of every document, score and predicted (1 for a score of 0.5 or more)."""
    # A text that is kept goes through Python once.
    at = keep.index(text) if text in keep else len(keep)
    rows = docs.select(*[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)],
                       *[F.col(text).cast("binary").alias("text")] * (at == len(keep)))
    schema = ", ".join([*(f"keep_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)),
                        "score double, predicted int"])
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    out = rows.mapInArrow(_score(sent, bits, len(keep), at), schema)
    return out.withColumnsRenamed({f"keep_{i}": c for i, c in enumerate(keep)})


def op5_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), fold_of(F.col("doc_id")) != 0)
    return scored(docs, machine, ["doc_id"]).select(
        "doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
