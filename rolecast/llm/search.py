"""Ranked lexical search: the best documents of each item, by MaxScore with bounds of term pairs.

1. One pass over the documents keeps, of each, its length and the counts of the terms asked for
   (the forward index); document frequencies and weights follow from it.
2. Each term has its highest impact in any document. For pairs of frequent terms that an item
   asks for together, the list of documents that hold both is condensed to its length and the
   highest joint impact. A pair's bound is the largest of the joint one and the two single
   ones, never above their sum.
3. Documents that hold rare terms of an item are scored in full first; the k-th best of them is a
   score that the result must reach (the floor).
4. An item's terms, by rising impact, are set aside as long as the combined bound of those set
   aside, pairs where they help and single terms otherwise, stays under the floor. Only documents
   that hold a remaining term can reach it; of those, only the ones whose remaining terms and
   that bound together reach the floor are scored in full.

Nothing is dropped that could be in the result: a document left out scores less than k others.

Items are dealt into groups of a bounded number of terms, so what is broadcast or sent to tasks
is bounded by `GROUP_TERMS` (or one item); documents only grow the scans. `PAIR_TERMS` and
`PAIRS` bound how many pairs are condensed; pairs beyond them count with their single bounds.

Terms are the maximal matches of `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, only A-Z
lower-cased. Null and empty texts have none; such items give no rows. Repeated documents and
items are separate rows. Null ids are ids like any other; a null doc_id sorts last among equal
scores.
"""

import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rolecast.llm.common import parts_of, stored, table

K = 10
GROUP_TERMS = 200_000
FREQUENT = 256        # a term is frequent above 1/256 of the documents
SEEDS = 4             # the rarest terms of an item count as rare in any case
PAIR_TERMS = 16       # of an item, so many of its most frequent terms are paired
PAIRS = 50_000
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = re.compile(TERM.encode())
FORWARD = "row long, doc_id long, n long, terms array<long>, times array<long>"
_FORWARD = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()),
                      ("terms", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
_JOINT = pa.schema([("pair", pa.int32()), ("n_both", pa.int64()), ("joint", pa.int64())])
_SPLIT = pa.schema([("item", pa.int64()), ("floor", pa.int64()), ("bound", pa.int64()), ("id", pa.int64())])
_DOCS, _STEP = 512, 1024


def terms_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(low, F.lit(TERM), F.lit(0))


def _forward(ids: dict):
    """Rows of the forward index; `ids` numbers the terms asked for."""
    def run(batches):
        for batch in batches:
            n, terms, times, keep = [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                words = _TERM.findall(text.lower()) if text else []   # bytes: only A-Z change
                if not words:
                    continue
                seen: dict = {}
                for t in map(ids.get, words):
                    seen[t] = seen.get(t, 0) + 1
                seen.pop(None, None)
                keep.append(i)
                n.append(len(words))
                terms.append(list(seen))
                times.append(list(seen.values()))
            rows = batch.select([0, 1]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(c, t) for c, t in zip(
                (n, terms, times), _FORWARD.types[2:])]], schema=_FORWARD)

    return run


def _joint_impacts(ids, weights, first, second, docs: int, length: int):
    """The joint list of each pair (numbers into `ids`) in a partition of the forward index."""
    def run(batches):
        both, joint = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        for batch in batches:
            n, terms = batch.column("n").to_numpy(), batch.column("terms")
            cuts = terms.offsets.to_numpy()
            terms, times = terms.values.to_numpy(), batch.column("times").values.to_numpy()
            owner = np.repeat(np.arange(len(n)), np.diff(cuts))
            terms, times = terms[cuts[0]:cuts[-1]], times[cuts[0]:cuts[-1]]
            at = np.minimum(np.searchsorted(ids, terms), len(ids) - 1)
            hit = ids[at] == terms
            at, owner, times = at[hit], owner[hit], times[hit]
            m = 10 + (90 * n * docs) // length
            impact = weights[at] * ((1_000_000_000 * times) // (1000 * times + 8 * m[owner]))
            for a in range(0, len(n), _DOCS):
                lo, hi = np.searchsorted(owner, [a, a + _DOCS])
                grid = np.zeros((len(ids), min(_DOCS, len(n) - a)), np.int64)
                grid[at[lo:hi], owner[lo:hi] - a] = impact[lo:hi]
                held = np.zeros(grid.shape, bool)
                held[at[lo:hi], owner[lo:hi] - a] = True
                for p in range(0, len(first), _STEP):
                    x, y = first[p:p + _STEP], second[p:p + _STEP]
                    meet = held[x] & held[y]
                    s = slice(p, p + len(x))
                    both[s] += meet.sum(1)
                    joint[s] = np.maximum(joint[s], ((grid[x] + grid[y]) * meet).max(1, initial=0))
        some = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((some, both[some], joint[some]), _JOINT.types)],
                                         schema=_JOINT)

    return run


def combined_bound(tops: dict, joints: dict, terms) -> int:
    """A bound on the summed impacts of `terms` in one document: the pairs that save most, each
    term in one pair at most, the other terms by themselves. A pair not in `joints` is not known."""
    chosen = set(terms)
    saving = sorted(((tops[a] + tops[b] - max(j, tops[a], tops[b]), a, b) for (a, b), j in joints.items()
                     if a in chosen and b in chosen), reverse=True)
    total = sum(tops[t] for t in chosen)
    for gain, a, b in saving:
        if gain > 0 and a in chosen and b in chosen:
            total -= gain
            chosen -= {a, b}
    return total


def _set_aside(terms: pa.Table, pairs: pa.Table) -> pa.Table:
    """For one item: the remaining terms and the bound of those set aside."""
    rows = sorted(zip(terms["top"].to_pylist(), terms["id"].to_pylist()))
    item, floor = terms["item"][0].as_py(), terms["floor"][0].as_py()
    tops, order = {t: top for top, t in rows}, [t for _, t in rows]
    joints = dict(zip(zip(pairs["a"].to_pylist(), pairs["b"].to_pylist()), pairs["joint"].to_pylist()))
    n, bound, single = 0, 0, 0
    while n < len(order):
        single += tops[order[n]]
        # Single bounds first; pairs are combined only once those do not suffice.
        now = single if single < floor else combined_bound(tops, joints, order[:n + 1])
        if now >= floor:
            break
        n, bound = n + 1, now
    left = order[n:]
    # Of an item none of whose documents can be left out by bounds, all terms remain.
    return pa.table([pa.array([x] * len(left), pa.int64()) for x in (item, floor, bound)] + [pa.array(left, pa.int64())],
                    schema=_SPLIT)


class _Group:
    """The search for one group of items: (item, item_id, id) with the numbered terms of all."""

    def __init__(self, docs: DataFrame, asked: DataFrame, vocabulary: DataFrame, k: int):
        self.asked, self.k = asked, k
        ids = {r["term"].encode(): r["id"] for r in vocabulary.toLocalIterator()}
        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                           F.col("text").cast("binary").alias("text"))
        self.forward = stored(rows.mapInArrow(_forward(ids), FORWARD), "forward")
        self.docs, self.length = self.forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = self.forward.select(F.explode("terms").alias("id")).groupBy("id").agg(F.count("*").alias("df"))
        weight = F.floor(1000 * F.log(F.lit(2.0 * self.docs + 2) / (2 * F.col("df") + 1))).cast("long")
        self.weights = stored(df.select("id", "df", weight.alias("w")), "weights")

    def postings(self, terms: DataFrame) -> DataFrame:
        """(row, doc_id, id, impact) of the given terms (few: they are broadcast), with their columns."""
        m = F.expr(f"10 + (90L * n * {self.docs}L) div {max(1, self.length)}L")
        cells = self.forward.select("row", "doc_id", m.alias("m"), F.inline(F.arrays_zip("terms", "times")))
        return (cells.join(F.broadcast(terms.join(F.broadcast(self.weights.select("id", "w")), "id")), F.col("terms") == F.col("id"))
                .withColumn("impact", F.expr("w * ((1000000000L * times) div (1000L * times + 8L * m))"))
                .drop("terms", "times", "m", "w"))

    def partial(self, terms: DataFrame) -> DataFrame:
        """(item, row, doc_id, part): summed impacts of (item, id) pairs."""
        return self.postings(terms).groupBy("item", "row", "doc_id").agg(F.sum("impact").alias("part"))

    def scores(self, pairs: DataFrame) -> DataFrame:
        """(item, row, doc_id, score): the full scores of (item, row) pairs."""
        m = F.expr(f"10 + (90L * n * {self.docs}L) div {max(1, self.length)}L")
        cells = (self.forward.join(pairs.select("item", "row"), "row")
                 .select("item", "row", "doc_id", m.alias("m"), F.inline(F.arrays_zip("terms", "times"))))
        asked = self.asked.join(F.broadcast(self.weights.select("id", "w")), "id").select("item", F.col("id").alias("terms"), "w")
        impact = F.expr("w * ((1000000000L * times) div (1000L * times + 8L * m))")
        return (cells.join(F.broadcast(asked), ["item", "terms"])
                .groupBy("item", "row", "doc_id").agg(F.sum(impact).alias("score")))

    def best(self, rows: DataFrame, score: str) -> DataFrame:
        order = W.partitionBy("item").orderBy(F.desc(score), F.asc_nulls_last("doc_id"), "row")
        return rows.where(f"{score} > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k)

    def floors(self) -> DataFrame:
        """(item, floor): a score that at least k documents reach, 0 where fewer are known."""
        rarest = W.partitionBy("item").orderBy("df", "id")
        known = self.asked.join(F.broadcast(self.weights), "id").withColumn("_n", F.row_number().over(rarest))
        rare = known.where((F.col("df") * FREQUENT <= self.docs) | (F.col("_n") <= SEEDS)).select("item", "id")
        seeds = stored(self.best(self.partial(rare), "part").select("item", "row"), "seeds")
        full = self.scores(seeds).groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("floor"))
        return full.where(F.col("n") >= self.k).select("item", "floor")

    def pair_bounds(self) -> DataFrame:
        """(item, a, b, n_both, joint) of the pairs that are condensed, the most asked for first."""
        frequent = self.asked.join(F.broadcast(self.weights.where(F.col("df") * FREQUENT > self.docs)), "id")
        order = W.partitionBy("item").orderBy(F.desc("df"), "id")
        frequent = frequent.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= PAIR_TERMS)
        held = frequent.groupBy("item").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        pairs = held.select("item", F.explode("ids").alias("a"), "ids").select("item", "a", F.explode("ids").alias("b")).where("a < b")
        pairs = stored(pairs, "pairs")
        chosen = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a", "b").limit(PAIRS).collect()
        if not chosen:
            return pairs.select("*", F.lit(0).cast("long").alias("n_both"), F.lit(0).cast("long").alias("joint"))
        a, b = np.array([r["a"] for r in chosen]), np.array([r["b"] for r in chosen])
        ids = np.unique(np.concatenate((a, b)))
        weight = dict(self.weights.where(F.col("df") * FREQUENT > self.docs).select("id", "w").toLocalIterator())
        kernel = _joint_impacts(ids, np.array([weight[i] for i in ids.tolist()], np.int64), np.searchsorted(ids, a),
                                np.searchsorted(ids, b), self.docs, self.length)
        lists = (self.forward.select("n", "terms", "times").mapInArrow(kernel, "pair int, n_both long, joint long")
                 .groupBy("pair").agg(F.sum("n_both").alias("n_both"), F.max("joint").alias("joint")))
        numbered = pairs.sparkSession.createDataFrame(pa.table({"pair": pa.array(range(len(a)), pa.int32()), "a": a, "b": b}))
        # A pair without a common document has an empty list and no joint impact.
        lists = numbered.join(lists, "pair", "left").select("a", "b", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_both", "joint")])
        return pairs.join(F.broadcast(lists), ["a", "b"])

    def result(self) -> DataFrame:
        tops = self.postings(self.asked.select("id").distinct()).groupBy("id").agg(F.max("impact").alias("top"))
        terms = (self.asked.select("item", "id").join(F.broadcast(tops), "id")
                 .join(self.floors(), "item", "left").na.fill(0, ["floor"]))
        split = stored(terms.groupBy("item").cogroup(self.pair_bounds().groupBy("item"))
                       .applyInArrow(_guarded, "item long, floor long, bound long, id long"), "split")
        near = self.partial(split.select("item", "id"))
        limits = split.select("item", "floor", "bound").distinct()
        near = near.join(F.broadcast(limits), "item").where("part + bound >= floor")
        return self.best(self.scores(stored(near.select("item", "row"), "candidates")), "score")


def _guarded(terms: pa.Table, pairs: pa.Table) -> pa.Table:
    return _set_aside(terms, pairs) if terms.num_rows else _SPLIT.empty_table()


def search(docs: DataFrame, items: DataFrame, k: int = K, group_terms: int = GROUP_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.array_distinct(terms_of(F.col("text"))).alias("terms"))
    rows = stored(rows.where(F.size("terms") > 0).withColumn("item", F.monotonically_increasing_id()), "items")
    total = rows.agg(F.sum(F.size("terms"))).first()[0] or 0
    groups, found = parts_of(total, group_terms, 1), []
    for g in range(groups):
        some = rows.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g)
        cells = some.select("item", F.explode("terms").alias("term"))
        vocabulary = stored(cells.select("term").distinct().select(F.monotonically_increasing_id().alias("id"), "term"), "vocabulary")
        asked = stored(cells.join(F.broadcast(vocabulary), "term").select("item", "id"), "asked")
        out = _Group(docs, asked, vocabulary, k).result()
        found.append(out.join(F.broadcast(some.select("item", "item_id")), "item"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


_SQL_TERMS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
              "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')")
SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_TERMS} AS t FROM documents), q AS (SELECT DISTINCT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark),
s AS (SELECT count(*) AS nd, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, nd),
i AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // l))) AS impact FROM p JOIN w USING (term), s),
r AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY ALL HAVING sum(impact) > 0)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM r)
WHERE rank <= 10"""


def op11_ranked_search(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
