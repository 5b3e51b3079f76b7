"""Documents whose sets of word shingles have a Jaccard similarity over a threshold.

Equal sets are one node from the start. For the others, candidates must share a prefix token
under two global orders of tokens: rarest first by document frequency, and by hash with
frequent tokens last. A set of n tokens has its n - ceil(t n) + 1 first tokens as prefix; two
sets over the threshold t share a token in the prefixes under every order. So:

1. Document frequencies: the tokens of each block of texts travel as packed sorted arrays, with
   their chunks, to buckets by hash; frequency classes of those in more than one document go back
   to the chunks. Tokens of one document come first and are shared with nobody, so most sets have
   no prefix to send.
2. Sets with a recurring prefix token are stored once per chunk with both prefixes.
3. Sets that share a token of the first order are a group. Links are sought where they still
   can join two components. While groups are large, every set is tested against one member of
   its groups, the smallest under the round's hash, of another component; once few are left, all
   pairs of a group in different components are. A pair must pass the filters by size and by the
   place of the common token, and share a prefix token of the second order, before the sets
   themselves are compared. Copies of one text, near or exact, are so joined by about one test
   each, whatever the size of the group.
4. Components over the found links give each document the smallest doc_id it can reach.

All links between components are found, so components are those of the full join. Words are
[^\\x20\\x09-\\x0D]+ after A-Z are lower-cased; a text of fewer words than a shingle has its
whole sequence as one shingle; null and empty texts have none and link with nothing. Null ids
never are a component's smallest id unless it has no other. Shingles are 64-bit hashes.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rolecast.llm.common import (BUCKET_BYTES, CHUNK_BYTES, chunk_of, components, dealt_join, key_counts, parts_of, stored, table,
                                 text_bytes)
from rolecast.llm.kernels import (LOWER, Rolling, U, blocks, bucket_slices, deflated, inflated, joined, mixed, ranges,
                                  word_hashes)
from rolecast.operators.common import lookup_join, union_all

WORDS, THRESHOLD = 4, 85   # per cent
STARS = 3                  # rounds of one test for each set, at most
PAIRS_PER_ROW = 16         # pairs left per row of a group, up to which all of them are looked at
GROUP_ROWS = 5000          # sets of a group on each side of a task that looks at pairs
BODY_ROWS = 10_000         # pairs of one set that one task compares
FREQUENT = 6               # classes are powers of two of the document frequency
ROUTED = "bucket int, n int, tokens binary, chunks binary, counts binary"
CLASSES = "chunk int, n int, tokens binary, classes binary"
STEP = ("kind int, doc_id long, n long, set long, rare int, prefix array<long>, second array<int>, "
        "tokens array<long>")


def _sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text: owners and hashes, sorted by both."""
    owners, hashes = [], []
    for a, b in blocks(texts):
        buffer, starts, ends = joined(texts[a:b])
        at, _, w = word_hashes(LOWER[buffer])
        first, last = np.searchsorted(at, starts), np.searchsorted(at, ends)
        n = last - first
        counts = np.where(n >= words, n - words + 1, np.minimum(n, 1))
        begin = ranges(first, counts)
        owner = np.repeat(np.arange(a, b), counts)
        end = np.minimum(begin + words, last[owner - a])
        h = Rolling(w).of(begin, end)
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        owners.append(owner[new])
        hashes.append(h[new])
    return (np.concatenate(owners), np.concatenate(hashes)) if owners else (np.zeros(0, np.int64), np.zeros(0, U))


def _send(words: int, bits: int, buckets: int):
    def run(batches):
        for chunks, texts in ((batch.column(0).to_numpy()[a:b], texts[a:b]) for batch in batches
                              for texts in [[t or b"" for t in batch.column(1).to_pylist()]]
                              for a, b in blocks(texts, CHUNK_BYTES)):
            owner, h = _sets(texts, words)
            chunk, h = chunks[owner].astype(np.int32), h >> U(64 - bits)
            order = np.lexsort((chunk, h))
            chunk, h = chunk[order], h[order]
            new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (chunk[1:] != chunk[:-1])))) if len(h) else np.zeros(0, int)
            counts = np.minimum(np.diff(np.append(new, len(h))), 255).astype(np.uint8)
            chunk, h = chunk[new], h[new]
            # One row a bucket, whatever the number of chunks: rows for pairs of both would soon be as many as tokens.
            rows = [(b, s.stop - s.start, deflated(h[s]), deflated(chunk[s], rising=False), deflated(counts[s], rising=False))
                    for b, s in bucket_slices(h << U(64 - bits), buckets)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [
                    pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()])],
                    names=["bucket", "n", "tokens", "chunks", "counts"])

    return run


def _classes(t: pa.Table) -> pa.Table:
    size = t.column("n").to_pylist()
    tokens = np.concatenate([inflated(x, n, U) for x, n in zip(t.column("tokens").to_pylist(), size)])
    counts = np.concatenate([inflated(x, n, np.uint8, rising=False) for x, n in zip(t.column("counts").to_pylist(), size)])
    chunk = np.concatenate([inflated(x, n, np.int32, rising=False) for x, n in zip(t.column("chunks").to_pylist(), size)])
    order = np.argsort(tokens, kind="stable")
    tokens, counts, chunk = tokens[order], counts[order], chunk[order]
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[1:] != tokens[:-1]
    group = np.cumsum(new) - 1
    total = np.bincount(group, weights=counts)
    kind = np.floor(np.log2(np.maximum(total, 1))).astype(np.uint8)[group]
    tokens, kind, chunk = tokens[kind > 0], kind[kind > 0], chunk[kind > 0]
    order = np.lexsort((tokens, chunk))
    tokens, kind, chunk = tokens[order], kind[order], chunk[order]
    ids, at = np.unique(chunk, return_index=True)
    cuts = list(zip(at, np.append(at[1:], len(chunk))))
    return pa.table({"chunk": pa.array(ids, pa.int32()), "n": pa.array([int(j - i) for i, j in cuts], pa.int32()),
                     "tokens": pa.array([deflated(tokens[i:j]) for i, j in cuts], pa.binary()),
                     "classes": pa.array([deflated(kind[i:j]) for i, j in cuts], pa.binary())})


def prefix_size(n, per_cent: int):
    """Tokens of which one must be shared: n - ceil(t n) + 1."""
    return n + 1 + (-per_cent * n) // 100


def _prefixes(words: int, per_cent: int, bits: int):
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        size = back.column("n").to_pylist()
        keys = np.concatenate([inflated(x, n, U) for x, n in zip(back.column("tokens").to_pylist(), size)] or [np.zeros(0, U)])
        kinds = np.concatenate([inflated(x, n, np.uint8) for x, n in zip(back.column("classes").to_pylist(), size)]
                               or [np.zeros(0, np.uint8)])
        order = np.argsort(keys, kind="stable")
        keys, kinds = keys[order], kinds[order]
        ids = docs.column("doc_id").to_pylist()
        owner, h = _sets([t or b"" for t in docs.column("text").to_pylist()], words)
        n = np.bincount(owner, minlength=len(ids))
        ends = np.cumsum(n)
        sums = np.concatenate(([0], np.cumsum(mixed(h), dtype=U))).astype(U)
        whole = mixed(sums[ends] - sums[ends - n] + n.astype(U) * U(0x9E3779B97F4A7C15)).astype(np.int64)
        at = np.minimum(np.searchsorted(keys, h >> U(64 - bits)), max(0, len(keys) - 1))
        kind = np.where(keys[at] == h >> U(64 - bits), kinds[at], 0) if len(keys) else np.zeros(len(h), np.uint8)
        rare = np.bincount(owner, weights=kind == 0, minlength=len(ids)).astype(np.int64)
        prefix = np.where(n > 0, prefix_size(n, per_cent), 0)
        # Sorted by frequency class, the tokens of this document alone stand first.
        open_ = np.flatnonzero(rare < prefix)
        _, one = np.unique(whole[open_], return_index=True)
        sets = []
        for d in open_[np.sort(one)].tolist():
            s = slice(ends[d] - n[d], ends[d])
            tokens, k, p = h[s], kind[s], int(prefix[d])
            first = np.lexsort((tokens, k))[:p]
            second = mixed(tokens ^ U(0xA5A5A5A5A5A5A5A5))
            by_hash = np.lexsort((second, k >= FREQUENT))[:p]
            sets.append((1, None, int(n[d]), int(whole[d]), int(rare[d]), tokens[first[k[first] > 0]].astype(np.int64),
                         (second[by_hash[k[by_hash] > 0]] >> U(32)).astype(np.uint32).astype(np.int32),
                         tokens.astype(np.int64)))
        rows = [(0, i, int(m), int(w) if m else None, None, None, None, None) for i, m, w in zip(ids, n, whole)] + sets
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()),
                 pa.list_(pa.int32()), pa.list_(pa.int64())]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in STEP.split(", ")])

    return run


def similar_documents(docs: DataFrame, words: int = WORDS, per_cent: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document."""
    size = text_bytes(docs)
    chunks, buckets = parts_of(size, CHUNK_BYTES), parts_of(size, BUCKET_BYTES // 2)
    # One byte of text makes less than one token: false sharing stays below 2 ** -5.
    bits = min(64, max(32, math.ceil(math.log2(size + 1)) + 5))
    chunk = chunk_of(F.xxhash64("doc_id", "text"), chunks).alias("chunk")
    text = F.col("text").cast("binary").alias("text")
    classes = (docs.select(chunk, text).mapInArrow(_send(words, bits, buckets), ROUTED)
               .groupBy("bucket").applyInArrow(_classes, CLASSES))
    full = docs.select(chunk, F.col("doc_id").cast("long").alias("doc_id"), text)
    step = stored(full.groupBy("chunk").cogroup(classes.groupBy("chunk"))
                  .applyInArrow(_prefixes(words, per_cent, bits), STEP), "sets")
    nodes = step.where("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "set")
    links = _links(step.where("kind = 1"), per_cent)
    # The sets that are more than one document: all others are their own component.
    per_set = nodes.where("set is not null").groupBy("set").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"))
    linked = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    comp = components(linked, links)
    several = (per_set.join(comp, per_set["set"] == comp["node"], "left")
               .where("copies > 1 or component is not null")
               .select("set", "low", F.coalesce("component", "set").alias("component")))
    several = stored(several, "several")
    lows = several.groupBy("component").agg(F.min("low").alias("component_id"))
    several = stored(lookup_join(several, lows, ["component"], "inner").select("set", "component_id"), "ids")
    # Null sets match nothing and need no join.
    out = lookup_join(nodes.where("set is not null"), several, ["set"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.union(nodes.where("set is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _links(sets: DataFrame, per_cent: int) -> DataFrame:
    """(a, b): verified links that join all sets of a component."""
    # The tokens of one document alone come first, so they count into a token's position.
    member = sets.select("set", "n", "rare", F.posexplode("prefix").alias("at", "token")).select(
        "set", "n", "token", (F.col("rare") + F.col("at")).alias("at"))
    # Of two similar sets the shorter has a common token in its first n - ceil(2t / (1 + t) n) + 1.
    member = member.withColumn("early", (100 + per_cent) * (F.col("n") - F.col("at")) >= 2 * per_cent * F.col("n"))
    shared = member.groupBy("token").agg(F.min("set").alias("lo"), F.max("set").alias("hi"),
                                         F.max("early").alias("any")).where("lo <> hi and any")
    # A set comes once per chunk that holds copies of it.
    member = stored(dealt_join(member, shared.select("token"), "token", "set", key_counts(member, "token")).distinct(), "members")
    bodies = sets.select("set", "second", "tokens").join(member.select("set").distinct(), "set", "left_semi")
    bodies = stored(bodies.dropDuplicates(["set"]), "bodies")
    found, comp, turn, fresh = [], None, 0, True
    while True:
        now = member.withColumn("comp", F.col("set")) if comp is None else (
            lookup_join(member, comp, ["set"], "left").withColumn("comp", F.coalesce("comp", "set")))
        each = now.groupBy("token", "comp").agg(F.count("*").alias("all"), F.sum(F.col("early").cast("int")).alias("early"))
        each = each.groupBy("token").agg(
            F.sum("all").cast("double").alias("all"), F.sum("early").cast("double").alias("early"), F.count("*").alias("comps"),
            F.sum(F.col("all").cast("double") * F.col("early")).alias("within"))
        # First the set with the fewest tokens of its own, most like an original; then any other.
        own = F.col("at") if turn == 0 else F.lit(0).cast("long")
        rank = [own.alias("own"), F.xxhash64("set", F.lit(turn)).alias("rank")]
        center = F.min(F.when(F.col("early"), F.struct(*rank, "set", "n", "at", "comp")))
        groups = stored(each.where("comps > 1 and early > 0").join(now.groupBy("token").agg(center.alias("c")), "token"), "groups")
        left = groups.agg(F.sum("all"), F.sum(F.expr("all * early - within"))).first()
        if not left[0]:
            break
        # Stars while they join sets and many pairs are left; the last round looks at all of them.
        last = turn >= STARS or turn > 0 and (not fresh or left[1] <= PAIRS_PER_ROW * left[0])
        sizes = groups.select("token", "c", F.col("all").alias("n_all"), F.col("early").alias("n_early"))
        mine = dealt_join(now, sizes, "token", "set", groups.select("token", F.col("all").alias("n")))
        if last:
            # Blocks of members meet blocks of early members, so no group is one task's.
            many = lambda n: F.ceil(F.col(n) / GROUP_ROWS).cast("int")
            turn = lambda n: F.pmod(F.xxhash64("set"), many(n)).cast("int")
            every = lambda n: F.explode(F.sequence(F.lit(0), many(n) - 1))
            early = mine.where("early").select(
                F.col("token").alias("t"), F.col("set").alias("b"), F.col("n").alias("m"), F.col("at").alias("bt"),
                F.col("comp").alias("other"), turn("n_early").alias("early_block"), every("n_all").alias("block"))
            pairs = mine.select("token", F.col("set").alias("a"), "n", "at", "comp", turn("n_all").alias("a_block"),
                                every("n_early").alias("with_block")).join(
                early, (F.col("token") == F.col("t")) & (F.col("a_block") == F.col("block"))
                & (F.col("with_block") == F.col("early_block")) & (F.col("comp") != F.col("other")) & (F.col("n") >= F.col("m"))
                & _hopeful(F.col("n"), F.col("at"), F.col("m"), F.col("bt"), per_cent)).select("a", "b").distinct()
        else:
            hope = _hopeful(F.col("n"), F.col("at"), F.col("c.n"), F.col("c.at"), per_cent)
            pairs = (mine.where((F.col("comp") != F.col("c.comp")) & hope).groupBy("set").agg(F.min("c").alias("c"))
                     .select(F.col("c.set").alias("a"), F.col("set").alias("b")))
        links = stored(_verified(stored(pairs, "pairs"), bodies, per_cent), "verified")
        fresh = not links.isEmpty()
        if fresh:
            found.append(links)
        if last:
            break
        if fresh:
            links = union_all(found)
            nodes = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
            comp = stored(components(nodes, links).select(F.col("node").alias("set"), F.col("component").alias("comp")), "comp")
        turn += 1
    return union_all(found) if found else member.select(F.col("set").alias("a"), F.col("set").alias("b")).limit(0)


def _hopeful(n, at, m, bt, per_cent: int):
    """Whether sets of n and m tokens that first meet at these places can be similar: all later
    tokens may be shared, and that many must be."""
    return (100 + per_cent) * F.least(n - at, m - bt) >= per_cent * (n + m)


def _verified(pairs: DataFrame, bodies: DataFrame, per_cent: int) -> DataFrame:
    """The pairs that share a prefix token of the second order, and whose sets are similar."""
    b = bodies.select(F.col("set").alias("b"), F.col("second").alias("q"), F.col("tokens").alias("y"))
    a = bodies.select(F.col("set").alias("a"), F.col("second").alias("p"), F.col("tokens").alias("x"))
    rows = dealt_join(pairs, b, "b", "a", key_counts(pairs, "b"), BODY_ROWS)
    rows = dealt_join(rows, a, "a", "b", key_counts(pairs, "a"), BODY_ROWS).where(F.arrays_overlap("p", "q"))
    shared = F.size(F.array_intersect("x", "y"))
    return rows.where(100 * shared >= per_cent * (F.size("x") + F.size("y") - shared)).select("a", "b")


def one_of_each(docs: DataFrame, words: int = 5, per_cent: int = 80) -> DataFrame:
    """One document of each group of similar ones, with all its columns: that of the smallest id;
    rows with a null or repeated id come after all others."""
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    odd = stored(odd.select(F.col("doc_id").alias("_odd")), "odd")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("doc_id").cast("long").alias("_id"))
    if not odd.isEmpty():
        # Written once, so that the numbers hold.
        same = F.col("_id").eqNullSafe(F.col("_odd"))
        late = rows.join(odd, same, "left_semi").select("_doc", (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("_id"))
        rows = rows.join(odd, same, "left_anti").union(stored(late, "late"))
    found = similar_documents(rows.select(F.col("_id").alias("doc_id"), F.col("_doc.text").alias("text")), words, per_cent)
    gone = stored(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_id")), "gone")
    return lookup_join(rows, gone, ["_id"], "left_anti").select("_doc.*")


def op9_jaccard(spark, sf_dir):
    return similar_documents(table(spark, sf_dir, "documents"))
