"""Near-duplicate vectors by inverted lists with product-quantised residuals.

Vectors of one label are compared by cosine in double precision. A coarse quantiser assigns
every vector to the list of its nearest centroid; what is left of it is coded by the nearest
codeword in each of a few subspaces. A query looks into the lists whose border it is near enough
to: those it would reach by moving `margin` towards them, so the number of probes follows
from the geometry, not from a constant. Distances to a list's codes are sums of table entries; a code
is dropped only if its distance less its own coding error is already over the threshold, which
loses nothing. The rest is reranked with the exact cosine.

The quantisers are fitted on a bounded sample (at most `sample` vectors, those with the smallest hash);
every vector is indexed. Equal vectors of a label are one entry, so copies are linked without
their pairs. A list goes to as many tasks as it has blocks of members times blocks of queries.

A vector that is null, zero, or holds null or non-finite components links with nothing, nor does
one without a label: such a row is its own component with no links. Vectors of different lengths
are not compared; lengths within a factor of two share a quantiser, filled with zeros. Repeated ids with different vectors are separate entries with the same component id rules.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rolecast.llm.common import components, dealt_join, key_counts, stored, table
from rolecast.operators.common import lookup_join

THRESHOLD, SAMPLE, SUBSPACES, CODES = 0.93, 20_000, 8, 256
BLOCK_ROWS = 2_000
MARGIN = 4.0   # border distance in standard deviations of a random step of the threshold's length


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(11)
    k = min(k, len(x))
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _distances(x, centers).argmin(1)
        count = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, weights=x[:, j], minlength=k) for j in range(x.shape[1])], 1)
        centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centers)
    return centers


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1))


class Quantiser:
    """Coarse centroids, and codewords of the residuals in each subspace."""

    def __init__(self, sample: np.ndarray, lists: int, threshold: float, margin: float):
        self.dim = sample.shape[1]
        self.radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
        self.margin = self.radius * min(1.0, margin / np.sqrt(self.dim))
        self.lists = _kmeans(sample, lists)
        left = sample - self.lists[_distances(sample, self.lists).argmin(1)]
        self.cuts = [int(c) for c in np.linspace(0, self.dim, min(SUBSPACES, self.dim) + 1)]
        self.words = [_kmeans(left[:, a:b], CODES) for a, b in zip(self.cuts[:-1], self.cuts[1:])]
        gap = np.sqrt(_distances(self.lists, self.lists))
        self.gap = np.where(gap > 0, gap, np.inf)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each vector's list, codes and coding error, and which lists it has to probe."""
        d = _distances(x, self.lists)
        near = d.argmin(1)
        # The distance to the border between the nearest list and each other one.
        border = (d - d[np.arange(len(x)), near][:, None]) / (2 * self.gap[near])
        probe = border <= self.margin
        probe[np.arange(len(x)), near] = True
        left = x - self.lists[near]
        codes = np.stack([_distances(left[:, a:b], w).argmin(1) for a, b, w in self._spaces()], 1).astype(np.uint8)
        back = np.concatenate([w[codes[:, i]] for i, w in enumerate(self.words)], 1)
        return near, codes, np.sqrt(((left - back) ** 2).sum(1)), probe

    def _spaces(self):
        return zip(self.cuts[:-1], self.cuts[1:], self.words)

    def near(self, list_id: int, queries: np.ndarray, codes: np.ndarray, error: np.ndarray) -> np.ndarray:
        """Which codes may be within the radius of each query, from table look-ups alone."""
        left = queries - self.lists[list_id]
        total = np.zeros((len(queries), len(codes)))
        for i, (a, b, words) in enumerate(self._spaces()):
            total += _distances(left[:, a:b], words)[:, codes[:, i]]
        return np.sqrt(total) <= self.radius + error[None, :] + 1e-6


ENTRY = "part string, list int, id long, codes binary, error double, vector binary"
QUERY = "part string, list int, id long, vector binary"


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _entries(sent):
    def run(batches):
        q = sent.value
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(2), q.dim)
                near, codes, error, _ = q.assign(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(near.astype(np.int32)), batch.column(1),
                     pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), batch.column(2)],
                    names=["part", "list", "id", "codes", "error", "vector"])

    return run


def _queries(sent):
    def run(batches):
        q = sent.value
        for batch in batches:
            if batch.num_rows:
                rows, lists = np.nonzero(q.assign(_matrix(batch.column(2), q.dim))[3])
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), pa.array(lists.astype(np.int32)), batch.column(1).take(at),
                     batch.column(2).take(at)], names=["part", "list", "id", "vector"])

    return run


def _search(sent, threshold: float):
    def run(members: pa.Table, queries: pa.Table) -> pa.Table:
        q, out = sent.value, []
        if members.num_rows and queries.num_rows:
            x, ids = _matrix(members.column("vector"), q.dim), members.column("id").to_numpy()
            codes = np.frombuffer(b"".join(members.column("codes").to_pylist()), np.uint8).reshape(len(x), -1)
            error, list_id = members.column("error").to_numpy(), members.column("list")[0].as_py()
            y, asked = _matrix(queries.column("vector"), q.dim), queries.column("id").to_numpy()
            for at in range(0, len(y), 256):
                hit = q.near(list_id, y[at:at + 256], codes, error) & (asked[at:at + 256, None] < ids[None, :])
                a, b = np.nonzero(hit)
                good = np.einsum("ij,ij->i", y[at + a], x[b]) >= threshold
                out.append((asked[at + a[good]], ids[b[good]]))
        a, b = (np.concatenate(c) for c in zip(*out)) if out else [np.zeros(0, np.int64)] * 2
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _normal(dim: int):
    """Unit vectors as 64-bit floats, filled with zeros up to `dim`."""
    def run(batches):
        for batch in batches:
            rows = [np.array(v, np.float64) for v in batch.column(2).to_pylist()]
            unit = [v / np.abs(v).max() for v in rows]  # no overflow in the squares
            data = [np.pad(v / np.sqrt((v * v).sum()), (0, dim - len(v))).tobytes() for v in unit]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())],
                                             names=["part", "id", "vector"])

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE,
                 margin: float = MARGIN) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each vector."""
    v = F.col("embedding")
    number = lambda x: x.cast("double")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(number(x)) & (F.abs(number(x)) < float("inf")), F.lit(False)))
    usable = F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False)) & F.col("label").isNotNull()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v)
    rows = rows.withColumn("usable", usable).withColumn("k1", F.xxhash64("label", v)).withColumn(
        "k2", F.xxhash64(F.lit(1), "label", v))
    alone = ["vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")]
    out = rows.where(~F.col("usable")).select(*alone)
    # Lengths within a factor of two share a quantiser; there are at most 32 such classes.
    band = F.ceil(F.log2(F.size(v)))
    rows = rows.where("usable").withColumn("band", band)
    for r in rows.groupBy("band").agg(F.max(F.size(v)).alias("dim")).orderBy("band").collect():
        out = out.union(_linked(rows.where(F.col("band") == r["band"]), r["dim"], threshold, sample, margin))
    return out


def _linked(rows: DataFrame, dim: int, threshold: float, sample: int, margin: float) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of usable vectors of up to `dim` numbers. Only those of
    one label and one length are compared: both are in the key of a list."""
    spark, v = rows.sparkSession, F.col("embedding")
    # Ids may repeat, so an entry has a number of its own; equal vectors share it.
    part = F.concat_ws("/", F.size(v), "label")
    entries = rows.groupBy("k1", "k2").agg(
        F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first(part).alias("part"), F.first(v).alias("v"))
    entries = stored(entries.withColumn("id", F.monotonically_increasing_id()), "entries")
    unit = stored(entries.select("part", "id", "v").mapInArrow(_normal(dim), "part string, id long, vector binary"), "units")
    # At most `sample` vectors come to the driver.
    some = unit.orderBy(F.xxhash64("vector"), "id").limit(sample).select("vector").toPandas()
    data = np.frombuffer(b"".join(some["vector"]), np.float64).reshape(-1, dim)
    lists = 1 << max(0, int(np.log2(max(1.0, np.sqrt(entries.count()) / 2))))
    sent = spark.sparkContext.broadcast(Quantiser(data, min(lists, max(1, len(data) // 16)), threshold, margin))
    members = stored(unit.mapInArrow(_entries(sent), ENTRY), "lists")
    probes = stored(unit.mapInArrow(_queries(sent), QUERY), "probes")
    key = ["part", "list"]
    many = lambda n: F.ceil(F.col(n) / BLOCK_ROWS).cast("int")
    blocks = (members.groupBy(*key).agg(F.count("*").alias("m")).join(probes.groupBy(*key).agg(F.count("*").alias("q")), key)
              .select(*key, many("m").alias("m"), many("q").alias("q")))
    blocks = stored(blocks, "blocks")
    turn = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = lookup_join(members, blocks, key, "inner").withColumn("mb", turn("m")).withColumn("qb", every("q")).drop("m", "q")
    right = lookup_join(probes, blocks, key, "inner").withColumn("qb", turn("q")).withColumn("mb", every("m")).drop("m", "q")
    four = [*key, "mb", "qb"]
    links = stored(left.groupBy(*four).cogroup(right.groupBy(*four)).applyInArrow(
        _search(sent, threshold), "a long, b long"), "links")
    # A link counts the copies at its other end; an entry's own copies link with each other.
    both = links.union(links.select("b", "a"))
    counts = dealt_join(both, entries.select(F.col("id").alias("b"), "copies"), "b", "a", key_counts(both, "b"))
    counts = counts.groupBy("a").agg(F.sum("copies").alias("n"))
    comp = components(both.select(F.col("a").alias("node")).distinct(), links)
    per = (entries.select("k1", "k2", "id", "low", "copies").join(counts, F.col("id") == F.col("a"), "left")
           .join(comp, F.col("id") == F.col("node"), "left")
           .select("k1", "k2", "low", F.coalesce("component", "id").alias("component"),
                   (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    per = stored(per, "per")
    lows = per.groupBy("component").agg(F.min("low").alias("component_id"))
    per = stored(lookup_join(per, lows, ["component"], "inner").select("k1", "k2", "n_links", "component_id"), "per")
    return lookup_join(rows.select("vec_id", "k1", "k2"), per, ["k1", "k2"], "inner").select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op3_vectors(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))
