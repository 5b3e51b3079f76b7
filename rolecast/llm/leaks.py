"""Benchmark items inside documents, by size-partitioned MinHash containment search.

An item leaks into a document that holds at least `per_cent` of its word shingles. The MinHash
signature of an item is its k smallest shingle hashes. A document that holds so much of an
item misses at most n - ceil(t n) of its n shingles, so with k one above that at least one
signature value is in it. n differs between items, so items are partitioned by size, and each
partition has the k of its largest item. Documents are then looked up by equality alone, however
long they are, with nothing missed; every candidate pair is verified by exact containment.

DataFrame functions only. A small signature table (counted and bounded) is broadcast; a larger
one is joined by hash with hot values spread over tasks.

Words are runs of letters and digits in the lower-cased text; shingles are `words` of them. An
item of fewer words is one shingle of all its words, and documents are also asked for shingles of
the sizes of such items, so it is found anywhere inside a longer document. An item without words
leaks nowhere; null and empty documents hold nothing. Repeated documents and repeated items each
give their own rows.
"""

from pyspark.sql import Column, DataFrame, functions as F

from rolecast.llm.common import stored, table
from rolecast.operators.common import lookup_join

WORDS, PER_CENT = 5, 80


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _runs(t: Column, n: int) -> Column:
    """The hashes of all runs of n words; none if there are fewer words."""
    return F.when(F.size(t) >= n, F.transform(
        F.slice(t, 1, F.greatest(F.size(t) - (n - 1), F.lit(1))),
        lambda w, i: F.xxhash64(w, *[F.get(t, i + j) for j in range(1, n)]))).otherwise(F.array().cast("array<bigint>"))


def shingles(text: Column, words: int = WORDS) -> Column:
    """The 64-bit hashes of an item's word shingles, in order; repeated ones repeat. An item of
    fewer words is one shingle."""
    def of(t: Column) -> Column:
        out = _runs(t, words)
        for n in range(1, words):
            out = F.when(F.size(t) == n, _runs(t, n)).otherwise(out)
        return out

    return F.transform(F.array(_tokens(text)), of)[0]


def document_shingles(text: Column, words: int, sizes: list[int]) -> Column:
    """The hashes of a document's shingles, and of its shorter runs of the given sizes."""
    return F.transform(F.array(_tokens(text)), lambda t: F.concat(*[_runs(t, n) for n in (words, *sizes)]))[0]


def short_sizes(items: DataFrame, words: int) -> list[int]:
    """How many words the items of fewer than `words` words have; at most words - 1 numbers."""
    n = F.size(_tokens(F.col("text")))
    return [r["n"] for r in items.select(n.alias("n")).where(f"n BETWEEN 1 AND {words - 1}").distinct().orderBy("n").collect()]


def item_signatures(items: DataFrame, words: int = WORDS, per_cent: int = PER_CENT) -> tuple[DataFrame, DataFrame]:
    """(item, n, shingle) of all items, and (item, shingle) of their signatures."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.array_distinct(shingles(F.col("text"), words)).alias("s"))
    # Repeated items stay apart by a number of their own.
    rows = rows.where(F.size("s") > 0).groupBy("item_id", "s").agg(F.count("*").alias("copies"))
    rows = stored(rows.select(F.monotonically_increasing_id().alias("item"), "item_id", "copies", "s", F.size("s").alias("n")), "items")
    # Sizes of one partition differ by less than a factor of two.
    part = F.floor(F.log2("n"))
    largest = F.pow(F.lit(2), part + 1) - 1
    k = (largest - F.ceil(largest * per_cent / 100) + 1).cast("int")
    every = rows.select("item", "item_id", "copies", "n", F.explode("s").alias("shingle"))
    return every, rows.select("item", F.explode(F.slice(F.sort_array("s"), F.lit(1), k)).alias("shingle"))


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def leaks(docs: DataFrame, items: DataFrame, words: int = WORDS, per_cent: int = PER_CENT,
          rows_only: bool = False) -> DataFrame:
    """(doc_id, item_id, shared, n_shingles, containment): documents that hold an item; or only
    the distinct (row), the `row_key` of each such document."""
    every, signatures = item_signatures(items, words, per_cent)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), "text")
    sizes = short_sizes(items, words)
    probes = rows.select("row", F.explode(document_shingles(F.col("text"), words, sizes)).alias("shingle"))
    values = stored(signatures.select("shingle").distinct(), "signatures")
    hits = lookup_join(probes, values, ["shingle"], "inner").distinct()
    pairs = stored(lookup_join(hits, signatures, ["shingle"], "inner").select("row", "item").distinct(), "candidates")
    # Only candidate documents are taken apart again, each row of equal content once.
    some = pairs.select("row").distinct()
    found = lookup_join(rows, stored(some, "rows"), ["row"], "inner")
    owners = stored(found.groupBy("row", "doc_id").agg(F.count("*").alias("times"), F.min("text").alias("text")), "documents")
    held = owners.select("row", F.explode(F.array_distinct(document_shingles(F.col("text"), words, sizes))).alias("shingle"))
    asked = pairs.join(every, "item")
    shared = (held.join(asked, ["row", "shingle"]).groupBy("row", "item", "item_id", "copies", "n")
              .agg(F.count("*").alias("shared")).where(100 * F.col("shared") >= per_cent * F.col("n")))
    out = shared.join(owners.select("row", "doc_id", "times"), "row")
    if rows_only:
        return out.select("row").distinct()
    times = F.explode(F.array_repeat(F.lit(0), (F.col("times") * F.col("copies")).cast("int")))
    return out.select("doc_id", "item_id", "shared", F.col("n").cast("long").alias("n_shingles"),
                      (F.col("shared") / F.col("n")).alias("containment"), times.alias("_")).drop("_")


SQL_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
SQL = f"""
WITH d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents), i AS (SELECT item_id, {SQL_WORDS} AS w FROM benchmark),
sizes AS (SELECT 5 AS n UNION SELECT len(w) FROM i WHERE len(w) BETWEEN 1 AND 4),
ds AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[j:j + n - 1], ' ') FOR j IN range(1, len(w) - n + 2)]) AS s
       FROM d, sizes WHERE len(w) >= n),
iss AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[j:j + 4], ' ') FOR j IN range(1, len(w) - 3)]
       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM i),
n AS (SELECT item_id, count(*) AS n_shingles FROM iss GROUP BY 1)
SELECT doc_id, item_id, count(*) AS shared, any_value(n_shingles) AS n_shingles, count(*) / any_value(n_shingles) AS containment
FROM ds JOIN iss USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 80 * any_value(n_shingles)"""


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    found = stored(leaks(docs, items, rows_only=True).withColumnRenamed("row", "_row"), "leaks")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), row_key().alias("_row"))
    return lookup_join(rows, found, ["_row"], "left_anti").select("_doc.*")


def op6_leaks(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
