"""Terms of texts: frequencies, dictionary hits, synonyms, weights, requirements."""

import re
from collections import Counter
from functools import reduce
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from rolecast import values as V
from rolecast.functions.text import (TOKEN, anchors, is_anchor, mark, normalize_term, sign_pattern, stands_in,
                                     term_anchor)
from rolecast.operators.common import checkpointed, is_small, lookup_join, union_all

_LINE, _PHRASE = 1 << 32, 1 << 31


def _values(spark: SparkSession, columns: str, rows) -> DataFrame:
    """A local table; unlike a parallelised list it needs no job to be read."""
    body = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v).lower() for v in row)
                     + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({columns})")


def seed_lexicon(spark: SparkSession) -> DataFrame:
    """Own seed (term, is_tool); callers pass their own table."""
    known = V.TOOLS + V.LEXICON + [s for s, _ in V.SYNONYMS]
    return _values(spark, "term, is_tool", [(t, t in V.TOOLS) for t in dict.fromkeys(known)])


def seed_synonyms(spark: SparkSession) -> DataFrame:
    return symmetric(_values(spark, "src, dst", V.SYNONYMS))


def symmetric(edges: DataFrame) -> DataFrame:
    """Edges both ways, normalised, without self-loops."""
    e = edges.select(normalize_term(F.col("src")).alias("src"),
                     normalize_term(F.col("dst")).alias("dst"))
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.where("src <> dst").distinct()


def vocabulary(lexicon: DataFrame, synonyms: DataFrame,
               extra: DataFrame | None = None) -> DataFrame:
    """(term, is_tool): lexicon terms, synonym sources and any further terms, each once."""
    parts = [lexicon.select(normalize_term(F.col("term")).alias("term"), "is_tool"),
             synonyms.select(F.col("src").alias("term"), F.lit(False).alias("is_tool"))]
    if extra is not None:
        parts.append(extra.select(normalize_term(F.col("term")).alias("term"),
                                  F.lit(False).alias("is_tool")))
    return (union_all(parts).where("term <> ''").groupBy("term")
            .agg(F.max(F.coalesce("is_tool", F.lit(False))).alias("is_tool")))


_COUNTED = "array<struct<term string, n bigint, first_pos bigint>>"
_TOKEN, _TEXTS = re.compile(TOKEN), 256


def _counted(lowered: str, stopwords: frozenset, ranked: bool, top_n: int | None) -> list[tuple[str, int, int]]:
    """(term, n, first_pos) of one lower-case text, in order of first use or ranked."""
    terms, at = [], []
    for i, line in enumerate(lowered.splitlines()):
        words = [w for w in (t.strip(".-/&") for t in _TOKEN.findall(line)) if len(w) >= 3 and w not in stopwords]
        start = i * _LINE
        terms += words
        at += range(start, start + len(words))
        terms += map(" ".join, zip(words, words[1:]))
        at += range(start + _PHRASE, start + _PHRASE + max(len(words) - 1, 0))
    # The first place of a term is the one that is entered last.
    first = dict(zip(reversed(terms), reversed(at)))
    rows = [(t, n, first[t]) for t, n in Counter(terms).items()]
    if ranked:
        # A pair counts half a use more than a word.
        rows.sort(key=lambda r: (-2 * r[1] - (" " in r[0]), r[2], r[0]))
    return rows[:top_n]


def _in_cells(lowered: Column, stopwords, ranked: bool = False, top_n: int | None = None) -> Column:
    stop = frozenset(stopwords)

    def some(cells: pa.Array) -> pa.Array:
        rows, ends = [], [0]
        for x in cells:
            rows += _counted(x.as_py() or "", stop, ranked, top_n)
            ends.append(len(rows))
        t, n, at = zip(*rows) if rows else ((), (), ())
        entries = pa.StructArray.from_arrays(
            [pa.array(t, pa.string()), pa.array(n, pa.int64()), pa.array(at, pa.int64())], ["term", "n", "first_pos"])
        none = pa.array([a == b for a, b in zip(ends, ends[1:])], pa.bool_())
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries, mask=none)

    def run(cells: pa.Array) -> pa.Array:
        # A few texts at a time: Python's lists of a whole batch would be far larger than its arrays.
        return pa.concat_arrays([some(cells.slice(i, _TEXTS)) for i in range(0, max(len(cells), 1), _TEXTS)])

    return F.arrow_udf(run, _COUNTED)(lowered)


def counted_terms(body: Column, stopwords=V.STOPWORDS) -> Column:
    """array<struct<term, n, first_pos>>: words and neighbouring pairs per line of a text, null without any.

    Counted inside the cell, by a small Python helper over Arrow batches: as built-in expressions
    Spark interprets each step per word. Nothing is exploded before it is counted, so nothing is
    shuffled. Lower case is Spark's own.
    """
    return _in_cells(F.lower(body), stopwords)


def term_counts(docs: DataFrame, doc: str = "doc_id", body: str = "text",
                stopwords=V.STOPWORDS) -> DataFrame:
    """(doc, term, n, is_phrase, first_pos): words and neighbouring pairs per line of each
    document, which is one row. Needs no shuffle."""
    return (docs.select(doc, F.inline(counted_terms(F.col(body), stopwords)))
            .withColumn("is_phrase", F.col("term").contains(" ")))


def term_weight(n: Column, is_phrase: Column) -> Column:
    w = F.lit(0.45) + F.lit(0.12) * F.least(n, F.lit(4)) + F.when(is_phrase, 0.12).otherwise(0.0)
    return F.round(F.least(w, F.lit(0.95)), 3)


def top_terms(docs: DataFrame, doc: str = "doc_id", body: str = "text", top_n: int | None = None,
              stopwords=V.STOPWORDS) -> DataFrame:
    """(doc, term, n, weight, term_rank): the terms of each document, most salient first;
    `top_n` of them (usually `V.TOP_TERMS`) if given."""
    # Ranked inside the cell, as they were counted.
    kept = _in_cells(F.lower(F.col(body)), stopwords, True, top_n)
    return (docs.select(doc, F.posexplode(kept).alias("_i", "_t"))
            .select(doc, "_t.term", "_t.n", (F.col("_i") + 1).alias("term_rank"))
            .select(doc, "term", "n", term_weight(F.col("n"), F.col("term").contains(" ")).alias("weight"), "term_rank"))


SKETCH_BITS_PER_VALUE, SKETCH_LEAST, SKETCH_MOST = 16, 1 << 10, 1 << 24


def sketch(values: DataFrame) -> bytes:
    """A bit per crc32 of each value of a one-column table of any size: at most `SKETCH_MOST` bits (2 MB),
    which go to every task. A value that is not there finds its bit set with a chance of one in
    `SKETCH_BITS_PER_VALUE` or, of a table too large for the list, more. Runs two jobs."""
    (name,) = values.columns
    n = values.agg(F.approx_count_distinct(name)).first()[0]
    bits = SKETCH_LEAST
    while bits < min(SKETCH_BITS_PER_VALUE * n, SKETCH_MOST):
        bits *= 2
    place = F.crc32(F.col(name).cast("binary")) % bits
    bit = F.call_function("shiftleft", F.lit(1), (place % 8).cast("int"))
    filled = (values.where(F.col(name).isNotNull()).groupBy(F.floor(place / 8).cast("int").alias("id"))
              .agg(F.bit_or(bit).alias("b")).agg(F.collect_list(F.struct("id", "b"))).first()[0])
    out = bytearray(bits // 8)
    for i, b in filled:
        out[i] = b
    return bytes(out)


def _anchor_rows(names: list[str]) -> Column:
    """array<struct<_anchor, flag per field>> from the anchor lists `_a_<field>`: each
    anchor of a document once, with the fields that have it."""
    def flagged(having) -> Column:
        lists = reduce(F.array_intersect, [F.col(f"_a_{n}") for n in having])
        only = reduce(F.array_except, [F.col(f"_a_{n}") for n in names if n not in having], lists)
        return F.transform(only, lambda a: F.struct(
            a.alias("_anchor"), *[F.lit(n in having).alias(n) for n in names]))

    return F.concat(*[flagged(having) for size in range(1, len(names) + 1)
                      for having in combinations(names, size)])


def term_hits(docs: DataFrame, terms: DataFrame, doc: str, fields: dict[str, Column],
              carry: dict[str, Column] | None = None, small: bool | None = None) -> DataFrame:
    """(doc, term, <one flag per field>, <carry>): terms that stand in any of the fields.

    Each term is looked up by its longest word pair, or word, among those of the
    document. For terms of up to two words that decides; only the others are tested on
    the text. With a small term table no text is shuffled. With a large one just
    (document, anchor) rows are, hot anchors spread, and texts come back only for terms
    of more words (this way runs a job). `carry` adds narrow columns of the document.
    """
    carry = carry or {}
    terms = (terms.select("term").where("term <> ''").distinct()
             .select("term", term_anchor(F.col("term")).alias("_anchor"),
                     mark(F.col("term")).alias("_marked"),
                     sign_pattern(F.col("term")).alias("_pattern"),
                     is_anchor(F.col("term")).alias("_sure")))
    names, extra = list(fields), [c.alias(n) for n, c in carry.items()]
    marked = [mark(c).alias(f"_m_{n}") for n, c in fields.items()]
    any_field = reduce(lambda a, b: a | b, [F.col(n) for n in names])
    out = [doc, "term", *names, *carry]

    def tested(candidates: DataFrame) -> DataFrame:
        hit = {n: F.when(F.col("_sure"), F.col(n)).otherwise(stands_in(
            F.col(f"_m_{n}"), F.col("_marked"), F.col("_pattern"))) for n in names}
        return candidates.withColumns(hit).where(any_field).select(*out)

    # Most anchors of a text belong to no term; they are left out in its cell, before a row is made of
    # each, which would carry the text.
    among = sketch(terms.select("_anchor"))
    listed = [anchors(c, among).alias(f"_a_{n}") for n, c in fields.items()]
    # explode_outer: a plain explode makes Spark read all words once more, just to
    # leave out documents without any; the join does that anyway.
    rows = F.explode_outer(_anchor_rows(names)).alias("_r")
    if is_small(terms) if small is None else small:
        found = (docs.select(doc, *marked, *extra, *listed)
                 .select(doc, *[f"_m_{n}" for n in names], *carry, rows)
                 .select("*", "_r.*").drop("_r"))
        return tested(found.join(F.broadcast(terms), "_anchor"))
    rows = docs.select(doc, *extra, *listed).select(doc, *carry, rows).select(doc, *carry, "_r.*")
    rows = rows.where("_anchor is not null")
    # Read by both branches below; written once, no text is taken apart again.
    found = checkpointed(lookup_join(rows, terms, ["_anchor"], "inner", small=False))
    sure = found.where("_sure").select(*out)
    unsure = (found.where("not _sure")
              .select(doc, *carry, "term", "_marked", "_pattern", "_sure", *names)
              .join(docs.select(doc, *marked), doc))
    return sure.unionByName(tested(unsure))


def known_terms(docs: DataFrame, lexicon: DataFrame, doc: str = "doc_id",
                body: str = "text", small: bool | None = None) -> DataFrame:
    """(doc, term): lexicon terms that stand in the text."""
    return term_hits(docs, lexicon, doc, {"_in": F.col(body)}, small=small).select(doc, "term")


def expand_synonyms(terms: DataFrame, synonyms: DataFrame, lexicon: DataFrame,
                    owner: str = "profile_id", small: bool | None = None) -> DataFrame:
    """(owner, term, weight): terms and their one-hop synonyms, tools weighing more."""
    tools = lexicon.where("is_tool").select(normalize_term(F.col("term")).alias("term")).distinct()
    exact = (terms.select(owner, normalize_term(F.col("term")).alias("term"))
             .where("term <> ''").withColumn("_base", F.lit(V.WEIGHT_EXACT)))
    near = (lookup_join(exact.select(owner, F.col("term").alias("src")), synonyms, ["src"], "inner",
                        small=small)
            .select(owner, F.col("dst").alias("term"), F.lit(V.WEIGHT_SYNONYM).alias("_base")))
    both = exact.unionByName(near).groupBy(owner, "term").agg(F.max("_base").alias("_base"))
    tool = lookup_join(both, tools.withColumn("_tool", F.lit(True)), ["term"], "left", small=small)
    factor = F.when(F.col("_tool"), V.TOOL_FACTOR).otherwise(1.0)
    return tool.select(owner, "term", F.round(F.col("_base") * factor, 6).alias("weight"))


def merge_weights(layers: list[DataFrame], owner: str = "profile_id") -> DataFrame:
    """(owner, term, weight, term_rank): the largest weight of each term over the layers."""
    # One exchange by owner serves the grouping and the ranking.
    best = (union_all([x.select(owner, "term", "weight") for x in layers])
            .repartition(F.col(owner)).groupBy(owner, "term").agg(F.max("weight").alias("weight")))
    order = W.partitionBy(owner).orderBy(F.desc("weight"), "term")
    return best.withColumn("term_rank", F.row_number().over(order))


def requirements(docs: DataFrame, lexicon: DataFrame, doc: str = "doc_id", body: str = "text",
                 limit: int | None = None, stopwords=V.STOPWORDS, small: bool | None = None) -> DataFrame:
    """(doc, requirements): known terms, longest first, then salient terms; `limit` in all
    (usually `V.REQUIREMENTS`) if given, else as many as the text has."""
    known = (known_terms(docs, lexicon, doc, body, small)
             .select(doc, "term", (F.lit(_PHRASE) - F.length("term")).alias("_at")))
    salient = (top_terms(docs, doc, body, None if limit is None else limit * 2, stopwords)
               .select(doc, "term", (F.lit(_PHRASE) + F.col("term_rank")).alias("_at")))
    # One exchange by document serves both groupings and the ranking.
    once = (known.unionByName(salient).repartition(F.col(doc))
            .groupBy(doc, "term").agg(F.min("_at").alias("_at")))
    order = W.partitionBy(doc).orderBy("_at", "term")
    kept = once.withColumn("_pos", F.row_number().over(order))
    if limit is not None:
        kept = kept.where(F.col("_pos") <= limit)
    # A list is as long as the terms of one document, at most.
    return (kept.groupBy(doc)
            .agg(F.sort_array(F.collect_list(F.struct("_pos", "term"))).alias("_l"))
            .select(doc, F.transform("_l", lambda x: x["term"]).alias("requirements")))


def tools_of(terms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Rows of `terms` whose term is a tool."""
    tools = lexicon.where("is_tool").select(normalize_term(F.col("term")).alias("term")).distinct()
    return lookup_join(terms, tools, ["term"], "left_semi")


def first_of_each(df: DataFrame, owner: str, item: str, position: str) -> DataFrame:
    """Ordered distinct: each item of an owner once, at its first position."""
    return df.groupBy(owner, item).agg(F.min(position).alias(position))
