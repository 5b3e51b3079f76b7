"""Spelling variants: words one edit apart, by a frontier of states that walks a trie of all words.

The trie is a table of edges (node, head, label, child): nodes are prefixes at which words part
or end, a label holds the characters down to the next such node. Each word starts as a state
(word, at, node, edits) and each level joins all states with the edges of their nodes: the label
must equal the word's next characters, or, while no edit is spent, be one insertion, deletion or
replacement away from them. A state at the end of a word, and at the end of its own word with
one edit spent, is a pair of neighbours.

An edit lies in the second half of a word or, read backwards, in the second half of the reversed
word. So the trie also holds all words reversed, and in both directions a state starts at the node
of its word's first half, if other words are below it. The first half of a word is never walked, so
its prefixes up to there are no part of the trie: a word of n letters meets words of n - 1 letters or
more, whose first halves have floor((n - 1) / 2) letters at least. Every node knows the lengths of the
words below it and the characters that follow it; states that can go nowhere end.

The frontier is a DataFrame: each level is written to the shared folder before the next one,
nodes with many states are spread over tasks (`lookup_join`), and nothing meets the driver but
tables that were counted and found small, to be broadcast.
Nodes are known by 64-bit hashes of their prefixes; every pair is verified on the words.

Null and empty texts have no words; a null doc_id counts as an empty one where runs are altered.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rolecast.llm.common import stored, table
from rolecast.operators.common import is_small, lookup_join

LEAST_LENGTH, LEAST_COUNT, RATIO, ALTERED = 6, 5, 5, 199
BELOW = ("least", "most", "heads")


def words_of(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
             altered: int | None = ALTERED) -> DataFrame:
    """(word, n): the words of `least_length` letters and `least_count` occurrences. Of a run whose
    hash with its document's id is divided by `altered`, one letter goes (none if it is None)."""
    runs = F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{least_length},}}"), F.lit(0)))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), runs.alias("run"))
    # Java's lower-casing is faster, and the same where no letter above Z is a capital.
    ascii_only = F.octet_length("run") == F.char_length("run")
    plain = F.when(ascii_only | ~F.col("run").rlike("[À-Þ]"), F.lower("run")).otherwise(F.translate(
        "run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    rows = rows.select("id", plain.alias("run"))
    word = F.col("run")
    if altered:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        place = F.pmod(h, F.char_length("run").cast("long")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.char_length("run")))
        word = F.when(F.pmod(h, F.lit(altered)) == 0, cut).otherwise(word)
    return (rows.select(word.alias("word")).where(F.char_length("word") >= least_length)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count))


def _prefixes(words: DataFrame) -> DataFrame:
    """(word, back, size, depth, node, next): the prefixes of each word and of its reverse that a walk may
    meet, their hash, and the character after them (0 at the end of the word)."""
    both = words.select(F.inline(F.array(F.struct("word", F.lit(False).alias("back")),
                                         F.struct(F.reverse("word").alias("word"), F.lit(True).alias("back")))))
    rows = both.withColumn("size", F.char_length("word"))
    rows = rows.select("word", "back", "size", F.explode(F.sequence(_half(F.col("size") - 1), F.col("size"))).alias("depth"))
    # The two directions are two tries; their nodes must not meet.
    return rows.select("*", F.xxhash64("back", F.substring("word", F.lit(1), F.col("depth"))).alias("node"),
                       F.ascii(F.substring("word", F.col("depth") + 1, F.lit(1))).alias("next"))


def _half(size: Column) -> Column:
    return F.floor(size / 2).cast("int")


def _bit(code: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(code, F.lit(64)).cast("int"))


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The steps (word, back, size, depth, node, ends, n, ...) of all words through the nodes at which
    words start, part or end, and the edges (node, head, label, child, depth, ends, least, most, heads):
    `ends` is the word that ends at the child or null, `n` counts the words below a node, `least` and
    `most` are their lengths, `heads` a bit set of the characters that follow it."""
    prefixes = _prefixes(words)
    nodes = prefixes.groupBy("node").agg(F.min("next").alias("low"), F.max("next").alias("high"),
                                         F.min("size").alias("least"), F.max("size").alias("most"),
                                         F.bit_or(_bit(F.col("next"))).alias("heads"), F.count("*").alias("n"),
                                         F.max(F.col("depth") == _half(F.col("size"))).alias("starts"))
    # From a node with one word below it a state would only find its own.
    nodes = nodes.where("low = 0 OR low <> high OR (starts AND n > 1)")
    nodes = stored(nodes.select("node", (F.col("low") == 0).alias("ends"), "n", *BELOW), "nodes")
    steps = stored(lookup_join(prefixes.drop("next"), nodes, ["node"], "inner"), "steps")
    step = F.lead(F.struct("depth", "node", "ends", *BELOW)).over(W.partitionBy("word", "back").orderBy("depth"))
    pairs = steps.select("word", "back", "depth", "node", "ends", *BELOW).select("word", "depth", "node", step.alias("b")).where("b IS NOT NULL")
    label = F.substring("word", F.col("depth") + 1, F.col("b.depth") - F.col("depth"))
    ends = F.when(F.col("b.ends"), F.substring("word", F.lit(1), F.col("b.depth")))
    edges = pairs.select("node", F.col("b.node").alias("child"), label.alias("label"), ends.alias("ends"),
                         *[F.col(f"b.{c}").alias(c) for c in ("depth", *BELOW)])
    return steps, stored(edges.distinct().withColumn("head", F.substring("label", 1, 1)), "edges")


def _next(n: Column) -> Column:
    """The `n` characters of the word after the state's place, null if it has fewer."""
    return F.when(F.col("at") + n <= F.char_length("word"), F.substring("word", F.col("at") + 1, n))


def _moved(shift: int, edits: int) -> Column:
    return F.struct((F.col("at") + F.col("n") + shift).cast("int").alias("at"), F.lit(edits).alias("edits"))


def _met(states: DataFrame, edges: DataFrame, on: list[str], small: bool) -> DataFrame:
    """The states with the edges of their nodes. Few states, as on the last levels, are broadcast to many edges."""
    if not small and is_small(states):
        return edges.join(F.broadcast(states), on)
    return lookup_join(states, edges, on, "inner", small)


def _walked(states: DataFrame, edges: DataFrame, small: bool) -> DataFrame:
    """The states one edge further down, with `ends`, the word that ends there."""
    size, n = F.char_length("word"), F.char_length("label")
    # Unspent: every edge of the node may be the one that differs.
    free = _met(states.where("edits = 0"), edges, ["node"], small).withColumn("n", n)
    exact = F.coalesce(F.col("label") == _next(F.col("n")), F.lit(False))

    def off(shift):
        # The length of the word met settles most edges before any characters are compared.
        fits = (F.col("least") <= size - shift) & (F.col("most") >= size - shift)
        return fits & (F.levenshtein("label", _next(F.col("n") + shift), 1) == 1)

    # A character of the word left over after an equal label is the next edge's to skip.
    moves = F.array_compact(F.array(F.when(exact, _moved(0, 0)), F.when(off(0), _moved(0, 1)),
                                    F.when(~exact & off(1), _moved(1, 1)), F.when(off(-1), _moved(-1, 1))))
    free = free.select("word", "back", F.inline(moves), "child", "depth", "ends", *BELOW)
    spent = states.where("edits = 1").withColumn("head", F.substring("word", F.col("at") + 1, F.lit(1)))
    spent = _met(spent, edges, ["node", "head"], small).withColumn("n", n).where(exact)
    spent = spent.select("word", "back", (F.col("at") + F.col("n")).cast("int").alias("at"), "edits", "child", "depth", "ends", *BELOW)
    # With the edit spent, what is left must be equal, so the length of the word met is known.
    met = F.col("depth") + size - F.col("at")
    follows = _bit(F.ascii(F.substring("word", F.col("at") + 1, F.lit(1)))).bitwiseAND(F.col("heads")) != 0
    alive = (F.when(F.col("edits") == 0, (F.col("least") <= size + 1) & (F.col("most") >= size - 1))
             .when(F.col("at") == size, F.col("ends").isNotNull())
             .otherwise((F.col("least") <= met) & (F.col("most") >= met) & follows))
    return free.unionByName(spent).where(alive).select("word", "back", "at", F.col("child").alias("node"), "edits", "ends")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near): all ordered pairs of words one edit apart."""
    steps, edges = trie(words)
    small = is_small(edges)
    states = steps.where((F.col("depth") == _half(F.col("size"))) & (F.col("n") > 1)).select(
        "word", "back", F.col("depth").alias("at"), "node", F.lit(0).alias("edits"),
        F.when(F.col("ends"), F.expr("substring(word, 1, depth)")).alias("ends"))
    met, level = [], stored(states, "states")
    while True:
        done = (F.col("edits") == 1) & (F.col("at") == F.char_length("word"))
        over = (F.col("edits") == 0) & (F.col("at") == F.char_length("word") - 1)
        met.append(level.where(F.col("ends").isNotNull() & (done | over)).select("word", "back", "ends"))
        walked = _walked(level.select("word", "back", "at", "node", "edits"), edges, small)
        level = stored(walked, "states")
        if level.isEmpty():
            break
    out = met[0]
    for m in met[1:]:
        out = out.unionByName(m)
    turned = [F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c)) for c in ("word", "ends")]
    out = out.where(F.levenshtein("word", "ends", 1) == 1)
    return stored(out.select(turned[0].alias("word"), turned[1].alias("near")).distinct(), "near")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of (word, n): a word's form is its neighbour of largest
    n (ties: the first in code-point order) if that is `ratio` times its own; its root is the last
    word along the forms, itself if it has none."""
    words = stored(words.select("word", "n"), "words")
    pairs = neighbours(words)
    counted = lookup_join(pairs, words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), ["near"], "inner")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    # Strings compare by their UTF-8 bytes, which is the order of code points.
    form_n = -F.col("best.minus")
    taken = form_n >= ratio * F.col("n")
    # Spark would size these by their files, which are compressed.
    rows = stored(words.join(best.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.near")).alias("form"),
        F.when(taken, form_n).alias("form_n")), "forms")
    # Each round doubles the forms followed; counts grow by `ratio`, so chains are short and end.
    roots = rows.select("word", F.col("form").alias("root")).where("root IS NOT NULL")
    while True:
        roots = stored(roots, "roots")
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        roots = lookup_join(roots, ahead, ["root"], "left")
        if roots.where("ahead IS NOT NULL").isEmpty():
            break
        roots = roots.select("word", F.coalesce("ahead", "root").alias("root"))
    return (rows.join(roots.select("word", "root").hint("merge"), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def op12_spelling(spark, sf_dir):
    return variants(words_of(table(spark, sf_dir, "documents")))
