"""Roles of raw transcripts by a hidden Markov model, and canonical turns.

A transcript is rows (conv_id, block, text) in order of the block; its lines may start with a
speaker marker in any of many styles, or with none. The hidden states are role x (first line of
a turn, later line); what is seen of a line is its marker, a blank line before it, a question mark at its end and its length.
Transition and emission probabilities are counted (add one) over transcripts whose roles are
known; Viterbi decoding gives each line its state, and each run from a first line on is a turn.

A conversation of any length is decoded in segments of a bounded number of blocks: each gives a
max-plus matrix from the state before it to its last state; the matrices of a conversation, one
small row per segment, fix the states at the borders; then all segments are decoded at once.

Blank lines only separate. A line of a marker alone starts a turn whose text follows. Null texts
are empty and have no lines; a conversation without lines has no turns. Null ids are one
conversation; null blocks sort last, equal blocks by text. Ties of scores go to the earlier state.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from rolecast.llm.common import fold_of, parts_of, stored, table
from rolecast.operators.common import lookup_join, number_all

ROLES = ["system", "user", "assistant"]
NAMES = {"system": 0, "system prompt": 0, "instruction": 0, "instructions": 0, "user": 1, "human": 1, "customer": 1,
         "question": 1, "q": 1, "prompter": 1, "assistant": 2, "ai": 2, "bot": 2, "model": 2, "answer": 2, "a": 2}
STATES = 2 * len(ROLES)          # 2 * role: a turn's first line, 2 * role + 1: a later one
_SEEN = (len(ROLES) + 1, 2, 2, 4)  # marker, blank line before, question mark, length
SYMBOLS = int(np.prod(_SEEN))
SEGMENT_BLOCKS, BUCKET_BLOCKS = 500, 20_000
MARKED = 20   # lines that the prior on markers counts as
_NAME = "|".join(sorted(NAMES, key=len, reverse=True))
#: "User: x", "[user] x", "### User", "**User:** x", "<user> x", "<|user|>".
_MARKER = re.compile(rf"\s*(?:#+ *({_NAME})\b *:?$|[*]{{2}}({_NAME}) *:?[*]{{2}} *:?|\[({_NAME})\] *:?|<[|]?({_NAME})[|]?>"
                     rf"|({_NAME}) *:)\s*", re.IGNORECASE)


def parsed(text: str | None) -> list[tuple[int, int, str]]:
    """(symbol, role of the marker or -1, text without it) of each line that is not blank; the text
    starts with the blank lines before it."""
    out, blank = [], 0
    for line in (text or "").split("\n"):
        line = line.rstrip("\r")
        if not line.strip():
            blank += 1
            continue
        m = _MARKER.match(line)
        role = NAMES[next(g for g in m.groups() if g).lower()] if m else -1
        rest = line[m.end():] if m else line
        size = min(3, len(rest).bit_length() // 3)
        symbol = (((role + 1) * 2 + (blank > 0)) * 2 + rest.rstrip().endswith("?")) * 4 + size
        out.append((symbol, role, "\n" * blank + rest))
        blank = 0
    return out


class Model:
    """Log probabilities: start[state], move[state, state], emit[state, symbol]."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def counted(cls, start: dict, move: dict, emit: dict) -> "Model":
        s, m, e = np.ones(STATES), np.ones((STATES, STATES)), np.zeros((STATES, SYMBOLS))
        s[1::2] = 1e-9  # nothing starts with a later line
        for r in range(len(ROLES)):
            m[:, 2 * r + 1] = 1e-9  # a later line has the role of the line before it
            m[2 * r:2 * r + 2, 2 * r + 1] = 1
        for a, counts in ((s, start), (m, move), (e, emit)):
            for k, n in counts.items():
                a[k] += n
        log = lambda a: np.log(a / a.sum(-1, keepdims=True))
        # What is seen of a line counts on its own, so that a new combination is no surprise.
        e, emission = e.reshape(STATES, *_SEEN), 0.0
        for axis, size in enumerate(_SEEN, 1):
            counts = 1 + e.sum(tuple(i for i in range(1, 5) if i != axis))
            if axis == 1:
                # Known beforehand: a marker names the role of a turn and stands on its first line.
                for r in range(len(ROLES)):
                    counts[2 * r, r + 1] += MARKED
                    counts[2 * r + 1, 0] += 20 * MARKED
            part = log(counts)
            emission = emission + part.reshape(STATES, *[size if i == axis else 1 for i in range(1, 5)])
        return cls(log(s), log(m), emission.reshape(STATES, SYMBOLS))

    def matrix(self, symbols: np.ndarray, first: bool) -> np.ndarray:
        """The best score from each state before the lines to each state of the last one; before
        the first line of a conversation there is none, so all rows are alike."""
        total = (np.tile(self.start, (STATES, 1)) if first else self.move) + self.emit[:, symbols[0]]
        for x in symbols[1:]:
            total = (total[:, :, None] + self.move[None]).max(1) + self.emit[:, x]
        return total

    def states(self, symbols: np.ndarray, first: int, last: int) -> np.ndarray:
        """The best path after state `first` (-1: the start) to state `last` (-1: any)."""
        score = (self.start if first < 0 else self.move[first]) + self.emit[:, symbols[0]]
        back = np.zeros((len(symbols), STATES), np.int64)
        for i, x in enumerate(symbols[1:], 1):
            through = score[:, None] + self.move
            back[i] = through.argmax(0)
            score = through.max(0) + self.emit[:, x]
        path = np.empty(len(symbols), np.int64)
        path[-1] = score.argmax() if last < 0 else last
        for i in range(len(symbols) - 1, 0, -1):
            path[i - 1] = back[i, path[i]]
        return path


def _segments(t: pa.Table):
    """(conversation key, segment, texts) of the blocks of a bucket."""
    rows = t.select(["conv", "segment", "block", "text"]).to_pylist()
    rows.sort(key=lambda r: (r["conv"], r["segment"], r["block"], r["text"] or ""))
    at = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or (rows[i]["conv"], rows[i]["segment"]) != (rows[at]["conv"], rows[at]["segment"]):
            yield rows[at]["conv"], rows[at]["segment"], [line for r in rows[at:i] for line in parsed("\n\n" + (r["text"] or ""))]
            at = i


def _matrices(model: Model):
    def run(t: pa.Table) -> pa.Table:
        rows = []
        for conv, segment, lines in _segments(t):
            if lines:
                symbols = np.array([x[0] for x in lines])
                rows.append((conv, segment, *(model.matrix(symbols, first).tobytes() for first in (False, True))))
        types = {"conv": pa.string(), "segment": pa.int64(), "matrix": pa.binary(), "opening": pa.binary()}
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 4, types.values())], names=list(types))

    return run


def _borders(model: Model):
    """The states around each segment of a conversation of several."""
    def run(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("segment", "matrix", "opening"))))
        at = np.array([np.frombuffer(o if i == 0 else m) for i, (_, m, o) in enumerate(rows)]).reshape(-1, STATES, STATES)
        score, back = np.zeros(STATES), []
        for m in at:
            step = score[:, None] + m
            back.append(step.argmax(0))
            score = step.max(0)
        last = [int(score.argmax())]
        for b in back[:0:-1]:
            last.append(int(b[last[-1]]))
        last.reverse()
        return pa.table({"conv": t.column("conv"), "segment": pa.array([r[0] for r in rows], pa.int64()),
                         "first": pa.array([-1, *last[:-1]], pa.int32()), "last": pa.array(last, pa.int32())})

    return run


PIECE = "conv string, segment long, piece int, opens boolean, role int, n_lines long, text string"


def _decode(model: Model):
    def run(t: pa.Table, borders: pa.Table) -> pa.Table:
        known = {(r["conv"], r["segment"]): (r["first"], r["last"]) for r in borders.to_pylist()}
        out = []
        for conv, segment, lines in _segments(t):
            if not lines:
                continue
            states = model.states(np.array([x[0] for x in lines]), *known.get((conv, segment), (-1, -1)))
            starts = [i for i, s in enumerate(states) if s % 2 == 0 or i == 0]
            for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(lines)])):
                opens = states[a] % 2 == 0
                text = "\n".join(x[2] for x in lines[a:b]).rstrip("\n")
                # Blank lines before a turn are not its own; inside it they are text.
                text = text.lstrip("\n") if opens or (segment, a) == (0, 0) else text
                out.append((conv, segment, n, bool(opens), int(states[a] // 2), b - a, text))
        types = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.string()]
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 7, types)],
                        names=[x.split()[0] for x in PIECE.split(", ")])

    return run


def rendered(role, text):
    """A turn in canonical form; markers inside the text are broken up."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("\n<|end|>"))


def _cut(blocks: DataFrame) -> DataFrame:
    """Adds conv, the id as text, and the segment of each row: conversations of more rows than a segment
    has are cut by the number of the row, so no null or repeated id or block makes a larger one."""
    rows = blocks.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).withColumn(
        "block", F.coalesce(F.col("block").cast("long"), F.lit(1 << 62)))
    many = stored(rows.groupBy("conv").agg(F.count("*").alias("n")).where(F.col("n") > SEGMENT_BLOCKS)
                  .select("conv", F.lit(True).alias("many")), "many")
    whole = F.lit(0).cast("long").alias("segment")
    if not many.head(1):
        return rows.select("*", whole)
    marked = lookup_join(rows, many, ["conv"], "left")
    inside = marked.where("many").select(*rows.columns, F.monotonically_increasing_id().alias("tie"))
    numbered = number_all(inside, [F.col("conv"), F.col("block"), F.coalesce("text", F.lit("")), F.col("tie")], "row")
    first = numbered.groupBy("conv").agg(F.min("row").alias("low"))
    numbered = lookup_join(numbered, first, ["conv"], "inner").withColumn(
        "segment", F.floor((F.col("row") - F.col("low")) / SEGMENT_BLOCKS)).select(*rows.columns, "segment")
    return marked.where("many is null").select(*rows.columns, whole).union(numbered)


def _keyed(blocks: DataFrame) -> DataFrame:
    rows = _cut(blocks.select("conv_id", "block", "text")).drop("conv_id")
    buckets = parts_of(blocks.count(), BUCKET_BLOCKS)
    return rows.withColumn("bucket", F.pmod(F.xxhash64("conv", "segment"), F.lit(buckets)).cast("int"))


def turns(blocks: DataFrame, model: Model) -> DataFrame:
    """(conv, turn, role, n_lines, text, rendered); conv is the conversation's id as text."""
    rows = _keyed(blocks)
    many = rows.groupBy("conv").agg(F.countDistinct("segment").alias("n")).where("n > 1").select("conv")
    long_rows = rows.join(many, "conv", "left_semi")
    borders = (long_rows.groupBy("bucket").applyInArrow(_matrices(model), "conv string, segment long, matrix binary, opening binary")
               .groupBy("conv").applyInArrow(_borders(model), "conv string, segment long, first int, last int"))
    keys = rows.select("conv", "segment", "bucket").distinct()
    borders = stored(borders.join(keys, ["conv", "segment"]), "borders")
    pieces = stored(rows.groupBy("bucket").cogroup(borders.groupBy("bucket")).applyInArrow(_decode(model), PIECE), "pieces")
    # Turns are numbered over the segments, of which there are few; a turn may go over a border.
    counts = pieces.groupBy("conv", "segment").agg(F.sum(F.col("opens").cast("int")).alias("n"))
    before = W.partitionBy("conv").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("conv", "segment", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = W.partitionBy("conv", "segment").orderBy("piece")
    numbered = pieces.join(counts, ["conv", "segment"]).withColumn(
        "turn", F.col("before") + F.sum(F.col("opens").cast("int")).over(inside) - 1)
    parts = F.array_sort(F.collect_list(F.struct("segment", "piece", "text")))
    out = numbered.groupBy("conv", "turn").agg(F.first("role").alias("r"), F.sum("n_lines").alias("n_lines"), parts.alias("p"))
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.col("r") + 1)
    text = F.array_join(F.transform("p", lambda x: x["text"]), "\n")
    out = out.select("conv", "turn", role.alias("role"), "n_lines", text.alias("text"))
    return out.withColumn("rendered", rendered(F.col("role"), F.col("text")))


def counted(blocks: DataFrame) -> Model:
    """A model from blocks that each are one turn of a known `role`; the counts are of fixed size.
    Other roles than system, user and assistant are not learnt from."""
    rows = blocks.where(F.col("role").isin(ROLES)).select("conv_id", "block", "role", "text")

    def seen(batches):
        for batch in batches:
            out = []
            for conv, block, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                r, lines = ROLES.index(role), parsed("\n\n" + (text or ""))
                out += [(2, 2 * r + (i > 0), x[0], 1) for i, x in enumerate(lines)]
                out += [(1, 2 * r + (i > 1), 2 * r + 1, 1) for i in range(1, len(lines))]
            kinds, a, b, n = zip(*out) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in (kinds, a, b)] + [pa.array(n, pa.int64())],
                                             names=["kind", "a", "b", "n"])

    inside = rows.mapInArrow(seen, "kind int, a int, b int, n long")
    number = F.create_map(*[F.lit(x) for i, r in enumerate(ROLES) for x in (r, i)])
    line = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    order = W.partitionBy("conv", "segment").orderBy("block", F.coalesce("text", F.lit("")))
    spoken = _cut(rows).where(line > 0).withColumn("now", number[F.col("role")]).withColumn("ends", (line > 1).cast("int"))
    pairs = spoken.select("now", F.lag("now").over(order).alias("was"), F.lag("ends").over(order).alias("e"), "segment")
    between = pairs.where("was is not null").select(
        F.lit(1).alias("kind"), (2 * F.col("was") + F.col("e")).cast("int").alias("a"), (2 * F.col("now")).cast("int").alias("b"),
        F.lit(1).cast("long").alias("n"))
    first = pairs.where(F.col("was").isNull() & (F.col("segment") == 0)).select(
        F.lit(0).alias("kind"), (2 * F.col("now")).cast("int").alias("a"), F.lit(0).alias("b"), F.lit(1).cast("long").alias("n"))
    total = inside.union(between).union(first).groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    start, move, emit = ({(r["a"], r["b"]): r["n"] for r in total if r["kind"] == k} for k in range(3))
    return Model.counted({a: n for (a, _), n in start.items()}, move, emit)


def transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, block, role, text): the table's turns as raw transcript blocks, in one of four
    marker styles by conversation, with no marker at one turn in ten."""
    style = F.pmod(F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")), F.lit(4))
    bare = F.pmod(F.crc32(F.concat_ws("/", "conv_id", "turn").cast("binary")), F.lit(10)) == 0
    name = F.initcap("role")
    other = F.when(F.col("role") == "user", "Human").when(F.col("role") == "assistant", "AI").otherwise("System")
    mark = (F.when(bare | F.col("role").isNull(), "").when(style == 0, F.concat(name, F.lit(": ")))
            .when(style == 1, F.concat(other, F.lit(": "))).when(style == 2, F.concat(F.lit("### "), name, F.lit("\n")))
            .otherwise(F.concat(F.lit("["), "role", F.lit("] "))))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("block"), "role",
                                F.concat(mark, F.coalesce("text", F.lit(""))).alias("text"))


def op7_chat(spark, sf_dir):
    """Every conversation of the table as a raw transcript, back as canonical turns; the model is
    counted over those whose crc32(conv_id) mod 5 is not 0."""
    raw = transcripts(table(spark, sf_dir, "conversations"))
    model = counted(raw.where(fold_of(F.col("conv_id")) != 0))
    return turns(raw.drop("role"), model).select(F.expr("try_cast(conv as bigint)").alias("conv_id"), "turn", "role", "n_lines", "rendered")
