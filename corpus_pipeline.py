"""A training corpus from raw documents: each stage is one operator of `rolecast.llm`.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents:

1. toxicity: documents predicted toxic go; labels of the held-out fifth are not learnt from;
2. near_duplicates: of documents linked by a Jaccard similarity of 0.8 over five-word shingles one
   stays, that of the smallest id;
3. repeated_passages: words in a window of 35 that occurs anywhere else are cut from the text
   (the words left are joined by single spaces; other texts stay as they are, and a document that
   is all repeated stays with an empty text); n_chars is that of the new text;
4. decontamination: documents that hold 0.8 of the five-word shingles of a benchmark item go;
5. packing: the pieces of all documents in sequences of 4096 tokens.

Empty tables pass through all stages; null ids and texts, repeated rows and further columns are
handled as each operator states. Inside a stage all columns but doc_id, text and n_chars have
names of its own (`apart`), so that no name of a column, with dots or without, can clash.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rolecast.llm import leaks, packing, passages, shingles, toxicity
from rolecast.llm.common import fold_of, stored, table

#: Packing, a fitted classifier and automata are not SQL; the tests compare with brute force.
ORACLE_SQL = None


USED = ("doc_id", "text", "n_chars")


def apart(stage: Callable) -> Callable:
    """The stage over columns renamed by their place, and renamed back after it."""
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inside = docs.toDF(*[c if c in USED else f"c{i}" for i, c in enumerate(docs.columns)])
        return stage(spark, inside, sf_dir).toDF(*docs.columns)

    return run


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    machine = toxicity.fit(docs.select("doc_id", "text"), labels, fold_of(F.col("doc_id")) != 0)
    return toxicity.scored(docs, machine, docs.columns).where("predicted = 0").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingles.one_of_each(docs, words=5, per_cent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select("doc_id", "text", F.struct(F.col("text").isNull().alias("null_text"), *others).alias("rest"))
    out = passages.without_passages(rows, ["rest"], with_text=True)
    cut = F.col("n_removed") > 0
    new = {"text": F.when(cut | ~F.col("rest.null_text"), F.col("kept_text"))}
    if "n_chars" in others:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(cut, F.char_length("kept_text").cast(kind)).otherwise(F.col("rest.n_chars"))
    return out.select(*[new.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs)


STAGES = [("toxicity", apart(clean)), ("near_duplicates", apart(near_duplicates)),
          ("repeated_passages", apart(repeated_passages)), ("decontamination", apart(decontamination)), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
