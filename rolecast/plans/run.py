"""The whole flow: landed postings to ranked, explained matches, as one plan."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from rolecast import values as V
from rolecast.operators import freshness as fr, live, match, state as st
from rolecast.operators.common import checkpointed, lookup_join
from rolecast.sources.listing import with_requirements, with_sequence
from rolecast.sources.union import union_softly


@dataclass(frozen=True)
class Settings:
    """Windows and limits of a run, with the usual defaults."""
    recency_days: int = 60
    lookahead_days: int = 90
    include_unverified: bool = True
    min_score: int = 0
    top_pairs: int | None = None


@dataclass(frozen=True)
class Result:
    """Tables of a run. `merged`, `seen` and `pairs` (profile, posting, score and ranks of what is
    reported) are written once, the rest lazy: `reported` joins a pair's posting and terms when a report
    is written, and `state`, the state after the run, is only worked out if it is read, since a run
    records its delta."""
    merged: DataFrame
    checked: DataFrame
    pairs: DataFrame
    reported: DataFrame
    state: DataFrame
    counters: DataFrame
    seen: DataFrame
    verdicts: DataFrame | None


def land(sources: dict[str, Callable[[], DataFrame]], lexicon: DataFrame, requirements: int | None = None,
         allow: list[str] | None = None) -> tuple[DataFrame | None, list[tuple[str, int, str]]]:
    """The postings of all sources that can be read, numbered, with their requirements, and the status
    of every source. Empty requirement lists are filled from the description; `requirements` (usually
    `V.REQUIREMENTS`) bounds them, if given. Without any readable source the postings are None.
    """
    rows, status = union_softly(sources, allow)
    if rows is None:
        return None, status
    return checkpointed(with_requirements(with_sequence(rows), lexicon, limit=requirements)), status


def merge_fresh(listings: DataFrame, state: DataFrame, run_at) -> tuple[DataFrame, DataFrame]:
    """(merged postings, folded rows of the keys seen) of postings with ingest_seq.

    Every posting of a run is observed before its date is resolved, so an undated copy
    always ranks as approximate. Copies can then be merged first and first_seen joined
    after, when each key is one row and no key is hot.

    A key is made of the texts of its posting. So copies meet by a digest of it, are folded and merged
    in one exchange, and are written once without their key, which every reader makes again.
    """
    named = ["company", "title", "location"]
    batch = fr.with_key(listings).withColumn("_id", F.unhex(F.sha2("key", 256))).drop("key")
    undated = F.col("posted_date").isNull()
    ranked = batch.withColumn("_label", F.col("date_confidence")).withColumn(
        "date_confidence", F.when(undated, V.APPROXIMATE).when(
            F.col("date_confidence").isin(V.VERIFIED, V.APPROXIMATE), F.col("date_confidence"))
        .otherwise(V.APPROXIMATE))
    folds = {n: c for n, c in st.fold_columns().items() if n not in ("_from", "_until")}
    merged = fr.dedupe_merge(ranked, "_id", more=folds)
    # Mostly one posting is the best and the first; its texts are written once.
    own = F.struct(*named)
    merged = merged.withColumn("_first", F.when(~F.col("_first").eqNullSafe(own), F.col("_first")))
    # One row per key on each side; of the state only two columns are read. The rows of these sides
    # are narrow, and the merged ones lie by their digest already.
    known = state.select(F.unhex(F.sha2("key", 256)).alias("_id"), F.col("first_seen").alias("_known"))
    merged = merged.join(fr.also_seen_text(ranked, "_id"), "_id", "left").join(known, "_id", "left").drop("_id")
    merged = fr.with_key(checkpointed(merged))
    now = F.lit(run_at).cast("timestamp")
    seen = st.folded(merged.select("key", F.coalesce("_first", own).alias("_first"), "_last", "_dated",
                                   now.alias("_from"), now.alias("_until")), "key")
    merged = merged.withColumns({"also_seen": F.coalesce("also_seen", F.lit("")),
                                 "first_seen": F.coalesce("_known", now)})
    merged = merged.drop("date_confidence", "_known", *folds).withColumnRenamed("_label", "date_confidence")
    return fr.resolve_dates(merged), seen


def run(listings: DataFrame, profile_terms: DataFrame, http_results: DataFrame | None,
        state: DataFrame, as_of, run_at, settings: Settings = Settings(),
        rescored: DataFrame | None = None) -> Result:
    """All steps of a run. What later steps read several times is written once to the
    shared folder. `rescored` (profile_id, key, score, rationale, matched_skills,
    missing_skills) are external scores, as `match.parse_scores` reads them.

    Every pair that shares a term and has the least score is reported; `top_pairs` keeps
    just the best of each profile.
    """
    merged, seen = merge_fresh(listings, state, run_at)
    state, verdicts = st.observe_folded(state, seen), None
    marked = fr.mark_eligibility(merged, as_of, settings.recency_days, settings.lookahead_days,
                                 settings.include_unverified)
    eligible = fr.eligible_only(marked)
    if http_results is None:
        checked = (eligible.withColumn("live_status", F.lit(V.NOT_CHECKED))
                   .withColumn("live_reason", F.lit(""))
                   .withColumn("live_checked_at", F.lit(None).cast("timestamp")))
    else:
        checked = live.live_check(eligible.drop("key"), http_results, as_of, run_at)
        checked = fr.with_key(checkpointed(checked))
        verdicts = checked.select("key", "live_status", "live_checked_at")
        state = st.record_verdicts(state, verdicts)
    retained = live.drop_dead(checked)
    # Merged rows have a unique ingest_seq, far narrower in a shuffle than their key. A pair stays
    # two ids, a score and ranks; postings never travel with the pairs before a report is written.
    pairs = match.at_least(match.match_pairs(retained, profile_terms, "ingest_seq"), settings.min_score)
    if settings.top_pairs is not None:
        pairs = match.best_pairs(pairs, settings.top_pairs, "ingest_seq")
    pairs = checkpointed(pairs)
    reported = lookup_join(match.with_term_lists(pairs, profile_terms), retained, ["ingest_seq"], "inner")
    if rescored is not None:
        reported = match.override_scores(reported, rescored, ["profile_id", "key"])
    shown = pairs.select("ingest_seq").distinct()
    counters = st.run_counters(listings, merged, checked, shown)
    return Result(merged, checked, pairs, reported, state, counters, seen, verdicts)


def record(result: Result, root: str, run_id: int, finished_at) -> DataFrame:
    """Writes state, run log and keys of a run; returns (key, change) since the last one.

    All three become visible in one commit: a run that breaks off before it leaves everything
    as it was, and running it again replaces what it wrote.
    """
    spark = result.merged.sparkSession
    shown = result.pairs.select("ingest_seq").distinct().withColumn("reported", F.lit(True))
    kept = (live.drop_dead(result.checked).select("key", "ingest_seq", "live_status")
            .join(shown, "ingest_seq", "left").withColumn("reported", F.coalesce("reported", F.lit(False))))
    kept = checkpointed(kept.groupBy("key").agg(F.max("reported").alias("reported"), F.max("live_status").alias("live_status")))
    n = kept.agg(F.count_if("reported").alias("r")).first()["r"]
    ended = spark.createDataFrame([(run_id, None, finished_at, result.merged.count(), n)], st.RUN_SCHEMA).coalesce(1)
    st.write_delta(spark, root, run_id, st.delta(result.seen, result.verdicts, run_id), **{
        st.LISTED: kept.select(F.lit(run_id).cast("long").alias("run_id"), "key", "reported", "live_status"),
        st.ENDED: ended})
    before = st.previous_reported(st.read_runs(spark, root), st.read_run_listings(spark, root), run_id)
    return st.diff_keys(kept.where("reported").select("key"), before)
