"""Dates, merging of copies, and the windows that make a posting eligible."""

from pyspark.sql import Column, DataFrame, functions as F

from rolecast import values as V
from rolecast.functions.dates import day
from rolecast.functions.text import blank_to_null, dedup_key, source_head, text
from rolecast.operators.common import checkpointed, lookup_join


def _lookup(c: Column, table: dict, other) -> Column:
    out = F.lit(other)
    for k, v in reversed(table.items()):
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def source_tier(source: Column) -> Column:
    return _lookup(source_head(source), V.SOURCE_TIER, V.OTHER_TIER)


def confidence_rank(confidence: Column) -> Column:
    return _lookup(text(confidence), V.CONFIDENCE_RANK, 3)


def with_key(listings: DataFrame) -> DataFrame:
    return listings.withColumn(
        "key", dedup_key(F.col("company"), F.col("title"), F.col("location")))


def resolve_dates(listings: DataFrame, seen: str = "first_seen",
                  current_run_start=None) -> DataFrame:
    """Fill posted_date and its confidence: the source's date, else the day first seen.

    With `current_run_start` (strict) a row first seen in the current run does not count
    as dated by that.
    """
    seen_at = F.col(seen).cast("timestamp")
    if current_run_start is not None:
        start = F.lit(current_run_start).cast("timestamp")
        seen_at = F.when(seen_at < start, seen_at)
    dated = F.col("posted_date").isNotNull()
    by_seen = ~dated & seen_at.isNotNull()
    known = F.col("date_confidence").isin(V.VERIFIED, V.APPROXIMATE)
    return listings.withColumns({
        "posted_date": F.coalesce("posted_date", seen_at.cast("date")),
        "date_confidence": (
            F.when(dated & known, F.col("date_confidence"))
            .when(dated | by_seen, F.lit(V.APPROXIMATE)).otherwise(F.lit(V.UNVERIFIED))),
        "date_source": (
            F.when(dated, F.col("date_source"))
            .when(by_seen, F.lit("cache first-seen (this tool)"))
            .otherwise(F.coalesce(blank_to_null(F.col("date_source")),
                                  F.lit("no determinable date")))),
    })


def quality(tie: str = "ingest_seq") -> Column:
    """Sort key of copies, best first."""
    return F.struct(
        confidence_rank(F.col("date_confidence")).alias("confidence"),
        source_tier(F.col("source")).alias("tier"),
        (-F.length(text(F.col("description_text")))).alias("text"),
        (-F.coalesce(F.array_size("requirements"), F.lit(0))).alias("requirements"),
        F.col(tie).alias("tie"))


def dedupe_merge(listings: DataFrame, key: str = "key", tie: str = "ingest_seq",
                 more: dict[str, Column] | None = None) -> DataFrame:
    """One row per key: the best copy, its gaps filled from the next best that has them.
    `more` are further aggregates of the copies, by name.

    Only min_by aggregates, so every task first folds its own rows of a key into one;
    a key that holds a third of all rows sends one row per task. `n_merged` counts the
    copies; `also_seen` lists their sources as rows.
    """
    q = quality(tie)
    payload = [c for c in listings.columns if c != key]
    rolling = F.coalesce("deadline_is_rolling", F.lit(False)).alias("deadline_is_rolling")
    has_text = blank_to_null(F.col("description_text")).isNotNull()

    def donor(value: Column, present: Column) -> Column:
        return F.min_by(value, F.when(present, q))

    out = listings.groupBy(key).agg(
        F.min_by(F.struct(*payload), q).alias("_p"),
        donor(F.struct("deadline", rolling), F.col("deadline").isNotNull()).alias("_deadline"),
        donor(F.struct("description_text", "requirements"), has_text).alias("_text"),
        donor(F.col("company_description"),
              blank_to_null(F.col("company_description")).isNotNull()).alias("_about"),
        donor(F.col("is_startup"), F.col("is_startup").isNotNull()).alias("_startup"),
        F.count("*").alias("n_merged"), *[c.alias(n) for n, c in (more or {}).items()])
    p = lambda c: F.col(f"_p.{c}")
    own_text = blank_to_null(p("description_text")).isNotNull()
    # The text moves together with its requirements; an empty list keeps the primary's.
    donated = F.col("_text.requirements")
    fills = {
        "deadline": F.col("_deadline.deadline"),
        "deadline_is_rolling": F.when(
            p("deadline").isNull() & F.col("_deadline").isNotNull(),
            F.col("_deadline.deadline_is_rolling")).otherwise(p("deadline_is_rolling")),
        "description_text": F.coalesce(F.col("_text.description_text"), p("description_text")),
        "requirements": F.when(own_text | (F.coalesce(F.array_size(donated), F.lit(0)) == 0),
                               p("requirements")).otherwise(donated),
        "company_description": F.coalesce("_about", p("company_description")),
        "is_startup": F.col("_startup"),
    }
    return out.select(key, *[fills.get(c, p(c)).alias(c) for c in payload], "n_merged", *(more or {}))


def also_seen(listings: DataFrame, merged: DataFrame, key: str = "key",
              tie: str = "ingest_seq", rank: Column | None = None) -> DataFrame:
    """(key, source, n, best): the sources of all copies but the primary.

    Rows, not one list per key, because a key may have any number of sources; `best`
    orders them as the copies rank. The join is by key and row, so it stays balanced. `rank` is
    a column of the listings that holds their `quality`, if it is known already.
    """
    others = listings.join(merged.select(key, tie), [key, tie], "left_anti")
    return others.groupBy(key, "source").agg(
        F.count("*").alias("n"), F.min(quality(tie) if rank is None else rank).alias("best"))


def also_seen_text(listings: DataFrame, key: str = "key", tie: str = "ingest_seq") -> DataFrame:
    """(key, also_seen) of keys with several copies: the sources of all but the best copy, other than its
    own, best first, as a text. A text is as long as the sources of one key.

    Ranks are worked out before anything is joined, so a copy travels as its key, tie, source and rank.
    """
    narrow = checkpointed(listings.select(key, tie, "source", quality(tie).alias("_rank")))
    best = F.min_by(F.struct(tie, F.col("source").alias("_own")), "_rank").alias("_b")
    several = narrow.groupBy(key).agg(best, F.count("*").alias("_n")).where("_n > 1").select(key, "_b.*")
    others = (also_seen(narrow.join(several.select(key), key, "left_semi"), several, key, tie, F.col("_rank"))
              .join(several.select(key, "_own"), key).where("source <> _own"))
    listed = others.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("best", "source"))).alias("_l"))
    return listed.select(key, F.array_join(F.transform("_l", lambda x: x["source"]), ", ").alias("also_seen"))


def mark_eligibility(listings: DataFrame, as_of, recency_days: int = 60,
                     lookahead_days: int = 90, include_unverified: bool = True) -> DataFrame:
    """Adds eligible and eligibility_reason: posted lately, or due soon, or undated."""
    age = F.datediff(day(as_of), F.col("posted_date"))
    dated = F.col("posted_date").isNotNull() & (F.col("date_confidence") != V.UNVERIFIED)
    recent = dated & age.between(0, recency_days)
    future = dated & (age < 0)
    left = F.datediff(F.col("deadline"), day(as_of))
    due = (F.col("deadline").isNotNull() & ~F.coalesce("deadline_is_rolling", F.lit(False))
           & left.between(0, lookahead_days))
    flags = [F.coalesce(c, F.lit(False)) for c in (recent, future, due)]
    recent, future, due = flags
    undated = (~(recent | future | due) & F.lit(include_unverified)
               & (F.col("date_confidence") == V.UNVERIFIED))
    undated = F.coalesce(undated, F.lit(False))
    reason = F.concat_ws(
        "; ",
        F.when(recent, F.format_string(f"posted %sd ago (≤{recency_days}d)", age)),
        F.when(future, "posted date in the future (treated as fresh)"),
        F.when(due, F.format_string(f"deadline in %sd (≤{lookahead_days}d)", left)),
        F.when(undated, "date unverified (included, flagged, sorted below verified)"))
    return listings.withColumns({
        "eligible": recent | future | due | undated,
        "eligibility_reason": F.coalesce(blank_to_null(reason),
                                         F.lit("outside recency/deadline windows"))})


def eligible_only(listings: DataFrame) -> DataFrame:
    return listings.where("eligible")


def recent_first_seen(listings: DataFrame, as_of_ts, days: int = 30) -> DataFrame:
    """Rows first seen in the last `days` days; never-seen rows do not count."""
    since = F.lit(as_of_ts).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return listings.where(F.col("first_seen").cast("timestamp") >= since)


def fresh_sources(listings: DataFrame, source_meta: DataFrame, as_of,
                  max_age_days: int = 14) -> DataFrame:
    """Drops every row of a source last updated over `max_age_days` ago.

    `source_meta` has source and last_commit (text); an unreadable date passes.
    """
    last = F.try_to_date(F.substring("last_commit", 1, 10), "yyyy-MM-dd")
    stale = (source_meta.where(F.datediff(day(as_of), last) > max_age_days)
             .select("source").distinct())
    return lookup_join(listings, stale, ["source"], "left_anti")
