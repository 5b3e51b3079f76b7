"""Is a posting still open? Verdicts from landed crawl results."""

from pyspark.sql import Column, DataFrame, functions as F

from rolecast import values as V
from rolecast.functions.text import blank_to_null, let, text, url_path
from rolecast.operators.common import checkpointed, lookup_join
from rolecast.sources.jsonld import open_flag


def closure_phrase(body: Column, phrases=V.CLOSURE_PHRASES) -> Column:
    """First phrase of the list that stands in the page, null when none does."""
    listed = F.array(*[F.lit(p) for p in phrases])
    return let(F.lower(text(body)), lambda page: F.get(
        F.filter(listed, lambda p: page.contains(p)), F.lit(0)))


def is_generic_landing(final_url: Column, requested_url: Column) -> Column:
    """Did a redirect end on a landing page, or on a parent path of the posting?"""
    asked = F.regexp_replace(url_path(requested_url), "/+$", "")
    final = F.regexp_replace(url_path(final_url), "/+$", "")
    words = "|".join(V.LANDING_PATHS)
    landing = F.when(final == "", "/").otherwise(final).rlike(rf"(?i)^/?({words})?/?$")
    parent = (final != "") & asked.startswith(F.concat(final, F.lit("/")))
    return (asked != "") & (final != asked) & (landing | parent)


def classify_live(status: Column, final_url: Column, requested_url: Column, body: Column,
                  redirected: Column, error: Column, is_open: Column,
                  phrases=V.CLOSURE_PHRASES) -> Column:
    """Struct (live_status, live_reason). The first rule that applies decides."""
    phrase = closure_phrase(body, phrases)
    status = F.coalesce(status, F.lit(0))
    error = blank_to_null(error)
    landed = F.coalesce(redirected, F.lit(False)) & is_generic_landing(final_url, requested_url)
    code = F.concat(F.lit("HTTP "), status.cast("string"))

    def verdict(live, reason):
        return F.struct(F.lit(live).alias("live_status"),
                        (reason if isinstance(reason, Column) else F.lit(reason)).alias("live_reason"))

    return (
        F.when(status.isin(404, 410), verdict(V.DEAD, F.concat(code, F.lit(" (removed)"))))
        .when((status == 0) | error.isNotNull(), verdict(V.UNKNOWN, F.concat(
            F.lit("unreachable ("), F.coalesce(error, F.lit("no response")),
            F.lit(") — kept, unverified"))))
        .when(status.isin(401, 403, 429) | status.between(500, 599), verdict(V.UNKNOWN, F.concat(
            code, F.lit(" (blocked/transient) — kept, could not verify live"))))
        .when(~status.between(200, 399), verdict(V.UNKNOWN, F.concat(
            code, F.lit(" — kept, could not verify live"))))
        .when(phrase.isNotNull(), verdict(V.DEAD, F.concat(
            F.lit("closure signal: '"), phrase, F.lit("'"))))
        .when(~is_open, verdict(V.DEAD, "schema.org validThrough indicates expired"))
        .when(landed, verdict(V.DEAD, F.concat(
            F.lit("redirected to generic page ("),
            F.coalesce(blank_to_null(url_path(final_url)), F.lit("/")), F.lit(")"))))
        .otherwise(verdict(V.LIVE, "verified live")))


def crawl_verdicts(http_results: DataFrame, as_of, phrases=V.CLOSURE_PHRASES) -> DataFrame:
    """(requested_url, live_status, live_reason): one narrow row per crawled page."""
    v = classify_live(F.col("status"), F.col("final_url"), F.col("requested_url"),
                      F.col("body"), F.col("redirected"), F.col("error"),
                      open_flag(F.col("body"), as_of), phrases)
    return (http_results.select("requested_url", v.alias("_v"))
            .select("requested_url", "_v.*"))


def live_check(listings: DataFrame, http_results: DataFrame, as_of, checked_at=None,
               phrases=V.CLOSURE_PHRASES) -> DataFrame:
    """Adds live_status, live_reason and live_checked_at by apply_url.

    Pages are judged before the join, so bodies never travel; the narrow verdicts are
    written once (a job), so no body is read again. A page crawled twice counts by its
    firmest verdict, in the order dead, live, unknown.
    """
    rank = (F.when(F.col("live_status") == V.DEAD, 0)
            .when(F.col("live_status") == V.LIVE, 1).otherwise(2))
    verdicts = (crawl_verdicts(http_results, as_of, phrases).groupBy("requested_url")
                .agg(F.min(F.struct(rank.alias("r"), "live_status", "live_reason")).alias("_v"))
                .select(F.col("requested_url").alias("apply_url"), "_v"))
    verdicts = checkpointed(verdicts)
    kept = listings.drop("live_status", "live_reason", "live_checked_at")
    out = lookup_join(kept, verdicts, ["apply_url"], "left")
    checkable = text(F.col("apply_url")).startswith("http")
    return (out.withColumn("live_status", F.when(checkable, F.coalesce(
                "_v.live_status", F.lit(V.UNKNOWN))).otherwise(V.UNKNOWN))
            .withColumn("live_reason", F.when(checkable, F.coalesce(
                "_v.live_reason", F.lit("unreachable (no response) — kept, unverified")))
                .otherwise("no application URL to verify"))
            .withColumn("live_checked_at", F.lit(checked_at).cast("timestamp"))
            .drop("_v"))


def drop_dead(listings: DataFrame) -> DataFrame:
    return listings.where(F.col("live_status") != V.DEAD)
