"""Score every profile against every posting it shares a term with."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rolecast import values as V
from rolecast.functions.text import first_n, shortened, text
from rolecast.operators.common import checkpointed, computed, is_small, lookup_join
from rolecast.operators.terms import term_hits

_MICRO = 1_000_000


def posting_fields(postings: DataFrame) -> dict[str, Column]:
    body = [text(F.col("description_text"))]
    if "requirements" in postings.columns:
        body.append(F.array_join(F.coalesce("requirements", F.array().cast("array<string>")), " "))
    return {"in_title": text(F.col("title")), "in_body": F.concat_ws(" ", *body)}


def score_of(weight_sum: Column, has_text: Column) -> Column:
    """0 to 100, saturating; a posting without text stays at 70 or below."""
    raw = F.lit(100.0) * (F.lit(1.0) - F.exp(-weight_sum / V.SCORE_SCALE))
    capped = F.when(has_text, raw).otherwise(F.least(raw, F.lit(V.SCORE_CAP_NO_TEXT)))
    return F.bround(capped, 0).cast("int")


def _hits(postings: DataFrame, profile_terms: DataFrame, posting: str, small: bool) -> DataFrame:
    """(posting, term, in_title, in_body, _has_text)"""
    has_text = text(F.col("description_text")) != ""
    return term_hits(postings, profile_terms, posting, posting_fields(postings), {"_has_text": has_text}, small)


def _weights(profile_terms: DataFrame) -> DataFrame:
    return profile_terms.select("profile_id", "term", "term_rank",
                                F.round(F.col("weight") * _MICRO).cast("bigint").alias("_w"))


def _in_title(weight: Column) -> Column:
    return (weight * V.TITLE_FACTOR_NUM / V.TITLE_FACTOR_DEN).cast("bigint")


def match_pairs(postings: DataFrame, profile_terms: DataFrame, posting: str = "posting_id",
                small: bool | None = None) -> DataFrame:
    """(profile_id, posting, match_score, matched_ranks): pairs sharing at least a term.

    Every pair that shares no term scores 0 and has no row. Weights are summed as whole
    millionths, so the sum does not depend on the order. The ranks, at most one per term
    of the profile, stand for the matched terms until `with_term_lists` names them.
    """
    if small is None:
        small = is_small(profile_terms)
    hits, weights = _hits(postings, profile_terms, posting, small), _weights(profile_terms)
    if small:
        # Dealt out by posting before they become pairs: a pair is summed where it is made, and
        # only the hits are shuffled.
        hits = hits.repartition(posting)
    # Hits of a word held by many postings are the large side; each becomes part of a
    # pair that is in the result.
    pairs = lookup_join(hits, weights, ["term"], "inner", small=small)
    summed = pairs.groupBy("profile_id", posting).agg(
        F.sum(F.when(F.col("in_title"), _in_title(F.col("_w"))).otherwise(F.col("_w"))).alias("_sum"),
        F.array_sort(F.collect_list("term_rank")).alias("matched_ranks"),
        F.max("_has_text").alias("_has_text"))
    return summed.select("profile_id", posting,
                         score_of(F.col("_sum") / F.lit(float(_MICRO)), F.col("_has_text"))
                         .alias("match_score"), "matched_ranks")


def best_pairs(pairs: DataFrame, k: int, posting: str = "posting_id") -> DataFrame:
    """The k best postings of each profile; ties go to the lower posting id."""
    order = W.partitionBy("profile_id").orderBy(F.desc("match_score"), posting)
    return (pairs.withColumn("pair_rank", F.row_number().over(order))
            .where(F.col("pair_rank") <= k))


def top_pairs(postings: DataFrame, profile_terms: DataFrame, k: int, posting: str = "posting_id",
              small: bool | None = None) -> DataFrame:
    """(profile_id, posting, match_score, matched_ranks, pair_rank): what `best_pairs` gives of
    `match_pairs`. Before the cut a pair is two numbers and two ids, summed by hash in both halves
    of the exchange; only the k pairs that stay get their ranks, from the rows of their posting."""
    small = is_small(profile_terms) if small is None else small
    hits = checkpointed(_hits(postings, profile_terms, posting, small).select(posting, "term", "in_title", "_has_text"))
    weights = _weights(profile_terms)
    pairs = lookup_join(hits, weights.drop("term_rank"), ["term"], "inner", small=small)
    summed = pairs.groupBy("profile_id", posting).agg(
        F.sum(F.when(F.col("in_title"), _in_title(F.col("_w"))).otherwise(F.col("_w"))).alias("_sum"),
        F.max("_has_text").alias("_has_text"))
    scored = summed.select("profile_id", posting, score_of(F.col("_sum") / F.lit(float(_MICRO)), F.col("_has_text")).alias("match_score"))
    best = checkpointed(best_pairs(scored, k, posting).select("profile_id", posting, "pair_rank"))
    return _whole(best, hits, weights, posting)


def _whole(pairs: DataFrame, hits: DataFrame, weights: DataFrame, posting: str) -> DataFrame:
    """The given pairs (with pair_rank) and their match_score and matched_ranks, worked out in their
    rows: the lists are those of one posting and of one profile."""
    held = (lookup_join(hits, pairs.select(posting).distinct(), [posting], "left_semi").groupBy(posting)
            .agg(F.collect_list("term").alias("_held"), F.collect_list(F.when(F.col("in_title"), F.col("term"))).alias("_titled"),
                 F.max("_has_text").alias("_has_text")))
    own = weights.groupBy("profile_id").agg(F.sort_array(F.collect_list(F.struct("term_rank", "term", "_w"))).alias("_own"))
    rows = lookup_join(lookup_join(pairs, held, [posting], "inner"), own, ["profile_id"], "inner")
    matched = F.filter("_own", lambda t: F.array_contains(F.col("_held"), t["term"]))
    rows = computed(rows, _matched=matched)
    summed = F.aggregate("_matched", F.lit(0).cast("bigint"), lambda a, t: a + F.when(
        F.array_contains(F.col("_titled"), t["term"]), _in_title(t["_w"])).otherwise(t["_w"]))
    return rows.select("profile_id", posting, "pair_rank", score_of(summed / F.lit(float(_MICRO)), F.col("_has_text")).alias("match_score"),
                       F.transform("_matched", lambda t: t["term_rank"]).alias("matched_ranks"))


def with_term_lists(pairs: DataFrame, profile_terms: DataFrame, matched: int | None = None,
                    missing: int | None = None, small: bool | None = None,
                    named: int | None = None) -> DataFrame:
    """Adds matched_keywords, missing_keywords and match_rationale, in weight order.

    Lists are as long as a profile's terms; `matched`, `missing` and `named` (in the
    rationale) shorten them, usually to `V.MATCHED_SHOWN`, `V.MISSING_SHOWN` and
    `V.RATIONALE_SHOWN`."""
    # One list per profile, as long as its terms.
    lists = profile_terms.groupBy("profile_id").agg(
        F.array_sort(F.collect_list(F.struct("term_rank", "term", "weight"))).alias("_terms"))
    small = is_small(profile_terms) if small is None else small
    out = lookup_join(pairs, lists, ["profile_id"], "left", small=small)
    hit = F.filter("_terms", lambda t: F.array_contains(F.col("matched_ranks"), t["term_rank"]))
    gap = F.filter("_terms", lambda t: (t["weight"] >= V.TOP_WEIGHT)
                   & ~F.array_contains(F.col("matched_ranks"), t["term_rank"]))
    names = lambda a: F.transform(a, lambda t: t["term"])
    out = (out.withColumn("matched_keywords", first_n(names(hit), matched))
           .withColumn("missing_keywords", first_n(names(gap), missing)))
    return out.withColumn("match_rationale", rationale(names(hit), named)).drop("_terms")


def missing_terms(pairs: DataFrame, profile_terms: DataFrame, posting: str = "posting_id",
                  limit: int | None = None) -> DataFrame:
    """(profile_id, posting, term, missing_rank): heavy terms a posting does not mention."""
    lists = with_term_lists(pairs, profile_terms, missing=limit)
    return lists.select("profile_id", posting,
                        F.posexplode("missing_keywords").alias("missing_rank", "term"))


def rationale(matched: Column, named: int | None = None) -> Column:
    more = F.lit("") if named is None else F.when(F.size(matched) > named, " ...").otherwise("")
    return (F.when(F.size(matched) == 0, "Keyword match: no strong overlap with resume skills.")
            .otherwise(F.concat(F.lit("Keyword match on: "),
                                F.array_join(first_n(matched, named), ", "), more)))


def score_all_for(postings: DataFrame, pairs: DataFrame, profile_id,
                  posting: str = "posting_id") -> DataFrame:
    """Every posting with the score of one profile, 0 where no term is shared."""
    mine = pairs.where(F.col("profile_id") == F.lit(profile_id)).drop("profile_id")
    return (postings.join(mine, posting, "left")
            .withColumn("profile_id", F.lit(profile_id))
            .withColumn("match_score", F.coalesce("match_score", F.lit(0)))
            .withColumn("matched_ranks",
                        F.coalesce("matched_ranks", F.array().cast("array<int>"))))


def at_least(scored: DataFrame, min_score: int) -> DataFrame:
    return scored.where(F.col("match_score") >= min_score)


def score_prompts(pairs: DataFrame, profiles: DataFrame, postings: DataFrame,
                  posting: str = "posting_id", text_chars: int | None = None) -> DataFrame:
    """(profile_id, posting, prompt): the outbox for an external scorer.

    `text_chars` (usually `V.PROMPT_CHARS`) bounds the posting's text in a prompt.
    """
    p = lookup_join(pairs.select("profile_id", posting),
                    profiles.select("profile_id", "summary", "target_role"), ["profile_id"], "left")
    full = lookup_join(p, postings.select(posting, "company", "title", "location",
                                          "description_text"), [posting], "left")

    def filled(c, other):
        return F.coalesce(F.nullif(c, F.lit("")), F.lit(other))

    prompt = F.concat(
        F.lit("CANDIDATE PROFILE:\n"), filled(F.col("summary"), "(resume text was sparse)"),
        F.lit("\nSTATED TARGET ROLES/FIELD: "),
        filled(F.col("target_role"), "(not specified - infer from the resume)"),
        F.lit("\n\nINTERNSHIP:\nCompany: "), text(F.col("company")),
        F.lit("\nTitle: "), text(F.col("title")), F.lit("\nLocation: "), text(F.col("location")),
        F.lit("\nDescription:\n"),
        filled(shortened(F.col("description_text"), text_chars),
               "(no description available; score from the title)"),
        F.lit("\n\nScore the fit."))
    return full.select("profile_id", posting, prompt.alias("prompt"))


SCORE_SCHEMA = ("score string, rationale string, matched_skills array<string>, "
                "missing_skills array<string>")


def _score_body(answer: str) -> Column:
    return F.regexp_extract(text(F.col(answer)), r"(?s)\{.*\}", 0)


def parse_scores(raw: DataFrame, answer: str = "answer") -> DataFrame:
    """Reads external answers: JSON, bare, in a code fence, or inside other words.

    A score may be any number, also in quotes; its whole part counts. Answers that hold no
    valid JSON object have no row here but one in `unread_scores`.
    """
    body = _score_body(answer)
    score = F.col("_s.score").try_cast("double")
    whole = F.when(F.abs(score) <= 2147483647, F.when(score < 0, F.ceil(score)).otherwise(F.floor(score)))
    rest = [F.col(f"_s.{c}") for c in ("rationale", "matched_skills", "missing_skills")]
    return (raw.where(F.try_parse_json(F.nullif(body, F.lit(""))).isNotNull())
            .withColumn("_s", F.from_json(body, SCORE_SCHEMA))
            .select(*[c for c in raw.columns if c != answer], whole.cast("int").alias("score"), *rest))


def unread_scores(raw: DataFrame, answer: str = "answer") -> DataFrame:
    """The answers without a valid JSON object."""
    return raw.where(F.try_parse_json(F.nullif(_score_body(answer), F.lit(""))).isNull())


def override_scores(pairs: DataFrame, rescored: DataFrame, on: list[str], matched: int | None = None,
                    missing: int | None = None) -> DataFrame:
    """Replaces scores and lists where an external score exists; gaps keep our values.

    `matched` and `missing` shorten the new lists, usually to `V.RESCORED_SHOWN`."""
    new = rescored.select(
        *on, F.col("score").alias("_score"), F.col("rationale").alias("_why"),
        F.col("matched_skills").alias("_hit"), F.col("missing_skills").alias("_gap"))
    out = pairs.join(new, on, "left")
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce("_score", "match_score")))

    def listed(new_list, old, n):
        return F.when(F.size(F.coalesce(new_list, F.array().cast("array<string>"))) > 0,
                      first_n(new_list, n)).otherwise(F.col(old))

    return (out.withColumn("match_score", score.cast("int"))
            .withColumn("match_rationale", F.trim(F.coalesce(F.nullif("_why", F.lit("")),
                                                             F.col("match_rationale"))))
            .withColumn("matched_keywords", listed(F.col("_hit"), "matched_keywords", matched))
            .withColumn("missing_keywords", listed(F.col("_gap"), "missing_keywords", missing))
            .drop("_score", "_why", "_hit", "_gap"))


def by_score(df: DataFrame, tie: str) -> DataFrame:
    return df.orderBy(F.desc("match_score"), tie)
