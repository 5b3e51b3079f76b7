"""Ordering, facets, metrics and rendered cards of a result."""

from pyspark.sql import Column, DataFrame, functions as F

from rolecast import values as V
from rolecast.functions.dates import day, deadline_display, posted_display
from rolecast.functions.html import escape
from rolecast.functions.text import blank_to_null, first_n, source_head, text
from rolecast.operators.common import number_rows

NO_DEADLINE = 10**6
DASH = "—"
FACETS = ("source", "work_mode", "date_confidence", "live_status")


def _rolling() -> Column:
    return F.coalesce("deadline_is_rolling", F.lit(False))


def days_to_deadline(as_of) -> Column:
    """Days left, a million for rolling or no deadline."""
    left = F.datediff(F.col("deadline"), day(as_of))
    return F.when(F.col("deadline").isNotNull() & ~_rolling(), left).otherwise(NO_DEADLINE)


def urgency_keys(as_of) -> list[Column]:
    """Dated deadlines first, the soonest first, then by score."""
    return [F.col("deadline").isNull() | _rolling(), days_to_deadline(as_of), -F.col("match_score")]


def by_urgency(df: DataFrame, as_of, tie: str = "ingest_seq") -> DataFrame:
    return df.orderBy(*urgency_keys(as_of), tie)


def sorted_by(df: DataFrame, order: str, as_of, tie: str = "ingest_seq") -> DataFrame:
    """Result order: 'deadline', 'score' or 'posted' (newest first, undated last)."""
    keys = {"deadline": [days_to_deadline(as_of)],
            "score": [F.desc("match_score")],
            "posted": [F.desc_nulls_last("posted_date")]}[order]
    return df.orderBy(*keys, tie)


def urgency_rank(df: DataFrame, as_of, tie: str = "ingest_seq",
                 group: tuple[str, ...] = ()) -> DataFrame:
    """Adds rank, the place of each row in urgency order."""
    return number_rows(df, list(group), urgency_keys(as_of), tie, "rank")


def facet_value(facet: str) -> Column:
    c = source_head(F.col(facet)) if facet == "source" else F.col(facet)
    return F.coalesce(blank_to_null(c), F.lit(DASH))


def facet_counts(df: DataFrame, facets=FACETS) -> DataFrame:
    """(facet, value, n): all facets in one pass over the table."""
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), facet_value(f).alias("value"))
                      for f in facets])
    return (df.select(F.explode(pairs).alias("_f")).groupBy("_f.facet", "_f.value")
            .agg(F.count("*").alias("n")))


def faceted_filter(df: DataFrame, as_of, query: str = "", min_score: int = 0,
                   deadline_only: bool = False, **selected: list[str]) -> DataFrame:
    """Rows that pass every given choice: text in company or title, least score, facet
    values, a deadline within a year (past ones pass)."""
    out = df.where(F.coalesce("match_score", F.lit(0)) >= min_score)
    if query.strip():
        hay = F.lower(F.concat_ws(" ", text(F.col("company")), text(F.col("title"))))
        out = out.where(hay.contains(query.strip().lower()))
    for facet, values in selected.items():
        if values:
            out = out.where(facet_value(facet).isin(list(values)))
    if deadline_only:
        out = out.where(days_to_deadline(as_of) <= 365)
    return out


def result_metrics(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("shown"),
                  F.count_if(F.col("date_confidence") == V.VERIFIED).alias("verified_date"),
                  F.count_if(F.col("live_status") == V.LIVE).alias("live_confirmed"))


def with_bucket(df: DataFrame) -> DataFrame:
    """Adds bucket: 'unverified' or 'verified' date, in one pass."""
    return df.withColumn("bucket", F.when(F.col("date_confidence") == V.UNVERIFIED, "unverified")
                         .otherwise("verified"))


def section_rank(df: DataFrame, as_of, tie: str = "ingest_seq",
                 owner: tuple[str, ...] = ("profile_id",)) -> DataFrame:
    """Adds bucket and rank, the place of a card in its section."""
    return urgency_rank(with_bucket(df), as_of, tie, (*owner, "bucket"))


# ---- cards -----------------------------------------------------------------

def posted_text() -> Column:
    has = F.col("posted_date").isNotNull()
    source = text(F.col("date_source"))
    return (F.when((F.col("date_confidence") == V.VERIFIED) & has, F.concat(
                F.col("posted_date").cast("string"), F.lit("  _(verified — "), source, F.lit(")_")))
            .when((F.col("date_confidence") == V.APPROXIMATE) & has, F.concat(
                F.lit("~"), F.col("posted_date").cast("string"), F.lit("  _(approximate — "),
                F.coalesce(blank_to_null(source), F.lit("relative date")), F.lit(")_")))
            .otherwise(F.concat(F.lit("**[unverified]**  _("), F.coalesce(
                blank_to_null(source), F.lit("no determinable date")), F.lit(")_"))))


def live_text() -> Column:
    at = F.coalesce(F.date_format("live_checked_at", "yyyy-MM-dd HH:mm 'UTC'"), F.lit(DASH))
    why = text(F.col("live_reason"))
    return (F.when(F.col("live_status") == V.LIVE, F.concat(F.lit("✅ verified live as of "), at))
            .when(F.col("live_status") == V.UNKNOWN, F.concat(
                F.lit("⚠️ could not verify ("), why, F.lit(") — checked "), at))
            .when(F.col("live_status") == V.DEAD, F.concat(F.lit("❌ dead ("), why, F.lit(")")))
            .otherwise("— not live-checked (disabled)"))


def startup_text() -> Column:
    stage = blank_to_null(F.col("funding_stage"))
    return (F.when(F.col("is_startup"), F.concat(F.lit("Startup"), F.coalesce(
                F.concat(F.lit(" · "), stage), F.lit(""))))
            .when(~F.col("is_startup"), "Established / non-startup").otherwise("Unknown"))


def _filled(c: str, other: str = DASH) -> Column:
    return F.coalesce(blank_to_null(F.col(c)), F.lit(other))


def _joined(c: str) -> Column:
    return F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), ", ")


def sources_text(also: bool) -> Column:
    own = _filled("source")
    return F.concat(own, F.when(text(F.col("also_seen")) != "", F.concat(
        F.lit("  ·  also seen: "), F.col("also_seen"))).otherwise("")) if also else own


def markdown_card(df: DataFrame) -> Column:
    """Markdown text of one ranked posting."""
    score = F.col("match_score").cast("string")

    def item(label, c):
        return F.concat(F.lit(f"- **{label}:** "), c)

    def when_any(column, line):
        return F.when(_joined(column) != "", line)

    about = blank_to_null(F.col("company_description"))
    lines = [
        F.concat(F.lit("### "), F.col("rank").cast("string"), F.lit(". "), text(F.col("company")),
                 F.lit(" — "), text(F.col("title")), F.lit("  ·  Match "), score, F.lit("/100")),
        F.lit(""),
        F.when(about.isNotNull(), F.concat(F.lit("> "), about, F.lit("\n"))),
        item("Startup", startup_text()),
        item("Level / mode", F.concat(_filled("level"), F.lit(" · "), _filled("work_mode", "unknown"))),
        item("Location", _filled("location")),
        item("Posted", posted_text()),
        item("Deadline", deadline_display(F.col("deadline"), F.col("deadline_is_rolling"))),
        item("Live check", live_text()),
        item("Source", sources_text("also_seen" in df.columns)),
        item("Apply", _filled("apply_url")),
        when_any("requirements", item("Tech stack / requirements", _joined("requirements"))),
        item("Eligibility", text(F.col("eligibility_reason"))),
        F.concat(F.lit("- **Match "), score, F.lit("/100** — "), text(F.col("match_rationale"))),
        when_any("matched_keywords", F.concat(F.lit("  - Matched: "), _joined("matched_keywords"))),
        when_any("missing_keywords", F.concat(F.lit("  - Missing: "), _joined("missing_keywords"))),
        F.lit(""),
    ]
    return F.concat_ws("\n", *lines)


def html_card(df: DataFrame) -> Column:
    """HTML text of one ranked posting, every value escaped."""
    def row(label, c, css=None):
        open_tag = F.lit("<li>") if css is None else F.concat(F.lit('<li class="'), css, F.lit('">'))
        return F.concat(open_tag, F.lit(f"<b>{label}:</b> "), c, F.lit("</li>"))

    def listed(c):
        return F.coalesce(blank_to_null(escape(_joined(c))), F.lit(DASH))

    conf = (F.when(F.col("date_confidence") == V.VERIFIED, "conf-verified")
            .when(F.col("date_confidence") == V.APPROXIMATE, "conf-approx")
            .when(F.col("date_confidence") == V.UNVERIFIED, "conf-unverified").otherwise(""))
    live = (F.when(F.col("live_status") == V.LIVE, "live-ok")
            .when(F.col("live_status") == V.UNKNOWN, "live-unknown")
            .when(F.col("live_status") == V.DEAD, "live-dead")
            .when(F.col("live_status") == V.NOT_CHECKED, "live-skip").otherwise(""))
    url = escape(F.col("apply_url"))
    link = F.when(url != "", F.concat(F.lit('<a href="'), url, F.lit(
        '" target="_blank" rel="noopener">'), url, F.lit("</a>"))).otherwise(DASH)
    posted = F.concat(escape(posted_display(F.col("posted_date"))), F.lit(" ("),
                      escape(F.col("date_confidence")), F.lit(" — "),
                      escape(F.col("date_source")), F.lit(")"))
    return F.concat_ws(
        "\n", F.lit('<div class="card"><div class="card-head">'),
        F.concat(F.lit('<span class="rank">'), F.col("rank").cast("string"),
                 F.lit('</span> <span class="company">'), escape(F.col("company")),
                 F.lit('</span> — <span class="title">'), escape(F.col("title")),
                 F.lit('</span> <span class="score">Match '), F.col("match_score").cast("string"),
                 F.lit("/100</span></div>")),
        F.concat(F.lit('<p class="desc">'), escape(F.col("company_description")), F.lit("</p><ul>")),
        row("Startup", escape(startup_text())),
        row("Level / mode", escape(F.concat(_filled("level"), F.lit(" · "),
                                            _filled("work_mode", "unknown")))),
        row("Location", escape(_filled("location"))), row("Posted", posted, conf),
        row("Deadline", escape(deadline_display(F.col("deadline"), F.col("deadline_is_rolling")))),
        row("Live check", escape(live_text()), live),
        row("Source", escape(sources_text("also_seen" in df.columns))), row("Apply", link),
        row("Tech stack", listed("requirements")),
        row("Eligibility", escape(F.col("eligibility_reason"))),
        row("Rationale", escape(F.col("match_rationale"))),
        row("Matched", listed("matched_keywords")), row("Missing", listed("missing_keywords")),
        F.lit("</ul></div>"))


def cards(df: DataFrame, as_of, tie: str = "ingest_seq",
          owner: tuple[str, ...] = ("profile_id",)) -> DataFrame:
    """(owner, bucket, rank, markdown, html): one rendered row per posting."""
    ranked = section_rank(df, as_of, tie, owner)
    return ranked.select(*owner, "bucket", "rank", markdown_card(ranked).alias("markdown"),
                         html_card(ranked).alias("html"))


def report_totals(df: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """(section, text): the heading lines of a report."""
    n = df.agg(F.count_if(F.col("date_confidence") != V.UNVERIFIED).alias("v"),
               F.count_if(F.col("date_confidence") == V.UNVERIFIED).alias("u"))
    out = n.select(F.lit("totals").alias("section"), F.format_string(
        "**Totals:** %d verified-date  ·  %d unverified-date  ·  %d retained",
        "v", "u", F.col("v") + F.col("u")).alias("text"))
    if changes is not None:
        c = changes.agg(F.count_if(F.col("change") == "new").alias("n"),
                        F.count_if(F.col("change") == "closed").alias("c"))
        out = out.unionByName(c.select(F.lit("diff").alias("section"), F.format_string(
            "**Since last run:** %d new  ·  %d no longer listed", "n", "c").alias("text")))
    return out


# ---- the parts of a report ---------------------------------------------------

HEAD, DATED, UNDATED = 0, 1, 2


def _blocks(*lines) -> Column:
    return F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])


def report_head(owners: DataFrame, generated: str, recency_days: int, lookahead_days: int, live_checked: bool,
                changes: DataFrame | None = None, title: str = "Results", tools: int | None = None) -> Column:
    """The head of a report: title, time, windows, totals, changes and the profile it was made for.

    `owners` has dated and undated (counts) and may have degree, major and tools_languages, whose
    list `tools` (usually `V.TOOLS_IN_HEAD`) shortens. Of `changes` only two counts are fetched."""
    empty = F.array().cast("array<string>")
    has = lambda c, other: F.coalesce(F.col(c), other) if c in owners.columns else other
    who = F.concat_ws(" ", F.nullif(has("degree", F.lit("")), F.lit("")), F.nullif(has("major", F.lit("")), F.lit("")))
    listed = F.array_join(first_n(has("tools_languages", empty), tools), ", ")
    since = []
    if changes is not None:
        c = changes.agg(F.count_if(F.col("change") == "new").alias("n"),
                        F.count_if(F.col("change") == "closed").alias("c")).first()
        since = [f"**Since last run:** {c['n']} new  ·  {c['c']} no longer listed", ""]
    profile = [] if "degree" not in owners.columns else [
        "<details><summary>Candidate profile used for matching</summary>", "",
        F.when(who != "", F.concat(F.lit("- **Background:** "), who)),
        F.when(listed != "", F.concat(F.lit("- **Tools/languages:** "), listed)), "</details>", ""]
    checked = " (all live-checked this run)" if live_checked else ""
    return _blocks(
        f"# {title}", "", f"_Generated {generated}_", "",
        f"**Windows:** posted ≤ {recency_days}d  ·  deadline ≤ {lookahead_days}d  ·  "
        f"live-check {'ON' if live_checked else 'OFF'}", "",
        F.format_string(f"**Totals:** %d verified-date  ·  %d unverified-date  ·  %d retained{checked}",
                        "dated", "undated", F.col("dated") + F.col("undated")), "", *since, *profile)


def report_parts(df: DataFrame, profiles: DataFrame, as_of, generated: str, recency_days: int = 60,
                 lookahead_days: int = 90, live_checked: bool = True, changes: DataFrame | None = None,
                 title: str = "Results", tools: int | None = None, tie: str = "ingest_seq",
                 owner: str = "profile_id") -> DataFrame:
    """(owner, part, rank, markdown): whole reports as rows, to be read in that order.

    Part 0 is the head, parts 1 and 2 are the sections of dated and of undated postings; rank 0 of
    a section is its heading, the others are cards. A report is never put together in one row or
    task, so it may have any number of cards. Every profile has a report, also one without postings;
    rows of profiles that are not in `profiles` have one without the profile's lines. Rows without
    an owner are left out.
    """
    df, profiles = df.where(F.col(owner).isNotNull()), profiles.where(F.col(owner).isNotNull())
    late = F.col("date_confidence") == V.UNVERIFIED
    counted = df.groupBy(owner).agg(F.count_if(late).alias("undated"), F.count("*").alias("_n"))
    owners = profiles.join(counted, owner, "full").withColumns({
        "undated": F.coalesce("undated", F.lit(0)), "_n": F.coalesce("_n", F.lit(0))})
    owners = owners.withColumn("dated", F.col("_n") - F.col("undated"))

    def section(part, heading, n, *note):
        return F.struct(F.lit(part).alias("part"), _blocks(
            "---", "", heading, "", *note,
            F.when(F.col(n) == 0, F.lit(V.NONE_THIS_RUN + "\n"))).alias("markdown"))

    frame = owners.select(owner, F.inline(F.array(
        F.struct(F.lit(HEAD).alias("part"), report_head(
            owners, generated, recency_days, lookahead_days, live_checked, changes, title, tools).alias("markdown")),
        section(DATED, V.DATED_HEADING, "dated"),
        section(UNDATED, V.UNDATED_HEADING, "undated", V.UNDATED_NOTE, ""))))
    frame = frame.withColumn("rank", F.lit(0).cast("long"))
    ranked = section_rank(df, as_of, tie, (owner,))
    body = ranked.select(owner, F.when(F.col("bucket") == "verified", DATED).otherwise(UNDATED).alias("part"),
                         F.col("rank").cast("long").alias("rank"), markdown_card(ranked).alias("markdown"))
    return frame.unionByName(body)
