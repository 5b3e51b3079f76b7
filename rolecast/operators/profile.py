"""Profiles from plain text: sections, facts, weighted terms, summary."""

from pyspark.sql import Column, DataFrame, functions as F

from rolecast import values as V
from rolecast.functions.text import (first_filled, first_n, let, lines, normalize_term, squeeze, strip, text,
                                     title_case)
from rolecast.operators import terms as T
from rolecast.operators.common import checkpointed, is_small, lookup_join

PREAMBLE = "_preamble"


def _header_name(line: Column) -> Column:
    """Section that a line opens, null for any other line."""
    name = F.lit(None).cast("string")
    for section, openings in reversed(V.SECTION_HEADERS.items()):
        name = F.when(line.rlike(rf"(?i)^\s*(?:{openings})\b"), section).otherwise(name)
    return name


def section_blocks(body: Column) -> Column:
    """array<struct<section, text>>: a text cut before each header line, in order.

    The header line itself leaves only what follows its first colon. All inside the
    row, so no document is ever spread over rows and gathered again.
    """
    sep = "\x01"
    any_header = "|".join(V.SECTION_HEADERS.values())
    flat = F.concat(F.lit("\n"), F.array_join(lines(text(body)), "\n"))
    cut = F.regexp_replace(flat, rf"(?i)\n(?=[^\S\n]*(?:{any_header})\b)", sep)
    blocks = F.split(cut, sep)

    def opened(b: Column, head: Column) -> Column:
        rest = F.when(F.instr(b, "\n") > 0, F.regexp_replace(b, r"^[^\n]*\n", ""))
        return let(F.when(head.contains(":"), F.regexp_replace(head, "^[^:]*:", "")), lambda after: F.struct(
            _header_name(head).alias("section"), F.concat_ws("\n", F.when(strip(after) != "", after), rest).alias("text")))

    def block(b: Column, i: Column) -> Column:
        return (F.when(i == 0, F.struct(F.lit(PREAMBLE).alias("section"),
                                        F.regexp_replace(b, r"^\n", "").alias("text")))
                .otherwise(let(F.split_part(b, F.lit("\n"), F.lit(1)), lambda head: opened(b, head))))

    return F.transform(blocks, block)


def section_text(blocks: Column, section: str) -> Column:
    """All text of one section, trimmed; empty when there is none."""
    mine = F.filter(blocks, lambda b: b["section"] == section)
    return strip(F.array_join(F.transform(mine, lambda b: b["text"]), "\n"))


def split_sections(docs: DataFrame, body: str = "text") -> DataFrame:
    """Adds one text column per section and the preamble."""
    out = docs.withColumn("_blocks", section_blocks(F.col(body)))
    names = [*V.SECTION_HEADERS, PREAMBLE]
    return out.withColumns({n: section_text(F.col("_blocks"), n) for n in names}).drop("_blocks")


def degree(scope: Column) -> Column:
    return F.replace(F.upper(F.regexp_extract(scope, V.DEGREE, 1)), F.lit("."), F.lit(""))


def major(scope: Column) -> Column:
    pattern = (r"(?i)\b(?:in|of)\s+([A-Za-z][A-Za-z&/ ]{3,60}?(?:"
               + "|".join(V.MAJOR_FIELDS) + r"))\b")
    return squeeze(F.regexp_extract(scope, pattern, 1))


def experience_titles(scope: Column, limit: int | None = None) -> Column:
    """Job titles of a text, title case, each once; the first `limit` if given."""
    pattern = (r"(?i)\b((?:" + "|".join(V.TITLE_QUALIFIERS) + r")\s+(?:"
               + "|".join(V.TITLE_NOUNS) + r")|" + "|".join(V.TITLE_SHORT) + r")\b")
    found = F.regexp_extract_all(scope, F.lit(pattern), F.lit(0))
    return first_n(F.array_distinct(F.transform(found, lambda t: title_case(F.lower(squeeze(t))))), limit)


def person_name(preamble: Column) -> Column:
    """First line of two to four capitalised words without digits or '@'."""
    candidates = F.filter(
        F.transform(lines(text(preamble)), strip),
        lambda x: ~x.contains("@") & ~x.rlike(r"\p{Nd}")
        & x.rlike(r"^\p{Lu}\S*(?:\s+\p{Lu}\S*){1,3}$"))
    return F.coalesce(F.get(candidates, F.lit(0)), F.lit(""))


def role_terms(target_role: Column) -> Column:
    parts = F.transform(F.split(text(target_role), "[,/;]+"), lambda t: F.lower(strip(t)))
    return F.filter(parts, lambda t: t != "")


def _owned(frame: DataFrame, terms: Column) -> DataFrame:
    return frame.select("profile_id", F.explode(terms).alias("term"))


def profile_terms(profiles: DataFrame, lexicon: DataFrame, synonyms: DataFrame,
                  stopwords=V.STOPWORDS, top_n: int | None = None) -> DataFrame:
    """(profile_id, term, weight, term_rank): all weighted terms of each profile.

    `top_n` (usually `V.TOP_TERMS`) bounds the generic terms of a text, if given.
    `profiles` has profile_id, text and, when known, target_role and priority_keywords.
    """
    p = split_sections(profiles)
    if "target_role" not in p.columns:
        p = p.withColumn("target_role", F.lit(""))
    if "priority_keywords" not in p.columns:
        p = p.withColumn("priority_keywords", F.array().cast("array<string>"))
    p = checkpointed(p)  # taken apart once, read by every layer
    strong = F.concat_ws("\n", "skills", "projects")
    active = p.select("profile_id",
                      F.concat_ws("\n", "skills", "projects", "experience").alias("text"))
    lex_small, syn_small = is_small(lexicon), is_small(synonyms)
    hits = checkpointed(T.term_hits(p, lexicon, "profile_id", {
        "in_text": F.col("text"), "in_strong": strong}, small=lex_small))
    found = hits.where("in_text").select("profile_id", "term")
    in_sections = hits.where("in_strong").select("profile_id", "term")
    # A document's words rank by first use; the layers below keep only their weights.
    generic_active = T.top_terms(active, "profile_id", "text", top_n, stopwords)
    generic_all = T.top_terms(p, "profile_id", "text", top_n, stopwords)
    roles = _owned(p, role_terms(F.col("target_role")))
    pinned = (_owned(p, F.transform("priority_keywords", lambda k: F.lower(strip(k))))
              .where("term <> ''"))

    def near(owned, weight):
        return (lookup_join(owned.withColumnRenamed("term", "src"), synonyms, ["src"], "inner",
                            small=syn_small)
                .select("profile_id", F.col("dst").alias("term"), F.lit(weight).alias("weight")))

    return T.merge_weights([
        T.expand_synonyms(found, synonyms, lexicon, small=lex_small and syn_small),
        in_sections.withColumn("weight", F.lit(V.WEIGHT_SECTION)),
        generic_active.withColumn("weight", F.round(F.lit(0.6) + F.lit(0.6) * F.col("weight"), 6)),
        generic_all,
        roles.withColumn("weight", F.lit(V.WEIGHT_ROLE)), near(roles, V.WEIGHT_ROLE_SYNONYM),
        pinned.withColumn("weight", F.lit(V.WEIGHT_PRIORITY)),
        near(pinned, V.WEIGHT_PRIORITY_SYNONYM),
    ])


def parse_profiles(profiles: DataFrame, lexicon: DataFrame) -> DataFrame:
    """One row per profile: name, degree, major, titles, term lists and a summary text."""
    p = split_sections(profiles)
    if "target_role" not in p.columns:
        p = p.withColumn("target_role", F.lit(""))
    scope = first_filled(F.col("education"), F.col("text"))
    facts = p.select(
        "profile_id", strip(text(F.col("target_role"))).alias("target_role"),
        person_name(F.col(PREAMBLE)).alias("name"), degree(scope).alias("degree"),
        major(scope).alias("major"),
        experience_titles(first_filled(F.col("experience"), F.col("text"))).alias("experience_titles"))
    small = is_small(lexicon)
    hits = T.term_hits(p, lexicon, "profile_id", {
        "in_text": F.col("text"), "in_coursework": F.col("coursework"),
        "in_projects": F.col("projects")}, small=small)
    is_tool = lexicon.select(normalize_term(F.col("term")).alias("term"), "is_tool").distinct()
    tagged = lookup_join(hits, is_tool, ["term"], "left", small=small)
    longest_first = F.struct((-F.length("term")).alias("l"), "term")

    def listed(flag, item=F.col("term")):
        return F.array_sort(F.collect_list(F.when(flag, item)))

    # The lists are as long as the lexicon terms found in one profile.
    lists = tagged.groupBy("profile_id").agg(
        listed(F.col("in_text")).alias("skills"),
        listed(F.col("in_text") & F.col("is_tool")).alias("tools_languages"),
        *[F.transform(listed(F.col(f"in_{part}"), longest_first), lambda x: x["term"]).alias(part)
          for part in ("coursework", "projects")])
    out = facts.join(lists, "profile_id", "left")
    empty = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(F.col(c), empty) for c in
                           ("skills", "tools_languages", "coursework", "projects")})
    return out.withColumn("summary", profile_summary())


def profile_summary(shown: dict[str, int] | None = None) -> Column:
    """Summary text over the columns of `parse_profiles`; `shown` (usually `V.SUMMARY_SHOWN`)
    bounds its lists."""
    shown = shown or {}

    def listed(label, c, part):
        return F.when(F.size(c) > 0, F.concat(F.lit(f"{label}: "), F.array_join(
            first_n(c, shown.get(part)), ", "), F.lit(".")))

    who = strip(F.concat_ws(" ", F.nullif("degree", F.lit("")), F.nullif("major", F.lit(""))))
    other = F.array_except("skills", "tools_languages")
    return F.concat_ws(
        " ",
        F.when(who != "", F.concat(F.lit("Candidate pursuing "), who, F.lit("."))),
        F.when(F.col("target_role") != "",
               F.concat(F.lit("Target roles: "), F.col("target_role"), F.lit("."))),
        listed("Tools/languages", F.col("tools_languages"), "tools"),
        listed("Skills/concepts", other, "skills"),
        listed("Coursework", F.col("coursework"), "coursework"),
        listed("Prior roles", F.col("experience_titles"), "titles"))
