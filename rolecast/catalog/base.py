"""Registry, table loaders and SQL fragments shared by the registered queries."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rolecast import values as V

QUERIES, ORACLE = {}, {}
AS_OF = "1998-06-15"
SEEN_AS_OF = "2024-01-31"
NL = "chr(10)"


def query(name: str, sql: str | None = None):
    """Registers a query under a name, with its SQL."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A text table, spread over the cores when it is a few unsplittable files.

    A table of many files has enough splits and is left as it lies.
    """
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def epoch_us(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def joined(c) -> Column:
    return F.array_join(c, "|")


# ---- SQL fragments ---------------------------------------------------------

def quoted(items) -> str:
    return ", ".join("'" + i.replace("'", "''") + "'" for i in items)


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"


def location_sql(x: str) -> str:
    return (f"array_to_string([w for w in string_split({norm_sql(x)}, ' ') "
            f"if w not in ({quoted(V.LOCATION_NOISE)})], ' ')")


def key_sql(company: str, title: str, location: str) -> str:
    return f"{norm_sql(company)} || '|' || {norm_sql(title)} || '|' || {location_sql(location)}"


def title_sql(x: str) -> str:
    return f"split_part({x}, {NL}, 1)"


def body_sql(x: str) -> str:
    return f"CASE WHEN instr({x}, {NL}) > 0 THEN substr({x}, instr({x}, {NL}) + 1) ELSE '' END"


def title_of(c: Column) -> Column:
    return F.split_part(c, F.lit("\n"), F.lit(1))


def body_of(c: Column) -> Column:
    at = F.instr(c, "\n")
    return F.when(at > 0, F.substr(c, at + 1)).otherwise("")


def counts_ctes(name: str, src: str, owner: str, body: str) -> str:
    """CTEs ending in <name>_n(owner, term, n, first_pos)."""
    return f"""
{name}_l AS (SELECT {owner}, unnest(string_split({body}, {NL})) AS line,
             generate_subscripts(string_split({body}, {NL}), 1) AS ln FROM {src}),
{name}_t AS (SELECT {owner}, ln, [x for x in
             [trim(w, '.-/&') for w in regexp_extract_all(lower(line), '[a-z][a-z+#.&/-]{{1,29}}')]
             if length(x) >= 3 and x not in ({quoted(V.STOPWORDS)})] AS w FROM {name}_l),
{name}_g AS (
  SELECT {owner}, unnest(w) AS term,
         ln * 4294967296 + generate_subscripts(w, 1) AS pos FROM {name}_t
  UNION ALL
  SELECT {owner}, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS term,
         ln * 4294967296 + 2147483648 + unnest(range(1, len(w))) AS pos FROM {name}_t),
{name}_n AS (SELECT {owner}, term, count(*) AS n, min(pos) AS first_pos
             FROM {name}_g GROUP BY ALL)"""


def top_ctes(name: str, src: str, owner: str, body: str, k: int) -> str:
    """CTEs ending in <name>(owner, term, n, weight, term_rank)."""
    return counts_ctes(name, src, owner, body) + f""",
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY {owner} ORDER BY
             n + CASE WHEN contains(term, ' ') THEN 0.5 ELSE 0 END DESC, first_pos) AS term_rank
             FROM {name}_n),
{name} AS (SELECT {owner}, term, n, round(least(0.45 + 0.12 * least(n, 4)
             + CASE WHEN contains(term, ' ') THEN 0.12 ELSE 0 END, 0.95)::DOUBLE, 3) AS weight,
             term_rank FROM {name}_r WHERE term_rank <= {k})"""


def present_sql(term: str, text: str) -> str:
    """Does a lower-case term stand in a lower-case text, by the boundary regex?"""
    return (f"(contains({text}, {term}) AND regexp_matches({text}, "
            f"'(^|[^a-z0-9+#])' || regexp_escape({term}) || '($|[^a-z0-9+#])'))")


SEED_LEXICON = list(dict.fromkeys(V.TOOLS + V.LEXICON + [s for s, _ in V.SYNONYMS]))
SEED_SQL = (
    "seed_lex(term, is_tool) AS (VALUES "
    + ", ".join(f"('{t}', {str(t in V.TOOLS).lower()})" for t in SEED_LEXICON) + "),\n"
    "seed_syn(src, dst) AS (SELECT DISTINCT * FROM (VALUES "
    + ", ".join(f"('{a}', '{b}'), ('{b}', '{a}')" for a, b in V.SYNONYMS) + ") WHERE col0 <> col1)")


def sections_cte(name: str, src: str, owner: str, body: str) -> str:
    """CTE <name>(owner, section, text): the text of each section, one row per section."""
    case = " ".join(f"WHEN regexp_matches(line, '(?i)^\\s*({p})\\b') THEN '{s}'"
                    for s, p in V.SECTION_HEADERS.items())
    return f"""
{name}_l AS (SELECT {owner}, unnest(string_split({body}, {NL})) AS line,
             generate_subscripts(string_split({body}, {NL}), 1) AS ln FROM {src}),
{name}_h AS (SELECT *, CASE {case} END AS head FROM {name}_l),
{name}_s AS (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY {owner}
             ORDER BY ln), '_preamble') AS section FROM {name}_h),
{name}_k AS (SELECT {owner}, section, ln, CASE WHEN head IS NULL THEN line
             WHEN contains(line, ':') AND trim(substr(line, instr(line, ':') + 1)) <> ''
             THEN substr(line, instr(line, ':') + 1) END AS line FROM {name}_s),
{name} AS (SELECT {owner}, section, regexp_replace(string_agg(line, {NL} ORDER BY ln),
             '^\\s+|\\s+$', '', 'g') AS text FROM {name}_k WHERE line IS NOT NULL GROUP BY ALL)"""


def with_headers(c: Column) -> Column:
    """A document as a profile: some line openings become section headers."""
    for word, header in HEADERS.items():
        c = F.regexp_replace(c, rf"(?m)^{word} ", f"{header} ")
    return c


def with_headers_sql(x: str) -> str:
    for word, header in HEADERS.items():
        x = f"regexp_replace({x}, '(?m)^{word} ', '{header} ', 'g')"
    return x


HEADERS = {"The": "Skills:", "And": "EXPERIENCE\n", "Of": "Projects:", "In": "Education:",
           "De": "Technical Skills:", "La": "Employment:", "Der": "Coursework:"}


def profile_terms_ctes(name: str, src: str, owner: str, body: str) -> str:
    """CTEs ending in <name>(owner, term, weight, term_rank) with the seed vocabulary."""
    return f"""{SEED_SQL},
{sections_cte(f"{name}_sec", src, owner, body)},
{name}_str AS (SELECT p.{owner}, coalesce(a.text, '') || {NL} || coalesce(b.text, '') AS text
  FROM {src} p LEFT JOIN {name}_sec a ON a.{owner} = p.{owner} AND a.section = 'skills'
  LEFT JOIN {name}_sec b ON b.{owner} = p.{owner} AND b.section = 'projects'),
{name}_act AS (SELECT p.{owner}, p.text || {NL} || coalesce(c.text, '') AS text
  FROM {name}_str p LEFT JOIN {name}_sec c ON c.{owner} = p.{owner} AND c.section = 'experience'),
{top_ctes(f"{name}_ga", f"{name}_act", owner, "text", 40)},
{top_ctes(f"{name}_gt", src, owner, body, 40)},
{name}_found AS (SELECT {owner}, term FROM {src}, seed_lex
  WHERE {present_sql("term", f"lower({body})")}),
{name}_base AS (SELECT {owner}, term, 1.0 AS b FROM {name}_found UNION ALL
  SELECT {owner}, dst, 0.6 FROM {name}_found JOIN seed_syn ON src = term),
{name}_all AS (
  SELECT {owner}, b.term, round(max(b) * max(CASE WHEN coalesce(is_tool, false)
    THEN 1.3 ELSE 1.0 END), 6)::DOUBLE AS weight
  FROM {name}_base b LEFT JOIN seed_lex l ON l.term = b.term GROUP BY ALL
  UNION ALL SELECT {owner}, term, 1.4 FROM {name}_str, seed_lex
    WHERE {present_sql("term", "lower(text)")}
  UNION ALL SELECT {owner}, term, round(0.6::DOUBLE + 0.6::DOUBLE * weight, 6) FROM {name}_ga
  UNION ALL SELECT {owner}, term, weight FROM {name}_gt),
{name}_max AS (SELECT {owner}, term, max(weight) AS weight FROM {name}_all GROUP BY ALL),
{name} AS (SELECT *, row_number() OVER (PARTITION BY {owner} ORDER BY weight DESC, term)
  AS term_rank FROM {name}_max)"""
