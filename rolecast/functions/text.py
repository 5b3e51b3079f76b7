"""Text expressions: normalisers, keys, tokens and boundary marks."""

import re
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, functions as F

from rolecast import values as V

# Whitespace as Unicode sees it; Java's \s is ASCII only.
WS = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
TOKEN = r"[a-z][a-z+#.&/-]{1,29}"

# Word characters of term matching: a term counts only where none of them adjoins it.
EDGE_CLASS = "a-z0-9+#"
EDGE = "\x01"


def let(c: Column, body) -> Column:
    """body(c) with c computed once; a plain expression repeats c wherever it is used
    inside branches and lambdas."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def text(c: Column) -> Column:
    """Null counts as the empty string."""
    return F.coalesce(c, F.lit(""))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_filled(*cols: Column) -> Column:
    """First column that is neither null nor empty, else the empty string."""
    return F.coalesce(*[blank_to_null(c) for c in cols], F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{WS}+", " "))


def normalize_term(c: Column) -> Column:
    return F.lower(squeeze(text(c)))


def norm_token(c: Column) -> Column:
    """Lower case, every run of other than [a-z0-9] one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", " "))


def norm_location(c: Column) -> Column:
    """`norm_token` without noise words; repeated words stay."""
    words = F.split(norm_token(c), " ")
    kept = F.filter(words, lambda w: ~w.isin(V.LOCATION_NOISE))
    return F.array_join(kept, " ")


def dedup_key(company: Column, title: Column, location: Column) -> Column:
    return F.concat_ws("|", norm_token(company), norm_token(title), norm_location(location))


def title_case(c: Column) -> Column:
    """Capitalise every run of letters, also after digits and punctuation."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def slug_to_name(c: Column) -> Column:
    return title_case(strip(F.regexp_replace(text(c), "[-_]+", " ")))


def source_head(source: Column) -> Column:
    return F.split_part(text(source), F.lit(":"), F.lit(1))


def lines(c: Column) -> Column:
    return F.split(c, LINE_BREAK)


def mark(c: Column) -> Column:
    """Lower-case text with an EDGE on both sides of every word.

    A term that starts and ends with a word character then stands in a text just where
    its marked form is a plain substring, which is far cheaper than the boundary regex.
    """
    return F.regexp_replace(F.lower(text(c)), f"([{EDGE_CLASS}]+)", f"{EDGE}$1{EDGE}")


def sign_pattern(term: Column) -> Column:
    """Regex on marked text for a term that starts or ends with another sign, else null.

    Next to such a sign an EDGE means that a word adjoins.
    """
    low = F.lower(term)
    first, last = low.rlike(f"^[{EDGE_CLASS}]"), low.rlike(f"[{EDGE_CLASS}]$")
    quoted = F.concat(F.lit(r"\Q"), F.replace(mark(term), F.lit(r"\E"), F.lit(r"\E\\E\Q")),
                      F.lit(r"\E"))
    return F.when(~(first & last), F.concat(
        F.when(first, "").otherwise(f"(?<!{EDGE})"), quoted,
        F.when(last, "").otherwise(f"(?!{EDGE})")))


def stands_in(marked_text: Column, marked_term: Column, pattern: Column) -> Column:
    """Does a term stand in a text? Both are marked; `pattern` is its `sign_pattern`."""
    return F.when(pattern.isNull(), marked_text.contains(marked_term)).otherwise(
        F.rlike(marked_text, pattern))


# The anchors of a text: words, pairs and other signs. Read by Python, too.
WORD = f"[{EDGE_CLASS}]+"
SIGN = rf"[^{EDGE_CLASS} \t\n\x0b\f\r]"
# Two neighbouring words and what stands between them, caught at the start of the first.
PAIR = f"(?<![{EDGE_CLASS}])(?=({WORD}[^{EDGE_CLASS}]{{1,64}}{WORD}))"


_WORDS, _PAIRS, _SIGNS = re.compile(WORD), re.compile(PAIR), re.compile(SIGN)


def anchors(c: Column, among: bytes | None = None) -> Column:
    """Distinct words, neighbouring word pairs and other signs of a text; of a `terms.sketch` only those
    whose bit is set.

    Every term in the text has its own `term_anchor` among them. Found by a small Python helper over
    Arrow batches, as Spark interprets each step of a list; lower case is Spark's own.
    """
    bits = 8 * len(among or b"")

    def found(low: str) -> list[str]:
        all_ = {*_WORDS.findall(low), *_PAIRS.findall(low), *_SIGNS.findall(low)}
        if among is None:
            return [*all_]
        return [x for x in all_ if among[(h := crc32(x.encode()) % bits) >> 3] >> (h & 7) & 1]

    def run(cells: pa.Array) -> pa.Array:
        return pa.array([found(x.as_py()) for x in cells], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(F.lower(text(c)))


def term_anchor(term: Column) -> Column:
    """The longest word pair of a term, else its longest word, else its first sign."""
    low = F.lower(term)

    def longest(found: Column) -> Column:
        return F.reduce(found, F.lit(""),
                        lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))

    pair = longest(F.regexp_extract_all(low, F.lit(PAIR), F.lit(1)))
    word = longest(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)))
    return first_filled(pair, word, F.regexp_extract(low, rf"[^{EDGE_CLASS}\s]", 0))


def is_anchor(term: Column) -> Column:
    """Is the term one word or one pair, so that its anchor in a text proves it?"""
    return F.lower(term).rlike(f"^{WORD}([^{EDGE_CLASS}]{{1,64}}{WORD})?$")


def strip_markdown(c: Column) -> Column:
    """Links and images become their text; tags, bold and code signs go."""
    out = F.regexp_replace(text(c), r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    return squeeze(F.regexp_replace(out, r"[*`]", ""))


def clean_location(c: Column) -> Column:
    return strip_markdown(F.regexp_replace(text(c), r"(?i)<br\s*/?>", "; "))


def url_path(url: Column) -> Column:
    return F.regexp_extract(
        text(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def safe_int(c: Column) -> Column:
    return strip(c.cast("string")).try_cast("int")


def batch_year(c: Column) -> Column:
    return F.regexp_extract(text(c), r"(20[0-9]{2})", 1).try_cast("int")


def first_n(items: Column, n: int | None) -> Column:
    """The first n of a list; all without n."""
    return items if n is None else F.slice(items, 1, n)


def shortened(c: Column, chars: int | None) -> Column:
    """The first characters of a text; all without a number."""
    return c if chars is None else F.substring(c, 1, chars)
