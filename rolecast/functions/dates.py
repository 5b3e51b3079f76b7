"""Date expressions. `as_of` is always given; nothing reads the clock."""

from datetime import date

from pyspark.sql import Column, functions as F

from rolecast.functions.text import let, strip, strip_markdown, text

# Month names by their first three letters.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
_DAY = r"([0-9]{1,2})(?:st|nd|rd|th)?"
_MONTH_DAY = rf"(?i)\b{_MONTH}\.?\s+{_DAY}\b(?:,?\s+([0-9]{{4}}))?"
_DAY_MONTH = rf"(?i)\b{_DAY}\s+{_MONTH}\b\.?,?(?:\s+([0-9]{{4}}))?"
_ISO = r"\b([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})(?![0-9])"
_SHORT = r"\b([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{2})\b(?![/.-]?[0-9])"
_YEAR_MONTH = r"\b([0-9]{4})[-/]([0-9]{1,2})\b(?![-/.0-9])"
_MONTH_YEAR = rf"(?i)\b{_MONTH}\.?,?\s+([0-9]{{4}})\b"
_SLASH = r"\b([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4})\b"

_RELATIVE = (r"(?i)\b(?:posted|updated)?\s*"
             r"(?:([0-9]+)\+?\s*(day|week|month|hour)s?\s*ago|(today|just posted|yesterday))")
_LOOSE_AGE = r"([0-9]+|a|an)\s+(day|week|month|year)s?"
_COMPACT_AGE = (r"(?i)^([0-9]+)\s*(h|hr|hrs|d|day|days|w|wk|wks|mo|mos|month|months|y|yr)$")
_LAST_SECOND = 253402300799  # end of the year 9999
_MOST_DAYS = 719162 + 1000 * 365   # back to before the year 1, where dates end


def day(c) -> Column:
    """A date literal or column."""
    if isinstance(c, (str, date)):
        return F.lit(c).cast("date")
    return c


def _group(c: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))


def _ymd(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def _month_number(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(name)).cast("string")


def free_text_date(c: Column, as_of=None) -> Column:
    """First date written in a text, in these forms: 2026-06-01 (also / and .),
    06/01/2026 and 06/01/26 (month first, day first when the first part is over 12), June 1
    2026, 1 June 2026, June 2026 and 2026-06. Without a year the year of `as_of` counts, or
    none without `as_of`; without a day its day, or the first. Two digits of a year mean the
    one less than 50 years ahead.
    """
    this_year = F.lit(None).cast("string") if as_of is None else F.year(day(as_of)).cast("string")

    def named(pattern, month, dom):
        found = _group(c, pattern, month)
        year = F.coalesce(_group(c, pattern, 3), this_year)
        return F.when(found.isNotNull() & year.isNotNull(),
                      _ymd(year, _month_number(F.lower(found)), _group(c, pattern, dom)))

    a, b = _group(c, _SLASH, 1), _group(c, _SLASH, 2)
    slash = F.when(a.try_cast("int") > 12, _ymd(_group(c, _SLASH, 3), b, a)).otherwise(
        _ymd(_group(c, _SLASH, 3), a, b))
    iso = _ymd(_group(c, _ISO, 1), _group(c, _ISO, 2), _group(c, _ISO, 3))
    a, b, y = (_group(c, _SHORT, i) for i in (1, 2, 3))
    full = F.lit(2000) + y.try_cast("int")
    ahead = F.coalesce(this_year.cast("int"), F.lit(2000)) + 49
    full = F.when(full > ahead, full - 100).otherwise(full).cast("string")
    first_over = a.try_cast("int") > 12
    short = _ymd(full, F.when(first_over, b).otherwise(a), F.when(first_over, a).otherwise(b))

    def month_of(year, month):
        first = _ymd(year, month, F.lit("1"))
        if as_of is None:
            return first
        return F.least(F.date_add(first, F.dayofmonth(day(as_of)) - 1), F.last_day(first))

    return F.coalesce(
        F.when(c.rlike(_ISO), iso), F.when(_group(c, _SLASH, 1).isNotNull(), slash), F.when(a.isNotNull(), short),
        named(_MONTH_DAY, 1, 2), named(_DAY_MONTH, 2, 1),
        month_of(_group(c, _MONTH_YEAR, 2), _month_number(_group(c, _MONTH_YEAR, 1))),
        month_of(_group(c, _YEAR_MONTH, 1), _group(c, _YEAR_MONTH, 2)))


def epoch_date(c: Column) -> Column:
    """Date of an epoch in seconds, or in milliseconds above 10^11."""
    seconds = F.when(c > 100000000000, F.floor(c / 1000)).otherwise(c).try_cast("bigint")
    return F.when(F.abs(seconds) <= _LAST_SECOND, F.timestamp_seconds(seconds).cast("date"))


def parse_date_loose(c: Column, as_of=None) -> Column:
    """Date of a string: yyyyMMdd, also before a time, an epoch with or without fraction, or
    free text; null when none is found."""
    def parse(s: Column) -> Column:
        compact = F.when(s.rlike("^(19|20)[0-9]{6}([T ][0-9]{2}:?[0-9]{2}.*)?$"),
                         F.try_to_date(F.substring(s, 1, 8), "yyyyMMdd"))
        whole = F.split_part(s, F.lit("."), F.lit(1))
        return (F.when(s.rlike(r"^[0-9]+$|^[0-9]{7,}\.[0-9]+$"), F.coalesce(compact, epoch_date(whole.try_cast("bigint"))))
                .otherwise(F.coalesce(compact, free_text_date(s, as_of))))

    return let(strip(text(c.cast("string"))), parse)


def _days_back(as_of, n: Column, unit_days: Column) -> Column:
    n = n.try_cast("int")
    return F.when(n.cast("bigint") * unit_days <= _MOST_DAYS, F.date_sub(day(as_of), (n * unit_days).cast("int")))


def relative_phrase(c: Column) -> Column:
    return strip(F.regexp_extract(text(c), _RELATIVE, 0))


def parse_relative_date(c: Column, as_of) -> Column:
    """Date of "5 days ago", "today", "just posted", "yesterday" anywhere in a text."""
    s = text(c)
    word = F.lower(F.regexp_extract(s, _RELATIVE, 3))
    unit = F.lower(F.regexp_extract(s, _RELATIVE, 2))
    days = (F.when(unit == "hour", 0).when(unit == "day", 1).when(unit == "week", 7)
            .when(unit == "month", 30))
    return (F.when(word == "yesterday", F.date_sub(day(as_of), 1))
            .when(word != "", day(as_of))
            .otherwise(_days_back(as_of, F.regexp_extract(s, _RELATIVE, 1), days)))


def parse_loose_age(c: Column, as_of) -> Column:
    """Date of an age with or without "ago": "about a month", "2 years"."""
    s = F.lower(strip(text(c)))
    amount = F.regexp_extract(s, _LOOSE_AGE, 1)
    n = F.when(amount.isin("a", "an"), F.lit("1")).otherwise(amount)
    unit = F.regexp_extract(s, _LOOSE_AGE, 2)
    days = (F.when(unit == "day", 1).when(unit == "week", 7).when(unit == "month", 30)
            .when(unit == "year", 365))
    return (F.when(s.isin("today", "just posted"), day(as_of))
            .when(s == "yesterday", F.date_sub(day(as_of), 1))
            .otherwise(_days_back(as_of, n, days)))


def parse_compact_age(c: Column, as_of) -> Column:
    """Date of "3d", "2w", "1mo", "5h", "1y"."""
    unit = F.lower(F.regexp_extract(c, _COMPACT_AGE, 2))
    days = (F.when(unit.startswith("h"), 0).when(unit.startswith("d"), 1)
            .when(unit.startswith("w"), 7).when(unit.startswith("y"), 365)
            .when(unit.startswith("m"), 30))
    return _days_back(as_of, F.regexp_extract(c, _COMPACT_AGE, 1), days)


def parse_explicit_date(c: Column, as_of) -> Column:
    """Date of free text; a date without year more than 7 days ahead is last year's."""
    s = text(c)
    found = free_text_date(s, as_of)
    ahead = (found > F.date_add(day(as_of), 7)) & ~s.rlike(r"\b(19|20)[0-9]{2}\b")
    return F.when(ahead, F.add_months(found, -12)).otherwise(found)


def list_date(cell: Column, as_of) -> Column:
    """Struct (posted_date, date_confidence, date_source) of a curated-list cell."""
    def label(d: Column) -> Column:
        aged, written = d["age"].isNotNull(), d["written"].isNotNull()
        return F.struct(
            F.coalesce(d["age"], d["written"]).alias("posted_date"),
            F.when(~aged & written, "verified").otherwise("approximate").alias("date_confidence"),
            F.when(aged, "curated list age").when(written, "curated list date column")
            .otherwise("").alias("date_source"))

    def read(s: Column) -> Column:
        age = F.coalesce(parse_compact_age(s, as_of), parse_relative_date(s, as_of))
        return F.struct(age.alias("age"), parse_explicit_date(s, as_of).alias("written"))

    return let(let(strip_markdown(cell), read), label)


def iso_prefix_date(c: Column) -> Column:
    """Date of the first ten characters, null when they are none."""
    return F.try_to_date(F.substring(text(c), 1, 10), "yyyy-MM-dd")


def deadline_display(deadline: Column, rolling: Column) -> Column:
    return F.when(F.coalesce(rolling, F.lit(False)), F.lit("rolling")).otherwise(
        F.coalesce(deadline.cast("string"), F.lit("—")))


def posted_display(posted: Column) -> Column:
    return F.coalesce(posted.cast("string"), F.lit("—"))
