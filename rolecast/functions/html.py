"""HTML to plain text, in JVM expressions only."""

import json
from html.entities import html5

from pyspark.sql import Column, functions as F

from rolecast.functions.text import let, strip, text

BREAK = "\x01"

_REFERENCE = r"^(#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[^\t\n\f <&#;]{1,32};?)"
# The names of the standard, by their first letter; a map is searched from its start.
_NAMES: dict[str, dict[str, str]] = {}
for _name, _chars in html5.items():
    _NAMES.setdefault(_name[0], {})[_name] = _chars
# Names that also count without a semicolon, before whatever follows.
_BARE = "^(" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)) + ")"
# Numbers of the range 128 to 159 mean the characters of Windows-1252, where it has one.
_WINDOWS = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160))


def _char(code: Column) -> Column:
    """The character of a number: none for controls, U+FFFD for what is no character."""
    none = (code.between(1, 8) | code.between(14, 31) | (code == 11) | (code == 127)
            | code.between(0xFDD0, 0xFDEF) | code.bitwiseAND(0xFFFE).eqNullSafe(F.lit(0xFFFE)))
    bad = code.isNull() | (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    return (F.when(bad, "\ufffd")
            .when(code.between(128, 159), F.substr(F.lit(_WINDOWS), code - 127, F.lit(1)))
            .when(none, "").otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))


def unescape(c: Column) -> Column:
    """Decode character references once, as HTML 5 has them: names with and, for the old ones,
    without semicolon, the longest name first, and numbers of any length.

    The text is cut at every '&', each piece decoded alone, so the work is linear.
    """
    names = F.from_json(F.lit(json.dumps(_NAMES)), "map<string,map<string,string>>")

    def decode(piece: Column, ref: Column) -> Column:
        digits = F.regexp_replace(F.rtrim(ref, F.lit(";")), "^#[xX]?0*", "")
        small = F.length(digits) <= 7  # longer numbers are no character
        number = F.when(small & ref.rlike("^#[xX]"), F.conv(digits, 16, 10)).when(small, digits)
        number = F.when(small & (digits == ""), F.lit(0)).otherwise(number.try_cast("int"))
        bare = F.regexp_extract(ref, _BARE, 1)
        known = lambda name: F.element_at(F.element_at(names, F.substring(name, 1, 1)), name)
        rest = F.substr(piece, F.length(ref) + 1)
        named = F.coalesce(F.concat(known(ref), rest), F.when(
            bare != "", F.concat(known(bare), F.substr(piece, F.length(bare) + 1))))
        return F.coalesce(F.when(ref.startswith("#"), F.concat(let(number, _char), rest))
                          .when(ref != "", named), F.concat(F.lit("&"), piece))

    def pieces(whole: Column) -> Column:
        cut = F.transform(F.split(whole, "&"), lambda p, i: F.when(i == 0, p).otherwise(
            let(F.regexp_extract(p, _REFERENCE, 0), lambda ref: decode(p, ref))))
        return F.when(whole.contains("&"), F.array_join(cut, "")).otherwise(whole)

    return let(c, pieces)


def html_to_text(c: Column) -> Column:
    """Text of an HTML fragment that may be escaped once on top.

    Scripts, styles and comments go; each run of tags is one line break, at most one
    empty line stays between lines.
    """
    out = unescape(text(c))
    out = F.regexp_replace(out, r"(?is)<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)", BREAK)
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", BREAK)
    out = F.regexp_replace(out, r"""<[A-Za-z/!?](?:[^>"']++|"[^"]*+"|'[^']*+')*+>""", BREAK)
    out = F.regexp_replace(out, f"{BREAK}+", "\n")
    return strip(F.regexp_replace(unescape(out), r"\n{3,}", "\n\n"))


def escape(c: Column) -> Column:
    """Escape text for HTML; null becomes the empty string."""
    out = text(c.cast("string"))
    for sign, ref in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]:
        out = F.replace(out, F.lit(sign), F.lit(ref))
    return out
