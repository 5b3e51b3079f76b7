"""Personal data: anchors found by an Aho-Corasick automaton, spans grown from them by local parsers.

One automaton pass over each text finds at-signs, plus signs before a digit, digits, the `://` of
schemes and identifier cues (words such as "iban" or "passport"). At each anchor a parser looks at
the characters around it, finds the span's boundaries and validates what is between:

- email: from an at-sign to the left over the local part, to the right over the host's labels;
- ip: four groups of digits with dots, each at most 255;
- card: 12 to 19 digits with single spaces or hyphens between, with a valid Luhn sum;
- phone: a plus sign and 9 to 15 digits with spaces, brackets, dots and hyphens between;
- login (added by the cues): `scheme://user[:password]@host`;
- iban (added): an account number after the cue "iban", valid modulo 97;
- account (added): after any other cue, an identifier of 6 to 34 letters and digits with at
  least 6 digits.

The first four are the spans that a leftmost search finds per kind, without overlaps; a match
that fails its check is passed over whole. Spans of different kinds may overlap. Places are code
points, ends exclusive. Every text is read once, by itself, whatever its length, and no shuffle is
needed. Null and empty texts hold nothing; repeated rows and null ids give rows like any other.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rolecast.llm.common import table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "account")
CUES = ("iban", "account", "acct", "passport", "ssn", "social security", "member id", "customer id", "tax id", "national id")
SPANS = "spans array<struct<kind:string,start:long,end:long>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

_LOCAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(rb"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(rb"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_SCHEME = re.compile(rb"[A-Za-z][A-Za-z0-9+.-]*$")
_LOGIN = re.compile(rb"[^\x00-\x20/@:]++(?::[^\x00-\x20/@]*+)?@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?::[0-9]++)?")
_AFTER = re.compile(rb"(?:[ \t]*(?:number|no\.?|nr\.?|id|code))?[ \t]*[:#=]?[ \t]*", re.I)
_IBAN = re.compile(rb"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}+(?![A-Za-z0-9])")
_NUMBER = re.compile(rb"[A-Za-z]{0,3}+[0-9](?:-?[A-Za-z0-9])*+")
_LETTER = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
_SCHEME_BYTES = 32


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    anchors = {"@": "at", "://": "scheme"} | {str(d): "digit" for d in range(10)} | {f"+{d}": "plus" for d in range(10)}
    for text, kind in (anchors | {cue: cue for cue in CUES}).items():
        found.add_word(text, (kind, len(text)))
    found.make_automaton()
    return found


def _digits(data: bytes) -> bytes:
    return bytes(c for c in data if 48 <= c <= 57)


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = (c - 48) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid_iban(text: bytes) -> bool:
    plain = text.replace(b" ", b"").upper().decode()
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _emails(data: bytes, places: list[int]):
    end = 0
    for at in places:
        before = data[end:at]
        start = at - (len(before) - len(before.rstrip(_LOCAL)))
        host = _HOST.match(data, at + 1) if start < at else None
        if host:
            yield start, host.end()
        end = host.end() if host else at + 1


def _runs(pattern: re.Pattern, data: bytes, places: list[int], valid):
    """Matches at the first free place each, kept if valid, passed over whole if not."""
    end = 0
    for at in places:
        if at < end:
            continue
        match = pattern.match(data, at)
        if match:
            end = match.end()
            if valid(match.group()):
                yield at, end


def _is_ip(text: bytes) -> bool:
    parts = [p.lstrip(b"0") for p in text.split(b".")]
    return all(len(p) <= 3 and int(p or b"0") <= 255 for p in parts)


def _is_card(text: bytes) -> bool:
    digits = _digits(text)
    return 12 <= len(digits) <= 19 and luhn(digits)


def _is_phone(text: bytes) -> bool:
    return 9 <= len(_digits(text)) <= 15


def _logins(data: bytes, places: list[int]):
    for at in places:
        scheme, rest = _SCHEME.search(data[max(0, at - _SCHEME_BYTES):at]), _LOGIN.match(data, at + 3)
        if scheme and rest:
            yield at - len(scheme.group()), rest.end()


def _accounts(data: bytes, cue: str, places: list[int]):
    """(kind, start, end) of the identifier after each cue that is a word by itself."""
    for at in places:
        end = at + len(cue)
        if (at and data[at - 1] in _LETTER) or (end < len(data) and data[end] in _LETTER):
            continue
        start = _AFTER.match(data, end).end()
        match = (_IBAN if cue == "iban" else _NUMBER).match(data, start)
        if not match:
            continue
        if cue == "iban":
            if valid_iban(match.group()):
                yield "iban", start, match.end()
        elif 6 <= len(match.group().replace(b"-", b"")) <= 34 and len(_digits(match.group())) >= 6:
            yield "account", start, match.end()


def spans_of(data: bytes, automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind."""
    places: dict[str, list[int]] = {}
    # One character a byte, so that places are bytes; only A-Z are lowered.
    for last, (kind, size) in automaton.iter(data.lower().decode("latin-1")):
        places.setdefault(kind, []).append(last + 1 - size)
    if not places:
        return []
    digits = places.get("digit", [])
    # Matches of digits start where a run of digits does: all of them take runs whole.
    starts = [p for p, q in zip(digits, [-2, *digits]) if p != q + 1]
    found = [("email", *s) for s in _emails(data, places.get("at", []))]
    found += [("ip", *s) for s in _runs(_IP, data, starts, _is_ip)]
    found += [("card", *s) for s in _runs(_CARD, data, starts, _is_card)]
    found += [("phone", *s) for s in _runs(_PHONE, data, places.get("plus", []), _is_phone)]
    found += [("login", *s) for s in _logins(data, places.get("scheme", []))]
    found += {a for cue in CUES for a in _accounts(data, cue, places.get(cue, []))}
    if found and not data.isascii():
        lead = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        before = np.concatenate(([0], lead))
        found = [(k, int(before[a]), int(before[b])) for k, a, b in found]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, end = [], 0
    for kind, a, b in spans:
        if a >= end:
            out += [text[end:a], f"[{kind}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def _find(schema: pa.Schema, with_text: bool):
    def run(batches):
        automaton = _automaton()
        for batch in batches:
            found, texts = [], []
            for data in batch.column(0).to_pylist():
                found.append(spans_of(data or b"", automaton))
                if with_text:
                    texts.append(None if data is None else _masked(data.decode(), found[-1]) if found[-1] else data.decode())
            spans = pa.array([[dict(zip(("kind", "start", "end"), s)) for s in row] for row in found], pa.list_(_SPAN))
            more = [pa.array(texts, pa.string())] if with_text else []
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], spans, *more], schema=schema)

    return run


def personal_data(docs: DataFrame, keep: list[str], with_text: bool = False) -> DataFrame:
    """The `keep` columns of each document, its spans and, if asked for, masked_text: the text with
    each span, or overlapping spans, replaced by the kind of the first in brackets."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    text = ", masked_text string" if with_text else ""
    schema = StructType([*docs.select(*[F.col(f"`{c}`") for c in keep]).schema, *StructType.fromDDL(SPANS + text)])
    rows = docs.select(F.col("text").cast("binary").alias("_text"), *[F.col(f"`{c}`") for c in keep])
    return rows.mapInArrow(_find(to_arrow_schema(schema), with_text), schema)


def op13_personal(spark, sf_dir):
    found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of_kinds(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of_kinds(k)).cast("long").alias(f"n_{k}") for k in BASE]
    base = of_kinds(*BASE)
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
