"""Personal data: regular expressions propose spans, checksum validators confirm them, context words adjust scores.

Kinds and what confirms them: ``email`` (shape), ``ip`` (parts at most 255), ``card`` (13 to 19 digits, Luhn),
``phone`` (9 to 15 digits), ``iban`` (mod 97), ``ssn`` (area, group and serial in range). The first four are always
reported; the others only if their score reaches ``THRESHOLD``. A score is the kind's base, raised by a passed checksum
and by a context word within ``CONTEXT_CHARS`` code points before or after the span.

The expressions run over whole texts and are written so that each text is scanned in linear time: a run of digits or
of address characters is entered only at its start, where a failing run cannot match later either.

Cases: a null text has no spans; an empty table gives an empty result; other columns pass through unchanged; tied or
repeated rows are treated row by row; offsets are code points, ends exclusive."""
from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
ALWAYS = KINDS[:4]
BASE_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.5, "phone": 0.5, "iban": 0.4, "ssn": 0.3}
CHECKSUM_BONUS, CONTEXT_BONUS, THRESHOLD, CONTEXT_CHARS = 0.4, 0.3, 0.6, 48
CONTEXT = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "visa", "credit", "debit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "anruf", "llame"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "tax", "id"),
}
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                 T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}))")
#: Lengths of the national forms; a code of another country is taken with all tokens that follow, or not at all.
IBAN_LENGTH = {c: n for n, names in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU"}.items() for c in names.split()}
_TOKEN_END = re.compile(r"(?<=[A-Z0-9])(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(code: str) -> bool:
    code = code.replace(" ", "")
    number = "".join(str(int(c, 36)) for c in code[4:] + code[:4])
    rest = 0
    for i in range(0, len(number), 9):
        rest = int(str(rest) + number[i:i + 9]) % 97
    return rest == 1


def _emails(text: str):
    """The expression local+@domain, leftmost first: a local part reaches back from its @ to the last match's end."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            floor = m.end()
        else:
            floor = at + 1          # a local part holds no @, so none reaches back over this one
        at = text.find("@", floor)


def _ibans(text: str):
    """Runs of whole tokens that pass mod 97: of the country's length first; elsewhere the longest run from a start."""
    out, rest = [], []
    for m in _IBAN.finditer(text):
        at = m.start()
        ends = [e for e in range(m.end() + 11, m.end(1) + 1) if _TOKEN_END.match(text, e)]
        ends = [(e, e - at - text.count(" ", at, e)) for e in ends]
        own = [e for e, n in ends if n == IBAN_LENGTH.get(m[0][:2])]
        if own and mod97(text[at:own[0]]):
            if not out or at >= out[-1][1]:
                out.append((at, own[0]))
        elif ends and ends[-1][1] >= 15:
            rest.append((at, ends[-1][0]))
    starts, last, more = [a for a, _ in out], 0, []
    for s, e in rest:                               # both lists are in order and free of overlaps among themselves
        k = bisect_left(starts, e)
        if s >= last and (not k or out[k - 1][1] <= s) and mod97(text[s:e]):
            more.append((s, e))
            last = e
    return out + more


def _only_digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def _ssn_valid(s: str) -> bool:
    return s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"


def _proposed(text: str):
    """``(kind, start, end, checksum)`` of every confirmed match."""
    if "@" in text:
        for s, e in _emails(text):
            yield "email", s, e, False
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end(), False
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37 and 13 <= len(d := _only_digits(m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end(), True
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_only_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end(), False
    for s, e in _ibans(text):
        yield "iban", s, e, True
    for m in _SSN.finditer(text):
        if _ssn_valid(m[0]):
            yield "ssn", m.start(), m.end(), False


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """All spans of one text in the order of ``KINDS``, then start."""
    out = []
    for kind, s, e, checksum in _proposed(text):
        near = (text[max(0, s - CONTEXT_CHARS):s] + " " + text[e:e + CONTEXT_CHARS]).lower()
        words = set(re.findall(r"[^\W\d_]+", near))
        context = any(w in words for w in CONTEXT[kind]) or (kind in ("email", "phone") and CONTEXT[kind][0] in near)
        score = min(1.0, BASE_SCORE[kind] + CHECKSUM_BONUS * checksum + CONTEXT_BONUS * context)
        if kind in ALWAYS or score >= THRESHOLD:
            out.append((kind, s, e, round(score, 3)))
    out.sort(key=lambda x: (KINDS.index(x[0]), x[1]))
    return out


def redact_text(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span, overlaps merged, replaced by the upper-case name of its first kind in brackets."""
    parts, at = [], 0
    for kind, s, e, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            parts += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(parts) + text[at:]


@F.arrow_udf(SPAN)
def _spans_udf(texts: pa.Array) -> pa.Array:
    found = [[] if t is None else find_spans(t) for t in (x.as_py() for x in texts)]
    return pa.array([[{"kind": k, "start": s, "end": e, "score": c} for k, s, e, c in row] for row in found], _SPAN_TYPE)


@F.arrow_udf(T.StringType())
def _redact_udf(texts: pa.Array) -> pa.Array:
    return pa.array([t if t is None else redact_text(t, find_spans(t)) for t in (x.as_py() for x in texts)], pa.string())


def spans(text: Column) -> Column:
    """The spans of a text column as an array of kind, start, end and score."""
    return _spans_udf(text.cast("string"))


def redacted(text: Column) -> Column:
    return _redact_udf(text.cast("string"))


def find_pii(docs: DataFrame, text_col: str = "text", out: str = "pii_spans") -> DataFrame:
    """``docs`` with the spans of ``text_col`` in column ``out`` (a column of that name is replaced)."""
    return docs.withColumn(out, spans(F.col(text_col)))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` redacted."""
    return docs.withColumn(text_col, redacted(F.col(text_col)))


def span_count(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def span_list(found: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` of the spans of ``kinds``, comma-joined."""
    chosen = F.filter(found, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
