"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust a score.

Each kind is one pattern, one validator and a list of context words.  A proposed span that its
validator rejects is dropped and not retried at another start.  Spans of one kind never overlap.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kinds in order, with context words that raise a score when they stand near.
BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "ssn", "secret")
CONTEXT = {
    "email": ("mail", "e-mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "login", "adresse"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("token", "secret", "password", "passwd", "key", "bearer", "credential"),
}
# Score of a match alone, what a checksum adds, what a context word adds, least score kept of the kinds beyond the base ones.
ALONE = {"email": 0.7, "ip": 0.5, "card": 0.4, "phone": 0.5, "iban": 0.3, "ssn": 0.2, "secret": 0.4}
CHECKED, NEAR, LEAST = 0.4, 0.3, 0.5
#: Characters before and after a span that are searched for context words.
REACH = 48
# Characters of an account number (ISO 13616) by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

# The patterns start at the head of a run and never give characters back, so that long runs of
# digits or letters cost linear time; matches are the same as those of the plain patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?= ?[A-Z0-9])")
_MORE = {n: re.compile(rf"(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in sorted(set(IBAN_LENGTHS.values()))}
_SECRET = re.compile(
    r"""(?<![A-Za-z0-9])(?:(?:(?:token|secret|password|passwd|pwd|bearer|api[_-]?key|access[_-]?key|secret[_-]?key)["']?[ \t]*(?:=|:)[ \t]*["']?|bearer[ \t]+)(?P<value>[A-Za-z0-9+/_.=-]{12,}+)"""
    r"""|(?P<marked>AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}+)|(?P<block>-----BEGIN [A-Z0-9 ]{0,24}PRIVATE KEY-----))""",
    re.IGNORECASE | re.ASCII,
)
_BLOCK_END = re.compile(r"-----END [A-Z0-9 ]{0,24}PRIVATE KEY-----", re.IGNORECASE | re.ASCII)
#: Lines of a key whose last line is missing: its headers and long lines of its text.
_BLOCK_LINES = re.compile(r"(?:[ \t]*+\r?\n(?:[A-Za-z0-9+/=]{16,}+|[A-Za-z-]++:[^\n]*+)?+)*+")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: Every secret's pattern holds one of these, in any case; texts without them aren't searched.
_HINTS = ("token", "secret", "passw", "pwd", "bearer", "key", "akia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def luhn(digits: str) -> bool:
    """Whether the Luhn checksum of a digit string is zero."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Whether an account number in the form of ISO 13616 leaves 1 modulo 97."""
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def dense(value: str) -> bool:
    """Whether a value looks drawn at random: letters and digits, three bits a character at least."""
    n = len(value)
    bits = -sum(k / n * log2(k / n) for k in Counter(value).values())
    return bits >= 3.0 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers, as long as their country has them, whatever capitals follow."""
    end = 0
    for m in _IBAN.finditer(text):
        size = IBAN_LENGTHS.get(m[1])
        rest = _MORE[size].match(text, m.end()) if size and m.start() >= end else None
        if rest and mod97(text[m.start() : rest.end()].replace(" ", "")):
            end = rest.end()
            yield m.start(), end


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", at + 1)


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    """Values to their end, and private keys from their first line to their last; without a last line, as far as lines of a key go."""
    ends = [(m.start(), m.end()) for m in _BLOCK_END.finditer(text)]
    found = list(_SECRET.finditer(text))
    heads = [m.start() for m in found if m["block"] is not None] + [len(text)]
    done = 0
    for m in found:
        if m.start() < done:
            continue
        if m["block"] is None:
            if m["value"] is None or dense(m["value"]):
                done = m.end()
                yield m.span("value" if m["value"] is not None else "marked")
            continue
        at = bisect_left(ends, (m.end(), 0))
        following = heads[bisect_right(heads, m.start())]
        done = ends[at][1] if at < len(ends) and ends[at][0] < following else _BLOCK_LINES.match(text, m.end()).end()
        yield m.start(), done


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _propose(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, checked) of every span that its validator accepts."""
    for start, end in _emails(text):
        yield "email", start, end, False
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            yield "ip", *m.span(), False
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 64 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", *m.span(), True
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            yield "phone", *m.span(), False
    for start, end in _ibans(text):
        yield "iban", start, end, True
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield "ssn", *m.span(), False
    low = text.lower()
    if any(h in low for h in _HINTS):
        yield from (("secret", start, end, True) for start, end in _secrets(text))


def find_spans(text: str | None) -> list[dict]:
    """All spans of one text by start, then kind: kind, start, end (code points, end exclusive), score, base."""
    out = []
    for kind, start, end, checked in _propose(text or ""):
        around = _WORD.findall(text[max(0, start - REACH) : start].lower()) + _WORD.findall(text[end : end + REACH].lower())
        score = min(1.0, ALONE[kind] + CHECKED * checked + NEAR * any(w in CONTEXT[kind] for w in around))
        base = kind in BASE_KINDS
        if base or score >= LEAST:
            out.append({"kind": kind, "start": start, "end": end, "score": round(score, 4), "base": base})
    order = BASE_KINDS + MORE_KINDS
    return sorted(out, key=lambda s: (s["start"], order.index(s["kind"])))


_SPANS = "array<struct<kind:string,start:long,end:long,score:double,base:boolean>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [find_spans(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _TYPE)], names=["id", "spans"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, spans)`` for every row of ``docs``, without a shuffle.

    Null and empty texts give an empty list; repeated rows and null ids give a row each; texts of any
    length are searched whole; an empty table gives an empty one; other columns are ignored, whatever
    their names.  Spans at one place come in the order of the kinds.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(_scan, f"id {kind}, spans {_SPANS}").withColumnRenamed("id", id_col)


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for t in batch.column(1).to_pylist():
            parts, end = [], 0
            for s in find_spans(t):
                if s["start"] >= end:
                    parts += [t[end : s["start"]], f"[{s['kind'].upper()}]"]
                end = max(end, s["end"])
            out.append(None if t is None else "".join(parts) + t[end:])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["id", "text"])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text)`` with every span replaced by its kind in brackets; of overlapping spans the first names the place, up to the end of the last.

    A null text stays null, an empty one empty; repeated rows and null ids give a row each; texts of any length are
    masked whole; an empty table gives an empty one; other columns are left out, whatever their names.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(_mask, f"id {kind}, text string").toDF(id_col, text_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per base kind, the SHA-256 of the base spans, all spans as text, their number, and the best score (0 without any)."""

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    return found.select(id_col, *[count(k) for k in BASE_KINDS], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), F.coalesce(F.array_max("spans.score"), F.lit(0.0)).alias("best_score"))
