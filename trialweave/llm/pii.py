"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Each proposal starts with its pattern's score, gains by a passed checksum (Luhn for cards, mod 97
for account numbers) and by a whole context word within ``NEAR`` characters, and is reported from
``THRESHOLD`` on. The base kinds (email, ip, card, phone) are proposals whose own test is enough;
the others, among them card numbers inside longer runs of digits, need a checksum or context.

Every search is linear in the text. Nulls and empty texts have no spans; repeated rows are judged
each on its own; all columns but doc_id and text are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import slices
from .spans import Span, Taken, span_table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
THRESHOLD = 0.7
NEAR = 40
# score of the pattern alone, gain by its checksum, gain by a context word
SCORES = {
    "card": (0.3, 0.4, 0.2),
    "phone": (0.4, 0.0, 0.3),
    "iban": (0.3, 0.5, 0.2),
    "ssn": (0.3, 0.0, 0.4),
}
CONTEXT = {
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "anruf", "portable", "llame"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "sozialversicherung"),
}

# fixed values: lengths of account numbers by country
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29,
    "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19,
    "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_INNER_CARD = re.compile(r"(?<![0-9])(?:[0-9]{13,16}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])")
_PLAIN_PHONE = re.compile(r"(?<![0-9+(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGITS = re.compile("[0-9]+")
_CONTEXT = {kind: re.compile(r"(?<!\w)(?:" + "|".join(words) + r")(?![^\W0-9_])", re.I) for kind, words in CONTEXT.items()}
_LONGEST = max(len(w) for words in CONTEXT.values() for w in words) + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i & 1:
            v = 2 * v - 9 if v > 4 else 2 * v
        total += v
    return total % 10 == 0


def mod97(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> list[Span]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """Leftmost matches per kind that don't overlap; those that fail their test are dropped."""
    out = _emails(text) if "@" in text else []
    for m in _IP.finditer(text) if "." in text else ():
        # a run of many digits is no number up to 255 unless it is led by zeros
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(len(d) for d in _DIGITS.findall(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def _near(kind: str, text: str, start: int, end: int) -> bool:
    """Whether a context word, whole, begins or ends within NEAR characters of the span."""
    words = _CONTEXT[kind]
    if words.search(text, max(0, start - NEAR), start):
        return True
    found = words.search(text, end, end + NEAR + _LONGEST)
    return found is not None and found.end() <= end + NEAR


def _score(kind: str, text: str, start: int, end: int, confirmed: bool) -> float:
    own, checksum, context = SCORES[kind]
    return own + checksum * confirmed + context * _near(kind, text, start, end)


def _ibans(text: str, taken: Taken) -> list[Span]:
    """Runs that mod 97 confirms. A run may go on into words and numbers behind blanks, so its shorter
    ends at blanks count too: the one of its country's length first, then the longest. A run holds at most 34 letters and digits.
    """
    out: list[Span] = []
    m = _IBAN.search(text)
    while m:
        start, at = m.start(), m.start() + 1
        ends = [start + k for k in range(len(m[0]), 14, -1) if k == len(m[0]) or m[0][k] == " "]
        codes = {end: text[start:end].replace(" ", "") for end in ends}
        own = IBAN_LENGTHS.get(m[0][:2])
        for end in sorted(ends, key=lambda e: (len(codes[e]) != own, -e)):
            code = codes[end]
            if len(code) >= 15 and not taken.overlap(start, end) and mod97(code) and _score("iban", text, start, end, True) >= THRESHOLD - 1e-9:
                out.append(("iban", start, end))
                taken.add(start, end)
                at = end
                break
        m = _IBAN.search(text, at)
    return out


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Further spans that score enough and overlap no span reported so far."""
    taken = Taken(base)
    out = _ibans(text, taken)
    for kind, pattern in (("card", _INNER_CARD), ("ssn", _SSN), ("phone", _PLAIN_PHONE)):
        for m in pattern.finditer(text):
            if taken.overlap(m.start(), m.end()):
                continue
            code = m[0].replace(" ", "").replace("-", "")
            confirmed = {"card": lambda c: c[0] in "3456" and luhn(c)}.get(kind)
            if confirmed and not confirmed(code):
                continue
            if _score(kind, text, m.start(), m.end(), confirmed is not None) >= THRESHOLD - 1e-9:
                out.append((kind, m.start(), m.end()))
                taken.add(m.start(), m.end())
    return out


def spans_of(text: str) -> tuple[list[Span], list[Span]]:
    base = base_spans(text)
    return base, added_spans(text, base) if _DIGITS.search(text) else []


def find_pii(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans per row of documents(doc_id, text)."""
    return span_table(documents, BASE, KINDS, lambda: spans_of)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by its first kind, in brackets."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact(documents: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """The same rows and columns with personal data replaced; ``length`` names a column to update."""
    schema = documents.schema

    def rows(batches):
        for batch in batches:
            for part in slices(batch, text):
                values = part.column(text).to_pylist()
                changed = [None if v is None else redacted(v, sum(spans_of(v), [])) for v in values]
                at = part.schema.get_field_index(text)
                part = part.set_column(at, part.schema.field(at), pa.array(changed, part.schema.field(at).type))
                if length:
                    at = part.schema.get_field_index(length)
                    was = part.column(at).to_pylist()
                    now = [w if v == c else len(c) for w, v, c in zip(was, values, changed)]
                    part = part.set_column(at, part.schema.field(at), pa.array(now, part.schema.field(at).type))
                yield part

    return documents.withColumn(text, F.col(text).cast("string")).mapInArrow(rows, schema)
