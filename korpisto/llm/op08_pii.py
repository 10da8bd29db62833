"""Operator 8: personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, URL schemes and identifier
cues. Deterministic local parsers expand an anchor to both sides and validate
what they find: e-mail addresses around an at-sign, URLs after a scheme, account
numbers and secrets after a cue. Numeric kinds (ip, card, phone) have no fixed
anchor string; a digit or a plus sign starts their parser.

Base kinds are leftmost and not overlapping within their kind; a candidate that
fails validation is dropped and the search goes on behind it. Kinds that the
method adds are ``url``, ``account`` (an IBAN by its check digits, or after a cue a
number of that cue's form: see ``account_number``) and ``secret`` (after a cue such
as ``password=`` a value that is no plain prose: see ``is_secret``). Offsets are
code points, ends exclusive.

Null and empty texts have no spans; masked, they stay as they are. Very long texts
are read whole. Repeated rows give repeated results, ids may be null or repeat,
and an empty table gives no rows. Further columns are not read; ``masked``
returns them unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
EXTRA = ("url", "account", "secret")
SCHEMES = ("http://", "https://", "ftp://")
ACCOUNT_CUES = ("iban", "account", "acct", "ssn", "passport")
SECRET_CUES = ("password", "passwd", "token", "secret", "api_key", "apikey")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL_REST = re.compile(r"[^\s<>\"']+")
_ACCOUNT = re.compile(r"((?:\s*(?:no\.?|number|nr\.?|#))?\s*[:=#]?)\s*((?-i:[A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]){11,30})|[0-9](?:[\x20-]?[0-9]){5,18})", re.IGNORECASE)
_SECRET = re.compile(r"(\s*[=:])\s*(\"[^\"\n]{6,}\"|'[^'\n]{6,}'|[^\s,;\"']{6,})")
_DIGIT = re.compile("[0-9]")
_PROSE = re.compile(r"[^\W\d_]+(?:[\s'’,.;:!?()-]+[^\W\d_]+)*[\s'’,.;:!?()-]*")
_DATE = re.compile(r"[12][0-9]{3}([ -])[01]?[0-9]\1[0-3]?[0-9]|[0-3]?[0-9]([ -])[01]?[0-9]\2[12][0-9]{3}")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}([ -]?)(?!00)[0-9]{2}\1(?!0000)[0-9]{4}")
#: Characters of each country's IBAN.
_IBAN_SIZE = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 "
    "GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 "
    "NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
).split()}
_automata: dict[str, object] = {}


def automaton():
    if "it" not in _automata:
        import ahocorasick

        a = ahocorasick.Automaton()
        for anchor in ("@", *SCHEMES, *ACCOUNT_CUES, *SECRET_CUES):
            a.add_word(anchor, anchor)
        a.make_automaton()
        _automata["it"] = a
    return _automata["it"]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(value: str) -> bool:
    value = value.replace(" ", "").upper()
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def iban_end(text: str, start: int, end: int) -> int | None:
    """Where the IBAN at ``start`` ends: at its country's length, else behind the last word up to ``end`` that passes."""
    ends = [i + 1 for i in range(start, end) if text[i] != " "]
    size = _IBAN_SIZE.get(text[start : start + 2].upper(), len(ends) + 1)
    if size <= len(ends) and iban(text[start : ends[size - 1]]):
        return ends[size - 1]
    whole = (e for e in reversed(ends) if not (text[e : e + 1].isascii() and text[e : e + 1].isalnum()))
    return next((e for e in whole if iban(text[start:e])), None)


def account_number(cue: str, marked: bool, number: str, after: str) -> bool:
    """Whether digits after a cue are a number of that cue's kind.

    They end at a boundary. A social security number has its groups, of which none
    is void; a passport number is 7 to 9 digits in one piece. An account number
    has 8 to 17 digits and is no date; without a mark such as ``:`` or ``no`` between
    cue and digits they stand in one piece.
    """
    if after[:1].isalnum() or re.match(r"[.,-][0-9]", after):
        return False
    if cue == "ssn":
        return bool(_SSN.fullmatch(number))
    if cue == "passport":
        return number.isdigit() and 7 <= len(number) <= 9
    count = sum(c.isdigit() for c in number)
    return 8 <= count <= 17 and (marked or count == len(number)) and not _DATE.fullmatch(number)


def is_secret(mark: str, value: str) -> bool:
    """Whether a value after a cue is more than a phrase: letters alone count right behind ``=``, and one word of them right behind ``:``, without a blank."""
    return mark.rstrip() == "=" or (mark == ":" and not any(c.isspace() for c in value)) or not _PROSE.fullmatch(value.strip("\"'"))


def email_at(text: str, at: int, least: int) -> tuple[int, int] | None:
    """The address around the at-sign at ``at`` that starts at ``least`` or later."""
    start = at
    while start > least and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1)
    return (start, domain.end()) if domain and start < at else None


def ascii_lower(text: str) -> str:
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def find(text: str) -> list[tuple[int, int, str, int]]:
    """(start, kind's place, kind, end) of all spans, in order."""
    out: list[tuple[int, int, str, int]] = []
    email_end = url_end = account_end = secret_end = 0
    for last, anchor in automaton().iter(ascii_lower(text)):
        begin = last + 1 - len(anchor)
        if anchor == "@":
            if begin >= email_end and (found := email_at(text, begin, email_end)):
                email_end = found[1]
                out.append((found[0], 0, "email", email_end))
        elif anchor in SCHEMES:
            if begin >= url_end and (rest := _URL_REST.match(text, last + 1)):
                end = last + 1 + len(rest[0].rstrip(".,;:!?)]}"))
                if end > last + 1:
                    url_end = end
                    out.append((begin, 4, "url", end))
        elif anchor in ACCOUNT_CUES:
            if begin >= account_end and (m := _ACCOUNT.match(text, last + 1)):
                if not m[2][0].isdigit():
                    end = iban_end(text, *m.span(2))
                else:
                    end = m.end() if account_number(anchor, bool(m[1].strip()), m[2], text[m.end() : m.end() + 2]) else None
                if end:
                    account_end = end
                    out.append((m.start(2), 5, "account", end))
        elif begin >= secret_end and (m := _SECRET.match(text, last + 1)) and is_secret(text[last + 1 : m.start(2)], m[2]):
            secret_end = m.end()
            out.append((m.start(2), 6, "secret", secret_end))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, "ip", m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, "card", m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append((m.start(), 3, "phone", m.end()))
    out.sort()
    return out


def joined(spans: list[tuple[int, int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)


def mask(text: str, spans: list[tuple[int, int, str, int]]) -> str:
    """The text with each run of overlapping spans replaced by the first one's kind."""
    out, at = [], 0
    for start, _, kind, end in spans:
        if start >= at:
            out += text[at:start], f"[{kind.upper()}]"
        at = max(at, end)
    return "".join(out) + text[at:]


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, every = [], []
            for text in pc.fill_null(b.column(1), "").to_pylist():
                spans = find(text)
                base = [s for s in spans if s[1] < 4]
                for k in range(4):
                    counts[k].append(sum(s[1] == k for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                every.append(joined(spans))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(every, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return source.mapInArrow(scan, schema)


def masked(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The input with every span of its text masked; null texts stay null."""
    where = docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if t is None else mask(t, find(t)) for t in b.column(where).to_pylist()]
            yield b.set_column(where, b.schema.field(where), pa.array(texts, b.schema.field(where).type))

    return docs.mapInArrow(scan, docs.schema)
