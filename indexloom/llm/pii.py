"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust scores.

The four base kinds (email, ip, card, phone) follow fixed rules and always stay. Further kinds are
kept if their score, after checksum and context, reaches THRESHOLD: bank account numbers (mod-97 on
the country's own length and on the longest run of groups; on every run, if the country is unknown), national numbers and local telephone numbers (context words decide), and quoted access tokens.

Null and empty texts have no spans. Repeated rows give repeated results. Spans of one kind never
overlap; spans of different kinds may. Extra columns are left out (`redact` keeps them). Texts are
searched whole, in time proportional to their length. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from indexloom.llm import textops

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "secret", "ssn", "local_phone")
KINDS = BASE_KINDS + ADDED_KINDS
THRESHOLD = 0.5
CONTEXT_CHARS = 40

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}))")
_SECRET = re.compile(r"""(?<![A-Za-z0-9_])(?:token|secret|api[_-]?key|password|passwd)["']?\s{0,4}[=:]\s{0,4}["']([A-Za-z0-9+/_=.-]{16,256})["']""", re.I)
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+().-])(?:\([0-9]{2,5}\)\x20?|0)[0-9]{2,4}(?:[\x20./-][0-9]{2,5}){1,4}(?![0-9])")

_CONTEXT = re.compile(r"[^\W\d_]+")

#: Lengths of account numbers by country code. Fixed values.
IBAN_LENGTHS = {
    c: n
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in codes.split()
}

#: Score before checks, gain by a passed checksum, gain by a context word, context words. Fixed values.
SCORES = {
    "email": (0.9, 0.0, 0.1, ("email", "mail", "contact", "courriel", "correo")),
    "ip": (0.6, 0.0, 0.3, ("ip", "host", "server", "address", "adresse")),
    "card": (0.3, 0.5, 0.2, ("card", "visa", "mastercard", "credit", "carte", "karte", "tarjeta")),
    "phone": (0.6, 0.0, 0.3, ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone")),
    "iban": (0.2, 0.6, 0.2, ("iban", "account", "bank", "konto", "compte", "cuenta")),
    "secret": (0.7, 0.0, 0.2, ("key", "access", "auth", "bearer")),
    "ssn": (0.3, 0.0, 0.4, ("ssn", "social", "security", "identity")),
    "local_phone": (0.2, 0.0, 0.4, ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono")),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    rest = 0
    for c in s[4:] + s[:4]:
        rest = (rest * (100 if c.isalpha() else 10) + int(c, 36)) % 97
    return rest == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers that pass mod-97; the search goes on behind each, or behind the first four characters where none passes."""
    at = 0
    while m := _IBAN.search(text, at):
        at = m.end()
        ends, n = [], 4
        for i in range(m.start(1), m.end(1)):
            n += text[i] != " "
            if n >= 15 and text[i] != " " and not (text[i + 1 : i + 2].isascii() and text[i + 1 : i + 2].isalnum()):
                ends.append((n, i + 1))
        own = IBAN_LENGTHS.get(m[0][:2])
        ends.sort(key=lambda x: (x[0] != own, -x[0]))
        for _, end in ends[:2] if own else ends:  # each further try lets one wrong number in 97 pass
            if mod97(text[m.start() : end]):
                yield m.start(), end
                at = end
                break


def _part_fits(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 4 and int(digits or 0) <= 255


def _proposals(text: str, has_digit: bool) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, checksum passed); base kinds come only if their rules hold."""
    for s, e in _emails(text):
        yield "email", s, e, False
    if has_digit:
        for m in _IP.finditer(text):
            if all(map(_part_fits, m[0].split("."))):
                yield "ip", m.start(), m.end(), False
        for m in _CARD.finditer(text):
            if 13 <= m.end() - m.start() <= 37 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                yield "card", m.start(), m.end(), True
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    yield "phone", m.start(), m.end(), False
        for s, e in _ibans(text):
            yield "iban", s, e, True
    if "=" in text or ":" in text:
        for m in _SECRET.finditer(text):
            yield "secret", m.start(1), m.end(1), False
    if has_digit:
        for m in _SSN.finditer(text):
            yield "ssn", m.start(), m.end(), False
        for m in _LOCAL_PHONE.finditer(text):
            yield "local_phone", m.start(), m.end(), False


def find_spans(text: str | None, has_digit: bool = True) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, checked) of all spans kept, by kind as listed in KINDS, then by start."""
    out = []
    for kind, start, end, checked in _proposals(text or "", has_digit):
        score, by_check, by_context, words = SCORES[kind]
        near = f"{text[max(0, start - CONTEXT_CHARS) : start]} {text[end : end + CONTEXT_CHARS]}".lower()
        score += by_check * checked + by_context * bool(set(_CONTEXT.findall(near)).intersection(words))
        if kind in BASE_KINDS or score >= THRESHOLD:
            out.append((kind, start, end, round(min(score, 1.0), 3), checked))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda x: (order[x[0]], x[1]))


def _has_digit(texts: pa.Array) -> np.ndarray:
    buf, offsets = textops.utf8(texts)
    before = np.concatenate([[0], np.cumsum((buf >= 0x30) & (buf <= 0x39))])[offsets]
    return before[1:] > before[:-1]


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in spans)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("checked", pa.bool_())]))
_FOUND = pa.schema([("doc_id", pa.int64()), ("spans", _SPANS)])
_DIGEST = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE_KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("mean_score", pa.float64())])


def _search(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch):
                texts = textops.text_column(part)
                found = [find_spans(t, d) for t, d in zip(texts.to_pylist(), _has_digit(texts).tolist(), strict=True)]
                keys = part.column(0).cast(pa.int64())
                if digest:
                    base = [[x for x in f if x[0] in BASE_KINDS] for f in found]
                    yield textops.batch_of(_DIGEST, keys, *([sum(x[0] == k for x in b) for b in base] for k in BASE_KINDS), [hashlib.sha256(_joined(b).encode()).hexdigest() for b in base], [_joined(f) for f in found], [sum(x[3] for x in f) / len(f) if f else None for f in found])
                else:
                    yield textops.batch_of(_FOUND, keys, [[dict(zip(("kind", "start", "end", "score", "checked"), x, strict=True)) for x in f] for f in found])

    return run


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id and an array of (kind, start, end, score, checked) of every row of docs (doc_id, text)."""
    return textops.narrow(docs, "doc_id", "text").mapInArrow(_search(False), "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double,checked:boolean>>")


def pii_digests(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of their places and all spans as one string, for every row."""
    return textops.narrow(docs, "doc_id", "text").mapInArrow(_search(True), "doc_id long, " + "".join(f"n_{k} long, " for k in BASE_KINDS) + "base_sha256 string, spans string, mean_score double")


def redact_text(text: str, spans) -> str:
    """Each span is replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, start, end, *_ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """docs with all personal data in `text` replaced; an integer column n_chars follows the new text."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch):
                texts = textops.text_column(part)
                new = part.column(names.index("text")).to_pylist()
                for i, (t, d) in enumerate(zip(texts.to_pylist(), _has_digit(texts).tolist(), strict=True)):
                    if found := find_spans(t, d):
                        new[i] = redact_text(t, found)
                columns = list(part.columns)
                columns[names.index("text")] = pa.array(new, type=part.schema.field("text").type)
                if "n_chars" in names and pa.types.is_integer(part.schema.field("n_chars").type):
                    columns[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in new], type=part.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return textops.narrow(docs).mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))
