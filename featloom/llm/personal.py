"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust their score.

A kind has a pattern, a prior, and perhaps a test of its digits or letters: Luhn for cards, mod-97 for bank accounts and
French personal numbers, mod-23 for Spanish ones, ranges for addresses and social security numbers. A passed checksum
raises the score of a proposal; a failed one ends it. Words of the kind's context within ``BEFORE`` characters
before a span or ``AFTER`` behind it raise the score, words that speak of something else lower it. The four base kinds
are fixed by their patterns and tests alone and stay whatever their score; proposals of the further kinds need a score of
``LEAST`` and must not overlap any span before them.

All patterns go through a text once: none can start within a run that an earlier start has failed on, so time is
linear in the text whatever it holds.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import unused
from .textwords import pieces

BASE = ("email", "ip", "card", "phone")
MORE = ("iban", "nir", "dni", "ssn", "tel")
KINDS = BASE + MORE

# Characters looked at for context before and behind a span, and the score that a further span needs.
BEFORE, AFTER, LEAST = 48, 24, 0.6
# What context, a checksum and a foreign context add to a prior.
NEAR, CHECKED, FOREIGN = 0.3, 0.4, -0.3

# Characters of local parts of addresses, and patterns. No pattern may start inside a run of its own
# first characters, where the leftmost match would have started earlier.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
NIR = re.compile(r"(?<![0-9])[12]\x20?[0-9]{2}\x20?(?:0[1-9]|1[0-2])\x20?[0-9]{2}\x20?[0-9]{3}\x20?[0-9]{3}\x20?[0-9]{2}(?![0-9])")
DNI = re.compile(r"(?<![A-Za-z0-9])[0-9]{8}-?[A-Z](?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
TEL = re.compile(r"(?<![A-Za-z0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])")
WORD = re.compile(r"[^\W\d_]+")

# Lengths of bank account numbers by country, and check letters of Spanish numbers.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22,
                "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"

# Priors of the kinds, the words that speak for them in four languages, and those that speak of something else.
PRIORS = {"email": 0.8, "ip": 0.5, "card": 0.5, "phone": 0.6, "iban": 0.5, "nir": 0.4, "dni": 0.4, "ssn": 0.35, "tel": 0.45}
CONTEXT = {
    "email": "address contact correo courriel email mail",
    "ip": "address client host ip login server",
    "card": "amex card carte credit kreditkarte mastercard payment tarjeta visa",
    "phone": "anruf appel call contact fax llame mobile phone tel teléfono telefon téléphone",
    "iban": "account bank banque banco compte cuenta iban konto",
    "nir": "assuré nir sociale sécurité",
    "dni": "documento dni identidad nif",
    "ssn": "security social ssn taxpayer",
    "tel": "anruf appel call contact fax llame mobile phone tel teléfono telefon téléphone",
}
CONTEXT = {kind: frozenset(words.split()) for kind, words in CONTEXT.items()}
ELSEWHERE = frozenset("build chapter figure invoice isbn issn order part release section serial ticket tracking version".split())


@dataclass(frozen=True)
class Found:
    start: int
    end: int
    kind: str
    score: float


def luhn(digits: str) -> bool:
    """Whether ASCII digits pass the Luhn test."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether a bank account number without spaces leaves 1 modulo 97, its head moved behind and letters as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses, not overlapping: what stands before each @ and behind it."""
    free, at = 0, text.find("@")
    while at >= 0:
        head = text[free:at]
        start = free + len(head.rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        free = domain.end() if domain else at + 1
        if domain:
            yield start, free
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of the base finds by start, then kind: of each kind leftmost matches, less those that fail its test."""
    out = [(s, e, "email") for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() < 14 or m.end() - m.start() > 37:  # 14 to 19 digits with a separator between them at most
            continue
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], BASE.index(s[2])))


def proposals(text: str) -> Iterator[tuple[int, int, str, bool]]:
    """Start, end and kind of what the further patterns propose and no test refutes, and whether a checksum confirms it."""
    for m in IBAN.finditer(text):
        left, end = IBAN_LENGTHS.get(m[0][:2], 0) - 4, m.end()
        while left > 0 and end < len(text):
            end += text[end] == " "
            if end == len(text) or not (text[end].isascii() and (text[end].isdigit() or text[end].isupper())):
                break
            left, end = left - 1, end + 1
        border = end == len(text) or not text[end].isalnum()
        if left == 0 and border and mod97(text[m.start():end].replace(" ", "")):
            yield m.start(), end, "iban", True
    for m in NIR.finditer(text):
        digits = _digits(m[0])
        if 97 - int(digits[:13]) % 97 == int(digits[13:]):
            yield *m.span(), "nir", True
    for m in DNI.finditer(text):
        if DNI_LETTERS[int(m[0][:8]) % 23] == m[0][-1]:
            yield *m.span(), "dni", True
    for m in SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield *m.span(), "ssn", False
    for m in TEL.finditer(text):
        yield *m.span(), "tel", False


def score(text: str, start: int, end: int, kind: str, checked: bool) -> float:
    """Prior of the kind, with what a checksum and the words nearby add, between 0 and 1."""
    nearby = set(WORD.findall(text[max(0, start - BEFORE):start].lower())) | set(WORD.findall(text[end:end + AFTER].lower()))
    total = PRIORS[kind] + CHECKED * checked + NEAR * bool(nearby & CONTEXT[kind]) + FOREIGN * bool(nearby & ELSEWHERE)
    return round(min(1.0, max(0.0, total)), 2)


def personal_spans(text: str, least: float = LEAST) -> list[Found]:
    """All finds of a text by start, then kind in the order of ``KINDS``."""
    base = base_spans(text)
    out = [Found(s, e, kind, score(text, s, e, kind, kind == "card")) for s, e, kind in base]
    taken = [(s, e) for s, e, _ in base]
    if any(c in text for c in "0123456789"):
        for s, e, kind, checked in sorted(proposals(text), key=lambda p: (p[0], KINDS.index(p[2]))):
            if (value := score(text, s, e, kind, checked)) >= least:
                out.append(Found(s, e, kind, value))
    return _apart(sorted(out, key=lambda f: (f.start, KINDS.index(f.kind))), sorted(taken))


def _apart(found: list[Found], base: list[tuple[int, int]]) -> list[Found]:
    """The finds without further ones that overlap a base span or an earlier further one."""
    out, free = [], 0
    starts, ends = [s for s, _ in base], [0, *accumulate((e for _, e in base), max)]
    for f in found:
        if f.kind in MORE:
            # the furthest end of the base spans that start before this one ends tells of an overlap
            if max(free, ends[bisect_left(starts, f.end)]) > f.start:
                continue
            free = f.end
        out.append(f)
    return out


def redact(text: str, found: list[Found]) -> str:
    """The text with each run of overlapping finds replaced by the kind of its first one in angle brackets."""
    out, at = [], 0
    for f in found:
        if f.start >= at:
            out += [text[at:f.start], f"<{f.kind}>"]
        at = max(at, f.end)
    return "".join([*out, text[at:]])


def find_personal(docs: DataFrame, text: str = "text", least: float = LEAST, redacted: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` with ``personal``: start, end (code points, end exclusive), kind and score of each find.

    With ``redacted`` also a column ``redacted``: the text with kinds in place of its finds. A null text has no finds, and a
    null redacted text; an empty one has none either. Texts are read whole, one scan does it all, and repeated rows are rows
    like any others. Added names take underscores if ``docs`` has them already.
    """
    place = docs.columns.index(text)
    names = [unused("personal", docs), unused("redacted", docs)][:1 + redacted]
    one = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType()),
                        T.StructField("score", T.DoubleType())])
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(names, (T.ArrayType(one), T.StringType())))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))
        for batch in (part for whole in batches for part in pieces(whole, place)):
            texts = batch.column(place).to_pylist()
            found = [personal_spans(t, least) if t else [] for t in texts]
            added = [pa.array([[vars(f) for f in fs] for fs in found], kind)]
            if redacted:
                added.append(pa.array([t and redact(t, fs) for t, fs in zip(texts, found)], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *names])

    return docs.mapInArrow(scan, schema)


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in each document: base finds, and all finds."""
    found = find_personal(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("personal", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{k}") for k in BASE]
    base = F.filter("personal", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("personal").alias("spans"))
