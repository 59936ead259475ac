"""Personal data in texts: patterns propose spans, checksums and number rules confirm them, words nearby move their score.

Four kinds are always kept once confirmed: e-mail addresses, IPv4 addresses, card numbers (Luhn) and telephone numbers
with a plus. Others need a score of `LEAST`, which a checksum alone reaches and a mere shape reaches only beside a
fitting word: account numbers (IBAN, mod 97), social security numbers, and telephone numbers without a plus.

Work on a text grows with its length: no pattern begins twice in a run of characters that it can't leave.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import map_batches, table, text_bytes

Span = tuple[int, int]

# The public lengths of account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}
#: Kinds in the order in which equal starts are listed; the first four are the base.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn", "local_phone"]
BASE = KINDS[:4]
#: What a confirmed span of the kind scores by itself, and the least score of spans beyond the base.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "local_phone": 0.3}
LEAST = 0.6
#: Bytes before and after a span in which words count, and what a fitting or a contrary word adds.
NEAR_BEFORE, NEAR_AFTER, FITS, CONTRARY = 60, 30, 0.3, -0.4

_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A first digit that follows a digit is inside a run already tried; whole runs are taken, as nothing shorter can go on.
_IP = re.compile(rb"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(rb"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(rb"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+")
_SSN = re.compile(rb"(?<![0-9A-Za-z-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9A-Za-z-])")
_LOCAL_PHONE = re.compile(rb"(?<![0-9A-Za-z+.-])\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}[0-9]{2,5}){1,4}+(?![0-9A-Za-z])")
_WORDS = {
    "email": rb"e-?mail|contact|write to|mailto|courriel|correo",
    "ip": rb"\bip\b|address|server|host|client|adresse|direcci",
    "card": rb"card|visa|credit|debit|payment|kreditkarte|carte|tarjeta",
    "phone": rb"phone|\btel\b|\bcall\b|mobile|\bfax\b|telefon|t\xc3\xa9l|portable|m\xc3\xb3vil",
    "iban": rb"iban|account|bank|konto|compte|cuenta",
    "ssn": rb"ssn|social security|tax id|taxpayer",
    "local_phone": rb"phone|\btel\b|mobile|\bfax\b|telefon|t\xc3\xa9l|m\xc3\xb3vil",
}
_NOT = {"ip": rb"version|release|section|\bv$", "card": rb"isbn|order|tracking|serial|\bid\b", "phone": rb"isbn|version", "local_phone": rb"isbn|version|\bdate\b", "ssn": rb"isbn|part no"}
_FITS, _CONTRARY = {k: re.compile(v, re.I) for k, v in _WORDS.items()}, {k: re.compile(v, re.I) for k, v in _NOT.items()}
_NO_DIGITS = bytes(i for i in range(256) if not 48 <= i <= 57)


def digits(b: bytes) -> bytes:
    return b.translate(None, _NO_DIGITS)


def luhn(number: bytes) -> bool:
    own = [c - 48 for c in number[::-1]]
    return (sum(own[::2]) + sum(2 * d - 9 * (d > 4) for d in own[1::2])) % 10 == 0


def mod97(account: bytes) -> bool:
    """The check of account numbers: the first four characters last, letters as 10 to 35, remainder 1."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(chr(c), 36)) for c in turned)) % 97 == 1


def emails(t: bytes) -> Iterator[Span]:
    """A local part begins as far before its @ as characters, and what was found before, let it."""
    end, at = 0, t.find(b"@")
    while at >= 0:
        if tail := _DOMAIN.match(t, at + 1):
            start = at
            while start > end and t[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = tail.end()
                yield start, end
        at = t.find(b"@", max(at + 1, end))


def addresses(t: bytes) -> Iterator[Span]:
    for m in _IP.finditer(t):
        if all(len(p := x.lstrip(b"0")) <= 3 and int(p or b"0") <= 255 for x in m[0].split(b".")):
            yield m.span()


def cards(t: bytes) -> Iterator[Span]:
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 14 and 14 <= len(own := digits(m[0])) <= 19 and luhn(own):
            yield m.span()


def phones(t: bytes) -> Iterator[Span]:
    for m in _PHONE.finditer(t):
        if 10 <= len(digits(m[0])) <= 15:
            yield m.span()


def accounts(t: bytes) -> Iterator[Span]:
    for m in _IBAN.finditer(t):
        want, at, n = IBAN_LENGTHS.get(m[0][:2].decode()), m.start(), 0
        while want and at < m.end() and n < want:
            n += t[at] != 32
            at += 1
        if want == n and not (at < len(t) and chr(t[at]).isalnum() and t[at] < 128) and mod97(t[m.start() : at].replace(b" ", b"")):
            yield m.start(), at


def social(t: bytes) -> Iterator[Span]:
    """Numbers that were given to somebody: no part of zeros, no area 666 or from 900."""
    for m in _SSN.finditer(t):
        if m[1] not in (b"000", b"666") and m[1] < b"900" and m[2] != b"00" and m[3] != b"0000":
            yield m.span()


def local_phones(t: bytes) -> Iterator[Span]:
    for m in _LOCAL_PHONE.finditer(t):
        if 7 <= len(digits(m[0])) <= 12:
            yield m.span()


FINDERS = {"email": emails, "ip": addresses, "card": cards, "phone": phones, "iban": accounts, "ssn": social, "local_phone": local_phones}


def score(kind: str, t: bytes, start: int, end: int) -> float:
    before, after = t[max(0, start - NEAR_BEFORE) : start], t[end : end + NEAR_AFTER]
    found = SCORES[kind] + FITS * bool(_FITS[kind].search(before) or _FITS[kind].search(after))
    if kind in _CONTRARY and _CONTRARY[kind].search(before):
        found += CONTRARY
    return round(min(1.0, max(0.0, found)), 2)


def spans(t: bytes) -> list[tuple[int, int, str, float]]:
    """start, end (code points, end exclusive), kind and score of all that a text holds, by start and the order of kinds. Spans
    beyond the base overlap neither base spans nor each other."""
    found = [(s, e, k, score(k, t, s, e)) for k in BASE for s, e in FINDERS[k](t)]
    taken = [(s, e) for s, e, *_ in found]
    for k in KINDS[len(BASE) :]:
        for s, e in FINDERS[k](t):
            if (x := score(k, t, s, e)) >= LEAST and all(e <= a or z <= s for a, z in taken):
                found.append((s, e, k, x))
                taken.append((s, e))
    if found and not t.isascii():
        # Bytes that begin a code point, counted up to each place.
        begun = np.concatenate(([0], np.cumsum((np.frombuffer(t, np.uint8) & 0xC0) != 0x80)))
        found = [(int(begun[s]), int(begun[e]), k, x) for s, e, k, x in found]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key and found, an array of (kind, start, end, score) by start and the order of KINDS.

    Null and empty texts hold nothing; rows of one key are a row each; texts are searched whole, whatever their length; an
    empty table gives no rows. Extra columns stay behind.
    """

    def batch(b):
        found = [[{"kind": k, "start": s, "end": e, "score": x} for s, e, k, x in spans(t.as_py())] for t in b.column("_text")]
        return {key: b.column(key), "found": found}

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(text_bytes(docs, key, text=text), batch, f"{key} {kind}, found array<struct<kind:string,start:int,end:int,score:double>>", 1000)


def masked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with each span of `text` replaced by its kind in angle brackets, e.g. <email>; spans that begin inside one
    before them go with it. All other columns and null texts stay as they are."""

    def clean(t: str | None) -> str | None:
        if t is None:
            return None
        out, at = [], 0
        for s, e, k, _ in spans(t.encode()):
            if s >= at:
                out += [t[at:s], f"<{k}>"]
            at = max(at, e)
        return "".join([*out, t[at:]])

    def run(batches):
        for b in batches:
            i = b.schema.get_field_index(text)
            yield b.set_column(i, text, pa.array([clean(x) for x in b.column(i).to_pylist()], pa.string()))

    return docs.mapInArrow(run, docs.schema)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    named = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    base = F.filter("found", lambda x: x["kind"].isin(BASE))
    number = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[number(k) for k in BASE], F.sha2(F.array_join(F.transform(base, named), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", named), ",").alias("spans"))
