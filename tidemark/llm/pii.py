"""Personal data: regular expressions propose, checksums confirm, nearby words adjust the score.

Kinds: email, ip (four parts of at most 255), card (12 to 19 digits, Luhn), phone (9 to 15 digits) and,
beyond those, iban (two letters, two digits, 11 to 30 letters or digits, mod-97). Matches of a kind
are leftmost and non-overlapping, over the whole text; a match that fails its check is dropped and
not tried again from a later place. Positions are code points, ends exclusive.

A span's score starts at its kind's prior (a confirmed checksum tells more than a shape) and moves by
CONTEXT_WEIGHT when one of the kind's context words stands, as a whole word, within CONTEXT_CHARS before or after it, and
down by as much when a word of the counter-list does. The score is reported; no span is dropped for it.

Edge cases: null text is empty and has no spans; a text of any length is searched whole, in time linear in
it; spans of several kinds may overlap and are listed by start, then kind; rows repeated whole get the same row
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import mapped

KINDS = ("email", "ip", "card", "phone")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match begins where a run of digits does (one that ended before it ended with its run), and no run is read
# again from its middle: time is linear in the text.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
# The contract's pattern but for a digit alone, which fails its check and stands next to no other digit.
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b", re.ASCII)
_NOT_DIGIT = re.compile(r"[^0-9]+")

PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
CONTEXT_CHARS, CONTEXT_WEIGHT = 40, 0.15
CONTEXT = {
    "email": ("mail", "contact", "write to", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "whatsapp"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
}
COUNTER = {
    "email": ("example", "test"),
    "ip": ("version", "release", "section", "chapter"),
    "card": ("isbn", "order", "tracking", "serial"),
    "phone": ("isbn", "order", "version"),
    "iban": ("sku", "serial"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(text: str) -> bool:
    text = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, looked for around each @ alone.

    The local part holds no @, so a match's local part is what stands before its @ back to the last
    character that is not of the class, or to the end of the match before.
    """
    done, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            start = at
            while start > done and _is_local(text[start - 1]):
                start -= 1
            if start < at:
                yield start, m.end()
                done = m.end()
        at = text.find("@", max(at + 1, done))


def _is_local(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c in "._%+-")


def proposals(text: str) -> Iterator[tuple[int, int, str]]:
    if "@" in text:
        for a, b in emails(text):
            yield a, b, "email"
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                yield m.start(), m.end(), "ip"
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.start(), m.end(), "card"
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield m.start(), m.end(), "phone"
    for m in _IBAN.finditer(text):
        if mod97(m[0]):
            yield m.start(), m.end(), "iban"


def whole_word(words: tuple[str, ...]) -> str:
    """A pattern of any of the words, in lower case, not inside a longer ASCII word."""
    return rf"(?:^|[^a-z0-9])(?:{'|'.join(words)})(?:[^a-z0-9]|$)"


_NEAR = {k: (re.compile(whole_word(CONTEXT[k])), re.compile(whole_word(COUNTER[k]))) for k in CONTEXT}
_LOWER = {c: c + 32 for c in range(65, 91)}


def score(text: str, start: int, end: int, kind: str) -> float:
    near = f"{text[max(0, start - CONTEXT_CHARS):start]} {text[end:end + CONTEXT_CHARS]}".translate(_LOWER)
    more, less = _NEAR[kind]
    up = (more.search(near) is not None) - (less.search(near) is not None)
    return round(min(1.0, max(0.0, PRIOR[kind] + CONTEXT_WEIGHT * up)), 2)


_ORDER = {k: i for i, k in enumerate((*KINDS, "iban"))}
SCHEMA = (
    "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, scores string"
)


def personal_data(docs: DataFrame) -> DataFrame:
    """A row for each input row: counts, digest of the base spans, all spans, and their scores in the same order."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for t in batch.column(1):
                text = t.as_py() or ""
                found = sorted(proposals(text), key=lambda s: (s[0], _ORDER[s[2]]))
                kinds = [k for *_, k in found]
                names = [f"{k}:{a}:{b}" for a, b, k in found]
                base = ",".join(n for n, k in zip(names, kinds, strict=True) if k in KINDS)
                row = (*(kinds.count(k) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), ",".join(names),
                       ",".join(f"{score(text, a, b, k):.2f}" for a, b, k in found))
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            yield pa.record_batch(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"],
            )

    return mapped(docs.select("doc_id", "text"), task, SCHEMA)
