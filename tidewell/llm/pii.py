"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, plus signs, scheme marks, digits, identifier cues) in one pass over the
whole text; at each anchor a deterministic local parser expands to both sides and validates the span. Kinds email, ip, card
and phone give exactly the leftmost non-overlapping matches of their patterns, of which those that fail validation drop out;
url, iban, account, secret and address are added by cues.

Null text counts as empty and has no spans. Rows repeat as they are given; columns other than the id and the text play no part.
Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.llm.common import small

KINDS = ("email", "ip", "card", "phone", "url", "iban", "account", "secret", "address")
BASE = KINDS[:4]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")

#: Cue words, by the kind that they start. They are found in any case, but for those of addresses.
CUES = {
    "iban": ("iban",),
    "account": ("account no", "account number", "acct", "kontonummer", "konto-nr", "ssn", "passport"),
    "secret": ("token", "password", "passwd", "api_key", "api-key", "api key", "apikey", "secret_key", "secret-key"),
    "address": (" Street", " Avenue", " Road", " Lane", " Boulevard", "straße", " rue ", "Calle "),
}
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_RUN = re.compile(r"[0-9]+")
_URL = re.compile(r"[^\s<>\"'`]+")
_IBAN = re.compile(r"[:\s]{0,3}([A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?)")
_ACCOUNT = re.compile(r"[A-Za-z.]{0,8}[\s:#.=]{0,4}([0-9][0-9 -]{4,24}[0-9])")
_SECRET = re.compile(r"\s?[:=]\s?[\"']?([A-Za-z0-9_\-./+]{16,128})")
_HOUSE_BEFORE = re.compile(r"([0-9]{1,5}[A-Za-z]? (?:[A-Z][\w'-]{0,30} ){0,3}[A-Z][\w'-]{0,30})$")
_HOUSE_AFTER = re.compile(r"[\w' -]{0,40}? ?[0-9]{1,5}[A-Za-z]?\b")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def part_valid(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in ("@", "+", "://", *DIGITS):
        found.add_word(word, ("digit" if word in DIGITS else word, len(word)))
    for kind, words in CUES.items():
        for word in words:
            found.add_word(word.lower(), (kind, len(word)))
    found.make_automaton()
    return found


def lowered(text: str) -> str:
    """The text in lower case, place for place: where a letter would become two, only A to Z are lowered."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_ASCII_LOWER)


def find_spans(text: str, anchors: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, each list in order of start."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email_end = phone_end = ip_end = card_end = run_end = url_end = 0
    for last, (kind, length) in anchors.iter(lowered(text)):
        at = last + 1 - length
        if kind == "digit":
            if at < run_end:
                continue
            run_end = _RUN.match(text, at).end()
            if at >= ip_end and (m := _IP.match(text, at)):
                ip_end = m.end()
                if all(map(part_valid, m[0].split("."))):
                    spans["ip"].append(m.span())
            if at >= card_end and (m := _CARD.match(text, at)):
                card_end = m.end()
                digits = m[0].replace(" ", "").replace("-", "") if m.end() - at <= 64 else ""
                if 13 <= len(digits) <= 19 and luhn(digits):
                    spans["card"].append(m.span())
        elif kind == "@":
            start = at
            while start > email_end and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email_end = m.end()
                spans["email"].append((start, email_end))
        elif kind == "+":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 9 <= sum(c in DIGITS for c in m[0]) <= 15:
                    spans["phone"].append(m.span())
        elif kind == "://":
            start = at
            while start > url_end and at - start < 16 and text[start - 1] in SCHEME:
                start -= 1
            if start < at and text[start].isalpha() and (m := _URL.match(text, last + 1)):
                url_end = last + 1 + len(m[0].rstrip(".,;:!?)]}"))
                if url_end > last + 1:
                    spans["url"].append((start, url_end))
        elif kind == "iban":
            if (m := _IBAN.match(text, last + 1)) and iban_valid(m[1]):
                spans["iban"].append(m.span(1))
        elif kind == "account":
            if m := _ACCOUNT.match(text, last + 1):
                spans["account"].append(m.span(1))
        elif kind == "secret":
            if m := _SECRET.match(text, last + 1):
                spans["secret"].append(m.span(1))
        elif text[at : last + 1] not in CUES["address"]:
            continue
        elif (m := _HOUSE_BEFORE.search(text, max(0, at - 130), at)) and text[at] == " ":
            spans["address"].append((m.start(1), last + 1))
        elif text[last] in " e" and (m := _HOUSE_AFTER.match(text, last + 1)):
            spans["address"].append((at + (text[at] == " "), m.end()))
    for kind in KINDS[4:]:  # cues may overlap
        kept: list[tuple[int, int]] = []
        for s in sorted(set(spans[kind])):
            if not kept or s[0] >= kept[-1][1]:
                kept.append(s)
        spans[kind] = kept
    return spans


def joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def redact(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """Each span becomes <KIND>; where spans overlap, the union takes the name of the one that starts first, then the longer one."""
    out, end = [], 0
    for a, b, kind in sorted(((a, b, k) for k in KINDS for a, b in spans[k]), key=lambda s: (s[0], -s[1], KINDS.index(s[2]))):
        if a >= end:
            out += [text[end:a], f"<{kind.upper()}>"]
        end = max(end, b)
    return "".join(out) + text[end:] if out else text


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, counts of the base kinds, the digest of their spans, and all spans. No shuffle."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in small(batches):
            counts, digests, every = {k: [] for k in BASE}, [], []
            for text in batch.column(1).to_pylist():
                spans = find_spans(text or "", anchors)
                for k in BASE:
                    counts[k].append(len(spans[k]))
                digests.append(hashlib.sha256(joined(spans, BASE).encode()).hexdigest())
                every.append(joined(spans, KINDS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(digests, pa.string()), pa.array(every, pa.string())], names=["id", *BASE, "sha", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(find, f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_pii(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with each span of personal data replaced by its kind in angle brackets and, if it has that column, the length of the new text. Null texts stay null; rows and other columns stay."""
    names = docs.columns
    text_at, chars_at = names.index(text_col), names.index(chars_col) if chars_col in names else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in small(batches):
            texts = [t and redact(t, find_spans(t, anchors)) for t in batch.column(text_at).to_pylist()]
            columns = list(batch.columns)
            columns[text_at] = pa.array(texts, pa.string())
            if chars_at is not None:
                columns[chars_at] = pa.array([None if t is None else len(t) for t in texts], batch.column(chars_at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(clean, docs.schema)
