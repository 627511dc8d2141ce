"""Personal data with offsets: plain identifiers by pattern, disguised ones after normalisation that remembers places.

Plain: the contract's patterns, leftmost and non-overlapping per kind. Disguised: transducers rewrite look-alike
letters and digits, invisible characters, spelled digits and at/dot disguises; each character of the rewritten text knows
the span of the source that it stands for, so what the same patterns find there maps back. A bare "at" before a plain domain
is an @ unless what stands around it makes the domain a web address (NOT_MAILBOXES, "www.", a path). Such a span counts only if
it holds something rewritten and overlaps no plain span of its kind. Offsets are code points, end exclusive.

Defined cases: a null text is empty; an empty text has no spans; texts are used whole; rows are independent, so repeats and
empty tables need nothing special.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from labelforge.llm.common import map_batches

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits is entered at its start only and never given back: the same matches, in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Starts from each @, so that long runs without one cost nothing."""
    end = 0
    at = text.find("@")
    while at >= 0:
        low = max(end, at - 512)
        while (start := low + len(text[low:at].rstrip(LOCAL))) == low and low > end:
            low = max(end, low - 4096)
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), sorted."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(out)


# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("аеорсхуіјѕԁһкмтвнАВЕКМНОРСТХУІЈЅαοινκρυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcxyijsdhkmtbhABEKMHOPCTXYIJSaoivkpuABEZHIKMNOPTYX", strict=True))
# Digits as words. Words that are common for other reasons ("un", "one") count only beside others.
DIGIT_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "oh": 0,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
INVISIBLE = "­​‌‍⁠﻿"
# Letters that match ASCII ones where case is ignored, though lower() doesn't turn them into these.
_CASE_TWINS = str.maketrans({"ſ": "s", "ı": "i", "İ": "i", "K": "k"})

_WORDS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_AT_WORD, _DOT_WORD = r"(?:at|arroba|chez|bei)", r"(?:dot|punkt|punto|point)"
# Runs of white space are entered at their start only, or right before what follows them, so long ones take linear time.
_SPACE, _GAP = r"(?:(?<!\s)\s*+|)", r"(?<!\s)\s++"
_DOT = rf"(?:{_SPACE}{_OPEN}\s*+(?:{_DOT_WORD}|\.)\s*+{_CLOSE}\s*+|{_GAP}{_DOT_WORD}\s++)"
_ATOM = r"[A-Za-z0-9-]++"
# What stands before "at" and a web address, not before a mail domain.
NOT_MAILBOXES = frozenset("us me you it him them here there is are was were be available found online look looked looking visit see website site more shop order buy read learn download hosted".split())
_RULES = re.compile(
    rf"(?P<at>{_SPACE}{_OPEN}\s*+(?:{_AT_WORD}|@)\s*+{_CLOSE}\s*+(?={_ATOM}(?:{_DOT}|\.){_ATOM})|{_GAP}{_AT_WORD}\s++(?={_ATOM}(?:\.{_ATOM})*(?:{_DOT}){_ATOM}))"
    rf"|(?P<bare>(?<=[A-Za-z0-9_%+-])[^\S\n\r]++{_AT_WORD}[^\S\n\r]++(?=(?P<domain>{_ATOM}(?:\.{_ATOM})+)))"
    rf"|(?P<plus>(?<![^\W_])(?:plus|más)[\s-]+(?=(?:{_WORDS}|[0-9])(?![^\W_])))"
    rf"|(?P<digits>(?<![^\W_])(?:{_WORDS}|[0-9]+)(?:(?:{_DOT}|[\s.-]+)(?:{_WORDS}|[0-9]+))+(?![^\W_]))"
    rf"|(?P<dot>(?<=[A-Za-z0-9])(?:{_DOT})(?=[A-Za-z0-9]))",
    re.IGNORECASE,
)
_UNIT = re.compile(rf"({_WORDS})|([0-9]+)|({_DOT}|\s*\.\s*)|([\s-]+)", re.IGNORECASE)
_SPELLED_DOT = re.compile(_DOT, re.IGNORECASE)
_TRIGGER = re.compile(rf"{_OPEN}\s*+(?:{_AT_WORD}|{_DOT_WORD}|@|\.)\s*+{_CLOSE}|\s{_DOT_WORD}\s|\s{_AT_WORD}\s++{_ATOM}\.[A-Za-z0-9]|\b(?:{_WORDS})[\s.-]+(?:{_WORDS}|[0-9]+)\b", re.IGNORECASE)
#: Styled forms of ASCII letters and digits (full width, mathematical, circled, raised) and the decimal digits of other scripts.
STYLED = {c: by for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c) != "Cs" and (by := str(unicodedata.decimal(c, "")) or unicodedata.normalize("NFKC", c)) != c and len(by) == 1 and by.isascii() and (by.isalnum() or 0xFF00 < ord(c) < 0xFF5F)}
_ODD = frozenset([*LOOKALIKES, *INVISIBLE, *STYLED])


class Traced:
    """A text whose characters know the source span they stand for, and whether they were rewritten."""

    def __init__(self, text: str):
        self.text, self.start, self.end, self.new = text, list(range(len(text))), list(range(1, len(text) + 1)), [False] * len(text)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """edits: (from, to, by what), in order. Each new character stands for the whole of what was replaced."""
        text, start, end, new, at = [], [], [], [], 0
        for a, b, by in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[at:a])
            start += self.start[at:a]
            end += self.end[at:a]
            new += self.new[at:a]
            if by:
                text.append(by)
                start += [self.start[a]] * len(by)
                end += [self.end[b - 1]] * len(by)
                new += [True] * len(by)
            at = b
        self.text, self.start, self.end, self.new = "".join(text), start, end, new


def _odd_edits(text: str, odd: frozenset[str]) -> list[tuple[int, int, str]]:
    """The edits of those characters of the text that are odd; a class of all odd ones would be walked at every place."""
    by = {c: "" if c in INVISIBLE else LOOKALIKES.get(c) or STYLED[c] for c in odd}
    return [(m.start(), m.end(), by[m[0]]) for m in re.finditer("[" + re.escape("".join(odd)) + "]", text)]


def _is_mail(text: str, m: re.Match) -> bool:
    """Whether a bare at-word before a plain domain is an @: the domain ends in letters and no path or call follows it."""
    last = m["domain"].rpartition(".")[2]
    if not (len(last) > 1 and last.isalpha() and (last.islower() or m["domain"].isupper())) or text[m.end("domain") : m.end("domain") + 1] in ("/", "("):
        return False
    before = text[max(0, m.start() - 64) : m.start()]
    return before[len(before.rstrip(LOCAL)) :].lower() not in NOT_MAILBOXES and not m["domain"].lower().startswith("www.")


def _rule_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _RULES.finditer(text):
        if m["bare"]:
            if _is_mail(text, m):
                edits.append((m.start(), m.end(), "@"))
        elif m["digits"] is None:
            edits.append((m.start(), m.end(), "@" if m["at"] else "." if m["dot"] else "+"))
        elif not any(u[1] for u in _UNIT.finditer(m[0])):
            # Only digits: what is spelled out between them is a dot, all else is plain already.
            edits += [(m.start() + u.start(), m.start() + u.end(), ".") for u in _SPELLED_DOT.finditer(m[0])]
        else:
            # Digit by digit, so that ends stay exact; what separates them goes, but for dots.
            for u in _UNIT.finditer(m[0]):
                a, b = m.start() + u.start(), m.start() + u.end()
                if u[1]:
                    edits.append((a, b, str(DIGIT_WORDS[u[1].translate(_CASE_TWINS).lower()])))
                elif u[3] and u[3] != ".":
                    edits.append((a, b, "."))
                elif u[4]:
                    edits.append((a, b, ""))
    return edits


def disguised_spans(text: str, plain: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    odd = frozenset() if text.isascii() else _ODD.intersection(text)
    if not odd and not _TRIGGER.search(text):
        return []
    traced = Traced(text)
    if odd:
        traced.rewrite(_odd_edits(text, odd))
    traced.rewrite(_rule_edits(traced.text))
    out = []
    for a, kind, b in plain_spans(traced.text):
        if any(traced.new[a:b]) or traced.end[b - 1] - traced.start[a] != b - a:
            span = traced.start[a], kind, traced.end[b - 1]
            if not any(k == kind and s < span[2] and span[0] < e for s, k, e in plain):
                out.append(span)
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span becomes the name of its kind in brackets; of spans that overlap, their union gets the first one's."""
    merged: list[list[int]] = []
    for a, k, b in sorted(spans):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([a, k, b])
    parts, at = [], 0
    for a, k, b in merged:
        parts += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = b
    return "".join([*parts, text[at:]])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: list[list[int]] = [[], [], [], []]
        digests, spans, added = [], [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            plain = plain_spans(text)
            more = disguised_spans(text, plain)
            for k in range(4):
                counts[k].append(sum(s[1] == k for s in plain))
            digests.append(hashlib.sha256(written(plain).encode()).hexdigest())
            spans.append(written(plain + more))
            added.append(len(more))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())],
            ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
        )


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Counts and digest of the plain spans, all spans, and how many the normalisation added."""
    return map_batches(docs.select("doc_id", "text"), _find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text in batch.column("text").to_pylist():
            plain = plain_spans(text or "")
            spans = plain + disguised_spans(text or "", plain)
            texts.append(redact(text, spans) if spans else text)
        names = batch.schema.names
        new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
        yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names)


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with spans replaced by their kinds, and n_chars to match."""
    return map_batches(docs.select("doc_id", "text", "lang", "source", "n_chars"), _redact, "doc_id long, text string, lang string, source string, n_chars long")
