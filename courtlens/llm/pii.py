"""Personal data in texts, also where it is disguised, with places in the original text.

Plain identifiers are found on the text itself. Then a chain of transducers rewrites a copy:
look-alike and zero-width characters, spelled at and dot, spelled digits. Every rewrite records
which source characters each new one stands for, identifiers are detected on the rewritten copy,
and their places are mapped back. Only spans that use a rewritten character are added, so texts
without a disguise get exactly the plain findings.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from typing import Callable, Iterable, Iterator, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from courtlens.llm.common import sliced

KINDS = ("email", "ip", "card", "phone")


class Span(NamedTuple):
    kind: int  # place in KINDS
    start: int
    end: int


# ---- plain identifiers ---------------------------------------------------------------------------

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern finds them, but from each @ outwards, so that long runs cost no square."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            yield start, last
            at = text.find("@", last)
        else:
            last = at + 1
            at = text.find("@", at + 1)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def plain_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping findings of each kind, sorted by kind and start."""
    out = [Span(0, *place) for place in _emails(text)]
    if _DIGIT.search(text):
        out += [Span(1, *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = _NO_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(Span(2, *m.span()))
        out += [Span(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    return out


# ---- rewriting with places -----------------------------------------------------------------------


class Rewritten:
    """A text and the source stretch each of its characters stands for.

    ``cuts`` are (start in the new text, start in the source, changed?) of stretches; an unchanged
    stretch maps character by character, a changed one as a whole.
    """

    def __init__(self, text: str):
        self.text = text
        self.length = len(text)
        self.cuts: list[tuple[int, int, int, bool]] = [(0, 0, len(text), False)]  # new, source from, source to, changed
        self.starts = [0]

    @property
    def touched(self) -> bool:
        return len(self.text) != self.length or any(c[3] for c in self.cuts)

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source stretch of [start, end) and whether it holds a rewritten or removed character."""
        first = max(0, bisect_right(self.starts, start) - 1)
        last = max(0, bisect_right(self.starts, end - 1) - 1)
        a, b = self.cuts[first], self.cuts[last]
        begin = a[1] if a[3] else a[1] + start - a[0]
        stop = b[2] if b[3] else b[1] + end - b[0]
        return begin, stop, stop - begin != end - start or any(c[3] for c in self.cuts[first:last + 1])

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces sorted, disjoint stretches of the current text; removals join the next stretch."""
        if not edits:
            return
        text, parts, cuts, new, at = self.text, [], [], 0, 0

        def copy(start: int, end: int) -> None:
            nonlocal new
            while start < end:
                k = max(0, bisect_right(self.starts, start) - 1)
                stop = min(end, self.starts[k + 1] if k + 1 < len(self.starts) else len(text))
                _, begin, finish, changed = self.cuts[k]
                shift = start - self.starts[k]
                cuts.append((new, begin, finish, True) if changed else (new, begin + shift, begin + shift + stop - start, False))
                parts.append(text[start:stop])
                new += stop - start
                start = stop

        for start, end, put in edits:
            copy(at, start)
            if put:
                begin, finish, _ = self.source(start, end)
                cuts.append((new, begin, finish, True))
                parts.append(put)
                new += len(put)
            at = end
        copy(at, len(text))
        self.text = "".join(parts)
        self.cuts = cuts or [(0, 0, 0, False)]
        self.starts = [c[0] for c in self.cuts]


# ---- transducers ---------------------------------------------------------------------------------

# Letters of other scripts that look like a-z, and other at signs and dots.
_ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h",
    "ԛ": "q", "ԝ": "w", "ɡ": "g", "ο": "o", "α": "a", "ν": "v", "ι": "i", "ρ": "p", "А": "A", "В": "B", "Е": "E", "К": "K",
    "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ο": "O", "Ι": "I",
    "＠": "@", "﹫": "@", "．": ".", "。": ".", "｡": ".", "․": ".", "﹒": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "＋": "+", "﹢": "+",
}
_ZERO_WIDTH = "­​‌‍⁠﻿"


def _plain_char(c: str) -> str | None:
    """What a character is rewritten to; None leaves it."""
    if c in _ALIKE:
        return _ALIKE[c]
    if c in _ZERO_WIDTH:
        return ""
    if c == " " or c == " " or c == " ":
        return " "
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    if 0xFF01 <= ord(c) <= 0xFF5E or 0x1D400 <= ord(c) <= 0x1D7FF:
        wide = unicodedata.normalize("NFKC", c)
        return wide if wide.isascii() else None
    return None


_BEYOND = re.compile(r"[^\x00-¬®-ɏ]")
_NO_BREAK = re.compile(r"[ ­]")


def look_alikes(text: str) -> list[tuple[int, int, str]]:
    if text.isascii():
        return []
    edits = []
    for pattern in (_BEYOND, _NO_BREAK):
        for m in pattern.finditer(text):
            put = _plain_char(m[0])
            if put is not None:
                edits.append((m.start(), m.end(), put))
    return sorted(edits)


_AT_WORD, _DOT_WORD = "at|arroba|arobase|ät", "dot|punto|punkt|point"
_OPEN, _CLOSE = r"[\[({<]\s{0,3}", r"\s{0,3}[\])}>]"
_MARKED_AT = re.compile(rf"(?<=[A-Za-z0-9])\s{{0,3}}(?:{_OPEN}(?:{_AT_WORD}|@){_CLOSE}|[-_]{{1,2}}(?:at|AT)[-_]{{1,2}})\s{{0,3}}(?=[A-Za-z0-9])", re.I)
_MARKED_DOT = re.compile(rf"(?<=[A-Za-z0-9])\s{{0,3}}{_OPEN}(?:{_DOT_WORD}|\.){_CLOSE}\s{{0,3}}(?=[A-Za-z0-9])", re.I)
_SAID = re.compile(
    rf"(?<=[A-Za-z0-9])(?P<at>\s+(?:{_AT_WORD})\s+|\s{{0,3}}@\s{{0,3}})(?P<domain>[A-Za-z0-9-]+(?:(?:\s+(?:{_DOT_WORD})\s+|\.)[A-Za-z0-9-]+)*"
    rf"\s+(?:{_DOT_WORD})\s+[A-Za-z]{{2,}})(?![A-Za-z0-9])", re.I)
# Begins where a run of blanks does and never gives blanks back, so a long run is read once.
_SAID_DOT = re.compile(rf"(?<!\s)\s++(?:{_DOT_WORD})\s++", re.I)
# What cannot begin a said host name, and how one may end.
_NO_HOST = frozenset("a an the this that these those my your his her our their its la le el un der die das ein".split())
_TOP_LEVEL = frozenset((
    "com org net edu gov mil int info biz io co dev app ai me tv uk us de fr es it nl eu ch at be ca au nz jp cn in br mx ru example test "
    "online xyz shop site store tech cloud blog agency club space website live news pro mobi name page email digital world group team work").split())
#: Endings that need no more evidence after ``at ... point``.
_PLAIN_LEVEL = frozenset("com org net".split())
# English words of two letters; other two letters may be a country's ending.
_TWO_LETTER_WORDS = frozenset("am an as at be by do go he if in is it me my no of oh ok on or so to up us we".split())
_NAME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_%+-")
_SPACED_AT = re.compile(r"(?<=[A-Za-z0-9])(?:\s{1,3}@\s{0,3}|@\s{1,3})(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})")
_HINT = re.compile(rf"[\[({{<]\s{{0,3}}(?:{_AT_WORD}|{_DOT_WORD}|@|\.)\s{{0,3}}[\])}}>]|[-_]at[-_]|\s(?:{_DOT_WORD})\s|\s@|@\s", re.I)


def marked_at_and_dot(text: str) -> list[tuple[int, int, str]]:
    """``name [at] host (dot) org`` and ``name @ host.org``."""
    low = text.lower()
    if not any(c in text for c in "[({<@") and "at_" not in low and "at-" not in low or not _HINT.search(text):
        return []
    edits = [(*m.span(), "@") for m in _MARKED_AT.finditer(text)]
    edits += [(*m.span(), "@") for m in _SPACED_AT.finditer(text)]
    edits += [(*m.span(), ".") for m in _MARKED_DOT.finditer(text)]
    return _disjoint(edits)


def _may_end(text: str, address: re.Match, labels: list[str]) -> bool:
    """Whether a said address may end so: in a usual ending or two letters that are no English word.

    Any other ending, and "at ... point", which sentences say too, need a second piece of evidence:
    a host of more labels, or a name that holds a digit, a sign or a said dot.
    """
    ending = labels[-1]
    sentence = address["at"].strip().lower() == "at" and any(d[0].strip().lower() == "point" for d in _SAID_DOT.finditer(address["domain"]))
    if ending in _PLAIN_LEVEL or not sentence and (ending in _TOP_LEVEL or len(ending) == 2 and ending not in _TWO_LETTER_WORDS):
        return True
    if ending in _TWO_LETTER_WORDS:
        return False
    at = address.start()
    begin = at
    while begin and text[begin - 1] in _NAME:
        begin -= 1
    return len(labels) > 2 or not text[begin:at].isalpha() or _name_start(text, at) < begin


def _name_start(text: str, end: int) -> int:
    """Where the words joined by said dots that end at ``end`` begin; ``end`` if there is no dot."""

    def back(at: int, holds: Callable[[str], bool]) -> int:
        while at and holds(text[at - 1]):
            at -= 1
        return at

    start, first = end, back(end, _NAME.__contains__)
    while first < end:
        dot = back(first, str.isspace)
        if dot == first or text[max(0, dot - 3):dot].lower() != "dot":
            break
        word = back(dot - 3, str.isspace)
        begin = back(word, _NAME.__contains__)
        if word == dot - 3 or begin == word:
            break
        start = first = begin
    return start


def said_at_and_dot(text: str) -> list[tuple[int, int, str]]:
    """``name at host dot org``: a bare at counts only where a said dot follows in the same address."""
    edits: list[tuple[int, int, str]] = []
    low = text.lower()
    if not any(w in low for w in _DOT_WORD.split("|")) or not _SAID_DOT.search(text):
        return edits
    for m in _SAID.finditer(text):
        labels = _SAID_DOT.sub(".", m["domain"]).lower().split(".")
        if labels[0] in _NO_HOST or not _may_end(text, m, labels):
            continue
        edits.append((*m.span("at"), "@"))
        edits += [(*d.span(), ".") for d in _SAID_DOT.finditer(text, *m.span("domain"))]
        edits += [(*d.span(), ".") for d in _SAID_DOT.finditer(text, _name_start(text, m.start()), m.start())]
    for m in re.finditer(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?:\s+dot\s+[A-Za-z0-9-]+)+", text, re.I):
        edits += [(*d.span(), ".") for d in _SAID_DOT.finditer(text, *m.span())]
    return _disjoint(edits)


# Digit words of the four languages.
_DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
_ONE_WORD = "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True))
_GAP = rf"(?:\s{{0,3}}\.\s{{0,3}}|\s+(?:{_DOT_WORD})\s+|[\s,-]{{1,3}})"
_SPELLED = re.compile(rf"(?<!\w)(?:{_ONE_WORD})(?:{_GAP}(?:{_ONE_WORD}|[0-9]+))*(?:{_GAP}(?:{_ONE_WORD}))(?!\w)", re.I)
_TOKEN = re.compile(rf"(?<!\w)(?:{_ONE_WORD})(?!\w)|[0-9]+|\.|(?<!\w)(?:{_DOT_WORD})(?!\w)", re.I)
_PLUS = re.compile(r"(?<!\w)(?:plus|más|mas)[\s-]+$", re.I)
_APART = bytes(i if i > 127 or chr(i).isalnum() else 32 for i in range(256))
_DIGIT_BYTES = frozenset(w.encode() for w in _DIGIT_WORDS)
#: Spelled digits that a run must have.
LEAST = 4


def spelled_digits(text: str) -> list[tuple[int, int, str]]:
    """``plus one five five five ...``: the digits close up, spelled dots become dots."""
    edits: list[tuple[int, int, str]] = []
    words = text.lower().encode("utf-8", "surrogatepass").translate(_APART).split()
    if sum(map(_DIGIT_BYTES.__contains__, words)) < LEAST - 2:  # the outer two may touch other signs
        return edits
    for m in _SPELLED.finditer(text):
        tokens = list(_TOKEN.finditer(text, *m.span()))
        if sum(t[0].lower() in _DIGIT_WORDS for t in tokens) < LEAST:
            continue
        plus = _PLUS.search(text, max(0, m.start() - 8), m.start())
        if plus:
            edits.append((*plus.span(), "+"))
        at = m.start()
        for t in tokens:
            low = t[0].lower()
            put = _DIGIT_WORDS.get(low, t[0] if t[0][0] in "0123456789" else ".")
            edits.append((at, t.end(), put))
            at = t.end()
    return _disjoint(edits)


def _disjoint(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for edit in sorted(edits):
        if not out or edit[0] >= out[-1][1]:
            out.append(edit)
    return out


CHAIN: tuple[Callable[[str], list[tuple[int, int, str]]], ...] = (
    look_alikes, marked_at_and_dot, said_at_and_dot, spelled_digits)


def hidden_spans(text: str, plain: list[Span]) -> list[Span]:
    """Spans found only after rewriting, in places of the original text, that do not lie inside a
    plain one of their kind or inside one another; they may reach beyond a plain one."""
    copy = Rewritten(text)
    for step in CHAIN:
        copy.apply(step(copy.text))
    if not copy.touched:
        return []
    out: list[Span] = []
    # Plain spans of a kind are in order and apart: one that holds a place is the last to begin before it.
    known = {k: [p for p in plain if p.kind == k] for k in range(len(KINDS))}
    starts = {k: [p.start for p in spans] for k, spans in known.items()}
    reached = [-1] * len(KINDS)
    for span in plain_spans(copy.text):
        start, end, touched = copy.source(span.start, span.end)
        if span.kind == 0 and not re.search(r"\.[A-Za-z]{2,}$", copy.text[span.start:span.end]):
            continue
        if not touched or start >= end or end <= reached[span.kind]:
            continue
        before = bisect_right(starts[span.kind], start) - 1
        if before < 0 or known[span.kind][before].end < end:
            out.append(Span(span.kind, start, end))
            reached[span.kind] = end
    return out


def written(spans: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in sorted(spans))


# ---- on tables -----------------------------------------------------------------------------------


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Findings per row: counts of plain spans by kind, digest of the plain spans, all spans.

    (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_hidden): places are code points,
    ends exclusive; the counts and the digest are of plain spans, ``n_hidden`` counts those that
    only the rewriting shows. A null text counts as empty and has none; texts are read whole; a
    repeated row gets the same answer each time; other columns are not read.
    """
    inner = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = dict(inner.dtypes)["doc_id"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for text in batch.column("text").to_pylist():
                plain = plain_spans(text) if text else []
                hidden = hidden_spans(text, plain) if text else []
                for k in range(4):
                    columns[k].append(sum(s.kind == k for s in plain))
                columns[4].append(hashlib.sha256(written(plain).encode()).hexdigest())
                columns[5].append(written([*plain, *hidden]))
                columns[6].append(len(hidden))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types)]],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_hidden"])

    return inner.mapInArrow(
        work, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_hidden long")


def masked(text: str | None) -> str | None:
    """The text with every finding replaced by its kind in angle brackets; overlapping findings
    become one, named after the first."""
    if not text:
        return text
    plain = plain_spans(text)
    out, at = [], 0
    for span in sorted([*plain, *hidden_spans(text, plain)], key=lambda s: (s.start, -s.end)):
        if span.start >= at:
            out += [text[at:span.start], f"<{KINDS[span.kind]}>"]
        at = max(at, span.end)
    return "".join([*out, text[at:]]) if out else text


def mask(docs: DataFrame, text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """All rows and columns with personal data masked in the text; the length column, if there is
    one, follows the text. Null texts stay null."""
    names = docs.columns
    place = names.index(text_column)
    has_length = length_column in names

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_column):
            texts = batch.column(place).to_pylist()
            out = [masked(t) for t in texts]
            columns = list(batch.columns)
            columns[place] = pa.array(out, columns[place].type)
            if has_length:
                at = names.index(length_column)
                old = columns[at].to_pylist()
                columns[at] = pa.array([o if new == was else len(new) for o, new, was in zip(old, out, texts)], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(work, docs.schema)
