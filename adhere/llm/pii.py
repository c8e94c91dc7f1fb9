"""Personal data, also in disguise, with offsets of the source text.

Four plain detectors (email, IP address, card, phone) run over each whole text.
Transducers then rewrite disguises: look-alike characters, invisible characters
and digits of other scripts to ASCII; ``(at)``, ``[dot]``, entities and the words
between names; runs of digits of which some are spelled. Each rewriting step keeps, for every character
it writes, the source characters it stands for. The same detectors run over the
rewritten text, and what they find in rewritten places is mapped back.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A whole run of digits is taken at once, so a long one is read only once.
DIGIT_RUN = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

# Letters of other scripts that look like ASCII letters.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
    "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ո": "n",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ℓ": "l", "․": ".", "。": ".", "｡": ".", "‚": ",",
}
DASHES = "‐‑‒–—−﹣"
BLANKS = "              　"
INVISIBLE = "­​‌‍⁠﻿"
# Digits as words, in the languages of the texts.
SPELLED = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
DIGIT_OF = {word: str(i) for line in SPELLED for i, word in enumerate(line.split())} | {"oh": "0"}
AT_WORDS, DOT_WORDS, PLUS_WORDS = "at|ät|arroba|arobase", "dot|punkt|point|punto", "plus|más"
#: Fewer digits in a row are ordinary words; so are fewer spelled ones among them, unless a
#: phone with its sign, a card or an address comes out.
LEAST_DIGITS, LEAST_SPELLED = 7, 3

_digit = "(?:" + "|".join(sorted(DIGIT_OF, key=len, reverse=True)) + ")"
_gap = rf"(?:\s{{1,3}}(?:{DOT_WORDS})\s{{1,3}}|[\s,.\-/]{{1,3}})"
_token = rf"(?:{_digit}|[0-9]{{1,19}})\b"
SPELLED_RUN = re.compile(rf"\b{_digit}\b(?:{_gap}{_token})*", re.IGNORECASE)
ANY_DIGIT = re.compile(r"[0-9]")
DIGIT_TOKEN = re.compile(rf"\b{_token}", re.IGNORECASE)
# What may stand before a run: a sign, its word, or digits written as digits.
BEFORE_RUN = re.compile(rf"(?:(?:\b(?:{PLUS_WORDS})[\s,\-]{{1,3}}|\+\s?)(?:[0-9]{{1,19}}{_gap}){{0,19}}"
                        rf"|\b(?:[0-9]{{1,19}}{_gap}){{1,19}})\Z", re.IGNORECASE)
_open, _close = r"\s{0,3}[\[({<]\s{0,3}", r"\s{0,3}[\])}>]\s{0,3}"
BRACKETED = re.compile(rf"{_open}(?:({AT_WORDS}|@)|(?:{DOT_WORDS}|\.)){_close}", re.IGNORECASE)
BARE = re.compile(
    rf"(?<![^\s<(\[,;:])[A-Za-z0-9._%+-]++(\s{{1,3}}(?:{AT_WORDS})\s{{1,3}}|\s{{0,3}}@\s{{0,3}})"
    rf"(?:[A-Za-z0-9-]++(?:\s{{1,3}}(?:{DOT_WORDS})\s{{1,3}}|\.))+"
    rf"(?!(?:{DOT_WORDS})\b)[A-Za-z]{{2,}}+\b",
    re.IGNORECASE)
BARE_DOT = re.compile(rf"\s{{1,3}}(?:{DOT_WORDS})\s{{1,3}}", re.IGNORECASE)
# An address with a plain dot needs a name that is no word: letters and a digit, dot or underscore.
INNER_DOT = re.compile(r"\.[A-Za-z0-9]")
AT_DOMAIN = re.compile(rf"\s(?:{AT_WORDS})\s{{1,3}}[a-z0-9-]++\.[a-z0-9-]", re.IGNORECASE)
BLANK_AT = re.compile(r"\s@|@\s")
BARE_AT = re.compile(
    rf"(?<![^\s<(\[,;:])(?=[^\s@]*[a-z])(?=[^\s@]*[._0-9])[a-z0-9._%+-]++(\s{{1,3}}(?:{AT_WORDS})\s{{1,3}})"
    rf"(?:[a-z0-9-]++\.)+[a-z]{{2,}}+\b", re.IGNORECASE)
# Joined by signs instead of blanks: name_at_host_dot_org.
SIGNED = re.compile(
    rf"(?<![A-Za-z0-9.+])[A-Za-z0-9.+]++([_-](?:{AT_WORDS})[_-])[A-Za-z0-9]++"
    rf"(?:[_-](?:{DOT_WORDS})[_-][A-Za-z0-9]++)+", re.IGNORECASE)
SIGNED_GATE = re.compile(rf"[_-](?:{DOT_WORDS})[_-]", re.IGNORECASE)
SIGNED_DOT = re.compile(rf"[_-](?:{DOT_WORDS})[_-]", re.IGNORECASE)
ENTITY = re.compile(r"&(?:(commat|#0{0,5}64|#x0{0,5}40)|(?:period|#0{0,5}46|#x0{0,5}2e));", re.IGNORECASE)
OPENED = re.compile(r"[\[({<]\s{0,3}(?:[A-Za-zä]{2,7}|[@.])\s{0,3}[\])}>]")
AS_BLANKS = str.maketrans(",.-/", "    ")
DOTS = frozenset(DOT_WORDS.split("|"))
DOTTED_NUMBERS = re.compile(
    rf"(?<![\w.])[0-9]{{1,3}}(?:(?:\s{{1,3}}(?:{DOT_WORDS})\s{{1,3}}|\.)[0-9]{{1,3}}){{3}}(?![\w.])",
    re.IGNORECASE)

Span = tuple[str, int, int]


@lru_cache(maxsize=1)
def ascii_of() -> dict[int, str | None]:
    """Code point to the ASCII character it passes for; None for invisible ones."""
    # Styled letters and digits: those whose compatibility form is one ASCII letter or digit.
    table_ = {c: plain for c in range(128, 0x20000)
              if len(plain := unicodedata.normalize("NFKC", chr(c))) == 1
              and plain.isascii() and plain.isalnum()}
    table_ |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    table_ |= {c: str(unicodedata.decimal(chr(c))) for c in range(128, sys.maxunicode + 1)
               if unicodedata.decimal(chr(c), None) is not None}
    table_ |= {ord(k): v for k, v in LOOK_ALIKES.items()}
    table_ |= {ord(c): "-" for c in DASHES} | {ord(c): " " for c in BLANKS}
    return table_ | {ord(c): None for c in INVISIBLE}


@lru_cache(maxsize=1)
def disguised_character() -> re.Pattern:
    return re.compile("[" + "".join(map(re.escape, map(chr, sorted(ascii_of())))) + "]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _part_fits(part: str) -> bool:
    kept = part.lstrip("0")
    return len(kept) <= 3 and int(kept or "0") <= 255


def plain_spans(text: str) -> list[Span]:
    """Base spans, leftmost and non-overlapping per kind, by kind and start."""
    found: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append(("email", start, match.end()))
            last = match.end()
        at = text.find("@", max(at + 1, last))
    ips, cards, phones = [], [], []
    for match in DIGIT_RUN.finditer(text):
        if match.group(1) and all(map(_part_fits, match.group().split("."))):
            ips.append(("ip", match.start(), match.end()))
    for match in CARD.finditer(text):
        if match.end() - match.start() >= 16:
            digits = NOT_DIGIT.sub("", match.group())
            if 16 <= len(digits) <= 19 and _luhn(digits):
                cards.append(("card", match.start(), match.end()))
    if "+" in text:
        for match in PHONE.finditer(text):
            if 8 <= len(NOT_DIGIT.sub("", match.group())) <= 15:
                phones.append(("phone", match.start(), match.end()))
    return found + ips + cards + phones


class Rewritten:
    """A rewritten text; for each of its characters the source span it stands for."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.start = np.arange(len(text))
        self.end = self.start + 1
        self.changed = np.zeros(len(text), bool)

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces non-overlapping spans (start, end, new), in order of their starts."""
        if not edits:
            return
        texts, starts, ends, changed, last = [], [], [], [], 0
        for start, end, new in edits:
            texts += [self.text[last:start], new]
            starts += [self.start[last:start], np.full(len(new), self.start[start])]
            ends += [self.end[last:start], np.full(len(new), self.end[end - 1])]
            changed += [self.changed[last:start], np.ones(len(new), bool)]
            last = end
        self.text = "".join([*texts, self.text[last:]])
        self.start = np.concatenate([*starts, self.start[last:]])
        self.end = np.concatenate([*ends, self.end[last:]])
        self.changed = np.concatenate([*changed, self.changed[last:]])

    def source(self, start: int, end: int) -> tuple[int, int] | None:
        """The source span of a rewritten span; None if nothing in it was rewritten.

        An invisible character inside leaves no character, but a gap.
        """
        first, last = int(self.start[start]), int(self.end[end - 1])
        gaps = (self.start[start + 1:end] > self.end[start:end - 1]).any()
        return (first, last) if gaps or self.changed[start:end].any() else None


def _characters(text: Rewritten) -> None:
    if text.text.isascii():
        return
    known = ascii_of()
    # A text has few different characters: looking each up is cheaper than a search.
    if not any(ord(c) in known for c in set(text.text)):
        return
    text.apply([(m.start(), m.end(), known[ord(m.group())] or "")
                for m in disguised_character().finditer(text.text)])


def _separators(text: Rewritten) -> None:
    if "&" in text.text:
        text.apply([(m.start(), m.end(), "@" if m.group(1) else ".")
                    for m in ENTITY.finditer(text.text)])
    if OPENED.search(text.text):
        text.apply([(m.start(), m.end(), "@" if m.group(1) else ".")
                    for m in BRACKETED.finditer(text.text)])
    if SIGNED_GATE.search(text.text):
        edits = []
        for match in SIGNED.finditer(text.text):
            edits.append((*match.span(1), "@"))
            edits += [(m.start(), m.end(), ".")
                      for m in SIGNED_DOT.finditer(text.text, match.end(1), match.end())]
        text.apply(edits)
    if INNER_DOT.search(text.text) and AT_DOMAIN.search(text.text):
        text.apply([(*m.span(1), "@") for m in BARE_AT.finditer(text.text)])
    if DOTS.isdisjoint(_words(text.text)) and not BLANK_AT.search(text.text):
        return
    edits, from_ = [], 0
    while match := BARE.search(text.text, from_):
        at = match.span(1)
        dots = [(m.start(), m.end(), ".") for m in BARE_DOT.finditer(text.text, at[1], match.end())]
        # A word for the sign counts only beside a word for a dot; BARE_AT has the named ones.
        if not dots and "@" not in match.group(1):
            from_ = at[0] + 1
            continue
        if match.group(1) != "@":
            edits.append((*at, "@"))
        edits += dots
        from_ = match.end()
    text.apply(edits)
    text.apply([(m.start(), m.end(), ".") for run in DOTTED_NUMBERS.finditer(text.text)
                for m in BARE_DOT.finditer(text.text, run.start(), run.end())])


def _words(text: str) -> list[str]:
    return text.lower().translate(AS_BLANKS).split() if text.isascii() else (
        text.lower().replace(",", " ").replace(".", " ").replace("-", " ").replace("/", " ").split())


def _digits(text: Rewritten) -> None:
    edits, last = [], 0
    for run in SPELLED_RUN.finditer(text.text):
        earliest = max(last, run.start() - 64)
        # Without a digit as such, as many words as digits are needed.
        if run.end() - run.start() < 2 * LEAST_DIGITS and not ANY_DIGIT.search(
                text.text, earliest, run.end()):
            continue
        before = BEFORE_RUN.search(text.text, earliest, run.start())
        start = before.start() if before else run.start()
        tokens = list(DIGIT_TOKEN.finditer(text.text, start, run.end()))
        values = [DIGIT_OF.get(t.group().lower(), t.group()) for t in tokens]
        spelled = sum(t.group().lower() in DIGIT_OF for t in tokens)
        if sum(map(len, values)) < LEAST_DIGITS:
            continue
        gaps = [text.text[a.end():b.start()].lower().split() for a, b in zip(tokens, tokens[1:])]
        signed = tokens[0].start() > start
        address = _is_address(values, gaps)
        if spelled < LEAST_SPELLED and not address and not _is_number(values, gaps, signed):
            continue
        if signed:
            edits.append((start, tokens[0].start(), "+"))
        for i, (token, value) in enumerate(zip(tokens, values)):
            if i:
                dot = DOTS & set(gaps[i - 1]) or address and gaps[i - 1] == ["."]
                edits.append((tokens[i - 1].end(), token.start(), "." if dot else ""))
            if value != token.group():
                edits.append((token.start(), token.end(), value))
        last = run.end()
    text.apply(edits)


def _is_number(values: list[str], gaps: list[list[str]], signed: bool) -> bool:
    """Whether digits without a dot word among them are a phone with its sign or a card."""
    digits = "".join(values)
    return not any(DOTS & set(g) for g in gaps) and (
        signed and 8 <= len(digits) <= 15 or 16 <= len(digits) <= 19 and _luhn(digits))


def _is_address(values: list[str], gaps: list[list[str]]) -> bool:
    """Whether digits with dots or words for them are an IP address."""
    joined = values[0] + "".join(
        ("." if g == ["."] or DOTS & set(g) else "") + v for v, g in zip(values[1:], gaps))
    parts = joined.split(".")
    return len(parts) == 4 and all(map(_part_fits, parts))


def disguised_spans(text: str, plain: list[Span]) -> list[Span]:
    """Spans only a rewritten text shows, in source offsets; none overlaps a plain one of its kind."""
    rewritten = Rewritten(text)
    for step in (_characters, _separators, _digits):
        step(rewritten)
    if rewritten.text is text:
        return []
    ends = {kind: [b for k, _, b in plain if k == kind] for kind in KINDS}
    starts = {kind: [a for k, a, _ in plain if k == kind] for kind in KINDS}
    found = []
    for kind, start, end in plain_spans(rewritten.text):
        span = rewritten.source(start, end)
        if not span:
            continue
        # The first plain span that ends behind this one's start begins behind its end.
        next_ = bisect_right(ends[kind], span[0])
        if next_ == len(ends[kind]) or starts[kind][next_] >= span[1]:
            found.append((kind, *span))
    return found


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(
        spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text).

    Columns: doc_id; n_email, n_ip, n_card, n_phone, base_sha256 of the plain
    spans; spans, all of them; n_disguised, how many of these the method added.
    Offsets are code points, ends exclusive. A null text is an empty one and has
    no spans. Whole texts are read. Rows are independent of each other: repeated
    rows repeat results, null ids stay, other columns are not read, an empty
    table gives no rows.
    """
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_disguised"]
    schema = ", ".join(f"{n} {'string' if n in ('base_sha256', 'spans') else 'bigint'}"
                       for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                plain = plain_spans(text)
                added = disguised_spans(text, plain)
                counts = [sum(k == kind for k, _, _ in plain) for kind in KINDS]
                base = _joined(plain)
                rows.append((*counts, hashlib.sha256(base.encode()).hexdigest(),
                             _joined(plain + added) if added else base, len(added)))
            columns = list(zip(*rows)) or [()] * 7
            types = [pa.string() if n in ("base_sha256", "spans") else pa.int64()
                     for n in names[1:]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, schema)


def op4_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
