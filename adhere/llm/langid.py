"""Language identification by rank-order profiles of character n-grams.

A language's profile is its most frequent n-grams in rank order. A document's
own most frequent n-grams are compared to each profile by the out-of-place
distance: the sum of how far each n-gram's rank is from its rank in the profile,
with the profile's length for n-grams it lacks. The nearest profile wins.

Words are runs of lower-cased letters with a blank before and behind; n-grams of
one to three characters lie inside them. They are counted for many texts at once
on numpy arrays; training sends one count per language, n-gram and task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import held_out, stored, table

PROFILE, LONGEST = 400, 3
UNKNOWN = "und"
#: Characters counted together. A longer text is counted in steps that end between
#: words, at a blank if there is one; a longer run of letters is one step.
STEP_CHARS = 1 << 20
#: Counting space (texts x possible n-grams) up to which counts are direct, without a sort.
DIRECT = 1 << 23
#: Code points up to here fit three times into a bigint.
BITS = 21
BLANK = 0x20


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _pieces(texts: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Groups of (pieces, text numbers): several whole texts, or one piece of a long text."""
    pieces, numbers, size = [], [], 0
    for number, text in enumerate(texts):
        at, long = 0, len(text) > STEP_CHARS
        if long and pieces:
            yield pieces, np.array(numbers)
            pieces, numbers, size = [], [], 0
        while at < len(text):
            end = min(len(text), at + STEP_CHARS)
            if end < len(text):
                end = _border(text, at, end)
            pieces.append(text[at:end])
            numbers.append(number)
            size += end - at
            at = end
            if size >= STEP_CHARS or long:
                yield pieces, np.array(numbers)
                pieces, numbers, size = [], [], 0
    if pieces:
        yield pieces, np.array(numbers)


def _border(text: str, at: int, end: int) -> int:
    """A place between words: the last blank before ``end``, or another one that is no letter."""
    cut = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end))
    if cut > at:
        return cut
    for k in range(end, at, -1):
        if not text[k].isalpha():
            return k
    return next((k for k in range(end, len(text)) if not text[k].isalpha()), len(text))


def _count_step(pieces: list[str], numbers: np.ndarray) -> tuple[np.ndarray, ...]:
    """(number, n-gram, count), sorted by both, of the pieces of one step."""
    lowered = [piece.lower() for piece in pieces]
    raw = np.frombuffer((" " + "  ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"),
                        np.uint32)
    names, place = np.unique(numbers, return_inverse=True)
    owner = np.repeat(place.astype(np.int64), [len(t) + 2 for t in lowered])
    letter = letters()[raw]
    # One blank stands before and behind each word; pieces have their own blanks.
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:-1] |= letter[1:]
    raw, letter, owner = raw[keep], letter[keep], owner[keep]
    if not len(raw):
        return owner, owner, owner
    seen = np.zeros(0x110000, bool)
    seen[raw[letter]] = True
    alphabet = np.concatenate([[BLANK], np.flatnonzero(seen)])
    index = np.zeros(0x110000, np.int64)
    index[alphabet[1:]] = np.arange(1, len(alphabet))
    code, k = np.where(letter, index[raw], 0), len(alphabet)
    # Codes of one, two and three characters follow each other: c, k + ck + c, ...
    # Neighbouring blanks, of two words or two pieces, and blanks inside end a word.
    two = letter[1:] | letter[:-1]
    three = two[1:] & two[:-1] & letter[1:-1]
    space = k + k * k + k ** 3
    pair = code[:-1] * k + code[1:]
    key = np.concatenate([
        owner[letter] * space + code[letter],
        owner[1:][two] * space + k + pair[two],
        owner[2:][three] * space + k + k * k + (pair[:-1] * k + code[2:])[three]])
    if len(names) * space <= DIRECT:
        n = np.bincount(key)
        key = np.flatnonzero(n)
        n = n[key]
    else:
        key = np.sort(key.astype(np.uint32) if len(names) * space < 2 ** 32 else key)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, n = key[first].astype(np.int64), np.diff(np.append(first, len(key)))
    text, gram = names[key // space], key % space
    long = gram >= k + k * k
    mid = ~long & (gram >= k)
    gram = gram - k * (mid | long) - k * k * long
    packed = alphabet[gram % k]
    packed = packed | np.where(mid | long, alphabet[gram // k % k] << BITS, 0)
    return text, packed | np.where(long, alphabet[gram // (k * k)] << 2 * BITS, 0), n


def _summed(steps: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Counts of several steps put together."""
    if len(steps) == 1:
        return steps[0]
    text, gram, n = map(np.concatenate, zip(*steps))
    order = np.lexsort((gram, text))
    text, gram, n = text[order], gram[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])]))
    return text[first], gram[first], np.add.reduceat(n, first)


def count_grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, n-gram, count), sorted by both, a few texts at a time, each text whole.

    An n-gram is the integer of its code points; texts without letters do not come.
    """
    held: list[tuple[np.ndarray, ...]] = []
    for now in (_count_step(*step) for step in _pieces(texts)):
        if not len(now[0]):
            continue
        if held and held[0][0][0] != now[0][0]:
            yield _summed(held)
            held = []
        # Only pieces of one long text begin with the same text.
        held.append(now)
        if len(held) == 16:
            held = [_summed(held)]
    if held:
        yield _summed(held)


def learn_profiles(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """(lang, gram, place) from rows of (text, lang): the ``size`` commonest n-grams of each.

    Ties go to the smaller n-gram. Rows with a null text or lang teach nothing.
    All rows are counted; each task sends one count per language and n-gram, and
    the ranking keeps the first places of each task before its shuffle.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, pd.Series] = {}
        for pdf in batches:
            for name, texts in pdf.groupby("lang")["text"]:
                for pieces, _ in _pieces(texts.tolist()):
                    _, gram, n = _count_step(pieces, np.zeros(len(pieces), np.int64))
                    counted = pd.Series(n, index=gram)
                    totals[name] = (totals[name].add(counted, fill_value=0)
                                    if name in totals else counted)
        for name, counted in totals.items():
            yield pd.DataFrame({"lang": name, "gram": counted.index.to_numpy(np.int64),
                                "n": counted.to_numpy(np.int64)})

    counts = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInPandas(
        run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("place", F.row_number().over(
        W.partitionBy("lang").orderBy(F.col("n").desc(), "gram")))
    return ranked.where(F.col("place") <= size).select("lang", "gram", "place")


class Profiles:
    """Places of n-grams by language, as arrays; ``size`` times the languages at most."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int) -> None:
        self.size = size
        self.langs = sorted({lang for lang, _, _ in rows})
        self.grams = np.array(sorted({gram for _, gram, _ in rows}), np.int64)
        # The last row stands for n-grams no profile has.
        self.places = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int32)
        for lang, gram, place in rows:
            self.places[np.searchsorted(self.grams, gram), self.langs.index(lang)] = place

    def classify(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        for doc, gram, n in count_grams(texts) if self.langs else ():
            # In order of text, count and n-gram: one plain sort, the place as last digits.
            base, most, m = doc[0], int(n.max()), len(doc)
            order = np.sort(((doc - base) * (most + 1) + most - n) * m + np.arange(m)) % m
            starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            place = np.arange(m) - np.repeat(starts, np.diff(np.append(starts, m))) + 1
            top = place <= self.size
            doc, gram, place = doc[top], gram[order][top], place[top]
            at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
            known = self.places[np.where(self.grams[at] == gram, at, len(self.grams))]
            away = np.where(known < 0, self.size,
                            np.minimum(np.abs(known - place[:, None]), self.size))
            starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            total = np.add.reduceat(away, starts, axis=0)
            used = np.diff(np.append(starts, len(doc)))
            nearest = total.argmin(axis=1)
            best[doc[starts]] = nearest
            score[doc[starts]] = 1 - total[np.arange(len(starts)), nearest] / (used * self.size)
        return [self.langs[b] if b >= 0 else UNKNOWN for b in best], score


def identify(docs: DataFrame, profiles: DataFrame, size: int = PROFILE) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of ``docs`` (doc_id, text).

    Profiles come to the driver: ``size`` rows per language. The score is one
    less the distance over the largest distance possible. A text that is null
    or has no letter is ``und`` with score 0, as is every text without profiles.
    Equal distances go to the language first by code point. Rows are independent of each other:
    repeated rows repeat results, null ids stay, other columns are not read.
    """
    known = Profiles([tuple(r) for r in profiles.select("lang", "gram", "place").collect()], size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = known.classify([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, lang_pred string, score double")


def learned(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """Profiles from the documents that are not held out, stored."""
    return stored(learn_profiles(docs.where(~held_out(F.col("doc_id"))), size), "profiles")


def accepted(docs: DataFrame, profiles: DataFrame, least: float = 0.0) -> DataFrame:
    """The documents in a known language, with a score above ``least``, all columns kept."""
    known = Profiles([tuple(r) for r in profiles.select("lang", "gram", "place").collect()], PROFILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            langs, scores = known.classify([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(
                [lang != UNKNOWN and s > least for lang, s in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learned(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
