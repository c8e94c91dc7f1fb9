"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Texts are cut where neither tokenizer joins what stands on both sides (a blank between
two visible characters), so the pieces of a chunk are encoded once each and the
tokens of a document are those of its pieces in order. Tokens are placed by their bytes;
``pandas.merge_asof``, keyed by document, finds for each token start the other side's
token that covers it, both ways, and the union of both ways is all overlaps.
Where tokens of both sides end together, a group ends.

Equal groups have equal links, so a chunk stores one number per group of a text, the
links of each different group once, and how often it links each pair of ids. These
counts are summed over the corpus; each chunk asks for those of its own pairs, and
so neither texts nor tokens are shuffled, and a frequent pair costs a row per chunk.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of text that one chunk holds, more only where a piece is longer.
CHUNK_CHARS = 1 << 20
#: Different pieces a partition remembers, about; a chunk may bring its own on top.
KNOWN_PIECES = 1 << 18
#: Pieces encoded in one call.
CALL_PIECES = 1 << 10
#: A blank between visible characters: no token of either side reaches over its left edge.
CUT = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
MIX = np.uint64(0x9E3779B97F4A7C15)

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
#: A chunk: its documents (or parts of them), the groups of each, and what the groups link.
#: Long arrays of numbers are bytes of 32-bit integers, which Spark passes on as they are.
CHUNK = ("chunk long, row array<long>, doc_id array<long>, n_a binary, n_b binary, digest array<string>, "
         "group_end binary, groups binary, link_end binary, links binary, a array<int>, b array<int>, n array<long>")
ANSWER = "row long, doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS) + ", groups_sha256 string"


def byte_level_alphabet() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for.

    Printable bytes stand for themselves, the others for 256 and on, in order.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Side:
    """One tokenizer: ids of pieces, the bytes of each id."""

    def __init__(self, bytes_of: list[bytes]) -> None:
        self.bytes_of = bytes_of
        self.lengths = np.array([len(b) for b in bytes_of], np.int64)

    def ids(self, pieces: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def spells(self, ids: list[int], raw: bytes) -> bool:
        return b"".join(map(self.bytes_of.__getitem__, ids)) == raw


class ByteLevel(Side):
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # of this Python worker; its core is one
        from tokenizers import Tokenizer
        self.made = Tokenizer.from_file(path)
        self.made.encode_special_tokens = True
        alphabet = byte_level_alphabet()
        entries = [self.made.id_to_token(i) for i in range(self.made.get_vocab_size())]
        super().__init__([bytes(alphabet[c] for c in e) if all(c in alphabet for c in e) else e.encode()
                          for e in entries])

    def ids(self, pieces: list[str]) -> list[list[int]]:
        encoded = self.made.encode_batch_fast([" " + p for p in pieces], add_special_tokens=False)
        return [e.ids for e in encoded]


class SentencePieces(Side):
    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor
        self.made = made = SentencePieceProcessor(model_file=path)
        names = [made.id_to_piece(i) for i in range(made.get_piece_size())]
        super().__init__([bytes([int(name[3:5], 16)]) if made.is_byte(i)
                          else name.replace("▁", " ").encode() for i, name in enumerate(names)])

    def ids(self, pieces: list[str]) -> list[list[int]]:
        return self.made.encode(pieces, num_threads=1)  # adds the blank itself


@lru_cache(maxsize=1)
def tokenizers(byte_level: str, pieces: str) -> tuple[Side, Side]:
    """Both sides, once per Python worker; their files are installed on every machine."""
    import public_tokenizers as public
    return ByteLevel(public.path(byte_level)), SentencePieces(public.path(pieces))


def _ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start, start + 1 ... of each range, one range after the other."""
    ends = np.cumsum(length)
    return np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Text:
    """A document while its steps go into chunks."""

    row: int
    doc_id: int | None
    digest: object = field(default_factory=hashlib.sha256)
    begun: bool = False


class Pieces:
    """The distinct pieces of a partition's texts and the tokens of each on both sides.

    Pieces are known until there are ``KNOWN_PIECES`` of them, and then are learned anew.
    """

    def __init__(self, sides: tuple[Side, Side]) -> None:
        self.sides = sides
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.good = np.zeros(0, bool)
        # Per side: ids, first place of each piece, their number.
        self.tokens = [(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in self.sides]

    def codes(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The numbers of each text's pieces; new pieces are encoded."""
        if len(self.numbers) > KNOWN_PIECES:
            self._forget()
        known = len(self.numbers)
        codes = [np.fromiter(map(self.numbers.__getitem__, t), np.int32, len(t)) for t in texts]
        new = list(islice(self.numbers, known, None))
        for start in range(0, len(new), CALL_PIECES):
            self._learn(new[start:start + CALL_PIECES])
        return codes

    def _learn(self, pieces: list[str]) -> None:
        raw = (" " + " ".join(pieces)).encode()
        sizes = pc.binary_length(pa.array(pieces, pa.large_string())).to_numpy().astype(np.int64) + 1
        good = np.ones(len(pieces), bool)
        for k, side in enumerate(self.sides):
            found = side.ids(pieces)
            counts = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum()))
            at = np.concatenate([[0], np.cumsum(side.lengths[ids])])[np.concatenate([[0], np.cumsum(counts)])]
            # All at once: equal bytes, and each piece ends where it should.
            if not ((np.diff(at) == sizes).all() and side.spells(ids.tolist(), raw)):
                good &= [side.spells(i, b" " + p.encode()) for p, i in zip(pieces, found)]
            old_ids, old_first, old_counts = self.tokens[k]
            self.tokens[k] = (np.concatenate([old_ids, ids]),
                              np.concatenate([old_first, len(old_ids) + np.cumsum(counts) - counts]),
                              np.concatenate([old_counts, counts]))
        self.good = np.concatenate([self.good, good])

    def spelled(self, codes: np.ndarray, pieces: list[str]) -> bool:
        """Whether the tokens' bytes are those of the text; only odd pieces need a look at them."""
        if self.good[codes].all():
            return True
        raw = b"".join(b" " + p.encode() for p in pieces)
        return all(side.spells(ids[_ragged(first[codes], n[codes])].tolist(), raw)
                   for side, (ids, first, n) in zip(self.sides, self.tokens))

    def stream(self, side: int, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of tokens of each text) of one side."""
        ids, first, n = self.tokens[side]
        counts = np.array([n[c].sum() for c in codes], np.int64)
        at = np.concatenate([np.zeros(0, np.int32), *codes])
        return ids[_ragged(first[at], n[at])], counts


def overlaps(a_start: np.ndarray, a_doc: np.ndarray, b_start: np.ndarray,
             b_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens whose byte ranges overlap, as (places on A, places on B).

    Each start finds the token of the other side that covers it in the same document; a
    pair that starts together is found both ways and taken once.
    """
    a = pd.DataFrame({"start": a_start, "doc": a_doc, "a": np.arange(len(a_start))})
    b = pd.DataFrame({"start": b_start, "doc": b_doc, "b": np.arange(len(b_start))})
    of_a = pd.merge_asof(a, b, on="start", by="doc")["b"].to_numpy(np.int64)
    of_b = pd.merge_asof(b, a, on="start", by="doc")["a"].to_numpy(np.int64)
    later = np.flatnonzero(a_start[of_b] != b_start) if len(b) else np.zeros(0, np.int64)
    return np.concatenate([np.arange(len(a)), of_b[later]]), np.concatenate([of_a, later])


def _group_hashes(ids: np.ndarray, place: np.ndarray, starts: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(1) + (place.astype(np.uint64) << np.uint64(32))
             + np.uint64(salt) * MIX) * MIX
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return np.add.reduceat(h, starts) if len(starts) else np.zeros(0, np.uint64)


def _kinds(a_ids, a_group, a_bounds, b_ids, b_group, b_bounds) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of equal groups from 0, and the first group of each number.

    Groups are put together by a hash, and every group is compared with the first of its number;
    a false match, if there ever is one, starts again with another hash.
    """
    bounds, n = (a_bounds, b_bounds), len(a_bounds[0])
    places = [np.arange(len(i)) - lo[g] for i, g, (lo, _) in zip(
        (a_ids, b_ids), (a_group, b_group), bounds)]
    salt = 1
    while True:
        key = _group_hashes(a_ids, places[0], a_bounds[0], salt) \
            + MIX * _group_hashes(b_ids, places[1], b_bounds[0], salt + 1)
        kind, different = pd.factorize(key)
        first = np.zeros(len(different), np.int64)
        first[kind[::-1]] = np.arange(n)[::-1]
        twin = first[kind]
        same = all((hi - lo == (hi - lo)[twin]).all() for lo, hi in bounds) and all(
            (ids == ids[lo[twin[g]] + p]).all() for ids, g, p, (lo, _) in zip(
                (a_ids, b_ids), (a_group, b_group), places, bounds))
        if same:
            return kind, first
        salt += 2


def pack(chunk: int, known: Pieces, parts: list[tuple[Text, np.ndarray, bool]],
         none: list[Text]) -> pa.RecordBatch:
    """One chunk: ``parts`` are (text, numbers of its pieces, whether it ends here)."""
    sides, chosen = known.sides, [codes for _, codes, _ in parts]
    (a_ids, n_a), (b_ids, n_b) = (known.stream(s, chosen) for s in (0, 1))
    ends = [np.cumsum(side.lengths[ids]) for side, ids in zip(sides, (a_ids, b_ids))]
    starts = [e - side.lengths[ids] for e, side, ids in zip(ends, sides, (a_ids, b_ids))]
    docs = [np.repeat(np.arange(len(parts)), n) for n in (n_a, n_b)]
    link_a, link_b = overlaps(starts[0], docs[0], starts[1], docs[1])
    # Bytes are the same on both sides, so their places are too; each text ends a group.
    cuts = [np.isin(ends[0], ends[1], assume_unique=True), np.isin(ends[1], ends[0], assume_unique=True)]
    group = [np.cumsum(c) - c for c in cuts]
    n = int(cuts[0].sum())
    ends_at = [np.flatnonzero(c) + 1 for c in cuts]
    a_bounds, b_bounds = ((np.concatenate([[0], e])[:-1], e) for e in ends_at)
    kind, first = _kinds(a_ids, group[0], a_bounds, b_ids, group[1], b_bounds)
    group_end = np.searchsorted(docs[0][cuts[0]], np.arange(len(parts)), side="right")

    names = [",".join(map(str, a_ids[a0:a1].tolist())) + "|" + ",".join(map(str, b_ids[b0:b1].tolist()))
             for a0, a1, b0, b1 in zip(*(x[first].tolist() for x in (*a_bounds, *b_bounds)))]
    kinds, digests, begin = kind.tolist(), [], 0
    for (text, _, last), end in zip(parts, group_end.tolist()):
        line = ";".join([names[k] for k in kinds[begin:end]])
        text.digest.update(((";" if text.begun else "") + line).encode())
        text.begun = True
        digests.append(text.digest.hexdigest() if last else None)
        begin = end

    # Links of the first group of each kind, and how often each pair of ids is linked.
    of = group[0][link_a]
    shown = first[kind[of]] == of
    of_kind = kind[of[shown]]
    order = np.argsort(of_kind, kind="stable")
    of_kind = of_kind[order]
    pair_key = (a_ids[link_a[shown]].astype(np.int64) << 32 | b_ids[link_b[shown]])[order]
    pair, keys = pd.factorize(pair_key)
    times = np.bincount(kind, minlength=len(first))
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, pair, times[of_kind])

    rows = [t for t, _, _ in parts] + none
    rest = [0] * len(none)
    values = {
        "chunk": chunk, "row": [t.row for t in rows], "doc_id": [t.doc_id for t in rows],
        "n_a": n_a.tolist() + rest, "n_b": n_b.tolist() + rest, "digest": digests + [""] * len(none),
        "group_end": np.concatenate([group_end, np.full(len(none), n)]), "groups": kind,
        "link_end": np.searchsorted(of_kind, np.arange(len(first)), side="right"), "links": pair,
        "a": keys >> 32, "b": keys & 0xFFFFFFFF, "n": counts}
    schema = arrow_schema(CHUNK)
    return pa.RecordBatch.from_arrays(
        [pa.array([np.asarray(values[f.name], np.int32).tobytes() if f.type == pa.binary() else values[f.name]],
                  f.type) for f in schema], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    kinds |= {f"array<{k}>": pa.list_(v) for k, v in kinds.items()} | {"binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def _steps(pieces: list[str], chars: int) -> Iterator[list[str]]:
    step, held = [], 0
    for piece in pieces:
        step.append(piece)
        held += len(piece) + 1
        if held >= chars:
            yield step
            step, held = [], 0
    if step:
        yield step


def chunks(texts: Iterator[tuple[int | None, str | None]], sides: tuple[Side, Side], part: int,
           chars: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Chunks of bounded size; a text longer than one goes through several, in steps."""
    made = rows = 0
    known = Pieces(sides)
    held: list[tuple[Text, list[str]]] = []
    none: list[Text] = []
    size = 0

    def number(count: int) -> int:
        return part << 33 | count

    def flush() -> pa.RecordBatch:
        codes = known.codes([pieces for _, pieces in held])
        parts = []
        for (text, pieces), own in zip(held, codes):
            if known.spelled(own, pieces):
                parts.append((text, own, True))
            else:
                none.append(text)
        return pack(number(made), known, parts, none)

    for doc_id, raw in texts:
        text = Text(number(rows), doc_id)
        rows += 1
        if not raw:
            none.append(text)
            size += 32
        elif len(raw) < chars:
            held.append((text, CUT.split(raw)))
            size += len(raw)
        else:
            steps = list(_steps(CUT.split(raw), chars))
            # Whether it has tokens at all is known before the first link counts.
            if all(known.spelled(known.codes([s])[0], s) for s in steps):
                for k, step in enumerate(steps):
                    yield pack(number(made), known, [(text, known.codes([step])[0], k == len(steps) - 1)], [])
                    made += 1
            else:
                none.append(text)
        if size >= chars:
            yield flush()
            made += 1
            held, none, size = [], [], 0
    if held or none:
        yield flush()


def _answers(key: tuple, chunk: pa.Table, counts: pa.Table) -> pa.Table:
    """The rows of one chunk, with the corpus-wide counts of its pairs."""
    schema = arrow_schema(ANSWER)
    if not chunk.num_rows:
        return schema.empty_table()
    get, number = {}, {}
    for c in chunk.column_names[1:]:
        value = chunk.column(c).combine_chunks()
        if pa.types.is_binary(value.type):
            number[c] = np.frombuffer(value[0].as_buffer(), np.int32)
        else:
            get[c] = value.flatten()
            if c not in ("doc_id", "digest"):
                number[c] = get[c].to_numpy(zero_copy_only=False)
    own = number["a"].astype(np.int64) << 32 | number["b"]
    asked = counts.column("a").to_numpy().astype(np.int64) << 32 | counts.column("b").to_numpy()
    order = np.argsort(asked)
    at = order[np.searchsorted(asked[order], own)] if len(own) else np.zeros(0, np.int64)

    def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[ends]
        return np.diff(total, prepend=0)

    links, groups = number["links"], number["groups"]
    per_link = {"n_links": np.ones(len(links), np.int64),
                "n_best": counts.column("best").to_numpy(zero_copy_only=False)[at][links],
                "count_sum": counts.column("total").to_numpy()[at][links]}
    out = {c: sums(sums(v, number["link_end"])[groups], number["group_end"]) for c, v in per_link.items()}
    out |= {"n_a": number["n_a"], "n_b": number["n_b"],
            "n_groups": np.diff(number["group_end"], prepend=0),
            "row": number["row"], "doc_id": get["doc_id"], "groups_sha256": get["digest"]}
    return pa.table([pa.array(out[f.name], f.type) for f in schema], schema=schema)


def align(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES,
          chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256.

    Side A is the byte-level tokenizer, side B the piece tokenizer, each over a blank and the whole text.
    An id pair's count is the number of links that hold it in all of ``docs``; n_best counts the
    links whose count is the highest of their B id, ties included; count_sum adds the counts.
    Null and empty texts, and texts whose tokens do not spell them, have no tokens: zeros and ''.
    Strings of special tokens are plain text. Repeated rows each count and
    give a row, null ids stay null, other columns are not read, an empty table gives no rows.
    A text longer than a chunk passes in steps; only a piece without a cut is held whole.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((doc_id.as_py(), text.as_py()) for batch in batches
                for doc_id, text in zip(batch.column(0), batch.column(1)))
        return chunks(rows, tokenizers(byte_level, pieces), TaskContext.get().partitionId(), chunk_chars)

    packed = stored(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, CHUNK), "aligned-chunks")
    pairs = packed.select("chunk", F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select(
        "chunk", "p.a", "p.b", "p.n")
    total = pairs.groupBy("a", "b").agg(F.sum("n").alias("total"))
    highest = total.groupBy(F.col("b").alias("of")).agg(F.max("total").alias("highest"))
    counted = total.join(highest, F.col("b") == F.col("of")).select(
        "a", "b", "total", (F.col("total") == F.col("highest")).alias("best"))
    asked = pairs.select(F.col("chunk").alias("asker"), "a", "b").join(counted, ["a", "b"]).select(
        "asker", "a", "b", "total", F.col("best").cast("bigint").alias("best"))
    rows = packed.drop("n").groupBy("chunk").cogroup(asked.groupBy("asker")).applyInArrow(
        _answers, ANSWER)
    # The steps of a long text come together again.
    return rows.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in COLUMNS),
        F.max("groups_sha256").alias("groups_sha256")).drop("row")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
