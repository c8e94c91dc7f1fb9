"""Byte-level BPE encoding and decoding on padded numpy matrices.

Texts are cut into pieces by the tokenizer's pattern. The distinct pieces of a
batch that are not known yet are put into matrices of token ids, one matrix per
length bucket, padded with -1. Each round looks up every neighbouring pair in a
hashed pair table, every row merges its leftmost pair of minimum rank, and the
rows are compacted; rows without a pair left are done. Ids of pieces seen in a
partition stay in a cache of bounded size until the partition ends.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

RANKS = "byte_bpe_50k.tiktoken"
#: Bytes of memory the cache of a worker may take, and the longest piece kept there.
CACHE_BYTES, CACHE_LONGEST = 32 << 20, 64
#: About what a cached piece costs besides its characters and ids: its string, tuple and slot.
PIECE_OVERHEAD = 200
#: Ids of one batch of results.
BATCH_IDS = 1 << 19
#: Cells of one matrix.
MATRIX_CELLS = 1 << 20
#: Pieces of more than 8 blocks are rows of their own, searched by the minima of their blocks.
BLOCK = 512
#: Pieces of one step over a long text; characters of short texts that go together.
STEP_PIECES, GROUP_CHARS = 1 << 16, 1 << 21
NO_RANK = np.int32(2**31 - 1)
MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open addressing over (left id, right id) -> id of the joined bytes."""

    def __init__(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray) -> None:
        bits = max(4, int(len(joined) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NO_RANK, np.int32)
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slots, values = self._slots(keys), joined.astype(np.int32)
        while len(keys):
            free = np.flatnonzero(self.keys[slots] == -1)
            self.keys[slots[free]] = keys[free]  # of several for one slot the last stays
            won = self.keys[slots] == keys
            self.values[slots[won]] = values[won]
            keys, values = keys[~won], values[~won]
            slots = (slots[~won] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * MIX >> self.shift).view(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of each joined pair, or ``NO_RANK``; ids below zero are padding."""
        keys = (left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)).ravel()
        out = np.full(keys.shape, NO_RANK, np.int32)
        at = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        keys = keys[at]
        slots = self._slots(keys)
        while len(at):
            found = self.keys[slots]
            hit = found == keys
            out[at[hit]] = self.values[slots[hit]]
            on = ~hit & (found != -1)
            at, keys, slots = at[on], keys[on], (slots[on] + 1) & self.mask
        return out.reshape(left.shape)


class Encoder:
    """Encodes pieces and decodes ids of one rank file."""

    def __init__(self, rank_lines: Iterable[bytes], pattern: str) -> None:
        self.ids: dict[bytes, int] = {}
        for line in rank_lines:
            if line.strip():
                token, rank = line.split()
                self.ids[base64.b64decode(token)] = int(rank)
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.pieces = regex.compile(pattern)
        self.of_byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        left, right, joined = [], [], []
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                a, b = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), joined.append(rank)
        self.pairs = PairTable(np.array(left), np.array(right), np.array(joined))
        self.forget()

    def forget(self) -> None:
        """Empties the cache, so that a reused Python worker holds the vocabulary alone."""
        self.cache: dict[str, tuple[int, ...]] = {}
        self.cached = 0

    def encode_pieces(self, pieces: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of distinct pieces; a piece that is itself a token is that token."""
        out, buckets = {}, {}
        for piece in pieces:
            raw = piece.encode("utf-8")
            whole = self.ids.get(raw)
            if whole is not None:
                out[piece] = (whole,)
            else:
                buckets.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for bits, members in buckets.items():
            if 1 << bits > 8 * BLOCK:
                # A row of a matrix costs the square of its length.
                out.update((piece, self._merge_long(raw)) for piece, raw in members)
                continue
            at_once = max(1, MATRIX_CELLS >> bits)
            for start in range(0, len(members), at_once):
                chunk = members[start:start + at_once]
                rows = self._merge_matrix([raw for _, raw in chunk], 1 << bits)
                out.update((piece, row) for (piece, _), row in zip(chunk, rows))
        return out

    def _merge_matrix(self, raws: list[bytes], width: int) -> list[tuple[int, ...]]:
        lengths = np.fromiter(map(len, raws), np.int64, len(raws))
        ids = np.full((len(raws), width), -1, np.int32)
        inside = np.arange(width) < lengths[:, None]
        ids[inside] = self.of_byte[np.frombuffer(b"".join(raws), np.uint8)]
        ranks = self.pairs.ranks(ids[:, :-1], ids[:, 1:])
        out: list[tuple[int, ...]] = [()] * len(raws)
        rows = np.arange(len(raws))
        while len(rows):
            at = ranks.argmin(axis=1)
            each = np.arange(len(rows))
            best = ranks[each, at]
            done = best == NO_RANK
            if done.any():
                for i in np.flatnonzero(done):
                    out[rows[i]] = tuple(ids[i, :lengths[i]].tolist())
                go = ~done
                width = int(lengths[go].max()) if go.any() else 0
                rows, lengths, at, best = rows[go], lengths[go], at[go], best[go]
                ids, ranks = ids[go, :width], ranks[go, :max(width - 1, 0)]
                if not len(rows):
                    break
                each = np.arange(len(rows))
            # Compaction: what is right of the merged pair moves one place left.
            later = np.arange(ids.shape[1] - 1) > at[:, None]
            ids[each, at] = best
            ids[:, :-1] = np.where(later, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            lengths = lengths - 1
            later = np.arange(ranks.shape[1] - 1) > at[:, None]
            if ranks.shape[1] > 1:
                ranks[:, :-1] = np.where(later, ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NO_RANK
            padded = np.concatenate([ids, np.full((len(rows), 1), -1, np.int32)], axis=1)
            left = np.maximum(at - 1, 0)
            ranks[each, np.minimum(at, ranks.shape[1] - 1)] = self.pairs.ranks(
                padded[each, at], padded[each, at + 1])
            has_left = np.flatnonzero(at > 0)
            ranks[has_left, left[has_left]] = self.pairs.ranks(
                ids[has_left, left[has_left]], ids[has_left, at[has_left]])
        return out

    def _merge_long(self, raw: bytes) -> tuple[int, ...]:
        """One very long row: blocks of a fixed width with their minima.

        Merged places are marked and skipped, and the row is compacted whenever
        half of it is marked, so a round costs a block and the list of minima.
        """
        ids = self.of_byte[np.frombuffer(raw, np.uint8)]
        while True:
            n = len(ids)
            ranks = np.full(-(-n // BLOCK) * BLOCK, NO_RANK, np.int32)
            ranks[:n - 1] = self.pairs.ranks(ids[:-1], ids[1:])
            blocks = ranks.reshape(-1, BLOCK)
            low = blocks.min(axis=1)
            after = list(range(1, n + 1))
            before = list(range(-1, n - 1))
            live = n
            while live > max(1, n // 2):
                b = int(low.argmin())
                if low[b] == NO_RANK:
                    break
                at = b * BLOCK + int(blocks[b].argmin())
                gone = after[at]
                ids[at] = ranks[at]
                ids[gone] = -1
                ranks[gone] = NO_RANK
                after[at] = nxt = after[gone]
                if nxt < n:
                    before[nxt] = at
                ranks[at] = self._rank(ids[at], ids[nxt]) if nxt < n else NO_RANK
                prev = before[at]
                if prev >= 0:
                    ranks[prev] = self._rank(ids[prev], ids[at])
                for touched in {at // BLOCK, gone // BLOCK, max(prev, 0) // BLOCK}:
                    low[touched] = blocks[touched].min()
                live -= 1
            ids = ids[ids >= 0]
            if live == n or len(ids) == 1 or low.min() == NO_RANK:
                return tuple(ids.tolist())

    def _rank(self, left: int, right: int) -> int:
        return self.ids.get(self.bytes_of[int(left)] + self.bytes_of[int(right)], NO_RANK)

    def steps(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, a bounded number at a time."""
        found = (m.group() for m in self.pieces.finditer(text)) if len(text) > STEP_PIECES \
            else iter(self.pieces.findall(text))
        while step := list(islice(found, STEP_PIECES)):
            yield step

    def learn(self, pieces: list[str]) -> dict[str, tuple[int, ...]]:
        """Makes sure that ids of all these pieces are known; returns those too long to keep."""
        new = {p for p in pieces if p not in self.cache}
        if not new:
            return {}
        if self.cached > CACHE_BYTES:
            self.forget()
            new = set(pieces)
        encoded = self.encode_pieces(list(new))
        long = {p: v for p, v in encoded.items() if len(p) > CACHE_LONGEST}
        kept = {p: v for p, v in encoded.items() if len(p) <= CACHE_LONGEST}
        self.cache.update(kept)
        self.cached += sum(PIECE_OVERHEAD + 2 * len(p) + 8 * len(v) for p, v in kept.items())
        return long

    def _ids(self, pieces: list[str], long: dict[str, tuple[int, ...]]) -> list[int]:
        known = self.cache
        if long:
            return list(chain.from_iterable(long[p] if p in long else known[p] for p in pieces))
        return list(chain.from_iterable(map(known.__getitem__, pieces)))

    def encode(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, step by step."""
        for pieces in self.steps(text):
            yield self._ids(pieces, self.learn(pieces))

    def encode_many(self, texts: Iterable[str]) -> Iterator[Iterator[list[int]]]:
        """For each text its steps; short texts share their matrices."""
        group, chars = [], 0
        for text in texts:
            if len(text) > STEP_PIECES:
                yield from self._grouped(group)
                group, chars = [], 0
                yield self.encode(text)
                continue
            group.append(self.pieces.findall(text))
            chars += len(text)
            if chars > GROUP_CHARS:
                yield from self._grouped(group)
                group, chars = [], 0
        yield from self._grouped(group)

    def _grouped(self, group: list[list[str]]) -> Iterator[Iterator[list[int]]]:
        long = self.learn(list(set(chain.from_iterable(group))))
        for pieces in group:
            yield iter([self._ids(pieces, long)] if pieces else [])

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per Python worker and rank file."""
    with open(path, "rb") as lines:  # part of the installed library, on every machine
        return Encoder(lines, pattern)


class _Results:
    """Rows until they make a batch; ids are kept as 32-bit arrays."""

    def __init__(self, schema: str, keep_ids: bool) -> None:
        self.names = [f.split()[0] for f in schema.split(", ")]
        self.keep_ids = keep_ids
        self._clear()

    def _clear(self) -> None:
        self.rows: list[tuple] = []
        self.ids: list[np.ndarray] = []
        self.size = 0

    def hold(self, ids: list[int]) -> None:
        self.size += len(ids)
        if self.keep_ids:
            self.ids.append(np.array(ids, np.int32))

    def end(self, *row) -> None:
        self.rows.append(row)
        self.size += 32

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * 4
        arrays = [pa.array(c, t) for c, t in zip(
            columns, (pa.int64(), pa.int64(), pa.string(), pa.string()))]
        if self.keep_ids:
            ends = np.concatenate([[0], np.cumsum(columns[1], dtype=np.int64)]).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(
                pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *self.ids]))))
        self._clear()
        return pa.RecordBatch.from_arrays(arrays, names=self.names)


def _public(ranks: str) -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path(ranks), public_tokenizers.PATTERN


def encode_texts(docs: DataFrame, ranks: str = RANKS, keep_ids: bool = False) -> DataFrame:
    """Tokens of each whole text, and the bytes they decode to.

    One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256 (of
    the decimal ids joined by one space), decoded_sha256; with ``keep_ids`` also
    ``ids``. A null text is an empty one and has no tokens. Strings
    of special tokens are ordinary text. The decoded bytes come from the ids alone.
    Rows are independent of each other: repeated rows give repeated results, null
    ids stay null, other columns are not read, and an empty table gives no rows.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (
        ", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(*_public(ranks))
        name = made.text_of.__getitem__
        out = _Results(schema, keep_ids)
        try:
            for batch in batches:
                texts = (text.as_py() or "" for text in batch.column(1))
                for doc_id, steps in zip(batch.column(0), made.encode_many(texts)):
                    n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
                    for ids in steps:
                        of_ids.update(((" " if n else "") + " ".join(map(name, ids))).encode())
                        of_bytes.update(made.decode(ids))
                        n += len(ids)
                        out.hold(ids)
                    out.end(doc_id.as_py(), n, of_ids.hexdigest(), of_bytes.hexdigest())
                    if out.size >= BATCH_IDS:
                        yield out.batch()
            yield out.batch()
        finally:
            made.forget()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, schema)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))
