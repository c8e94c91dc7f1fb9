"""Removing long repeated byte strings with merged Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in
an earlier document, or earlier in the same one. No suffix array of the corpus
is built. Three jobs lead from texts to marks:

1. Every window of LENGTH bytes has an anchor, its K-byte string of least hash
   (the leftmost of several). Equal windows have equal anchors at equal places,
   so a window can only repeat if its anchor's hash does. Tasks send hashes by
   bucket, those that repeat inside a task once, and learn which repeat.
2. The windows of a repeating anchor that follow each other make a context. Each
   context in a task is sent once, to the bucket of its anchor; other copies of
   it are marked at once, as they start later.
3. In a bucket, the contexts of each sender are a shard. Its Burrows-Wheeler
   transform is built over symbols of STRIDE bytes (each residue of the stride
   is a string of its own). The shards' transforms are merged by refining their
   interleave: round h puts every suffix where the symbol before it sends it, and
   blocks after it are equal in h symbols. After LENGTH / STRIDE rounds a block
   of several suffixes is a repeated interval; its earliest start stays.

Then each document meets its own marks and is cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

LENGTH, K, STRIDE = 100, 32, 25
WINDOW = LENGTH - K + 1
ROUNDS = LENGTH // STRIDE
#: Bytes of one numpy block and of the texts a task looks at together.
BLOCK_BYTES, GROUP_BYTES = 1 << 19, 1 << 23
#: Text bytes per bucket of anchors, and context bytes sent per bucket of contexts.
ANCHOR_BUCKET, CONTEXT_BUCKET = 1 << 25, 1 << 21
#: An anchor of more occurrences is hot: its windows are dealt by their own bytes.
#: At most 1 / HOT_SHARE anchors can be so frequent, which bounds what the driver holds.
HOT_LEAST, HOT_SHARE = 1 << 16, 1e-5
NO_ID = 2 ** 63 - 1
HASH_BITS = 48
LOW = np.int64((1 << HASH_BITS) - 1)
SYMBOL_BITS = 40
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
FINISH = np.uint64(0xBF58476D1CE4E5B9)


def rolling(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n-byte string, by joining strings of powers of two."""
    powers = {1: (data.astype(np.uint64) + np.uint64(1), MULTIPLIER)}
    length = 1
    while length * 2 <= n:
        h, p = powers[length]
        square = np.uint64(int(p) ** 2 % 2 ** 64)
        powers[length * 2] = (h[:-length] * p + h[length:], square)
        length *= 2
    out, done = powers[length][0], length
    for part in sorted(powers, reverse=True)[1:]:
        if n & part:
            h, p = powers[part]
            out = out[:len(out) - part] * p + h[done:done + len(out) - part]
            done += part
    out = (out ^ out >> np.uint64(29)) * FINISH
    return out ^ out >> np.uint64(32)


def _slide_min(x: np.ndarray, n: int) -> np.ndarray:
    width = 1
    while width * 2 <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[:width - n], x[n - width:]) if width < n else x


def anchor_runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first start, number of starts, anchor place, anchor hash) of each run of windows.

    ``ends`` has the end of its document for every byte; windows stay inside.
    """
    if len(data) < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    h = rolling(data, K)
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    place = _slide_min((h & ~low) | np.arange(len(h), dtype=np.uint64), WINDOW) & low
    place = place.astype(np.int64)
    fits = ends[:len(place)] - np.arange(len(place)) >= LENGTH
    edge = np.concatenate([[True], (place[1:] != place[:-1]) | (fits[1:] != fits[:-1])])
    first = np.flatnonzero(edge)
    n = np.diff(np.append(first, len(place)))
    first, n = first[fits[first]], n[fits[first]]
    return first, n, place[first], h[place[first]].view(np.int64)


def _blocks(raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined to blocks: (bytes, end of its text for each byte, text number, offset).

    A text longer than a block comes in steps that overlap by LENGTH - 1 bytes; the
    windows of a step are those that start in it.
    """
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def block() -> tuple[np.ndarray, ...]:
        lengths = np.array([len(raw) for _, _, raw in held])
        ends = np.cumsum(lengths)
        return (np.frombuffer(b"".join(raw for _, _, raw in held), np.uint8),
                np.repeat(ends, lengths),
                np.repeat(np.array([t for t, _, _ in held]), lengths),
                np.repeat(np.array([at for _, at, _ in held]) - (ends - lengths), lengths))

    for number, raw in enumerate(raws):
        for at in range(0, max(1, len(raw) - LENGTH + 1), BLOCK_BYTES):
            part = raw[at:at + BLOCK_BYTES + LENGTH - 1] if len(raw) > BLOCK_BYTES else raw
            if len(part) < LENGTH:
                continue
            held.append((number, at, part))
            size += len(part)
            if size >= BLOCK_BYTES:
                yield block()
                held, size = [], 0
            if part is raw:
                break
    if held:
        yield block()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[pa.RecordBatch]]]:
    """Rows of a task in groups of bounded size; the last column is the text in bytes."""
    raws, rows, size = [], [], 0
    for batch in batches:
        start = 0
        texts = batch.column(batch.num_columns - 1)
        for i in range(len(texts)):
            raw = texts[i].as_buffer()
            raw = raw.to_pybytes() if raw is not None else b""
            raws.append(raw)
            size += len(raw)
            if size >= GROUP_BYTES:
                rows.append(batch.slice(start, i + 1 - start))
                yield raws, rows
                raws, rows, size, start = [], [], 0, i + 1
        if start < len(texts):
            rows.append(batch.slice(start))
    if raws:
        yield raws, rows


def _column(rows: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([r.column(name).to_numpy(zero_copy_only=False) for r in rows])


def _six(x: np.ndarray) -> bytes:
    """The low 48 bits of each number."""
    return x.astype(np.int64).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.int64).ravel()


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket by all bits of a hash, for any number of buckets."""
    return (h.view(np.uint64) * MULTIPLIER >> np.uint64(8)).astype(np.int64) % buckets


def _split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    for at in np.split(order, edges) if len(order) else ():
        yield int(bucket[at[0]]), at


SINGLE, SEVERAL, KNOWN = 0, 1, 2
ANCHOR_ROW = "bucket bigint, kind int, hashes binary, docs binary, counts binary"


def _send_anchors(buckets: int):
    """Anchor hashes by bucket: of hashes seen once with their document, of others a count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raws, rows in _groups(batches):
            key = _column(rows, "doc_key")
            found = [(h, number[first]) for data, ends, number, _ in _blocks(raws)
                     for first, _, _, h in [anchor_runs(data, ends)]]
            if not found:
                continue
            h, doc = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(h)
            h, doc = h[order], key[doc[order]]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            n = np.diff(np.append(first, len(h)))
            several = np.repeat(n > 1, n)
            out = []
            for kind, hashes, docs, counts in (
                    (SINGLE, h[~several], doc[~several], None),
                    (SEVERAL, h[first[n > 1]], None, n[n > 1]),
                    (KNOWN, h[several], doc[several], None)):
                # What is known needs no meeting and may go anywhere.
                dealt = docs % buckets if kind == KNOWN else _bucket(hashes, buckets)
                for bucket, at in _split(dealt):
                    out.append((bucket, kind, _six(hashes[at]),
                                _six(docs[at]) if docs is not None else None,
                                counts[at].astype(np.int64).tobytes() if counts is not None else None))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (
                    pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                names=["bucket", "kind", "hashes", "docs", "counts"])
    return run


def _meet_anchors(hot: int):
    """Per bucket (doc_key, hash) of hashes that repeat, and a flagged row for each hot one.

    All occurrences of a hash meet in its bucket, as single rows or in counts, so
    its total is exact, while a hash that a task has seen twice costs one entry.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        def of(kind: int, column: str) -> np.ndarray:
            raw = b"".join(pdf.loc[pdf["kind"] == kind, column])
            return np.frombuffer(raw, np.int64) if column == "counts" else _from_six(raw)

        single, doc = of(SINGLE, "hashes"), of(SINGLE, "docs")
        several, counts = of(SEVERAL, "hashes"), of(SEVERAL, "counts")
        h = np.concatenate([single, several])
        names, place = np.unique(h, return_inverse=True)
        total = np.bincount(place, np.concatenate([np.ones(len(single)), counts]), len(names))
        repeats = total[place[:len(single)]] > 1
        docs = np.concatenate([doc[repeats], of(KNOWN, "docs")])
        hashes = np.concatenate([single[repeats], of(KNOWN, "hashes")])
        often = names[total > hot]
        return pd.DataFrame({
            "doc_key": np.concatenate([docs, np.zeros(len(often), np.int64)]),
            "hash": np.concatenate([hashes, often]),
            "hot": np.repeat([False, True], [len(docs), len(often)])})
    return run


CONTEXT_ROW = ("bucket bigint, texts binary, lengths binary, ids binary, versions binary, "
               "firsts binary, lasts binary")


def _context_row(bucket: int, texts: list[bytes] | None, ids, versions, firsts, lasts) -> tuple:
    return (bucket,
            zstandard.compress(b"".join(texts), 1) if texts is not None else None,
            np.array([len(t) for t in texts], np.int32).tobytes() if texts is not None else None,
            *(np.asarray(x, np.int64).tobytes() for x in (ids, versions, firsts, lasts)))


def _send_contexts(buckets: int, hot: np.ndarray):
    """Distinct contexts of a group of texts by bucket, and the marks of their other copies."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raws, rows in _groups(batches):
            ids, versions = _column(rows, "id"), _column(rows, "version")
            lists = [r.column("hashes") for r in rows]
            wanted = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in lists])
            owner = np.repeat(np.arange(len(raws)), np.concatenate(
                [np.asarray(x.value_lengths()) for x in lists]))
            # Hashes of a text as one sorted list of (text number, 48 bits).
            names, place = np.unique(wanted, return_inverse=True)
            known = np.sort(owner * len(names) + place)
            best: dict[bytes, tuple[int, int, int]] = {}
            marks: list[tuple[int, int, int]] = []
            home: dict[bytes, int] = {}
            for data, ends, number, offset in _blocks(raws):
                first, n, _, h = anchor_runs(data, ends)
                h, doc = h & LOW, number[first]
                at = np.minimum(np.searchsorted(names, h), len(names) - 1)
                key = doc * len(names) + at
                spot = np.minimum(np.searchsorted(known, key), len(known) - 1)
                good = (names[at] == h) & (known[spot] == key)
                first, n, h, doc = first[good], n[good], h[good], doc[good]
                if len(hot):
                    # Windows of hot anchors stand alone, so their own bytes can deal them.
                    often = np.isin(h, hot)
                    times = np.where(often, n, 1)
                    first = np.repeat(first, times) + (np.arange(times.sum()) - np.repeat(
                        np.cumsum(times) - times, times))
                    n, h, doc = (np.repeat(x, times) for x in (np.where(often, 1, n), h, doc))
                    often = np.repeat(often, times)
                else:
                    often = np.zeros(len(first), bool)
                whole = data.tobytes()
                for start, many, hash_, d, o, alone in zip(
                        first.tolist(), n.tolist(), h.tolist(), doc.tolist(),
                        offset[first].tolist(), often.tolist()):
                    text = whole[start:start + many + LENGTH - 1]
                    now = (d, start + o, many)
                    then = best.get(text)
                    if then is None:
                        best[text] = now
                        home[text] = int.from_bytes(
                            hashlib.md5(text).digest()[:6]) if alone else hash_
                        continue
                    a = (ids[d], versions[d], now[1])
                    b = (ids[then[0]], versions[then[0]], then[1])
                    if a < b:
                        best[text] = now
                        marks.append(then)
                    elif b < a:
                        marks.append(now)
            out = []
            if best:
                texts = list(best)
                d, start, many = np.array(list(best.values())).T
                for bucket, at in _split(np.array([home[t] for t in texts]) % buckets):
                    out.append(_context_row(bucket, [texts[i] for i in at], ids[d[at]],
                                            versions[d[at]], start[at], start[at]))
            if marks:
                d, start, many = np.array(marks).T
                d, start, last = _joined_runs(d, start, start + many - 1)
                for bucket, at in _split(ids[d] % buckets):
                    out.append(_context_row(bucket, None, ids[d[at]], versions[d[at]],
                                            start[at], last[at]))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64() if i == 0 else pa.binary())
                     for i, c in enumerate(zip(*out))],
                    names=[f.split()[0] for f in CONTEXT_ROW.split(", ")])
    return run


def _joined_runs(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of starts of a document that follow each other put together."""
    order = np.lexsort((first, doc))
    doc, first, last = doc[order], first[order], last[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (first[1:] > last[:-1] + 1)])
    at = np.flatnonzero(new)
    return doc[at], first[at], np.maximum.reduceat(last, at) if len(at) else last


def _symbols(data: np.ndarray) -> np.ndarray:
    """The symbol that starts at each place, from 1; in steps, as hashing needs room."""
    parts = [rolling(data[at:at + BLOCK_BYTES // 4 + STRIDE - 1], STRIDE)
             for at in range(0, len(data) - STRIDE + 1, BLOCK_BYTES // 4)]
    return (np.concatenate(parts) >> np.uint64(64 - SYMBOL_BITS)).astype(np.int64) + 1


class Suffixes:
    """All suffixes of the symbol strings of contexts, terminators first, then by place.

    Places are 32-bit: a bucket is far below two thousand million bytes.
    """

    def __init__(self, contexts: list[bytes], shards: np.ndarray) -> None:
        lengths = np.array([len(c) for c in contexts], np.int32)
        self.low = np.cumsum(lengths, dtype=np.int32) - lengths
        self.data = np.frombuffer(b"".join(contexts), np.uint8)
        starts = lengths - np.int32(LENGTH - 1)
        owner = np.repeat(np.arange(len(contexts), dtype=np.int32), lengths)
        place = np.arange(len(self.data), dtype=np.int32) - self.low[owner]
        residue = place % np.int32(STRIDE)
        # Strings too short for a whole window cannot repeat one.
        real = np.flatnonzero((place <= lengths[owner] - STRIDE) & (residue < starts[owner])
                              ).astype(np.int32)
        strings = np.minimum(starts, np.int32(STRIDE))
        before = np.cumsum(strings, dtype=np.int32) - strings
        self.n_strings = m = int(strings.sum())
        self.place = real
        self.owner = owner[real]
        string = before[self.owner] + residue[real]
        number = np.full(len(self.data), -1, np.int32)
        number[real] = np.arange(m, m + len(real), dtype=np.int32)
        more = place[real] + STRIDE <= lengths[self.owner] - STRIDE
        del owner, place, residue
        #: The suffix one symbol on; terminators follow themselves.
        string[more] = number[real[more] + STRIDE]
        self.next = np.concatenate([np.arange(m, dtype=np.int32), string])
        del number, more, string
        #: First symbol of each suffix; a terminator's is below all and its own.
        self.symbol = np.concatenate([np.zeros(m, np.int64), _symbols(self.data)[real]])
        #: The symbol before each suffix, 0 before the first of its string.
        self.previous = np.zeros(m + len(real), np.int64)
        self.previous[self.next[m:]] = self.symbol[m:]
        #: Places inside the shard that is being sorted.
        self.index = np.zeros(m + len(real), np.int32)
        self.shard = shards.astype(np.int16 if len(shards) and shards.max() < 2 ** 15 else np.int32)[
            np.concatenate([np.repeat(np.arange(len(contexts), dtype=np.int32), strings), self.owner])]

    def shard_order(self, own: np.ndarray) -> np.ndarray:
        """The suffixes of one shard in sorted order, by doubling the compared symbols."""
        self.index[own] = np.arange(len(own))
        following = self.index[self.next[own]]
        m = int((own < self.n_strings).sum())
        symbol = self.symbol[own].copy()
        symbol[m:] += m
        symbol[:m] = np.arange(m)  # every terminator is different
        order = _sorted_places(symbol)
        while True:
            by = symbol[order]
            rank = np.empty(len(own), np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], by[1:] != by[:-1]]))
            if rank[order[-1]] == len(own) - 1:
                return own[order]
            symbol = rank * np.int64(len(own)) + rank[following]
            following = following[following]
            order = _sorted_places(symbol)

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """(suffix, block) of all suffixes that share their first LENGTH bytes with another.

        The merge of the shards' transforms: only the interleave is refined.
        """
        total, m = len(self.next), self.n_strings
        shards = np.argsort(self.shard, kind="stable").astype(np.int32)
        sizes = np.bincount(self.shard)
        order = np.concatenate([self.shard_order(np.sort(x)) for x in np.split(
            shards, np.cumsum(sizes)[:-1]) if len(x)])
        transform = self.previous[order]
        interleave = self.shard[order]
        terminators = np.sort(self.shard[:m])
        # From here on the transforms say everything.
        del shards
        self.symbol = self.previous = self.next = self.index = None
        block = np.zeros(total, np.int32)
        for _ in range(ROUNDS):
            # Each shard's suffixes keep their order; the interleave says where they stand.
            stand = np.argsort(interleave, kind="stable")
            symbol = np.empty(total, np.int64)
            symbol[stand] = transform
            at = np.flatnonzero(symbol)
            source = at[_sorted_places(symbol[at])]
            now, came = symbol[source], block[source]
            new = np.concatenate([[True], (now[1:] != now[:-1]) | (came[1:] != came[:-1])])
            interleave = np.concatenate([terminators, interleave[source]])
            block = np.concatenate([np.arange(m, dtype=np.int32),
                                    np.cumsum(new, dtype=np.int32) + np.int32(m - 1)])
            del stand, symbol, at, source, now, came, new
        stand = np.argsort(interleave, kind="stable")
        suffix = np.empty(total, np.int32)
        suffix[stand] = order
        many = np.bincount(block)[block] > 1
        return suffix[many], block[many]


def _sorted_places(values: np.ndarray) -> np.ndarray:
    """The stable order of numbers from 0; one plain sort where value and place fit one integer."""
    bits = max(1, int(len(values)).bit_length())
    if len(values) and int(values.max()).bit_length() + bits <= 63:
        return np.sort(values << bits | np.arange(len(values))) & ((1 << bits) - 1)
    return np.argsort(values, kind="stable")


def _later_starts(texts: list[bytes], shards: np.ndarray, doc: np.ndarray,
                  first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) of windows that also start earlier; doc: order of documents."""
    found = Suffixes(texts, shards)
    suffix, block = found.repeated()
    if not len(suffix):
        return suffix, suffix
    context = found.owner[suffix - found.n_strings]
    place = found.place[suffix - found.n_strings]
    offset = place - found.low[context]
    head = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    block = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(block))))
    block = _verified(found.data, place, block, head)
    order = np.argsort(block, kind="stable")
    context, offset, block = context[order], offset[order], block[order]
    head = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    when = doc[context] << 32 | (first[context] + offset)  # both are 64-bit
    least = np.repeat(np.minimum.reduceat(when, head), np.diff(np.append(head, len(block))))
    later = when > least
    return context[later], offset[later]


def _verified(data: np.ndarray, place: np.ndarray, block: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Blocks whose members are equal byte by byte; a block that hashes mixed up is parted."""
    # Eight bytes at every place; LENGTH bytes are some of these, the last overlapping.
    words = np.ndarray((len(data) - 7,), np.uint64, data, strides=(1,))
    lead = place[head[block]]
    other = np.flatnonzero(place != lead)
    differs = np.zeros(len(other), bool)
    for at in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        differs |= words[place[other] + at] != words[lead[other] + at]
    bad, width = [block[other[differs]]], np.arange(LENGTH)
    for mixed in np.unique(np.concatenate(bad)):
        at = np.flatnonzero(block == mixed)
        _, kind = np.unique(data[place[at][:, None] + width], axis=0, return_inverse=True)
        block = block.copy()
        block[at] = np.where(kind.ravel() == 0, mixed, block.max() + kind.ravel())
    return block


def _meet_contexts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Marks of one bucket: (id, version, first, last) runs of window starts that go."""
    passed, later, best = [], [], {}
    for shard, row in enumerate(pdf.itertuples(index=False)):
        ids, versions, firsts, lasts = (np.frombuffer(x, np.int64) for x in (
            row.ids, row.versions, row.firsts, row.lasts))
        if row.texts is None:
            passed.append((ids, versions, firsts, lasts))
            continue
        raw, lengths = zstandard.decompress(row.texts), np.frombuffer(row.lengths, np.int32)
        ends = np.cumsum(lengths).tolist()
        for end, length, *when in zip(ends, lengths.tolist(), ids.tolist(), versions.tolist(),
                                      firsts.tolist()):
            text = raw[end - length:end]
            then = best.get(text)
            if then is None:
                best[text] = (shard, *when)
                continue
            now = (shard, *when)
            if now[1:] < then[1:]:
                best[text], now, then = now, then, now
            if now[1:] != then[1:]:
                later.append((now[1], now[2], now[3], now[3] + length - LENGTH))
    if later:
        passed.append(tuple(np.array(later).T))
    if best:
        texts = list(best)
        shard, ids, versions, firsts = (np.array(x) for x in zip(*best.values()))
        order = np.lexsort((versions, ids))
        new = (np.diff(ids[order]) != 0) | (np.diff(versions[order]) != 0)
        doc = np.empty(len(ids), np.int64)
        doc[order] = np.cumsum(np.concatenate([[0], new]))
        _, shard = np.unique(shard, return_inverse=True)
        context, offset = _later_starts(texts, shard, doc, firsts)
        context, start, last = _joined_runs(context, offset, offset)
        passed.append((ids[context], versions[context], firsts[context] + start,
                       firsts[context] + last))
    columns = [np.concatenate(x) for x in zip(*passed)] if passed else [np.zeros(0, np.int64)] * 4
    return pd.DataFrame(dict(zip(("id", "version", "first", "last"), columns)))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for id_, version, marks, raw in zip(*(batch.column(c) for c in (
                "id", "version", "marks", "raw"))):
            raw = raw.as_buffer().to_pybytes()
            spans = np.array(marks.as_py() or [], np.int64).reshape(-1, 4)
            # A key of 48 bits may stand for several documents.
            spans = spans[(spans[:, 0] == id_.as_py()) & (spans[:, 1] == version.as_py()), 2:]
            removed = n_spans = 0
            kept = [raw]
            if len(spans):
                _, first, last = _joined_runs(np.zeros(len(spans), np.int64), spans[:, 0],
                                              spans[:, 1] + LENGTH - 1)
                kept, at = [], 0
                for a, b in zip(first.tolist(), last.tolist()):
                    kept.append(raw[at:a])
                    at = b + 1
                kept.append(raw[at:])
                removed, n_spans = int((last - first + 1).sum()), len(first)
            rows.append((len(raw), removed, n_spans, hashlib.sha256(b"".join(kept)).hexdigest(),
                         b"".join(kept)))
        columns = list(zip(*rows)) or [()] * 5
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


#: Both joins of the texts take the same columns by the same key, so one shuffle serves them.
TEXT_COLUMNS = ("doc_id", "id", "version", "doc_key", "raw")


def _doc_key() -> Column:
    return F.xxhash64("id", "version").bitwiseAND(int(LOW))


def marks(texts: DataFrame, hot_least: int = HOT_LEAST) -> DataFrame:
    """(id, version, first, last): runs of window starts that also start earlier.

    ``texts`` has the columns ``TEXT_COLUMNS``.
    """
    total = texts.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    buckets = max(1, -(-total // ANCHOR_BUCKET))
    hot = max(hot_least, int(HOT_SHARE * total / (WINDOW / 2)))
    anchors = texts.select("doc_key", "raw").mapInArrow(_send_anchors(buckets), ANCHOR_ROW)
    repeating = stored(anchors.groupBy("bucket").applyInPandas(
        _meet_anchors(hot), "doc_key bigint, hash bigint, hot boolean"), "anchors")
    often = np.array([r.hash for r in repeating.where("hot").select("hash").collect()], np.int64)
    pairs = repeating.where("NOT hot")
    buckets = max(1, -(-pairs.count() * (LENGTH + WINDOW // 2) // CONTEXT_BUCKET))
    # As many hashes per document as it has anchors.
    wanted = pairs.groupBy(F.col("doc_key").alias("wanted_key")).agg(
        F.collect_set("hash").alias("hashes"))
    contexts = texts.join(wanted, F.col("doc_key") == F.col("wanted_key")).select(
        "doc_id", "id", "version", "hashes", "raw").mapInArrow(
        _send_contexts(buckets, often), CONTEXT_ROW)
    return contexts.groupBy("bucket").applyInPandas(
        _meet_contexts, "id bigint, version bigint, first bigint, last bigint")


def remove_repeats(docs: DataFrame, keep_bytes: bool = False, hot_least: int = HOT_LEAST) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text), whole texts as UTF-8 bytes.

    Columns: doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256 of the remaining bytes; ``keep_bytes`` adds these as ``kept``.
    Strings are judged on the input, and overlaps count. A null text is empty; texts
    below LENGTH bytes lose nothing. Documents are ordered by doc_id, null last;
    rows that share an id and differ in text are ordered by a hash of the text,
    and rows that repeat an id and a text are one document: neither is earlier,
    and both get its result. Other columns are not read; an empty table gives no rows.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(raw).alias("version"), raw.alias("raw")).withColumn(
        "doc_key", _doc_key()).select(*TEXT_COLUMNS)
    runs = marks(texts, hot_least).groupBy(_doc_key().alias("marked_key")).agg(
        F.collect_list(F.array("id", "version", "first", "last")).alias("marks"))
    cut = texts.join(runs, F.col("doc_key") == F.col("marked_key"), "left").select(
        "doc_id", "id", "version", "marks", "raw").mapInArrow(
        _cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, "
              "kept_sha256 string, kept binary")
    return cut if keep_bytes else cut.drop("kept")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
