"""Toxicity: FTRL-proximal logistic regression on hashed word n-grams and skip-grams.

Every coordinate has its own learning rate and L1 keeps weights that noise made
at zero, so the model is a short list of (coordinate, weight).

Training runs in rounds over a few shards. A task starts from the state (z, n) of
the last round, goes through its documents one by one, and sends by how much it
moved each coordinate; the mean of the moves, taken on the executors, makes the next state. The state has
``2 ** BITS`` coordinates whatever the input, and the labelled documents used are
bounded by ``TRAIN_ROWS``. Scoring reads every document once and shuffles nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, stored, table

BITS = 20
#: Labelled documents the model is fitted on at most: those with the smallest hashes of their id.
TRAIN_ROWS = 20_000
SHARDS, ROUNDS = 4, 8
ALPHA, BETA, L1, L2 = 2.0, 1.0, 5.0, 0.0
#: Toxic documents are the fewer ones; each counts so many times.
POSITIVE_WEIGHT = 3.0
#: Bytes hashed together; a longer text is hashed in steps that share two words.
STEP_BYTES = 1 << 21
BASE = np.uint64(0x100000001B3)
INVERSE = np.uint64(pow(int(BASE), -1, 2 ** 64))
MIXERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F),
          np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5))
IS_WORD = np.array([chr(b).isalnum() or b >= 128 for b in range(256)])
NO_WORD = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Coordinates whose moves are averaged in one group.
BLOCK = 1 << 15


class Hasher:
    """Word hashes of byte blocks: a word's hash is a difference of running sums."""

    def __init__(self, size: int) -> None:
        self.powers = self.inverses = np.ones(0, np.uint64)
        self._grow(size)

    def _grow(self, size: int) -> None:
        if len(self.powers) < size:
            factors = np.full(size, BASE), np.full(size, INVERSE)
            for f in factors:
                f[0] = 1
            self.powers, self.inverses = (np.multiply.accumulate(f) for f in factors)

    def words(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of every word of a block."""
        data = np.frombuffer(raw, np.uint8)
        self._grow(len(data))
        inside = np.concatenate([[False], IS_WORD[data], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[::2], edges[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(
            (data.astype(np.uint64) + np.uint64(1)) * self.powers[:len(data)], dtype=np.uint64)])
        if not len(start):
            return start, np.zeros(0, np.uint64)
        return start, (sums[end] - sums[start]) * self.inverses[start]


def _steps(raw: bytes) -> Iterator[bytes]:
    """A long text in steps that end between words; each begins with the last two words before it.

    So every pair of words is in some step. A word is never cut, however long it is.
    """
    at = end = 0
    while end < len(raw):
        end = min(len(raw), end + STEP_BYTES)
        last = NO_WORD.search(raw, end)
        end = last.start() if last else len(raw)
        yield raw[at:end]
        inside = np.concatenate([[False], IS_WORD[np.frombuffer(raw[at:end], np.uint8)]])
        starts = np.flatnonzero(inside[1:] & ~inside[:-1])
        at += int(starts[-2:][0]) if len(starts) else 0


def _blocks(texts: list[str]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Lower-cased texts joined into blocks: (bytes, start of each text in it, text numbers)."""
    parts, starts, numbers, size = [], [], [], 0
    for number, text in enumerate(texts):
        raw = text.lower().encode()
        if len(raw) > STEP_BYTES:
            for step in _steps(raw):
                yield step, np.zeros(1, np.int64), np.array([number])
            continue
        parts.append(raw)
        starts.append(size)
        numbers.append(number)
        size += len(raw) + 1
        if size > STEP_BYTES:
            yield b"\n".join(parts), np.array(starts), np.array(numbers)
            parts, starts, numbers, size = [], [], [], 0
    if parts:
        yield b"\n".join(parts), np.array(starts), np.array(numbers)


def features(texts: list[str], hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """(text number, coordinate) of the distinct features of each text, sorted by both.

    Features: words, pairs of neighbours, and pairs that skip one word.
    """
    keys = []
    for raw, starts, numbers in _blocks(texts):
        start, word = hasher.words(raw)
        if not len(start):
            continue
        doc = numbers[np.searchsorted(starts, start, side="right") - 1]
        found = [(doc, word * MIXERS[0])]
        for gap in (1, 2):
            same = doc[gap:] == doc[:-gap]
            pair = (word[:-gap] * MIXERS[1] ^ word[gap:] * MIXERS[2]) * MIXERS[3]
            found.append((doc[gap:][same], pair[same] * MIXERS[0] + MIXERS[gap]))
        block = np.concatenate([d.astype(np.int64) << BITS
                                | ((h ^ h >> np.uint64(32)) * MIXERS[1] >> np.uint64(64 - BITS)
                                   ).astype(np.int64) for d, h in found])
        keys.append(_distinct(block))
    key = _distinct(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return key >> BITS, key & ((1 << BITS) - 1)


def _distinct(key: np.ndarray) -> np.ndarray:
    key = np.sort(key)
    return key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0,
                    -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train_shard(doc: np.ndarray, at: np.ndarray, label: np.ndarray, z: np.ndarray,
                n: np.ndarray) -> None:
    """One pass over documents in order; z and n are changed in place. The last place is the bias."""
    bounds = np.searchsorted(doc, np.arange(len(label) + 1))
    for i, y in enumerate(label):
        own = np.append(at[bounds[i]:bounds[i + 1]], len(z) - 1)
        zi, ni = z[own], n[own]
        w = weights(zi, ni)
        g = (_sigmoid(w.sum()) - y) * (POSITIVE_WEIGHT if y else 1.0)
        root = np.sqrt(ni + g * g)
        z[own] = zi + g - (root - np.sqrt(ni)) / ALPHA * w
        n[own] = ni + g * g


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(shard, doc_id, label, text) of at most ``most`` labelled documents.

    Taken are those with the smallest hashes of their ids, so reruns agree. The
    ids taken are a table of bounded size and may be broadcast; texts are not
    shuffled before they are chosen. A document of several labels is toxic if any says so;
    labels that are null or whose document is missing or null teach nothing.
    """
    chosen = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(
        ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("label_id")).agg(
        F.max("toxic").alias("label")).orderBy(
        F.xxhash64(F.lit(11), "label_id"), "label_id").limit(most)
    return docs.where("text IS NOT NULL").select("doc_id", "text").join(
        F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select(
        F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(SHARDS)).alias("shard"),
        "doc_id", F.col("label").cast("int").alias("label"), "text")


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Coordinates of each document instead of its text, a few texts at a time."""
    hasher = Hasher(STEP_BYTES)
    for batch in batches:
        texts = batch.column(3)
        for start, end in _groups(texts):
            doc, at = features([t.as_py() for t in texts[start:end]], hasher)
            bounds = np.searchsorted(doc, np.arange(end - start + 1))
            places = [at[a:b].astype(np.int32).tobytes() for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [*(c[start:end] for c in batch.columns[:3]), pa.array(places, pa.binary())],
                names=["shard", "doc_id", "label", "places"])


def _groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are hashed together: a few MB, or one long text."""
    sizes = np.asarray(pc.binary_length(texts.fill_null("")))
    start = size = 0
    for end, n in enumerate(sizes.tolist()):
        if size and size + n > STEP_BYTES:
            yield start, end
            start, size = end, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def pack_shards(rows: DataFrame) -> DataFrame:
    """One row per shard: its documents' labels, feature counts and coordinates as bytes.

    Features are made before the shuffle, so texts stay where they are.
    """
    def pack(found: pa.Table) -> pa.Table:
        found = found.sort_by([("doc_id", "ascending"), ("places", "ascending")])
        places = found.column("places").to_pylist()
        return pa.table({
            "shard": found.column("shard")[:1],
            "labels": [found.column("label").to_numpy().astype(np.int8).tobytes()],
            "counts": [np.array([len(p) // 4 for p in places], np.int32).tobytes()],
            "places": [b"".join(places)]})

    return rows.mapInArrow(
        _featured, "shard bigint, doc_id bigint, label int, places binary").groupBy("shard").applyInArrow(
        pack, "shard bigint, labels binary, counts binary, places binary")


def _mean(moves: pa.Table) -> pa.Table:
    """The mean move of one block of coordinates over all shards."""
    moves = moves.sort_by("shard")
    return pa.table({"block": moves.column("block")[:1]} | {
        c: [(sum(np.frombuffer(m, np.float32).astype(np.float64) for m in moves.column(c).to_pylist())
             / moves.num_rows).astype(np.float32).tobytes()] for c in ("dz", "dn")})


def fit(shards: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, weights, bias) of the coordinates whose weight is not zero.

    The moves of a round are averaged on the executors, block by block; the driver takes one
    state of ``2 ** BITS`` coordinates and sends it on. Without a labelled document the
    model is empty and every score is one half.
    """
    spark = shards.sparkSession
    size = (1 << BITS) + 1
    z, n = np.zeros(size, np.float32), np.zeros(size, np.float32)
    for _ in range(rounds):
        state = spark.sparkContext.broadcast((z, n))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard, labels, counts, places in zip(*(c.to_pylist() for c in batch.columns)):
                    label = np.frombuffer(labels, np.int8)
                    doc = np.repeat(np.arange(len(label)), np.frombuffer(counts, np.int32))
                    z0, n0 = state.value
                    z1, n1 = z0.astype(np.float64), n0.astype(np.float64)
                    train_shard(doc, np.frombuffer(places, np.int32), label, z1, n1)
                    dz, dn = ((x1 - x0).astype(np.float32) for x0, x1 in ((z0, z1), (n0, n1)))
                    cuts = range(0, size, BLOCK)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.arange(len(cuts), dtype=np.int32)), pa.array([shard] * len(cuts)),
                         *(pa.array([d[k:k + BLOCK].tobytes() for k in cuts], pa.binary()) for d in (dz, dn))],
                        names=["block", "shard", "dz", "dn"])

        moves = shards.mapInArrow(run, "block int, shard bigint, dz binary, dn binary").groupBy(
            "block").applyInArrow(_mean, "block int, dz binary, dn binary").toArrow()
        for block, dz, dn in zip(*(c.to_pylist() for c in moves.columns)):
            part = slice(block * BLOCK, (block + 1) * BLOCK)
            z[part] += np.frombuffer(dz, np.float32)
            n[part] += np.frombuffer(dn, np.float32)
        # One state at a time is kept, on the driver as on the executors.
        del moves
        state.destroy()
    w = weights(z.astype(np.float64), np.maximum(n, 0).astype(np.float64))
    at = np.flatnonzero(w[:-1])
    return at, w[at], float(w[-1])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """(doc_id, score) of each row of ``docs`` (doc_id, text), whole texts.

    Null and empty texts have the score of the bias alone. Rows are independent
    of each other: repeated rows repeat results, null ids stay, other columns are
    not read, an empty table gives no rows.
    """
    at, values, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(STEP_BYTES)
        dense = np.zeros(1 << BITS)
        dense[at] = values
        for batch in batches:
            texts = batch.column(1)
            total = np.zeros(len(texts))
            for start, end in _groups(texts):
                doc, place = features([t.as_py() or "" for t in texts[start:end]], hasher)
                total[start:end] = np.bincount(doc, dense[place], minlength=end - start)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(_sigmoid(total + bias))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, score double")


def op10_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    shards = stored(pack_shards(training_rows(docs, table(spark, sf_dir, "labels"))), "shards")
    return score(docs, fit(shards)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
