"""Hard-negative mining: a secondary sort of packed (anchor, descending score, id) keys.

The anchors are a stated query set that meets all rows in blocks. A block of
anchors is a matrix of bounded size, sent to the tasks; each task multiplies it
with its own rows, a tile at a time, and packs a pair into one key of bytes whose
order is (anchor, descending score, positive before negative, id). Of every
anchor a task sends only what its own rows cannot rule out: its first positives,
and then, as the anchor's positives are known, the first negatives of each
positive's window. Keys are dealt by anchor and sorted within partitions; one
iterator walks a partition, opens a window at each positive and emits negatives
as they pass, so that it holds the open windows of one anchor and nothing else.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Bytes of one block of anchors (as doubles), which the driver sends to the tasks.
BLOCK_BYTES = 16 << 20
#: Scores of a tile: rows that meet a block of anchors at once.
TILE_CELLS = 1 << 20
#: Components count at most this much either way, scores at most 64 bits.
MOST_COMPONENT = 2.0 ** 62
#: Doubles add integers below this without loss.
EXACT = 2 ** 53
LONGS = np.iinfo(np.int64)
#: Anchor id, anchor number, score from above, kind, id: bytes in the order of the keys.
KEY = struct.Struct(">QQQBQ")
POSITIVE, NEGATIVE = 0, 1


@dataclass(frozen=True)
class Limits:
    """How many positives an anchor has, and negatives a positive; the window in hundredths."""

    positives: int = 5
    negatives: int = 5
    least_percent: int = 80
    most_percent: int = 100

    def window(self, score: int) -> tuple[int, int]:
        """The least and the greatest score of a negative beside a positive's."""
        clip = lambda x: max(LONGS.min, min(LONGS.max, x))
        return clip(-(-self.least_percent * score // 100)), clip(self.most_percent * score // 100)


def _quantised(values: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * scale), -MOST_COMPONENT, MOST_COMPONENT)


def _rows(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, ids, labels, vectors) of the rows that take part, one group for each length."""
    whole = np.ones(batch.num_rows, bool)
    for column in batch.columns[:3]:
        whole &= ~np.asarray(column.is_null())
    lists = batch.column(2)
    ends = np.cumsum(np.where(whole, np.asarray(lists.value_lengths().fill_null(0)), 0))
    flat = lists.filter(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])  # a null component is read as NaN
    starts = np.concatenate([[0], ends[:-1]])
    whole &= bad[ends] == bad[starts]
    length = ends - starts
    for n in np.unique(length[whole]):
        at = np.flatnonzero(whole & (length == n))
        vectors = flat[(starts[at][:, None] + np.arange(n)).ravel()].reshape(len(at), n)
        yield (at, np.asarray(batch.column(0).take(pa.array(at))).astype(np.int64),
               np.asarray(batch.column(1).take(pa.array(at))).astype(np.int64),
               _quantised(vectors, scale))


@dataclass
class Block:
    """Anchors of one vector length, in the order of their numbers."""

    number: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        """Inner products, whole numbers."""
        most = [float(np.abs(v).max(initial=0)) for v in (self.vectors, vectors)]
        if most[0] * most[1] * vectors.shape[1] < EXACT:
            return (self.vectors @ vectors.T).astype(np.int64)
        exact = [np.array([[int(x) for x in v] for v in side], object).reshape(side.shape)
                 for side in (self.vectors, vectors)]
        return np.clip(exact[0] @ exact[1].T, LONGS.min, LONGS.max).astype(np.int64) \
            if vectors.shape[1] else np.zeros((len(self.vectors), len(vectors)), np.int64)


class Best:
    """The first ``most`` (score, id) of each of n lists, by descending score and then by id."""

    def __init__(self, n: int, most: int) -> None:
        self.most = most
        self.rows = tuple(np.zeros(0, np.int64) for _ in range(3))
        #: Below this score nothing gets into a list any more.
        self.least = np.full(n, LONGS.min)

    def add(self, place: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(place):
            return
        place, score, ids = (np.concatenate(p) for p in zip(self.rows, (place, score, ids)))
        order = np.lexsort((ids, ~score, place))  # ~x falls as x grows, without overflow
        place = place[order]
        first = np.searchsorted(place, place)
        rank = np.arange(len(place)) - first
        kept = order[rank < self.most]
        full = rank == self.most - 1
        self.least[place[full]] = score[order[full]]
        self.rows = place[rank < self.most], score[kept], ids[kept]


def _tiles(batches: Iterable[pa.RecordBatch], block: Block, scale: int):
    """(scores, ids, labels) of the block's anchors beside a tile of rows."""
    size = max(1, TILE_CELLS // max(1, len(block.ids)))
    for batch in batches:
        for _, ids, labels, vectors in _rows(batch, scale):
            if vectors.shape[1] == block.vectors.shape[1]:
                for start in range(0, len(ids), size):
                    part = slice(start, start + size)
                    yield block.scores(vectors[part]), ids[part], labels[part]


def _packed(block: Block, anchor: np.ndarray, score: np.ndarray, kind: int,
            ids: np.ndarray) -> pa.RecordBatch:
    """Keys of pairs; their bytes have the order of (anchor, descending score, kind, id)."""
    def ordered(x: np.ndarray) -> np.ndarray:
        return (x.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8")

    key = np.zeros(len(anchor), [("a", ">u8"), ("n", ">u8"), ("s", ">u8"), ("k", "u1"), ("i", ">u8")])
    key["a"], key["n"] = ordered(block.ids[anchor]), ordered(block.number[anchor])
    key["s"], key["k"], key["i"] = ordered(~score), kind, ordered(ids)
    raw = pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(KEY.size), len(key), [None, pa.py_buffer(key.tobytes())])
    return pa.RecordBatch.from_arrays([raw.cast(pa.binary())], names=["key"])


def _unpacked(key: bytes) -> tuple[int, int, int, int, int]:
    a, n, s, kind, i = KEY.unpack(key)
    half = 1 << 63
    return a - half, n - half, ~(s - half), kind, i - half


def first_positives(batches: Iterable[pa.RecordBatch], block: Block, limits: Limits,
                    scale: int) -> Iterator[pa.RecordBatch]:
    """Keys of the first positives that a task's rows hold for each anchor."""
    best = Best(len(block.ids), limits.positives)
    for scores, ids, labels in _tiles(batches, block, scale):
        fits = (block.labels[:, None] == labels) & (block.ids[:, None] != ids) \
            & (scores >= best.least[:, None])
        anchor, row = np.nonzero(fits)
        best.add(anchor, scores[anchor, row], ids[row])
    yield _packed(block, best.rows[0], best.rows[1], POSITIVE, best.rows[2])


def first_negatives(batches: Iterable[pa.RecordBatch], block: Block, windows: np.ndarray,
                    limits: Limits, scale: int) -> Iterator[pa.RecordBatch]:
    """Keys of the first negatives a task's rows hold for each window (anchor, place, ends)."""
    n, places = windows.shape[:2]
    best = Best(n * places, limits.negatives)
    for scores, ids, labels in _tiles(batches, block, scale):
        other = block.labels[:, None] != labels
        for place in range(places):
            low, high = windows[:, place, 0], windows[:, place, 1]
            low = np.maximum(low, best.least[place::places])
            anchor, row = np.nonzero(
                other & (scores >= low[:, None]) & (scores <= high[:, None]))
            best.add(anchor * places + place, scores[anchor, row], ids[row])
    pairs = np.unique(np.stack([best.rows[0] // places, best.rows[1], best.rows[2],
                                # Rows that share an id and a score count as often as they stand.
                                _repeats(best.rows)], axis=1), axis=0)
    yield _packed(block, pairs[:, 0], pairs[:, 1], NEGATIVE, pairs[:, 2])


def _repeats(rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The number of each row among its equals, which stand together."""
    n = len(rows[0])
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = np.any([r[1:] != r[:-1] for r in rows], axis=0)
    return np.arange(n) - np.flatnonzero(new)[np.cumsum(new) - 1] if n else np.zeros(0, np.int64)


def walk_positives(keys: Iterable[tuple[bytes, None]], limits: Limits) -> Iterator[tuple]:
    """(number, anchor_id, place, positive_id, score) of each anchor's first positives."""
    last, place = None, 0
    for key, _ in keys:
        anchor, number, score, _, row = _unpacked(key)
        place = place + 1 if (anchor, number) == last else 1
        last = anchor, number
        if place <= limits.positives:
            yield number, anchor, place, row, score


def walk_windows(keys: Iterable[tuple[bytes, None]], limits: Limits) -> Iterator[tuple]:
    """The result rows; keys come in order, so a positive opens its window before its negatives."""
    last, windows = None, []
    for key, _ in keys:
        anchor, number, score, kind, row = _unpacked(key)
        if (anchor, number) != last:
            last, windows = (anchor, number), []
        if kind == POSITIVE:
            if len(windows) < limits.positives:
                windows.append([row, score, *limits.window(score), 0])
            continue
        for window in windows:
            positive, positive_score, low, high, given = window
            if low <= score <= high and given < limits.negatives:
                window[4] += 1
                yield anchor, positive, window[4], row, positive_score, score


def _in_order(keys: DataFrame, walk: Callable, limits: Limits, schema: str, purpose: str) -> DataFrame:
    """Deals keys by anchor, sorts them within partitions and walks each partition once."""
    spark = keys.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The anchor's id and number are the key's first 16 bytes; crc32 spreads them alike on all machines.
    walked = keys.rdd.map(lambda r: (bytes(r.key), None)).repartitionAndSortWithinPartitions(
        parts, lambda key: crc32(key[:16])).mapPartitions(lambda it: walk(it, limits))
    return stored(spark.createDataFrame(walked, schema), purpose)


def mine(rows: DataFrame, is_anchor: Column, label: Column | None = None, scale: int = 256,
         limits: Limits = Limits(), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Hard negatives of each anchor and positive.

    ``rows`` holds vec_id, label and embedding (numbers); ``is_anchor`` marks the
    query set and ``label`` may replace the label, both as expressions over these columns.
    A component counts as floor(scale * x), a score is the inner product. An anchor's
    positives are the first ``limits.positives`` rows of its label under another id; beside
    each, the first ``limits.negatives`` rows of another label whose score lies in the window. First
    means higher scores, then smaller ids.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.
    Rows with a null id, label, vector or component, or one that is not finite, take no
    part. Vectors of different lengths have no score and never meet; empty ones score 0.
    Repeated rows count as often as they stand, repeated anchors give repeated
    results. Other columns are not read; an empty table, or one without anchors, gives no
    rows. Components beyond 2**62 count as 2**62, scores beyond 64 bits as the nearest long.
    """
    own = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"),
                      (F.col("label") if label is None else label).cast("bigint").alias("label"),
                      F.col("embedding").cast("array<double>").alias("embedding"),
                      is_anchor.alias("is_anchor"))
    spark = rows.sparkSession
    anchors = stored(own.where("is_anchor AND label IS NOT NULL AND embedding IS NOT NULL").select(
        "vec_id", "label", "embedding", F.monotonically_increasing_id().alias("number")), "anchors")
    data = own.select("vec_id", "label", "embedding")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, " \
        "positive_score long, negative_score long"
    results = spark.createDataFrame([], schema)
    # Blocks of one vector length each and of a bounded size: a scan of all rows for each.
    sizes = anchors.groupBy(F.size("embedding").alias("length")).count().orderBy("length").collect()
    for length, count in sizes:
        parts = -(-count * max(1, length) * 8 // block_bytes)
        for part in range(parts):
            held = anchors.where((F.size("embedding") == length) & (
                F.pmod(F.xxhash64("number"), F.lit(parts)) == part))
            block = _block(held, scale)
            if len(block.ids):
                results = results.unionByName(_mine_block(data, block, limits, scale, schema))
    return results


def _block(held: DataFrame, scale: int) -> Block:
    arrow = held.toArrow().combine_chunks()
    batches = arrow.to_batches()
    for batch in batches:
        for at, ids, labels, vectors in _rows(batch, scale):
            number = np.asarray(batch.column(3))[at].astype(np.int64)
            order = np.argsort(number)
            return Block(number[order], ids[order], labels[order], vectors[order])
    return Block(*(np.zeros(0, np.int64) for _ in range(3)), np.zeros((0, 0)))


def _mine_block(data: DataFrame, block: Block, limits: Limits, scale: int, schema: str) -> DataFrame:
    spark = data.sparkSession
    shared = spark.sparkContext.broadcast(block)
    keys = stored(data.mapInArrow(
        lambda batches: first_positives(batches, shared.value, limits, scale), "key binary"), "positive-keys")
    positives = _in_order(keys, walk_positives, limits,
                          "number long, anchor_id long, place int, row long, score long", "positives")
    # At most ``limits.positives`` rows for each anchor of this block.
    windows = np.full((len(block.ids), limits.positives, 2), LONGS.min)
    windows[:, :, 0] = LONGS.max  # no score lies in the window of a positive that is not there
    found = positives.select("number", "place", "score", "row").toPandas()
    at = np.searchsorted(block.number, found["number"].to_numpy(np.int64))
    ends = [limits.window(int(s)) for s in found["score"]]
    windows[at, found["place"].to_numpy(np.int64) - 1] = np.array(ends, np.int64).reshape(-1, 2)
    ends_of = spark.sparkContext.broadcast(windows)
    negatives = stored(data.mapInArrow(
        lambda batches: first_negatives(batches, shared.value, ends_of.value, limits, scale),
        "key binary"), "negative-keys")
    opened = _packed(block, at, found["score"].to_numpy(np.int64), POSITIVE,
                     found["row"].to_numpy(np.int64))
    both = negatives.unionByName(spark.createDataFrame(pa.Table.from_batches([opened])))
    mined = _in_order(both, walk_windows, limits, schema, "hard-negatives")
    ends_of.destroy()
    shared.destroy()
    return mined


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the ids divisible by 100; ids divisible by 7 have the next label."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(
        F.col("label"))
    return mine(rows, F.col("vec_id") % 100 == 0, moved)


ORACLE = """
WITH part AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vector
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS row_id, a.label = r.label AS same,
    CAST(list_inner_product(a.vector, r.vector) AS BIGINT) AS score
  FROM part a JOIN part r ON r.vec_id <> a.vec_id OR r.label <> a.label
  WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, row_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) <= 5)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.row_id) AS INTEGER)
    AS rank, n.row_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.row_id) <= 5
"""
