"""SimHash near-dedup: fingerprints searched with vantage-point trees.

Fingerprints at most three bits apart have a 32-bit half at most one bit apart,
so every distinct fingerprint goes through two trees, one over each half, with
radius one. The top of a tree is planned on the driver from a bounded sample:
each node holds a vantage point and the median distance to it. A fingerprint is
stored in one leaf, its shard, and asks every shard that its ball overlaps by the
triangle inequality. Inside a shard the tree goes on, and what it cannot rule
out is compared on all 64 bits, so links are exact. A shard passes on a forest
of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import one_row_each, stored, table, text_digest
from .components import LocalForest, components

SHINGLE_WORDS, SEED, MAX_BITS = 3, 42, 3
#: Fingerprints of a shard on average. The tops of the trees are planned on the driver from a
#: sample of at least SAMPLE_ROWS, a few per shard, and at most MOST_SAMPLED.
SHARD_ROWS, SAMPLE_ROWS, MOST_SAMPLED = 8192, 20_000, 1 << 22
#: Comparisons below which a node of a shard's tree is compared directly.
DIRECT = 1 << 17
HALF_BITS, HALF_RADIUS = 32, MAX_BITS // 2
#: Hashes of one step over a long text.
STEP = 1 << 15


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """64 bits: bit i is set if it is set in over half of the shingles' hashes."""
    # On bytes, lower() changes A-Z alone and split() parts at the six ASCII blanks.
    words = text.encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, n, STEP):
        hashes = np.fromiter(
            (digest(b" ".join(words[i:i + shingle_words]), SEED)
             for i in range(start, min(n, start + STEP))), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, digests: bool = False) -> DataFrame:
    """(doc_id, fp): fp as a signed bigint; null and wordless texts have fingerprint 0.

    With ``digests`` also the digest of each text, for telling rows apart.
    """
    more = [text_digest(F.col("text")).alias("digest")] if digests else []
    names = ["doc_id", "fp", "digest"][:2 + len(more)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or "", shingle_words)
                              for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), *batch.columns[2:]],
                                             names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *more).mapInArrow(
        run, "doc_id bigint, fp bigint" + ", digest string" * len(more))


def halves(fps: np.ndarray, half: int) -> np.ndarray:
    return (fps >> np.uint64(HALF_BITS * half)).astype(np.uint32)


Tree = tuple[np.ndarray, np.ndarray]


def plan_tree(sample: np.ndarray, depth: int) -> Tree:
    """The top of a tree over 32-bit halves as a heap: vantage points and median distances.

    A node whose sample lies on one side of every tried median is a leaf, with distance -1.
    """
    points = np.zeros(2 ** (depth + 1), np.uint32)
    middles = np.full(2 ** (depth + 1), -1, np.int8)
    members = {1: sample}
    rng = np.random.default_rng(SEED)
    for node in range(1, 2 ** depth):
        own = members.pop(node, None)
        if own is None or len(own) < 4:
            continue
        for vantage in rng.choice(own, 4):
            away = np.bitwise_count(own ^ vantage)
            near = away <= (middle := int(np.median(away)))
            if not near.all():
                points[node], middles[node] = vantage, middle
                members[2 * node], members[2 * node + 1] = own[near], own[~near]
                break
    return points, middles


def overlapped(values: np.ndarray, tree: Tree, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, indices of the values whose ball of this radius reaches it); radius 0: its own."""
    points, middles = tree
    stack = [(1, np.arange(len(values)))]
    while stack:
        node, at = stack.pop()
        if not len(at):
            continue
        middle = int(middles[node])
        if middle < 0:
            yield node, at
            continue
        away = np.bitwise_count(values[at] ^ points[node]).astype(np.int64)
        stack.append((2 * node, at[away - radius <= middle]))
        stack.append((2 * node + 1, at[away + radius > middle]))


def search_shard(stored_fps: np.ndarray, asking: np.ndarray, half: int,
                 forest: LocalForest, stored_at: np.ndarray, asking_at: np.ndarray,
                 max_bits: int = MAX_BITS) -> None:
    """Links every stored fingerprint with those asking that are at most max_bits apart."""
    seed = 0
    stack = [(np.arange(len(stored_fps)), np.arange(len(asking)), 0, True)]
    while stack:
        own, ask, failed, by_half = stack.pop()
        if not len(own) or not len(ask):
            continue
        if len(own) * len(ask) <= DIRECT or len(own) < 16 or failed >= 8:
            step = max(1, DIRECT // len(own))
            for start in range(0, len(ask), step):
                part = ask[start:start + step]
                hit = np.bitwise_count(
                    asking[part][:, None] ^ stored_fps[own][None, :]) <= max_bits
                q, s = np.nonzero(hit)
                forest.link(asking_at[part[q]], stored_at[own[s]])
            continue
        # By halves with radius 1; where halves no longer differ, by all bits.
        if by_half:
            a, b, radius = halves(stored_fps[own], half), halves(asking[ask], half), HALF_RADIUS
        else:
            a, b, radius = stored_fps[own], asking[ask], max_bits
        seed = (seed * 48271 + 11) % 2147483647
        vantage = a[seed % len(a)]
        away = np.bitwise_count(a ^ vantage).astype(np.int64)
        middle = int(np.median(away))
        near = away <= middle
        if near.all():
            if failed >= 3 and by_half:
                stack.append((own, ask, 0, False))
            else:
                stack.append((own, ask, failed + 1, by_half))
            continue
        asked = np.bitwise_count(b ^ vantage).astype(np.int64)
        stack.append((own[near], ask[asked - radius <= middle], 0, by_half))
        stack.append((own[~near], ask[asked + radius > middle], 0, by_half))


def links(distinct: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): links that join all distinct fingerprints (column fp) within three bits."""
    n = distinct.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n) / shard_rows))))
    sampled = min(MOST_SAMPLED, max(SAMPLE_ROWS, 4 << depth))
    sample = np.zeros(0, np.uint64)
    if depth:
        sample = distinct.select("fp").sample(min(1.0, 1.2 * sampled / n), seed=SEED).limit(
            sampled).toArrow().column(0).to_numpy().view(np.uint64)
    trees = [plan_tree(halves(sample, half), depth) for half in (0, 1)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for half, tree in enumerate(trees):
                values = halves(fps.view(np.uint64), half)
                home = np.empty(len(fps), np.int64)
                for leaf, at in overlapped(values, tree, 0):
                    home[at] = leaf
                for leaf, at in overlapped(values, tree, HALF_RADIUS):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), 2 * leaf + half)), pa.array(fps[at]),
                         pa.array(home[at] == leaf)], names=["shard", "fp", "own"])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = pdf["fp"].to_numpy().view(np.uint64)
        own = np.flatnonzero(pdf["own"].to_numpy())
        forest = LocalForest(len(fps))
        search_shard(fps[own], fps, int(pdf["shard"].iat[0]) % 2, forest, own,
                     np.arange(len(fps)))
        a, b = forest.links()
        return pd.DataFrame({"a": fps[a].view(np.int64), "b": fps[b].view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(deal, "shard bigint, fp bigint, own boolean")
    return dealt.groupBy("shard").applyInPandas(search, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint, component_id.

    Documents whose fingerprints are at most three bits apart are linked; the
    component is the smallest doc_id reachable. Null and wordless texts have
    fingerprint zero and are linked like any other, repeated rows share a
    fingerprint, and a text of fewer words than a shingle is one shingle. Null ids
    are linked too, but a component has a null id only if it has no other. Other
    columns are not read; an empty table gives no rows. Copies are summed to one
    fingerprint before the search, so their number does not matter.
    """
    found = stored(fingerprints(docs, shingle_words), "fingerprints")
    named = _grouped(found).select("fp", "component_id")
    return found.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(found: DataFrame) -> DataFrame:
    """(fp, component, component_id) of the fingerprints of rows (doc_id, fp)."""
    distinct = stored(found.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fps")
    of_fp = components(links(distinct)).select(F.col("node").alias("fp"), "component")
    grouped = distinct.join(of_fp, "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))
    lowest = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return stored(grouped.join(lowest, "component").select("fp", "component", "component_id"), "fp-components")


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, with all its columns: one of the smallest id.

    A row is told from others by its id and its text, so ids may be null, repeat, or stand for
    several texts; a null id stays only where its group has no other. Of rows of
    one id and text, and of several texts under the smallest id, one stays.
    """
    found = stored(fingerprints(docs, SHINGLE_WORDS, digests=True), "fingerprints")
    first = found.join(_grouped(found), "fp").groupBy("component").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("first"))
    return one_row_each(docs, first.select("first.doc_id", "first.digest"))


def op8_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
