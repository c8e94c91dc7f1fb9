"""Embedding near-dedup by sorted projection passes.

In each pass vectors of one label are ordered lexicographically by concatenated
random hashes (signs of random projections), and every vector is compared to its
neighbours within a window of ranks. The window is extended over all vectors
that share the leading bits of the hash, as many bits as leave a window of rows on
average, so a pair is seen in a pass at least when these bits agree. The chance of
that follows from the cosine alone, whatever the vectors and the sizes of their
clusters, and each label takes as many passes as fix the recall. Pairs are verified
by cosine in double precision. Every vector carries its ranks and leading bits in
all passes, so a pair that several passes see is counted in the first of them, and
neither pairs nor copies of pairs are ever written: a block passes on one row per
vector (links counted) and a forest of the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .components import LocalForest, components

COSINE = 0.93
#: Passes at least, signs of a pass.
PASSES, HASHES, SEED = 8, 48, 17
#: Chance at least that a pair whose cosine just suffices is found; labels with more rows than
#: a window take more passes for it.
RECALL = 0.999
#: Ranks compared to either side in each pass; ranks of one task.
WINDOW, BLOCK = 1024, 8192
#: Rows of one matrix product; signs of one step of hashing.
ROWS, KEY_SIGNS = 512, 1 << 22


@lru_cache(maxsize=8)
def projections(dim: int, passes: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((passes * HASHES, dim))


def plan_passes(n: int, cosine: float, passes: int, window: int) -> tuple[int, int]:
    """(bits, passes) for a label of n vectors: leading bits that are shared, passes for RECALL."""
    bits = min(HASHES, max(0, int(n - 1) // window).bit_length())
    seen = (1 - np.arccos(cosine) / np.pi) ** bits
    needed = np.log(1 - RECALL) / np.log1p(-seen) if seen < 1 else 1
    return bits, max(passes, int(np.ceil(needed)))


def hash_keys(vectors: np.ndarray, passes: int) -> np.ndarray:
    """(vector, pass): the signs of a pass concatenated, the first the most significant."""
    signs = vectors @ projections(vectors.shape[1], passes).T > 0
    shifts = np.arange(HASHES - 1, -1, -1)
    return (signs.reshape(len(vectors), passes, HASHES).astype(np.int64) << shifts).sum(axis=2)


def usable(embedding: Column) -> Column:
    """Neither null nor zero, no component null, NaN or infinite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two that brings its largest component near 1.

    Directions stay exactly as they are, and no square of a very large or small component is lost.
    """
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, initial=0))
    return np.ldexp(vectors, -exponent[:, None])


def _keys(planned: DataFrame) -> DataFrame:
    """(pass, label, dim, lead, key, node) of every class in every pass of its label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, label = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            lists = batch.column(2)
            bits, passes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            dims = np.asarray(lists.value_lengths())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(dims)
            for dim, count in np.unique(np.stack([dims, passes], axis=1), axis=0):
                all_ = np.flatnonzero((dims == dim) & (passes == count))
                step = max(1, KEY_SIGNS // (HASHES * count))
                for own in (all_[i:i + step] for i in range(0, len(all_), step)):
                    vectors = _scaled(flat[(ends[own] - dim)[:, None] + np.arange(dim)])
                    keys = hash_keys(vectors, count)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.tile(np.arange(count), len(own))),
                         label.take(pa.array(np.repeat(own, count))),
                         pa.array(np.full(len(own) * count, dim, np.int64)),
                         pa.array((keys >> (HASHES - bits[own])[:, None]).ravel()),
                         pa.array(keys.ravel()), pa.array(np.repeat(node[own], count))],
                        names=["pass", "label", "dim", "lead", "key", "node"])

    return planned.select("node", "label", "embedding", "bits", "passes").mapInArrow(
        run, "pass bigint, label bigint, dim bigint, lead bigint, key bigint, node bigint")


def _ranks(keys: DataFrame) -> DataFrame:
    """(node, places): rank, leading bits and blocks of each node in every pass, from one sort.

    The range-partitioned sort is stored with each row's place in its partition; only
    the partitions' row counts come to the driver. ``first`` and ``last`` are the
    blocks of the run of equal leading bits, null for a run inside one block: of the
    others there is at most one per block, so their table is small.
    """
    run = ["pass", "label", "dim", "lead"]
    order = [*run, "key", "node"]
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(keys.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
        *run, "node", F.monotonically_increasing_id().alias("at")), "pass-order")
    part = F.shiftright("at", 33)
    counts = dict(placed.groupBy(part.alias("part")).count().collect())
    offsets, before = [], 0
    for p in range(parts):
        offsets.append(before)
        before += counts.get(p, 0)
    ranked = placed.withColumn("rank", (F.element_at(F.lit(offsets), (part + 1).cast(
        "int")) + F.col("at").bitwiseAND((1 << 33) - 1)).cast("bigint"))
    block = F.floor(F.col("rank") / BLOCK)
    long = stored(ranked.groupBy(*run).agg(F.min(block).alias("first"), F.max(block).alias(
        "last")).where("first < last"), "long-runs")
    # As many rows per node as its label has passes.
    return ranked.join(long, run, "left").groupBy("node").agg(F.array_sort(F.collect_list(
        F.struct("pass", "rank", "lead", "first", "last"))).alias("places"))


def _deal(classes: DataFrame, ranks: DataFrame, window: int) -> DataFrame:
    """Every vector in every task that compares it.

    A task is a block of ranks with the window behind it, or two blocks of one run
    of equal leading bits. ``own`` rows are of the block, the others of ``other``.
    """
    def tasks(block: Column, other: Column, own: bool) -> Column:
        return F.struct(block.alias("block"), other.alias("other"), F.lit(own).alias("own"))

    at = classes.join(ranks, "node").select(
        "node", "label", "embedding", "size", "places", F.explode("places").alias("place")).select(
        "node", "label", "embedding", "size", "place.*", "places").withColumn(
        "block", F.floor(F.col("rank") / BLOCK))
    block, none = F.col("block"), F.expr("array()")
    spilled = (F.col("rank") % BLOCK < window) & (block > 0)
    dealt = F.concat(
        F.array(tasks(block, block, True)),
        F.when(spilled, F.array(tasks(block - 1, block - 1, False))).otherwise(none),
        F.when(F.col("last") > block, F.transform(F.sequence(
            block + 1, F.col("last")), lambda b: tasks(block, b, True))).otherwise(none),
        F.when(F.col("first") < block, F.transform(F.sequence(
            F.col("first"), block - 1), lambda b: tasks(b, block, False))).otherwise(none))
    seen = F.slice("places", F.lit(1), (F.col("pass") + 1).cast("int"))
    return at.select(
        "pass", "node", "label", "embedding", "size",
        F.transform(seen, lambda x: x["rank"]).alias("ranks"),
        F.transform(seen, lambda x: x["lead"]).alias("leads"),
        F.explode(dealt).alias("task")).select("*", "task.*").drop("task")


def _compare(pdf: pd.DataFrame, cosine: float, window: int) -> pd.DataFrame:
    """Links of one task of a pass: (node, n_links, root)."""
    number = int(pdf["pass"].iat[0])
    across = pdf["block"].iat[0] != pdf["other"].iat[0]
    ranks = np.stack(pdf["ranks"].to_numpy())
    order = np.argsort(ranks[:, number])
    pdf, ranks = pdf.iloc[order], ranks[order]
    leads = np.stack(pdf["leads"].to_numpy())
    node, size = pdf["node"].to_numpy(), pdf["size"].to_numpy()
    own, label = pdf["own"].to_numpy(), pdf["label"].to_numpy()
    dims = pdf["embedding"].map(len).to_numpy()
    forest, n_links = LocalForest(len(pdf)), np.zeros(len(pdf), np.int64)
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        x = _scaled(np.stack(pdf["embedding"].to_numpy()[at]).astype(np.float64))
        norm = np.sqrt((x * x).sum(axis=1))
        # Where the run of equal label and leading bits ends; of two blocks all rows are one run.
        new_run = (np.diff(label[at]) != 0) | (np.diff(leads[at, number]) != 0)
        run = np.concatenate([[0], np.cumsum(new_run)])
        run_end = np.searchsorted(run, run, "right")
        n_own = int(own[at].sum())
        for start in range(0, n_own if across else len(at), ROWS):
            a = at[start:min(start + ROWS, n_own) if across else start + ROWS]
            # Ranks have gaps where other dimensions lie between, never more places.
            end = max(start + ROWS + window, run_end[start + len(a) - 1])
            for low in range(n_own if across else start, min(end, len(at)), ROWS + window):
                b = at[low:min(low + ROWS + window, end)]
                dots = x[start:start + len(a)] @ x[low:low + len(b)].T
                near = dots >= cosine * np.outer(
                    norm[start:start + len(a)], norm[low:low + len(b)])
                i, j = np.nonzero(near)
                i, j = a[i], b[j]
                away = ranks[j, number] - ranks[i, number]
                same = leads[i, number] == leads[j, number]
                good = (away > 0) & own[i] & (label[i] == label[j]) & (
                    same & (away > window) if across else (away <= window) | same & own[j])
                i, j = i[good], j[good]
                forest.link(i, j)
                for earlier in range(number):
                    new = (np.abs(ranks[i, earlier] - ranks[j, earlier]) > window) & (
                        leads[i, earlier] != leads[j, earlier])
                    i, j = i[new], j[new]
                np.add.at(n_links, i, size[j])
                np.add.at(n_links, j, size[i])
    said = np.flatnonzero((n_links > 0) | (forest.root != np.arange(len(pdf))))
    return pd.DataFrame({"node": node[said], "n_links": n_links[said],
                         "root": node[forest.root[said]]})


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, passes: int = PASSES) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label), ``passes`` at least.

    Columns: vec_id, n_links (other vectors linked directly), component_id
    (smallest vec_id reachable), kept. Equal vectors of a label are one class in
    the search and count as links of each other. Vectors that are null, empty, zero or
    hold null or non-finite components, and those without a label, link with
    nothing and are kept. Vectors of different lengths never link. Rows that
    repeat an id count each; null ids are linked, but name a component only if it
    has no other id. Other columns are not read; an empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"),
                          F.col("label").cast("bigint").alias("label"), F.when(
        usable(F.col("embedding")), F.col("embedding")).alias("embedding"))
    classes = stored(rows.where("label IS NOT NULL AND embedding IS NOT NULL").groupBy(
        "label", "embedding").agg(F.min("vec_id").alias("first_id"),
                                  F.count(F.lit(1)).alias("size")).withColumn(
        "node", F.monotonically_increasing_id()), "vector-classes")
    window = WINDOW

    @F.pandas_udf("bits bigint, passes bigint")
    def plan(n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([plan_passes(x, cosine, passes, window) for x in n],
                            columns=["bits", "passes"])

    dim = F.size("embedding").alias("dim")
    plans = stored(classes.groupBy("label", dim).count().select(
        "label", "dim", plan("count").alias("plan")).select("label", "dim", "plan.*"), "pass-plans")
    planned = classes.select("node", "label", "embedding", dim).join(plans, ["label", "dim"])
    searched = _deal(classes, _ranks(_keys(planned)), window)
    found = stored(searched.groupBy("pass", "block", "other").applyInPandas(
        lambda pdf: _compare(pdf, cosine, window), "node bigint, n_links bigint, root bigint"),
        "links")
    counted = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    grouped = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = classes.select("node", "first_id", "size").join(counted, "node", "left").join(
        grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(lowest, "component").select("node", "component_id", (
        F.col("size") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"))
    of_class = classes.join(named, "node").select("label", "embedding", "component_id", "n_links")
    return rows.join(of_class, ["label", "embedding"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
         .alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9_projection_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
