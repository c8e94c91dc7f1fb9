"""Connected components of a link table, by alternating large and small stars.

Each round is one minimum per node and one join on the node, so that a node with
a third of all links sends a few partial minima, and its links may be split by
adaptive execution. Rounds are stored in the shared folder; only one number per
round reaches the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _lowest(both: DataFrame) -> DataFrame:
    return both.groupBy("a").agg(F.min("b").alias("low")).select(
        F.col("a").alias("n"), F.least("a", "low").alias("low"))


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of a node are linked to its smallest neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(_lowest(both), F.col("a") == F.col("n")).where("b > a").select(
        F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    low = _lowest(links)
    return links.join(low, F.col("a") == F.col("n")).select(
        F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
        low.select(F.col("n").alias("a"), F.col("low").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link; the component is its smallest node.

    ``links`` has bigint columns a and b in either direction; loops, repeated
    links and nulls are ignored. No links give no rows.
    """
    now = stored(links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
        large = _large_star(now).where("a <> b").distinct()
        now = stored(_small_star(large).where("a > b").distinct(), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


class LocalForest:
    """Components inside one task: of all links seen only a forest is passed on."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            low = np.minimum(ra, rb)
            np.minimum.at(self.root, ra, low)
            np.minimum.at(self.root, rb, low)
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """A link from every node that is not a root to its root."""
        rest = np.flatnonzero(self.root != np.arange(len(self.root)))
        return rest, self.root[rest]
