"""A table kept as blocks of micro-batches, folded in tiers.

Tier 0 has a block per batch. As soon as ``every`` blocks of a tier are complete they are folded into one
block of the next tier, so a table of n batches is read from fewer than
``every`` blocks of each of its log(n) tiers, and each row is rewritten once per tier, whatever
the age of the table. Blocks are folders ``tier=t/block=b``, partitioned further by what the
reader prunes (months): a fold reads and writes only what its own batches brought.

A block's content follows from its batches alone, so a batch that is replayed, with the folds it
starts, overwrites folders with what they held.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVERY = 16


def blocks_before(batch_id: int, every: int = EVERY) -> list[tuple[int, int]]:
    """(tier, block) of the blocks that hold the batches below ``batch_id``, each batch once."""
    tier = 0
    while every ** (tier + 1) <= batch_id:
        tier += 1
    out, start = [], 0
    for t in range(tier, -1, -1):
        size = every ** t
        n = (batch_id - start) // size
        out += [(t, start // size + k) for k in range(n)]
        start += n * size
    return out


def folds_due(batch_id: int, every: int = EVERY) -> list[tuple[int, int]]:
    """(tier, block) of the blocks that become complete with the batch before ``batch_id``, lowest tier first."""
    out, tier = [], 1
    while batch_id and batch_id % every ** tier == 0:
        out.append((tier, batch_id // every ** tier - 1))
        tier += 1
    return out


def blocks_written(batches: int, every: int = EVERY) -> list[tuple[int, int]]:
    """The same for a reader between two batches: the folds that the next batch finds due are not made yet."""
    due, out = set(folds_due(batches, every)), []
    todo = blocks_before(batches, every)[::-1]
    while todo:
        tier, block = todo.pop()
        if (tier, block) in due:
            todo += [(tier - 1, block * every + k) for k in range(every)][::-1]
        else:
            out.append((tier, block))
    return out


def covered(committed: int, every: int = EVERY) -> list[tuple[int, int]]:
    """(tier, block) of the blocks no reader needs once batch ``committed`` is committed: those inside a
    block of a higher tier whose fold is older than that batch, as a replay starts after it."""
    kept, out = set(blocks_before(committed, every)), []
    tier = 0
    while every ** tier <= committed:
        out += [(tier, b) for b in range(committed // every ** tier) if (tier, b) not in kept]
        tier += 1
    return out


class TieredTable:
    """Rows of a stream at ``path``; ``fold`` brings rows of several batches together, in any order."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, fold: Callable[[DataFrame], DataFrame],
                 partition_by: tuple[str, ...] = (), every: int = EVERY) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.fold, self.partition_by, self.every = fold, partition_by, every

    def _folder(self, tier: int, block: int) -> str:
        return f"{self.path}/tier={tier}/block={block}"

    def _write(self, rows: DataFrame, tier: int, block: int) -> None:
        writer = rows.select(*self.schema.names).write.mode("overwrite")
        if self.partition_by:
            writer = writer.partitionBy(*self.partition_by)
        writer.parquet(self._folder(tier, block))

    def _read(self, blocks: list[tuple[int, int]]) -> DataFrame:
        if not blocks:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(
            *[self._folder(*b) for b in blocks]).select(*self.schema.names)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        self._write(rows, 0, batch_id)

    def before(self, batch_id: int) -> DataFrame:
        """Rows of all batches below ``batch_id``, folded as far as their tiers are."""
        return self._read(blocks_before(batch_id, self.every))

    def fold_due(self, batch_id: int) -> None:
        """The folds that batch ``batch_id`` finds due, before it reads anything."""
        for tier, block in folds_due(batch_id, self.every):
            parts = [(tier - 1, block * self.every + k) for k in range(self.every)]
            self._write(self.fold(self._read(parts)), tier, block)

    def batches(self) -> int:
        """How many batches there are; each must have written a row."""
        found = self.spark.read.parquet(self.path)
        held = found.agg(F.max((F.col("block") + 1) * F.pow(F.lit(float(self.every)), F.col("tier")))).first()[0]
        return int(held or 0)

    def rows(self) -> DataFrame:
        return self._read(blocks_written(self.batches(), self.every))
