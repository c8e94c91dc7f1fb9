"""Exact dedup against a persistent digest index, bucketed and sorted by hash.

The index is a table of one row per digest, ``CLUSTERED BY (digest) SORTED BY
(digest)``. New data is summed to one row per digest (partial sums come before
the shuffle, so a text with a third of all rows sends a few rows), goes through
a sort-merge anti-join with the index, which reads its buckets without a
shuffle, and what is new is appended. An index never changes a row: the text
that came first stays, over all later batches.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookups import lookup
from ..session import work_path
from .common import one_row_each, stored, table, text_digest

INDEX_COLUMNS = "digest STRING, keep_id BIGINT, n_rows BIGINT"


class DigestIndex:
    """The table of known digests at ``path``; made empty where nothing is yet.

    ``buckets`` is fixed when the index is made and kept beside its files in
    ``_buckets``; an index opened again takes the count from there, whatever the
    session says, and another count is refused. Files without a kept count are taken
    only if each digest lies in its bucket. A bucket should stay below a few hundred
    MB: about 50 bytes a distinct text.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark, self.path = spark, path
        self.buckets = self._kept_buckets(buckets)
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} ({INDEX_COLUMNS}) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS "
                  f"LOCATION '{path}'")

    def _kept_buckets(self, asked: int | None) -> int:
        kept = f"{self.path.rstrip('/')}/_buckets"
        try:
            buckets = self.spark.read.text(kept).first()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            buckets = None
        if buckets is None:
            made = asked or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            if self._misplaced(made):
                raise ValueError(f"{self.path} was not made with {made} buckets")
            self.spark.range(1).select(F.lit(str(made)).alias("value")).write.mode(
                "overwrite").text(kept)
            return made
        if asked and asked != int(buckets.value):
            raise ValueError(f"{self.path} was made with {buckets.value} buckets, not {asked}")
        return int(buckets.value)

    def _misplaced(self, buckets: int) -> bool:
        """Whether files at the path hold a digest outside the bucket their name says."""
        try:
            rows = self.spark.read.schema(INDEX_COLUMNS).parquet(self.path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return False
        named = F.regexp_extract(F.col("_metadata.file_name"), r"_(\d+)(?:\..*)?$", 1)
        return not rows.where(F.pmod(F.hash("digest"), F.lit(buckets)) != F.when(
            named != "", named.cast("int")).otherwise(-1)).isEmpty()

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def new_of(self, batch: DataFrame) -> DataFrame:
        """The entries to add for those of a batch (``counted``)."""
        return batch.join(self.rows().hint("merge"), "digest", "left_anti")

    def append(self, entries: DataFrame) -> None:
        """One file per bucket; a failed append leaves the index as it was."""
        (entries.select("digest", "keep_id", "n_rows").repartition(self.buckets, "digest")
         .write.mode("append").format("parquet").option("path", self.path)
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name))

    def entries(self) -> DataFrame:
        """The index as plain files: Spark may then split a hot digest of the other side."""
        return self.spark.read.schema(INDEX_COLUMNS).parquet(self.path)


def counted(digests: DataFrame) -> DataFrame:
    """An entry for each text of rows (doc_id, digest): the largest doc_id stays."""
    return digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n_rows"))


def deduplicate(docs: DataFrame, index: DigestIndex, text: str = "text",
                doc_id: str = "doc_id") -> DataFrame:
    """Adds a batch to the index; one row per row of the batch.

    Columns: doc_id, keep_id (the row that stays, possibly one of an earlier
    batch), group_size (rows with this text in the batch that brought it),
    kept, text_sha256. Null texts are empty texts, and empty texts equal each
    other. Null ids never win over an id; among null ids alone keep_id is null
    and each of them is kept. Rows that repeat an id and a text are one document
    written twice and share their fate, in one batch or in several. Other columns of the batch are not read,
    so their names cannot clash. An empty batch gives no rows.
    """
    digests = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"),
                          text_digest(F.col(text)).alias("digest"))
    batch = stored(counted(digests), "batch-digests")
    index.append(index.new_of(batch))
    entries = index.entries().select(F.col("digest").alias("known"), "keep_id", F.col("n_rows").alias("group_size"))
    # The rows of a frequent text do not meet in one task.
    found = lookup(digests, entries, "digest", "known", "left",
                   counts=batch.select("digest", F.col("n_rows").alias("n")), spread_by=["doc_id"])
    return found.select("doc_id", "keep_id", "group_size",
                        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                        F.col("digest").alias("text_sha256"))


def kept_documents(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """One document of each text that the index does not know yet, with all its columns.

    It is the one with the largest id, a null id only where there is no other; rows that
    repeat an id and a text give one row. The texts are added to the index.
    """
    digests = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                          text_digest(F.col("text")).alias("digest"))
    # Stored before the anti-join, which the optimizer would else move below the sums.
    new = stored(index.new_of(stored(counted(digests), "batch-digests")), "new-digests")
    index.append(new)
    return one_row_each(docs, new.select(F.col("keep_id").alias("doc_id"), "digest"))


def new_index(spark: SparkSession) -> DigestIndex:
    return DigestIndex(spark, work_path(spark, "digest-index"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against an index that starts empty."""
    return deduplicate(table(spark, sf_dir, "documents"), new_index(spark))


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                  'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.n AS group_size,
       d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.h AS text_sha256
FROM d JOIN g USING (h)
"""
