"""What the operators share: reading a table, stored intermediate tables, small columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import store

#: Lower-casing of ASCII letters only; other letters stay as they are.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: The rows written to the shared folder and read again: later steps restart from these
#: files when an executor is lost, and what is used twice is computed once.
stored = store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8, A-Z lower-cased; null counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


def one_row_each(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row of ``docs``, with all its columns, for each row (doc_id, digest) of ``chosen``.

    The digest is that of the row's text (``text_digest``), so an id that stands for several
    texts, and ids that are null, are told apart. Of rows equal in both one stays;
    where they differ in other columns it is not told which.
    """
    def key(doc_id: Column, digest: Column) -> Column:
        return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), digest)

    keys = chosen.select(key(F.col("doc_id"), F.col("digest")).alias("key"))
    # Documents travel as one struct, so none of their columns can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"),
                       key(F.col("doc_id"), text_digest(F.col("text"))).alias("key"))
    return rows.join(keys, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents nothing is learned from; a null id belongs to it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))
