"""From raw documents to token ids: five stages, each writing what the next one reads.

All stages take null ids, ids that repeat or stand for several texts, null, empty and very long texts, extra
columns of any name, and empty tables, which give empty tables. All but the last return the columns they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adhere.llm import bpe, exact_dedup, langid, mixing, simhash
from adhere.llm.common import stored, table

#: Texts this far from every profile are in no language that was learned.
LEAST_LANGUAGE_SCORE = 0.2


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Goes: texts without a letter (null and empty ones), and those far from every language learned here.

    Each row is judged by its own text, so repeated rows stay or go together. Without a document to learn
    from, all go.
    """
    return langid.accepted(docs, langid.learned(docs), LEAST_LANGUAGE_SCORE)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Goes: all of equal texts but the one with the largest id.

    One row of each text stays, whatever ids repeat; under a null id only where there is no other.
    """
    return exact_dedup.kept_documents(docs, exact_dedup.new_index(spark))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Goes: all of a group of near copies but the one with the smallest id.

    One row of each group stays; under a null id only where there is no other. Texts without a word are one group.
    """
    return simhash.representatives(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target shares: documents repeat, stay, or go as the mix takes them, always whole.

    Null sources are one source. Documents without a word go. Rows that share an id and a number of words stand for the
    mean of what is taken of them.
    """
    taken = mixing.mix(docs, mixing.quality_weights(table(spark, sf_dir, "labels")))
    return mixing.mixed_documents(docs, taken)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of them and of what they decode to; a null text has none.

    One row for each row, also for repeated ones.
    """
    return bpe.encode_texts(docs, keep_ids=True)


STAGES = [
    ("language ID", known_language),
    ("exact dedup", without_copies),
    ("SimHash near-dedup", without_near_copies),
    ("mixing to target weights", mixed),
    ("byte-level BPE", tokens),
]

#: No SQL expresses rank-order profiles, trees over fingerprints or merges by rank.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
