"""Mixing sources to target weights by exponential keys (Efraimidis and Spirakis).

Each document gets the key ``-ln(u) / weight`` with ``u`` from a digest of its
id, so the smallest keys of a source are a weighted sample without replacement
and reruns agree. Documents are put in key order within their source and their
sizes are summed up to the budget of the source: first whole epochs, then the
documents of the smallest keys for the rest, the last one in part.

The order of all rows by source and key is cut into slices by a range sort, so that no
task holds a source: sizes are summed per (source, slice), then over slices, then inside
a slice. The number of slices follows the number of rows; no result depends on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, stored, table

SLICE_ROWS = 4096
EPOCHS = 3
#: Weight of a document in the sample by its quality label; without a label 1.
QUALITY_WEIGHTS = {0: 0.5, 1: 2.0}


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(doc_id: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 from the id: 52 bits of its MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(
        doc_id.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(2 ** 52))


def targets(sizes: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """Budget of each source from rows of (source, source_size), one per source.

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share the
    total of all sizes. A target stops at ``epochs`` times its source's size and
    the excess is shared anew by weight. That ends where sources are capped in
    the order of cap / weight, which integers decide exactly: a source is capped
    if its cap is at most its share of what the sources before it left over.
    One row per source is all these windows see.
    """
    ordered = sizes.select("source", "source_size", (
        (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1
    ).cast("bigint").alias("w"))
    cap = F.col("source_size") * epochs
    # Equal levels are capped together: a range frame keeps them so.
    level = W.orderBy("level")
    before = level.rangeBetween(W.unboundedPreceding, -1)
    onward = level.rangeBetween(W.currentRow, W.unboundedFollowing)
    leveled = ordered.withColumns({"cap": cap, "level": (cap * 6 / F.col("w")).cast("bigint")})
    everything = W.partitionBy()
    capped = leveled.withColumns({
        "total": F.sum("source_size").over(everything),
        "spent": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "left_w": F.sum("w").over(onward),
    }).withColumn("capped", F.col("level").cast("decimal(38,0)") * F.col("left_w")
                  <= 6 * (F.col("total") - F.col("spent")))
    rest = capped.withColumns({
        "all_capped": F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything),
                                 F.lit(0)),
        "free_w": F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything),
    })
    return rest.select("source", "source_size", F.when(
        F.col("capped"), F.col("cap").cast("double")).otherwise(
        ((F.col("total") - F.col("all_capped")) * F.col("w")).cast("double")
        / F.col("free_w").cast("double")).alias("target"))


def mix(docs: DataFrame, weights: DataFrame | None = None, seed: int = 7,
        epochs: int = EPOCHS) -> DataFrame:
    """Words taken of each document: doc_id, size, source_size, target, taken.

    One row per row of ``docs`` (doc_id, source, text). A null text has size 0.
    Null sources are one source, the last. ``weights`` has (doc_id, weight), one
    row per id; documents without one weigh 1, and a negative weight counts as
    zero; documents of weight zero come last. Null ids share one key; rows that
    tie in key and id are taken in order of size. At most one document of a source
    is taken in part. Columns other than those read are ignored. An empty table
    gives no rows.
    """
    # Texts are read once and never shuffled; from here on rows are small.
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    heavy = F.lit(1.0)
    if weights is not None:
        rows = rows.join(weights.select(F.col("doc_id").alias("_id"), F.col("weight").alias(
            "_weight")), F.col("doc_id") == F.col("_id"), "left")
        heavy = F.greatest(F.coalesce(F.col("_weight").cast("double"), F.lit(1.0)), F.lit(0.0))
    sized = stored(rows.select(
        "doc_id", "source", "size",
        F.when(heavy > 0, -F.ln(uniform(F.col("doc_id"), seed)) / heavy)
         .otherwise(F.lit(float("inf"))).alias("key")), "mix-sizes")
    # A range sort cuts the order itself, whatever the weights, so slices are even.
    slices = max(1, -(-sized.count() // SLICE_ROWS))
    sliced = stored(sized.repartitionByRange(
        slices, F.col("source").asc_nulls_last(), "key", "doc_id", "size").withColumn(
        "slice", F.spark_partition_id()), "mix-slices")
    per_slice = sliced.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    budget = targets(per_slice.groupBy("source").agg(
        F.sum("slice_size").alias("source_size")), epochs)
    up_to = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_slice.withColumn(
        "offset", F.coalesce(F.sum("slice_size").over(up_to), F.lit(0))).join(
        budget.withColumnRenamed("source", "b_source"),
        F.col("source").eqNullSafe(F.col("b_source"))).select(
        F.col("source").alias("o_source"), F.col("slice").alias("o_slice"),
        "offset", "source_size", "target")
    within = W.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(
        W.unboundedPreceding, -1)
    placed = sliced.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(
        offsets, F.col("source").eqNullSafe(F.col("o_source"))
        & (F.col("slice") == F.col("o_slice")))
    whole = F.when(F.col("source_size") > 0, F.expr(
        "cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0))
    left_over = F.floor("target").cast("bigint") - F.col("whole") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(
        F.col("size"), left_over - F.col("before") - F.col("offset")))
    return placed.withColumn("whole", whole).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("whole") * F.col("size") + part).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """The mix itself: a document taken k times is k rows, always whole.

    ``taken`` has doc_id, size, taken. The one document of a source that is taken in part
    is there once more if at least half of it is taken, and else left out, so a source is
    off its target by half a document at most. Documents of which nothing is taken go; so do
    those without a word. All columns of ``docs`` stay. Rows that share an
    id and a size each stand for the mean of what is taken of them.
    """
    counts = taken.groupBy(F.col("doc_id").alias("id"), "size").agg(
        F.avg("taken").alias("taken")).where("size > 0").select(
        "id", "size", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("copies")).where("copies > 0")
    # Documents travel as one struct, so none of their columns can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row")).join(
        counts, F.col("row.doc_id").eqNullSafe(F.col("id"))
        & (word_count(F.col("row.text")) == F.col("size")))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def quality_weights(labels: DataFrame) -> DataFrame:
    """Sampling weight of each labelled document; the best of several labels counts."""
    weight = F.lit(1.0)
    for quality, value in QUALITY_WEIGHTS.items():
        weight = F.when(F.col("quality") == quality, value).otherwise(weight)
    return labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max("quality").alias("quality")).select("doc_id", weight.alias("weight"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, sampled by the weight of their quality label."""
    return mix(table(spark, sf_dir, "documents"),
               quality_weights(table(spark, sf_dir, "labels"))).select(
        "doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
d AS (
  SELECT d.doc_id, d.source,
         coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CASE q.quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         (('0x' || substr(md5('7:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE
          + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents d LEFT JOIN q USING (doc_id)),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
o AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM s),
l AS (SELECT *, source_size * 3 AS cap, source_size * 18 // w AS level,
             (sum(source_size) OVER ())::BIGINT AS total FROM o),
c AS (
  SELECT *, level::HUGEINT * (sum(w) OVER (ORDER BY level DESC)) <= 6 * (total
         - coalesce((SELECT sum(cap) FROM l y WHERE y.level < l.level), 0)) AS capped FROM l),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE
         ((total - coalesce((sum(cap) FILTER (capped) OVER ())::BIGINT, 0)) * w)::DOUBLE
         / (sum(w) FILTER (NOT capped) OVER ())::DOUBLE END AS target FROM c),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(u) / weight, d.doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, floor(target)::BIGINT - whole * source_size - before))
       )::BIGINT AS taken
FROM p
"""
