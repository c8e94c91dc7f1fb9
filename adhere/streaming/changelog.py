"""A table written as one folder per micro-batch.

A batch overwrites its own folder, so a batch that is replayed after a failure
leaves the same files. Nothing is read back through the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def write_batch(df: DataFrame, path: str, batch_id: int, *partition_by: str) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path}/batch={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All batches, with their number in the column ``batch``."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(full).parquet(path)


def latest_rows(batches: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the newest batch for each key."""
    rest = [c for c in batches.columns if c not in (*keys, "batch")]
    return (batches.groupBy(*keys)
            .agg(F.max_by(F.struct(*rest), F.col("batch")).alias("_row"))
            .select(*keys, "_row.*"))


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None],
                  checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there now and stop; a later call goes on from there."""
    query = (stream.writeStream.outputMode(mode).foreachBatch(each)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return query
