"""Current logs and live tallies from a stream of patches.

The stream itself keeps no state. Each micro-batch is folded to one delta per
touched log: for every field the newest value that batch sets, with its time.
Deltas fold into each other the same way, so the current table is a fold over
all deltas, in any order and with any split into batches.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clock as C
from ..functions import dates as D
from ..operators.occurrences import is_planned
from ..operators.upserts import LOG_KEY, LOG_PATCH_FIELDS
from ..sources.readers import one_offs, recurring
from .changelog import latest_rows, read_batches, run_available, write_batch
from .tiers import EVERY, TieredTable

_TYPES = {"completed": T.BooleanType(), "actual_start_min": T.IntegerType(),
          "actual_end_min": T.IntegerType(), "note": T.StringType()}


def _versioned(dtype: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("ts", T.TimestampNTZType()),
                         T.StructField("seq", T.LongType()), T.StructField("value", dtype)])


DELTA_SCHEMA = T.StructType([
    T.StructField("owner_id", T.LongType()), T.StructField("activity_id", T.StringType()),
    T.StructField("log_date", T.DateType()),
    *[T.StructField(f, _versioned(t)) for f, t in _TYPES.items()],
    T.StructField("log_month", T.StringType())])

TALLY_SCHEMA = T.StructType([
    T.StructField("owner_id", T.LongType()), T.StructField("d", T.DateType()),
    T.StructField("done", T.LongType()), T.StructField("total", T.LongType()),
    T.StructField("minutes", T.LongType())])


def to_deltas(patches: DataFrame) -> DataFrame:
    """One row per touched log; a field nobody sets is null."""
    return patches.groupBy(*LOG_KEY).agg(*[
        F.max(F.when(F.col(mask), F.struct("ts", "seq", F.col(field).alias("value"))))
        .alias(field) for field, mask in LOG_PATCH_FIELDS.items()]
    ).withColumn("log_month", F.date_format("log_date", "yyyy-MM"))


def merge_deltas(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*LOG_KEY, "log_month").agg(*[
        F.max(field).alias(field) for field in LOG_PATCH_FIELDS])


def current_logs(deltas: DataFrame) -> DataFrame:
    """Plain log rows; a log never marked is not completed."""
    merged = merge_deltas(deltas)
    return merged.select(
        *LOG_KEY, F.coalesce("completed.value", F.lit(False)).alias("completed"),
        *[F.col(f"{f}.value").alias(f) for f in LOG_PATCH_FIELDS if f != "completed"])


def arrivals(patches: DataFrame, path: str, steps: int) -> Iterator[int]:
    """Writes the patches to a feed folder, one part after the other; between the parts a stream may run."""
    part = F.pmod(F.xxhash64("seq"), F.lit(steps))
    for k in range(steps):
        patches.where(part == k).write.mode("overwrite").parquet(f"{path}/part={k}")
        yield k


def arrived(patches: DataFrame, path: str) -> DataFrame:
    """The feed folder as a stream, with the columns of ``patches``."""
    return patches.sparkSession.readStream.schema(patches.schema).option(
        "recursiveFileLookup", "true").parquet(path)


def read_deltas(spark: SparkSession, path: str,
                compacted: tuple[str, int] | None = None) -> DataFrame:
    """All deltas; with a compacted copy, that copy and the batches after it."""
    deltas = read_batches(spark, path, DELTA_SCHEMA)
    if compacted is None:
        return deltas
    base, through = compacted
    return read_batches(spark, base, DELTA_SCHEMA).unionByName(
        deltas.where(F.col("batch") > through))


def follow_logs(patches: DataFrame, deltas_path: str, checkpoint: str) -> None:
    """Append the deltas of everything that has arrived."""
    def each(batch: DataFrame, batch_id: int) -> None:
        _write_deltas(batch, deltas_path, batch_id)

    run_available(patches, each, checkpoint)


def _write_deltas(batch: DataFrame, path: str, batch_id: int) -> None:
    """One folder per month, in files sized by their rows rather than by tasks."""
    write_batch(to_deltas(batch).hint("rebalance", "log_month"), path, batch_id, "log_month")


def compact(spark: SparkSession, deltas_path: str, into: str, through: int,
            compacted: tuple[str, int] | None = None) -> None:
    """Fold the batches up to ``through`` into one, in another folder.

    An earlier copy saves reading the batches it covers. The stream keeps
    writing meanwhile; ``read_deltas`` puts both together.
    """
    old = read_deltas(spark, deltas_path, compacted).where(F.col("batch") <= through)
    write_batch(merge_deltas(old).hint("rebalance", "log_month"), into, through, "log_month")


def touched_tallies(touched: DataFrame, deltas: DataFrame,
                    activities: DataFrame) -> DataFrame:
    """Done count, number planned and active minutes of the given (owner, day) pairs.

    A later correction may undo a mark, so the pairs are counted anew from
    their current logs. The month is part of the join, which lets Spark prune
    the delta folders by the months that were touched.
    """
    pairs = touched.select("owner_id", "log_date",
                           F.date_format("log_date", "yyyy-MM").alias("log_month")).distinct()
    mine = deltas.join(pairs, ["owner_id", "log_date", "log_month"], "left_semi")
    plan = activities.select("owner_id", "activity_id", "day_type", "entry_date")
    zero = F.lit(0).cast("long")
    done = current_logs(mine).join(plan, ["owner_id", "activity_id"]) \
        .where(is_planned(F.col("log_date"))).select(
        "owner_id", "log_date", F.col("completed").cast("long").alias("done"), zero.alias("total"),
        C.span_minutes(F.col("actual_start_min"), F.col("actual_end_min")).alias("minutes"))
    return _with_totals(done, pairs, activities)


def _with_totals(done: DataFrame, pairs: DataFrame, activities: DataFrame) -> DataFrame:
    """Rows (owner_id, log_date, done, minutes) summed per pair, with the number planned on its day."""
    plan = activities.select("owner_id", "activity_id", "day_type", "entry_date")
    zero = F.lit(0).cast("long")
    # The agenda of a day: its day type's template, summed first, and its own one-offs.
    template = recurring(plan).groupBy("owner_id", "day_type").agg(F.count(F.lit(1)).alias("total"))
    planned = pairs.withColumn("day_type", D.day_type(F.col("log_date"))).join(
        template, ["owner_id", "day_type"]).select("owner_id", "log_date", "total")
    single = one_offs(plan).select("owner_id", F.col("entry_date").alias("log_date")) \
        .join(pairs, ["owner_id", "log_date"], "left_semi").groupBy("owner_id", "log_date").agg(
        F.count(F.lit(1)).alias("total"))
    counted = done.unionByName(planned, allowMissingColumns=True) \
        .unionByName(single, allowMissingColumns=True).unionByName(
        pairs.select("owner_id", "log_date"), allowMissingColumns=True)
    return counted.groupBy("owner_id", F.col("log_date").alias("d")).agg(*[
        F.coalesce(F.sum(c), zero).alias(c) for c in ("done", "total", "minutes")])


# Batches after which the deltas are folded into one.
COMPACT_EVERY = 16


def base_of(batch_id: int, every: int = COMPACT_EVERY) -> int | None:
    """The last batch that the compacted copy read by ``batch_id`` covers, if there is one."""
    through = (batch_id // every) * every - 1
    return through if through >= 0 else None


def follow_tallies(patches: DataFrame, activities: DataFrame, deltas_path: str,
                   tallies_path: str, checkpoint: str, compact_every: int = COMPACT_EVERY) -> None:
    """Append deltas and, from them, the tallies of every touched day.

    Each ``compact_every`` batches the deltas so far are folded into a copy beside
    them, from the copy before and the batches since. So a batch reads one copy
    and fewer than ``compact_every`` batches, however long the stream has run.
    A replayed batch reads what it read before: copies cover whole numbers of
    batches and overwrite themselves.
    """
    def base(batch_id: int) -> tuple[str, int] | None:
        through = base_of(batch_id, compact_every)
        return None if through is None else (f"{deltas_path}-through-{through}", through)

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _write_deltas(batch, deltas_path, batch_id)
        here = base(batch_id)
        if here and batch_id == here[1] + 1:
            compact(spark, deltas_path, *here, base(here[1]))
        fresh = read_deltas(spark, deltas_path).where(F.col("batch") == batch_id)
        # A replayed batch must not see batches after it.
        known = read_deltas(spark, deltas_path, here).where(F.col("batch") <= batch_id)
        write_batch(touched_tallies(fresh, known, activities), tallies_path, batch_id)

    run_available(patches, each, checkpoint)


def current_tallies(spark: SparkSession, path: str) -> DataFrame:
    return latest_rows(read_batches(spark, path, TALLY_SCHEMA), ["owner_id", "d"])


CHANGE_SCHEMA = T.StructType([
    T.StructField("owner_id", T.LongType()), T.StructField("d", T.DateType()),
    T.StructField("done", T.LongType()), T.StructField("minutes", T.LongType())])


def _delta_table(spark: SparkSession, path: str, every: int) -> TieredTable:
    return TieredTable(spark, f"{path}/deltas", DELTA_SCHEMA, merge_deltas, ("log_month",), every)


def _change_table(spark: SparkSession, path: str, every: int) -> TieredTable:
    def fold(changes: DataFrame) -> DataFrame:
        return changes.groupBy("owner_id", "d").agg(*[F.sum(c).alias(c) for c in ("done", "minutes")])

    return TieredTable(spark, f"{path}/changes", CHANGE_SCHEMA, fold, (), every)


def tally_changes(fresh: DataFrame, known: DataFrame, activities: DataFrame) -> DataFrame:
    """By how much the deltas of a batch move done and minutes of each (owner, day) they touch.

    The touched logs are brought together with what was known of them: their image before is taken
    back, their image after is added. Logs that are not on the day's plan move nothing. One aggregate makes
    both images.
    """
    touched = fresh.select(*LOG_KEY, "log_month")
    old = known.join(touched, [*LOG_KEY, "log_month"], "left_semi")
    both = old.withColumn("_new", F.lit(False)).unionByName(fresh.withColumn("_new", F.lit(True)))
    images = both.groupBy(*LOG_KEY).agg(
        *[F.max(F.when(~F.col("_new"), F.col(f))).alias(f"{f}_before") for f in LOG_PATCH_FIELDS],
        *[F.max(f).alias(f"{f}_after") for f in LOG_PATCH_FIELDS])
    plan = activities.select("owner_id", "activity_id", "day_type", "entry_date")
    planned = images.join(plan, ["owner_id", "activity_id"], "left").withColumn(
        "_counts", F.coalesce(F.col("day_type").isNotNull() & is_planned(F.col("log_date")), F.lit(False)))

    def counted(side: str) -> tuple:
        done = F.coalesce(F.col(f"completed_{side}.value"), F.lit(False)).cast("long")
        return done, C.span_minutes(F.col(f"actual_start_min_{side}.value"), F.col(f"actual_end_min_{side}.value"))

    (done, minutes), (was_done, was_minutes) = counted("after"), counted("before")
    return planned.groupBy("owner_id", F.col("log_date").alias("d")).agg(*[
        F.sum(F.when(F.col("_counts"), now - was).otherwise(0)).cast("long").alias(name)
        for name, now, was in (("done", done, was_done), ("minutes", minutes, was_minutes))])


def of_months(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """What is known of the months that a batch touches: other folders are not opened.

    The months' names come to the driver, one for each month a batch has edits of.
    """
    months = [r.log_month for r in fresh.select("log_month").distinct().collect()]
    return known.where(F.col("log_month").isin(months))


def follow_tally_changes(patches: DataFrame, activities: DataFrame, path: str, checkpoint: str,
                         every: int = EVERY) -> None:
    """Keep tallies as sums of signed changes.

    A batch reads what is known of the logs it touches, from the months it touches, and writes its deltas
    and its changes; no day is counted anew. Both tables are folded in tiers (``tiers``), so old months
    that nobody edits are never rewritten. A replayed batch reads the batches before it and overwrites its own
    folders. ``tiers.covered`` names the folders that may be removed.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        deltas, changes = _delta_table(spark, path, every), _change_table(spark, path, every)
        for table in (deltas, changes):
            table.fold_due(batch_id)
        deltas.write(to_deltas(batch).hint("rebalance", "log_month"), batch_id)
        fresh = deltas._read([(0, batch_id)])
        # An empty row stands for a batch without edits, so that every batch can be counted.
        mark = spark.createDataFrame([(None, None, 0, 0)], CHANGE_SCHEMA)
        changes.write(tally_changes(fresh, of_months(deltas.before(batch_id), fresh), activities).unionByName(mark), batch_id)

    run_available(patches, each, checkpoint)


def tallies_from_changes(spark: SparkSession, path: str, activities: DataFrame, every: int = EVERY) -> DataFrame:
    """(owner_id, d, done, total, minutes) of every touched day: the sums, and the day's plan as it is now."""
    changes = _change_table(spark, path, every).rows().where(F.col("owner_id").isNotNull()).select(
        "owner_id", F.col("d").alias("log_date"), "done", "minutes")
    return _with_totals(changes, changes.select("owner_id", "log_date").distinct(), activities)


def follow_log_state(patches: DataFrame, path: str, checkpoint: str) -> None:
    """Keep the newest value of every field of every log in the stream's own state.

    A streaming aggregate in update mode: the state store holds a row per log, a batch reads and writes
    the rows of the logs it touches and gives these out, and a restart goes on from the checkpoint. What a
    batch gives out is the whole current row, so the newest one of a log is the log.
    """
    def each(rows: DataFrame, batch_id: int) -> None:
        write_batch(rows, path, batch_id)

    run_available(to_deltas(patches).drop("log_month"), each, checkpoint, "update")


def logs_of_state(spark: SparkSession, path: str) -> DataFrame:
    """The current logs of ``follow_log_state``."""
    schema = T.StructType([f for f in DELTA_SCHEMA if f.name != "log_month"])
    newest = latest_rows(read_batches(spark, path, schema), LOG_KEY)
    return newest.select(*LOG_KEY, F.coalesce("completed.value", F.lit(False)).alias("completed"), *[
        F.col(f"{f}.value").alias(f) for f in LOG_PATCH_FIELDS if f != "completed"])


WEEK_COUNT_SCHEMA = T.StructType([
    T.StructField("owner_id", T.LongType()), T.StructField("week_start", T.DateType()),
    T.StructField("edits", T.LongType())])


def week_counts(patches: DataFrame) -> DataFrame:
    """Edits per owner and Monday-based week."""
    return patches.groupBy("owner_id", D.week_start(F.to_date("ts")).alias("week_start")) \
        .agg(F.count(F.lit(1)).alias("edits"))


def follow_weekly_counts(patches: DataFrame, counts_path: str, checkpoint: str) -> None:
    """Append the counts of each batch. They are sums, so no edit is ever too late and
    the result does not depend on how a backlog is split into batches."""
    def each(batch: DataFrame, batch_id: int) -> None:
        write_batch(week_counts(batch), counts_path, batch_id)

    run_available(patches, each, checkpoint)


def current_weekly_counts(spark: SparkSession, path: str) -> DataFrame:
    return read_batches(spark, path, WEEK_COUNT_SCHEMA).groupBy("owner_id", "week_start") \
        .agg(F.sum("edits").alias("edits"))


def live_weekly_counts(patches: DataFrame, lateness: str = "7 days") -> DataFrame:
    """The same as a windowed stream with bounded state, for a live display.

    Edits that arrive more than ``lateness`` behind the newest one are left out;
    that is the bound on the state. Windows are aligned to the epoch, a Thursday,
    hence the four days. Edit times carry no zone; they are read as UTC for the
    windows, whatever the session's zone is.
    """
    zone = F.current_timezone()
    timed = patches.withColumn("at", F.convert_timezone(F.lit("UTC"), zone, F.col("ts"))
                               .cast("timestamp")).withWatermark("at", lateness)
    week = F.window("at", "7 days", startTime="4 days")
    monday = F.to_date(F.to_utc_timestamp(F.col("window.start"), zone))
    return (timed.groupBy("owner_id", week).agg(F.count(F.lit(1)).alias("edits"))
            .select("owner_id", monday.alias("week_start"), "edits"))


ON_TIME_SCHEMA = T.StructType([T.StructField("owner_id", T.LongType()), T.StructField("ts", T.TimestampNTZType())])


def split_by_lateness(batch: DataFrame, behind: dt.datetime | None, lateness: str) -> DataFrame:
    """Rows (owner_id, ts) with ``late``: their week had ended ``lateness`` before ``behind``, the newest
    time of all earlier batches. Before the first batch nothing is late."""
    rows = batch.select("owner_id", "ts")
    if behind is None:
        return rows.withColumn("late", F.lit(False))
    week_end = F.date_add(D.week_start(F.to_date("ts")), 7).cast("timestamp_ntz")
    mark = F.lit(behind).cast("timestamp_ntz") - F.expr(f"interval {lateness}")
    return rows.withColumn("late", F.coalesce(week_end <= mark, F.lit(False)))


def follow_windowed_weeks(patches: DataFrame, path: str, checkpoint: str, lateness: str = "7 days") -> None:
    """Weekly counts by event-time windows of bounded state, and what comes too late for them.

    A first stream parts each batch: edits whose week's window is closed are counted apart, in ``late``,
    the others go on as files, and the newest time so far is kept. A second stream counts those files by windows
    under a watermark. Its watermark is never ahead of the one the parting went by, however batches
    are split, so it drops nothing. The streams run one after the other: a batch of the first that is replayed
    overwrites files the second has not seen.
    """
    def part(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        behind = None
        if batch_id:
            behind = read_batches(spark, f"{path}/newest", NEWEST_SCHEMA).where(
                F.col("batch") == batch_id - 1).first().newest
        split = split_by_lateness(batch, behind, lateness).persist()
        write_batch(split.where("NOT late").select("owner_id", "ts"), f"{path}/on-time", batch_id)
        write_batch(week_counts(split.where("late")), f"{path}/late", batch_id)
        newest = split.agg(F.greatest(F.max("ts"), F.lit(behind).cast("timestamp_ntz")).alias("newest"))
        write_batch(newest, f"{path}/newest", batch_id)
        split.unpersist()

    run_available(patches, part, f"{checkpoint}/parting")
    on_time = patches.sparkSession.readStream.schema(ON_TIME_SCHEMA).option(
        "recursiveFileLookup", "true").parquet(f"{path}/on-time")
    follow_live_weekly_counts(on_time, f"{path}/windows", f"{checkpoint}/windows", lateness)


NEWEST_SCHEMA = T.StructType([T.StructField("newest", T.TimestampNTZType())])


def windowed_weeks(spark: SparkSession, path: str) -> DataFrame:
    """(owner_id, week_start, edits, late_edits): all edits of each week, and how many of them came late."""
    zero = F.lit(0).cast("long")
    windows = live_counts(spark, f"{path}/windows").withColumn("late_edits", zero)
    late = current_weekly_counts(spark, f"{path}/late").withColumn("late_edits", F.col("edits"))
    return windows.unionByName(late).groupBy("owner_id", "week_start").agg(
        F.sum("edits").alias("edits"), F.sum("late_edits").alias("late_edits"))


def follow_live_weekly_counts(patches: DataFrame, counts_path: str, checkpoint: str,
                              lateness: str = "7 days") -> None:
    def each(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, counts_path, batch_id)

    run_available(live_weekly_counts(patches, lateness), each, checkpoint, "update")


def live_counts(spark: SparkSession, path: str) -> DataFrame:
    return latest_rows(read_batches(spark, path, WEEK_COUNT_SCHEMA),
                       ["owner_id", "week_start"])
