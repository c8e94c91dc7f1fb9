"""The six tables and the edit feeds, derived from the given parquet tables.

customers are the owners, events are their edits, documents are their
reflections. Every row of those tables takes part; values are assigned by
rule, so the same rows can be derived in plain SQL (see FIXTURES.md).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.names import CODE_SPACE, code_of_number
from ..functions.rows import several_rows
from ..model import TARGET_TYPE
from ..operators.latest import latest_per_key
from ..session import store

# Events above this value are one-off entries, the others log the routine.
ONE_OFF_VALUE = 200
# An edit at or above this value marks its activity done.
DONE_VALUE = 20
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
EMAIL_DOMAIN = "example.org"


def _type_number(event_type: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), event_type).cast("int")


def _code_for(owner: Column) -> Column:
    """A code of its own for every owner number: 7919 has no factor 2, 3 or 5."""
    return code_of_number((owner * 7919 + 104729) % CODE_SPACE)


class DriverTables:
    """Lazy tables over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._kept: dict[str, DataFrame] = {}

    def raw(self, table: str) -> DataFrame:
        """A given table with the schema of its file; those six of ``model`` are derived from it."""
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    @cached_property
    def profiles(self) -> DataFrame:
        username = F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("")))
        owner = F.col("c_custkey")
        return self.raw("customer").select(
            owner.alias("owner_id"),
            F.concat(username, F.lit(f"@{EMAIL_DOMAIN}")).alias("email"),
            username.alias("username"),
            _code_for(owner).alias("share_code"),
            F.when(owner % 5 != 0, F.col("c_name")).alias("display_name"))

    @cached_property
    def edits(self) -> DataFrame:
        return self._as_edits(self.raw("events"))

    def edit_stream(self, batch_bytes: int = 256 << 30) -> DataFrame:
        """The same edits as a stream over the events table.

        ``batch_bytes`` bounds a micro-batch; a backlog becomes several.
        """
        reader = self.spark.readStream.schema(self.raw("events").schema) \
            .option("maxBytesPerTrigger", batch_bytes)
        # A stream over one file needs a pattern; this one matches the table's name alone.
        return self._as_edits(reader.parquet(f"{self.folder}/event[s].parquet"))

    def kept(self, name: str) -> DataFrame:
        """One of these tables, derived once and read from the shared folder by each use."""
        if name not in self._kept:
            self._kept[name] = store(getattr(self, name), name)
        return self._kept[name]

    @staticmethod
    def _as_edits(events: DataFrame) -> DataFrame:
        """One patch per event; the masks say which fields it sets."""
        seq, value, ts = F.col("event_id"), F.col("value"), F.col("ts")
        start = F.hour(ts) * 60 + F.minute(ts)
        one_off = value > ONE_OFF_VALUE
        end = (F.when(seq % 10 == 0, F.lit(None))
               .when(seq % 7 == 0, F.greatest(start - 5, F.lit(0)))
               .otherwise(F.least(F.lit(1439), start + F.floor(value).cast("int"))))
        note = (F.when(seq % 4 == 0, F.concat(F.lit("done /* private "), seq.cast("string"),
                                              F.lit(" */ well")))
                .when(seq % 4 == 1, F.concat(F.lit("ok /* hidden "), F.col("event_type")))
                .when(seq % 4 == 2, F.concat(F.col("event_type"), F.lit(" note "),
                                             (seq % 17).cast("string"))))
        routine = F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("event_type"))
        return events.select(
            seq.alias("seq"), ts, F.col("user_id").alias("owner_id"), "event_type", "value",
            F.when(one_off, F.concat(F.lit("e"), seq.cast("string"))).otherwise(routine)
             .alias("activity_id"),
            one_off.alias("one_off"), F.to_date(ts).alias("log_date"),
            (value >= DONE_VALUE).alias("completed"),
            start.alias("actual_start_min"), end.alias("actual_end_min"),
            note.alias("note"),
            (seq % 3 == 0).alias("sets_completed"), (seq % 3 == 1).alias("sets_times"),
            (seq % 3 == 2).alias("sets_note"))

    @cached_property
    def edit_authors(self) -> DataFrame:
        """Who sent each edit: its owner, or one of the next few keys."""
        seq, owner = F.col("event_id"), F.col("user_id")
        return self.raw("events").select(
            seq.alias("seq"), owner.alias("owner_id"), (owner + seq % 6).alias("author_id"))

    @cached_property
    def activities(self) -> DataFrame:
        """A routine per owner and event type, and a one-off per event above
        ``ONE_OFF_VALUE``. A routine is for weekends when these hold over a
        third of its value, counted in whole cents."""
        kind = _type_number(F.col("event_type"))
        owner = F.col("owner_id")
        cents = F.round(F.col("value") * 100).cast("long")
        at_weekends = F.when(D.day_type(F.col("log_date")) == "weekend", cents).otherwise(0)
        routine = (
            self.edits.where(~F.col("one_off"))
            .groupBy("owner_id", "event_type", "activity_id")
            .agg(F.min("ts").alias("created_at"),
                 F.sum(cents).alias("_cents"), F.sum(at_weekends).alias("_at_weekends"))
            .select(
                "activity_id", "owner_id", F.col("event_type").alias("title"),
                F.when(F.col("_at_weekends") * 3 > F.col("_cents"), "weekend")
                 .otherwise("weekday").alias("day_type"),
                (390 + kind * 90).alias("planned_start_min"),
                (450 + kind * 90).alias("planned_end_min"),
                F.when(kind.isin(2, 5), "focus").when(kind == 4, "move")
                 .otherwise("rest").alias("category"),
                kind.alias("sort_order"), F.lit(None).cast("date").alias("entry_date"),
                F.when(kind == 2, "#3f6fb0").alias("color"),
                F.when(kind.isin(2, 5), owner * 2).when(kind == 4, owner * 2 + 1)
                 .alias("goal_id"),
                "created_at"))
        single = self.edits.where("one_off").select(
            "activity_id", "owner_id", F.concat(F.lit("extra "), "event_type").alias("title"),
            D.day_type(F.col("log_date")).alias("day_type"),
            F.lit(None).cast("int").alias("planned_start_min"),
            F.lit(None).cast("int").alias("planned_end_min"),
            F.lit("rest").alias("category"), F.lit(100).alias("sort_order"),
            F.col("log_date").alias("entry_date"), F.lit(None).cast("string").alias("color"),
            F.when(kind == 3, owner * 2 + 1).alias("goal_id"), F.col("ts").alias("created_at"))
        return routine.unionByName(single)

    @cached_property
    def logs(self) -> DataFrame:
        # Only the columns of a log: whole rows are carried through the aggregate.
        words = self.edits.select(
            "owner_id", "activity_id", "log_date", "ts", "seq", "completed", "note",
            "actual_start_min", "actual_end_min")
        return latest_per_key(words, ["owner_id", "activity_id", "log_date"], ["ts", "seq"]) \
            .withColumnRenamed("ts", "updated_at").drop("seq")

    @cached_property
    def goals(self) -> DataFrame:
        owner = F.col("c_custkey")
        return self.raw("customer").select(several_rows(
            dict(goal_id=owner * 2, owner_id=owner, title=F.lit("Focus time"),
                 period_type=F.lit("weekly"), metric=F.lit("hours"),
                 target=F.lit("2.50").cast(TARGET_TYPE),
                 created_at=F.lit("2024-01-01 10:00:00").cast("timestamp_ntz")),
            dict(goal_id=owner * 2 + 1, owner_id=owner, title=F.lit("Moves"),
                 period_type=F.lit("monthly"), metric=F.lit("count"),
                 target=(owner % 9).cast(TARGET_TYPE),
                 created_at=F.lit("2024-01-01 09:00:00").cast("timestamp_ntz"))))

    @cached_property
    def reflection_edits(self) -> DataFrame:
        """Every document, whole, as somebody's reflection with a private part."""
        doc, text = F.col("doc_id"), F.col("text")
        half = F.floor(F.length(text) / 2).cast("int")
        part = F.floor(F.length(text) / 4).cast("int")
        head = F.substr(text, F.lit(1), half)
        mid = F.substr(text, half + 1, part)
        tail = F.substr(text, half + part + 1, F.length(text))
        return self.raw("documents").select(
            doc.alias("seq"), F.floor(doc / 6).cast("long").alias("owner_id"),
            F.when(doc % 3 == 0, "daily").when(doc % 3 == 1, "weekly").otherwise("monthly")
             .alias("period_type"),
            F.when(doc % 3 == 0, F.date_add(F.lit("2024-01-01").cast("date"),
                                            (doc % 30).cast("int")))
             .when(doc % 3 == 1, F.date_add(F.lit("2024-01-01").cast("date"),
                                            (F.floor(doc / 3) % 5 * 7).cast("int")))
             .otherwise(F.lit("2024-01-01").cast("date")).alias("period_date"),
            F.when(doc % 4 == 0, F.concat(head, F.lit("/* "), mid, F.lit(" */"), tail))
             .when(doc % 4 == 1, F.concat(head, F.lit("/*"), mid, tail))
             .when(doc % 4 == 2, F.concat(head, F.lit("\n // "), mid, F.lit("\n"), tail))
             .otherwise(text).alias("content"))

    @cached_property
    def reflections(self) -> DataFrame:
        return latest_per_key(self.reflection_edits,
                              ["owner_id", "period_type", "period_date"], ["seq"]) \
            .select("owner_id", "period_type", "period_date", "content")

    @cached_property
    def shares(self) -> DataFrame:
        """Each owner shares towards two other keys; edges to nobody are dropped."""
        owner, step = F.col("c_custkey"), F.col("c_nationkey").cast("long") + 1
        edges = self.raw("customer").select(several_rows(
            dict(owner_id=owner, viewer_id=owner + step,
                 permission=F.when(F.col("c_acctbal") < 0, "edit").otherwise("view")),
            dict(owner_id=owner, viewer_id=owner - step,
                 permission=F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"),
                                   "edit").otherwise("view"))))
        viewers = self.raw("customer").select(F.col("c_custkey").alias("viewer_id"))
        return edges.join(viewers, "viewer_id", "left_semi") \
            .select("owner_id", "viewer_id", "permission")

    @cached_property
    def share_requests(self) -> DataFrame:
        """Grants asked for by code: some to oneself, some to codes nobody has."""
        seq, owner = F.col("event_id"), F.col("user_id")
        target = F.when(seq % 4 == 0, owner).otherwise(owner + seq % 4)
        code = F.when(F.col("event_type") == "error", F.lit("999999")) \
            .otherwise(_code_for(target))
        return self.raw("events").select(
            seq.alias("seq"), "ts", owner.alias("owner_id"),
            F.concat(F.lit(" "), F.lower(code), F.lit(" ")).alias("code"),
            F.when(F.col("value") >= DONE_VALUE, "edit").otherwise("view").alias("permission"))

    @cached_property
    def share_edits(self) -> DataFrame:
        """Changes to shares by key; errors take the share away."""
        seq, owner = F.col("event_id"), F.col("user_id")
        return self.raw("events").select(
            seq.alias("seq"), "ts", owner.alias("owner_id"),
            (owner + seq % 4 + 1).alias("viewer_id"),
            F.when(F.col("value") >= DONE_VALUE, "edit").otherwise("view").alias("permission"),
            (F.col("event_type") == "error").alias("removed"))

    @cached_property
    def activity_forms(self) -> DataFrame:
        """New one-off entries as typed into a form, untrimmed and with blanks."""
        seq, value = F.col("event_id"), F.col("value")
        return self.raw("events").select(
            seq.alias("seq"), F.col("ts").alias("created_at"),
            F.col("user_id").alias("owner_id"), F.to_date("ts").alias("entry_date"),
            F.when(seq % 11 == 0, "   ")
             .otherwise(F.concat(F.lit("  "), F.col("event_type"), F.lit("\t"))).alias("title"),
            F.when(seq % 4 == 0, " ").when(seq % 4 == 1, "").otherwise(" focus ")
             .alias("category"),
            F.when(value < DONE_VALUE, "").otherwise(F.date_format("ts", "HH:mm"))
             .alias("planned_start"),
            F.lit("").alias("planned_end"),
            F.when(seq % 5 == 0, (F.col("user_id") * 2).cast("string")).otherwise("")
             .alias("goal_id"),
            F.when(seq % 6 == 0, "#4e944f").otherwise("").alias("color"))

    @cached_property
    def goal_forms(self) -> DataFrame:
        """New goals as typed: blank names, words for numbers, zero, negative."""
        seq, value = F.col("event_id"), F.col("value")
        return self.raw("events").select(
            seq.alias("seq"), F.col("user_id").alias("owner_id"),
            F.when(seq % 13 == 0, "").otherwise(F.concat(F.lit(" "), F.col("event_type")))
             .alias("title"),
            F.when(seq % 2 == 0, "weekly").otherwise("monthly").alias("period_type"),
            F.when(seq % 2 == 0, "hours").otherwise("count").alias("metric"),
            F.when(seq % 7 == 0, "many").when(seq % 7 == 1, "0").when(seq % 7 == 2, "-1.5")
             .when(seq % 21 == 3, "123456789.125").when(seq % 21 == 10, "0.004")
             .when(seq % 21 == 17, "0.000000000004")
             .otherwise(F.floor(value).cast("string")).alias("target"))

    @cached_property
    def signups(self) -> DataFrame:
        owner = F.col("owner_id")
        return self.profiles.select(
            "owner_id", "email",
            F.when(owner % 2 == 0, F.concat(F.lit('{"username": "u'), owner.cast("string"),
                                            F.lit('"}')))
             .otherwise("{}").alias("raw_user_meta_data"))

    @cached_property
    def closed_accounts(self) -> DataFrame:
        """Owners to erase: the customers in debt."""
        return self.raw("customer").where(F.col("c_acctbal") < 0) \
            .select(F.col("c_custkey").alias("owner_id"))

    @cached_property
    def dropped_activities(self) -> DataFrame:
        """Activities to delete: everything of the event type ``error``."""
        return self.activities.where(F.col("title").isin("error", "extra error")) \
            .select("activity_id")

    @cached_property
    def dropped_goals(self) -> DataFrame:
        """Goals to delete: those without a target."""
        return self.goals.where(F.col("target") == 0).select("goal_id")

    @cached_property
    def activity_patches(self) -> DataFrame:
        """An edit of one or two fields per event, as typed; several for most routines."""
        seq, kind = F.col("seq"), F.col("seq") % 6
        return self.edits.select(
            "seq", "ts", "activity_id",
            (kind.isin(0, 5)).alias("sets_title"), (kind == 1).alias("sets_category"),
            (kind == 1).alias("sets_color"), (kind.isin(2, 5)).alias("sets_goal"),
            (kind == 3).alias("sets_day_type"), (kind == 4).alias("sets_times"),
            F.when(seq % 4 == 0, "  ").otherwise(F.concat(
                F.lit(" new "), F.col("event_type"), F.lit("\t"))).alias("title"),
            F.when(seq % 4 == 1, "").otherwise(" focus ").alias("category"),
            F.when(seq % 8 < 4, "").otherwise("#112233").alias("color"),
            F.when(kind == 5, "x").when(seq % 5 == 0, "")
             .otherwise((F.col("owner_id") * 2).cast("string")).alias("goal_id"),
            F.when(seq % 10 == 3, "someday").when(F.col("value") >= DONE_VALUE, "weekend")
             .otherwise("weekday").alias("day_type"),
            F.date_format("ts", "HH:mm").alias("planned_start"), F.lit("").alias("planned_end"))

    @cached_property
    def moves(self) -> DataFrame:
        """A drag in the day's list per event, several for many lists.

        Some moves go nowhere and some point outside their list.
        """
        seq = F.col("seq")
        return self.edits.select(
            "owner_id", F.col("log_date").alias("d"), "seq",
            (seq % 4).cast("int").alias("from_index"),
            (F.floor(seq / 4) % 4).cast("int").alias("to_index"))

    def untidy(self, name: str) -> DataFrame:
        """One of the six tables with values missing or outside their list."""
        owner = F.col("owner_id")
        if name == "goals":
            return self.untidy_goals
        df = getattr(self, name)
        column, bad, rows = {
            "profiles": ("email", None, owner % 6 == 0),
            "activities": ("day_type", "holiday", owner % 5 == 0),
            "logs": ("completed", None, owner % 7 == 0),
            "reflections": ("period_type", "yearly", owner % 4 == 0),
            "shares": ("permission", "own", owner % 3 == 0)}[name]
        return df.withColumn(column, F.when(rows, F.lit(bad)).otherwise(F.col(column)))

    @cached_property
    def untidy_goals(self) -> DataFrame:
        """Goal forms forced into the goals schema without cleaning."""
        return self.goal_forms.select(
            F.col("seq").alias("goal_id"), "owner_id",
            F.nullif("title", F.lit("")).alias("title"),
            F.when(F.col("seq") % 9 == 0, "daily").otherwise(F.col("period_type"))
             .alias("period_type"),
            F.when(F.col("seq") % 10 == 0, "words").otherwise(F.col("metric"))
             .alias("metric"),
            F.col("target").try_cast(TARGET_TYPE).alias("target"))
