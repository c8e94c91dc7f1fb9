import datetime as dt
import json

from helpers import D, table, values
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adhere.model import Horizon
from adhere.operators.ranking import with_positions
from adhere.plans import publish as P
from adhere.sources.sinks import as_json

DAY = Horizon(D(2024, 1, 3), D(2024, 1, 4))


def crowd(spark, hot=3000, others=50):
    """Owner 0 holds nearly all rows: a template and a day full of one-offs."""
    rows = spark.range(hot).select(
        F.concat(F.lit("h"), F.hex("id")).alias("activity_id"), F.lit(0).cast("long").alias("owner_id"),
        F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.lit("2024-01-03")).cast("date")
        .alias("entry_date"), (F.pmod(F.hash("id"), F.lit(5000))).cast("int").alias("sort_order"))
    rest = spark.range(others * 4).select(
        F.concat(F.lit("r"), F.hex("id")), F.floor(F.col("id") / 4) + 1, F.lit(None).cast("date"),
        (F.col("id") % 3).cast("int"))
    return rows.union(rest).select(
        "*", F.col("activity_id").alias("title"), F.lit("weekday").alias("day_type"),
        F.lit(None).cast("int").alias("planned_start_min"),
        F.lit(None).cast("int").alias("planned_end_min"), F.lit("rest").alias("category"),
        F.lit(None).cast("string").alias("color"), F.lit(None).cast("long").alias("goal_id"),
        F.lit("2024-01-01 05:00:00").cast("timestamp_ntz").alias("created_at"))


def test_positions_of_a_hot_group_are_exact(spark):
    """Also with nulls, one sort_order for a bulk insert, and a null key."""
    df = crowd(spark).withColumns({
        "owner_id": F.when(F.col("owner_id") != 7, F.col("owner_id")),
        "sort_order": F.when(F.col("sort_order") % 5 == 0, F.lit(None))
        .when(F.col("sort_order") % 5 == 1, 2000).otherwise(F.col("sort_order"))})
    order = [F.col("sort_order"), F.col("created_at"), F.col("activity_id")]
    got = with_positions(df, ["owner_id"], order, "p", size="n")
    assert got.columns == [*df.columns, "p", "n"]
    group = W.partitionBy("owner_id")
    want = df.withColumn("p", F.row_number().over(group.orderBy(*order)) - 1) \
        .withColumn("n", F.count("*").over(group))
    assert values(got, "activity_id", "p", "n") == values(want, "activity_id", "p", "n")


def test_positions_of_nothing(spark):
    assert with_positions(crowd(spark).limit(0), ["owner_id"], [F.col("sort_order")]).isEmpty()


def _people(spark, n):
    return spark.range(n).select(
        F.col("id").alias("owner_id"), F.lit(None).cast("string").alias("email"),
        F.concat(F.lit("u"), "id").alias("username"),
        F.concat(F.lit("C"), "id").alias("share_code"), F.lit(None).cast("string").alias("display_name"))


def test_parts_of_a_hot_document_lose_nothing(spark):
    acts, none = crowd(spark), table(spark, "logs", [])
    texts = table(spark, "reflections", [])
    whole = P.public_days(_people(spark, 60), acts, none, texts, DAY, part_size=10 ** 6)
    parts = P.public_days(_people(spark, 60), acts, none, texts, DAY, part_size=100)
    titles = F.transform("document.activities", lambda a: a["title"])
    want = {(r.owner_id, r.d): r.t for r in whole.select("owner_id", "d", titles.alias("t")).collect()}
    got, sizes = {}, []
    for r in parts.orderBy("part_no").select("owner_id", "d", titles.alias("t")).collect():
        got.setdefault((r.owner_id, r.d), []).extend(r.t)
        sizes.append(len(r.t))
    assert got == want
    assert len(want) == 120 and len(want[0, D(2024, 1, 3)]) == 3000
    assert max(sizes) <= 100
    # everybody else is one document
    assert parts.where("owner_id > 0 and part_no > 0").isEmpty()
    # every part tells whose it is and how many there are
    assert parts.where("document.owner_name is null or share_code is null").isEmpty()
    counts = {(r.owner_id, r.d): (r.n, r.c) for r in parts.groupBy("owner_id", "d").agg(
        F.count("*").alias("n"), F.max("part_count").alias("c")).collect()}
    assert all(n == c for n, c in counts.values())
    by_code = parts.where("share_code = 'C0' and d = '2024-01-03'").select(F.explode(titles)).count()
    assert by_code == 3000


def test_a_small_day_is_one_document_in_any_horizon(spark):
    rows = [dict(activity_id=f"x{k}", owner_id=0, title=str(k), day_type="weekday", category="c",
                 sort_order=k, entry_date=D(2024, 1, 4)) for k in range(30)]
    rows += [dict(activity_id=f"y{k}", owner_id=0, title=str(k), day_type="weekday", category="c",
                  sort_order=k, entry_date=D(2024, 1, 3)) for k in range(3)]
    args = (_people(spark, 1), table(spark, "activities", rows), table(spark, "logs", []),
            table(spark, "reflections", []))
    one = P.public_days(*args, Horizon(D(2024, 1, 3), D(2024, 1, 3)), part_size=10)
    month = P.public_days(*args, Horizon(D(2024, 1, 1), D(2024, 1, 31)), part_size=10)
    columns = ("part_no", "part_count", as_json("document"))
    assert values(one.select(*columns)) == values(month.where("d = '2024-01-03'").select(*columns))
    assert values(month.where("d = '2024-01-04'"), "part_no", "part_count") == [(0, 3), (1, 3), (2, 3)]


def _small(spark):
    acts = table(spark, "activities", [
        dict(activity_id="b", owner_id=0, title="second", day_type="weekday", category="rest",
             sort_order=1, planned_start_min=65, goal_id=5),
        dict(activity_id="a", owner_id=0, title="first", day_type="weekday", category="focus",
             sort_order=0)])
    logs = table(spark, "logs", [
        dict(owner_id=0, activity_id="b", log_date=D(2024, 1, 3), completed=True,
             note="a/* b */", actual_start_min=0, actual_end_min=30)])
    texts = table(spark, "reflections", [
        dict(owner_id=0, period_type="weekly", period_date=D(2024, 1, 1), content="w /* x"),
        dict(owner_id=0, period_type="monthly", period_date=D(2024, 1, 1), content="m"),
        dict(owner_id=0, period_type="daily", period_date=D(2024, 1, 3), content="d")])
    goals = table(spark, "goals", [
        dict(goal_id=5, owner_id=0, title="g", period_type="weekly", metric="hours")])
    return acts, logs, texts, goals


def test_day_document(spark):
    acts, logs, texts, _ = _small(spark)
    docs = P.public_days(_people(spark, 1), acts, logs, texts, Horizon(D(2024, 1, 3), D(2024, 1, 3)))
    assert json.loads(docs.select(as_json("document").alias("j")).collect()[0].j) == {
        "owner_name": "u0", "date": "2024-01-03", "activities": [
            {"title": "first", "category": "focus", "planned_start": None, "planned_end": None,
             "completed": False, "actual_start": None, "actual_end": None, "note": None},
            {"title": "second", "category": "rest", "planned_start": "01:05", "planned_end": None,
             "completed": True, "actual_start": "00:00", "actual_end": "00:30", "note": "a"}],
        "week_start": "2024-01-01", "week_reflection": "w", "month_start": "2024-01-01",
        "month_reflection": "m"}
    past = P.past_reflections(_people(spark, 1), texts, Horizon(D(2024, 1, 3), D(2024, 1, 3)),
                              D(2024, 1, 10))
    assert values(past, "week_reflection", "month_reflection") == [("w", None)]


def test_progress_document(spark):
    acts, logs, texts, goals = _small(spark)
    docs = P.public_progress(_people(spark, 2), acts, logs, goals, texts, D(2024, 1, 3))
    got = {r.owner_id: json.loads(r.j) for r in docs.select(
        "owner_id", as_json("document").alias("j")).collect()}
    mine = got[0]
    assert list(mine) == ["owner_name", "today", "week", "month", "calendar", "goals", "reflections"]
    assert [a["title"] for a in mine["today"]] == ["first", "second"]
    assert mine["week"] == {"done": 1, "planned": 10} and mine["month"] == {"done": 1, "planned": 46}
    assert len(mine["calendar"]) == 31
    assert mine["calendar"][2] == {"d": "2024-01-03", "planned": 2, "done": 1}
    assert mine["goals"] == [{"title": "g", "period": "weekly", "metric": "hours", "target": None,
                              "actual": 30}]
    assert mine["reflections"] == {"daily": "d", "weekly": "w", "monthly": "m"}
    assert got[1]["today"] == [] and got[1]["goals"] == []
    assert got[1]["week"] == {"done": 0, "planned": 0}


def test_week_totals_reach_over_the_month(spark):
    """The week of January 29 ends in February; the calendar does not."""
    acts, logs, texts, goals = _small(spark)
    docs = P.public_progress(_people(spark, 1), acts, logs, goals, texts, D(2024, 1, 31))
    doc = docs.select("document.*").collect()[0]
    assert doc.week.planned == 10 and doc.month.planned == 46 and len(doc.calendar) == 31


def test_owner_without_code_has_no_document(spark):
    acts, logs, texts, goals = _small(spark)
    people = _people(spark, 1).withColumn("share_code", F.lit(None).cast("string"))
    assert P.public_days(people, acts, logs, texts, DAY).isEmpty()
    assert P.public_progress(people, acts, logs, goals, texts, D(2024, 1, 3)).isEmpty()


def test_days_are_expanded_after_the_pieces_meet(spark):
    people, none, texts = _people(spark, 2), table(spark, "logs", []), table(spark, "reflections", [
        dict(owner_id=0, period_type="weekly", period_date=D(2024, 1, 29), content="week"),
        dict(owner_id=0, period_type="weekly", period_date=D(2024, 1, 30), content="no Monday"),
        dict(owner_id=0, period_type="monthly", period_date=D(2024, 2, 1), content="month"),
        dict(owner_id=7, period_type="monthly", period_date=D(2024, 2, 1), content="nobody's")])
    docs = P.public_days(people, table(spark, "activities", []), none, texts, Horizon(D(2024, 1, 30), D(2024, 2, 6)))
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(" in plan[:plan.index("Exchange")]
    owners = sorted({r.owner_id for r in people.collect()})
    got = {(r.owner_id, r.d): r.document for r in docs.collect()}
    assert sorted(got) == [(o, D(2024, 1, 30) + dt.timedelta(days=k)) for o in owners for k in range(8)]
    for (owner, d), doc in got.items():
        assert doc.week_reflection == ("week" if owner == 0 and d < D(2024, 2, 5) else None)
        assert doc.month_reflection == ("month" if owner == 0 and d >= D(2024, 2, 1) else None)
