"""The SQL functions on small tables; their queries beside SQL are in test_queries."""

import datetime as dt
import json
import re

import pytest
from helpers import D, table

from adhere.plans import registry
from adhere.plans import sql_functions as S
from adhere.sources.driver_tables import DriverTables


@pytest.fixture(scope="module")
def sql(spark):
    made = {
        "profiles": [dict(owner_id=1, username="ann", display_name="Ann", share_code="AAAAAA"),
                     dict(owner_id=2, username="bob", share_code="BBBBBB"), dict(owner_id=3, username="cy")],
        "activities": [
            dict(activity_id="a", owner_id=1, title="Run", day_type="weekday", planned_start_min=390,
                 planned_end_min=450, category="move", sort_order=2),
            dict(activity_id="b", owner_id=1, title="Read", day_type="weekday", category="rest", sort_order=1, goal_id=7),
            dict(activity_id="c", owner_id=1, title="Nap", day_type="weekend", category="rest", sort_order=1),
            dict(activity_id="d", owner_id=1, title="Trip", day_type="weekday", category="rest", sort_order=100,
                 entry_date=D(2024, 1, 10))],
        "logs": [dict(owner_id=1, activity_id="b", log_date=D(2024, 1, 10), completed=True, note="x /* y */",
                      actual_start_min=60, actual_end_min=125),
                 dict(owner_id=1, activity_id="b", log_date=D(2024, 1, 8), completed=False, actual_start_min=9,
                      actual_end_min=5)],
        "reflections": [dict(owner_id=1, period_type="weekly", period_date=D(2024, 1, 8), content="/* all */"),
                        dict(owner_id=1, period_type="monthly", period_date=D(2024, 1, 1), content=" good "),
                        dict(owner_id=1, period_type="daily", period_date=D(2024, 1, 10), content="today")],
        "shares": [dict(owner_id=1, viewer_id=2, permission="view"), dict(owner_id=2, viewer_id=3, permission="edit")],
        "goals": [dict(goal_id=7, owner_id=1, title="Hours", period_type="weekly", metric="hours", target=2)],
    }
    from decimal import Decimal
    made["goals"][0]["target"] = Decimal(2)
    S.register(spark, {n: table(spark, n, rows) for n, rows in made.items()}, prefix="small_")
    yield spark.sql


def one(sql, query):
    rows = sql(query).collect()
    assert len(rows) == 1
    return rows[0]


def test_scalars(sql):
    got = one(sql, r"""SELECT strip_private('a /* b */ c'), strip_private('x /* open'), strip_private('/* all */ '),
                   strip_private(NULL), strip_private('a\n/* b\nc */\t'), clean_code('  ab3\t'), clock(61), clock(NULL),
                   percent_done(29, 200), percent_done(3, 0), percent_done(1, 8)""")
    assert list(got) == ["a  c", "x", None, None, "a", "AB3", "01:01", None, 14, 0, 13]


def test_access(sql):
    got = one(sql, """SELECT can_view(1, 1), can_edit(1, 1), can_view(2, 1), can_edit(2, 1), can_edit(3, 2), can_view(1, 2),
                   can_view(NULL, 1), can_edit(1, NULL)""")
    assert list(got) == [True, True, True, False, True, False, False, False]
    rows = sql("SELECT activity_id FROM small_activities WHERE can_view(2, owner_id)").collect()
    assert len(rows) == 4 and sql("SELECT * FROM small_activities WHERE can_edit(2, owner_id)").count() == 0


def test_schedule(sql):
    rows = sql("SELECT * FROM get_public_schedule(' aaaaaa ') ORDER BY day_type, sort_order").collect()
    assert [(r.owner_name, r.title, r.planned_start_min) for r in rows] == [
        ("Ann", "Read", None), ("Ann", "Run", 390), ("Ann", "Nap", None)]
    assert sql("SELECT * FROM get_public_schedule('ZZZZZZ')").count() == 0
    assert sql("SELECT * FROM get_public_schedule(NULL)").count() == 0


def test_day(sql):
    day = one(sql, "SELECT * FROM get_public_day('AAAAAA', DATE '2024-01-10')")
    assert [(a.title, a.completed, a.actual_end, a.note) for a in day.activities] == [
        ("Read", True, "02:05", "x"), ("Run", False, None, None), ("Trip", False, None, None)]
    assert (day.owner_name, day.date, day.week_start, day.week_reflection, day.month_reflection) == (
        "Ann", "2024-01-10", "2024-01-08", None, "good")
    sunday = one(sql, "SELECT * FROM get_public_day('AAAAAA', DATE '2024-02-04')")
    assert [a.title for a in sunday.activities] == ["Nap"] and sunday.month_reflection is None
    assert one(sql, "SELECT * FROM get_public_day('bbbbbb', DATE '2024-01-10')").activities == []
    assert sql("SELECT * FROM get_public_day('ZZZZZZ', DATE '2024-01-10')").count() == 0


def test_progress(sql):
    got = one(sql, "SELECT * FROM get_public_progress('AAAAAA', DATE '2024-01-10')")
    assert (got.week.done, got.week.planned) == (1, 5 * 2 + 2 + 1)
    assert (got.month.done, got.month.planned) == (1, 23 * 2 + 8 + 1)
    assert len(got.calendar) == 31 and tuple(got.calendar[9]) == ("2024-01-10", 3, 1)
    assert [tuple(g) for g in got.goals] == [("Hours", "weekly", "hours", 2.0, 65)]
    assert tuple(got.reflections) == ("today", None, "good") and len(got.today) == 3
    bare = one(sql, "SELECT * FROM get_public_progress('BBBBBB', DATE '2024-01-10')")
    assert bare.today == [] and bare.goals == [] and bare.month.planned == 0 and tuple(bare.reflections) == (None,) * 3


def test_calls_for_a_table_of_codes(sql):
    asked = "(VALUES ('AAAAAA', DATE '2024-01-10'), ('none', DATE '2024-01-10'), ('BBBBBB', DATE '2024-01-10'), " \
        "('AAAAAA', DATE '2024-01-10'), (NULL, NULL)) AS q(code, d)"
    rows = sql(f"SELECT q.code, p.owner_name, size(p.activities) n FROM {asked}, LATERAL get_public_day(q.code, q.d) p").collect()
    assert sorted(map(tuple, rows)) == [("AAAAAA", "Ann", 3), ("AAAAAA", "Ann", 3), ("BBBBBB", "bob", 0)]
    rows = sql(f"SELECT q.code, p.month.planned n FROM {asked} LEFT JOIN LATERAL get_public_progress(q.code, q.d) p").collect()
    assert sorted(map(tuple, rows), key=str) == [("AAAAAA", 55), ("AAAAAA", 55), ("BBBBBB", 0), ("none", None), (None, None)]


def test_plans_read_the_asked_owner_without_python(spark, tmp_path, sql):
    profiles = table(spark, "profiles", [dict(owner_id=i, share_code=f"C{i:05d}", username=f"u{i}") for i in range(50)])
    profiles.write.parquet(str(tmp_path / "p"))
    tables = {n: table(spark, n, []) for n in S.VIEWS} | {"profiles": spark.read.parquet(str(tmp_path / "p"))}
    S.register(spark, tables, prefix="filed_")
    plan = sql("SELECT * FROM get_public_day('c00007', DATE '2024-01-10')")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(share_code,C00007)" in plan
    assert "Python" not in plan and "Cartesian" not in plan
    assert one(sql, "SELECT owner_name FROM get_public_day('c00007', DATE '2024-01-10')").owner_name == "u7"


def test_texts_stay_out_of_lists_and_pages_are_made_once_a_day(spark, sql):
    asked = "(VALUES ('AAAAAA', DATE '2024-01-10'), ('BBBBBB', DATE '2024-01-10')) AS q(code, d)"
    calls = sql(f"SELECT * FROM {asked}, LATERAL get_public_day(q.code, q.d) p")
    every = registry.queries()["sql_public_day"](spark, "/root/testdata/sf0.001")
    for df in (calls, every):
        keys = re.findall(r"Aggregate\(keys=\[([^\]]*)\], functions=\[(?:partial_)?collect_list",
                          df._jdf.queryExecution().executedPlan().toString())
        assert keys and not any("content" in k for k in keys)
    grouped = re.findall(r"HashAggregate\(keys=\[(code#[^\]]*)\]", every._jdf.queryExecution().executedPlan().toString())
    assert grouped and not any("ts#" in k for k in grouped)


@pytest.fixture(scope="module")
def typed(spark, tmp_path_factory):
    """Given tables whose calls fall into two months, and a session that sends no table to all tasks."""
    folder = str(tmp_path_factory.mktemp("typed"))

    def moment(month, day):
        return dt.datetime(2024, month, day, 9, 30)

    customers = [(1, "A#1"), (1, "B#1"), (2, "C#2"), (3, None), (5, "E#5"), (5, "E#5")]
    events = [(4, moment(1, 16), 1, "click", 30.0), (8, moment(1, 18), 1, "view", 250.0), (8, moment(1, 18), 1, "view", 250.0),
              (12, moment(1, 16), 1, "click", 5.0), (3000016, moment(1, 16), 1, "view", 5.0), (20, moment(1, 23), 1, "click", 9.0),
              (24, moment(1, 30), 2, "click", 30.0), (28, moment(2, 1), 2, "click", 30.0), (5, moment(1, 31), 1, "view", 21.0),
              (6, moment(1, 9), 1, "click", 7.0), (32, None, 2, "click", 3.0), (36, moment(1, 3), 5, "signup", 3.0),
              (7, moment(1, 9), 1, "error", 7.0), (40, moment(1, 9), 9, "click", 7.0), (None, moment(1, 9), 1, "click", 7.0)]
    documents = [(doc, f"{doc} is its number") for doc in range(6, 36)]
    for name, rows, schema in (
            ("customer", [(*r, 1, 1.0, "BUILDING") for r in customers],
             "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
            ("events", [(*r, None) for r in events],
             "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"),
            ("documents", [(*r, "en", "web", 9) for r in documents],
             "doc_id long, text string, lang string, source string, n_chars long")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield folder
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_no_exchange_takes_lists_and_texts(spark, typed):
    df = registry.queries()["sql_public_day"](spark, typed)
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    taken = [set(re.findall(r"(\w+)#", x)) for x in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)]
    lists, texts = {"items", "activities"}, {"text", "texts", "week_reflection", "month_reflection"}
    assert any(x & lists for x in taken) and any(x & texts for x in taken)
    assert not any(x & lists and x & texts for x in taken)


def test_pages_of_a_table_of_calls_are_those_of_single_calls(spark, typed):
    pages = sorted(map(tuple, registry.queries()["sql_public_day"](spark, typed).collect()))
    calls = DriverTables(spark, typed).share_requests.collect()
    single = {(code, d): [r.document for r in spark.sql(
        "SELECT to_json(struct(p.*), map('ignoreNullFields', 'false')) AS document FROM get_public_day(:code, CAST(:d AS DATE)) p",
        {"code": code, "d": d}).collect()] for code, d in {(c.code, c.ts and c.ts.date()) for c in calls}}
    assert pages == sorted((c.seq, document) for c in calls for document in single[c.code, c.ts and c.ts.date()])
    days = [(seq, json.loads(document)) for seq, document in pages]
    texts = {(seq, day["date"], *(text and int(text.split()[0]) for text in (day["week_reflection"], day["month_reflection"])))
             for seq, day in days}
    assert texts == {
        (4, "2024-01-16", 7, 11), (12, "2024-01-16", 7, 11), (8, "2024-01-18", 7, 11), (3000016, "2024-01-16", 7, 11),
        (20, "2024-01-23", 10, 11), (24, "2024-01-30", 13, 17), (28, "2024-02-01", 13, None), (5, "2024-01-31", 13, 17),
        (6, "2024-01-09", 19, 23), (32, None, None, None), (36, "2024-01-03", 31, 35)}
    names = [(seq, day["owner_name"]) for seq, day in days]
    assert names.count((8, "A#1")) == names.count((8, "B#1")) == 2 and names.count((36, "e5")) == 1


def test_missing_tables(spark):
    with pytest.raises(ValueError, match="goals"):
        S.register(spark, {n: table(spark, n, []) for n in S.VIEWS if n != "goals"})
