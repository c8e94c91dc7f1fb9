from helpers import D, routine, table, values
from pyspark.sql import functions as F

from adhere.model import Horizon
from adhere.operators import adherence as A
from adhere.operators import goals as G
from adhere.operators import occurrences as O
from adhere.plans import reports as R

JANUARY = Horizon(D(2024, 1, 1), D(2024, 1, 31))


def people(spark, *ids):
    return table(spark, "profiles", [dict(owner_id=i, email=f"{i}@example.org") for i in ids])


def no_logs(spark):
    return table(spark, "logs", [])


def test_default_routine_totals(spark):
    acts = routine(spark)
    weeks = A.week_adherence(people(spark, 1), acts, no_logs(spark), JANUARY)
    assert values(weeks) == [(1, D(2024, 1, d), 43, 0, 0) for d in (1, 8, 15, 22, 29)]
    months = A.month_adherence(people(spark, 1), acts, no_logs(spark), JANUARY)
    assert values(months) == [(1, D(2024, 1, 1), 193, 0, 0)]


def test_closed_form_equals_spine(spark):
    acts = routine(spark)
    span = Horizon(D(2023, 11, 1), D(2024, 3, 31))
    listed = O.occurrences(acts, span).groupBy("owner_id", F.trunc("d", "month").alias("m")).count()
    months = A.month_adherence(people(spark, 1), acts, no_logs(spark), span)
    assert values(listed) == values(months, "owner_id", "month_start", "planned")


def test_owner_without_anything_has_zero_rows(spark):
    days = A.calendar_days(people(spark, 7), routine(spark, 1), no_logs(spark), JANUARY)
    assert values(days.groupBy("owner_id").agg(F.count("*"), F.sum("planned"), F.max("level"))) \
        == [(7, 31, 0, 0)]


def _case(spark):
    acts = table(spark, "activities", [
        dict(activity_id="r", owner_id=1, title="run", day_type="weekday", category="move",
             sort_order=1, goal_id=10),
        dict(activity_id="o", owner_id=1, title="once", day_type="weekend", category="rest",
             sort_order=2, entry_date=D(2024, 1, 6)),
        dict(activity_id="x", owner_id=2, title="other", day_type="weekday", category="move",
             sort_order=1, goal_id=10)])
    logs = table(spark, "logs", [
        dict(owner_id=1, activity_id="r", log_date=D(2024, 1, 3), completed=True,
             actual_start_min=60, actual_end_min=100, note="n"),
        # done on a Saturday although planned for weekdays only
        dict(owner_id=1, activity_id="r", log_date=D(2024, 1, 6), completed=True,
             actual_start_min=60, actual_end_min=70),
        dict(owner_id=1, activity_id="o", log_date=D(2024, 1, 6), completed=True,
             actual_start_min=30, actual_end_min=20),
        # tagged with owner 1's goal, but logged by owner 2
        dict(owner_id=2, activity_id="x", log_date=D(2024, 1, 3), completed=True,
             actual_start_min=0, actual_end_min=500)])
    goals = table(spark, "goals", [
        dict(goal_id=10, owner_id=1, title="g", period_type="weekly", metric="hours", target=None),
        dict(goal_id=11, owner_id=1, title="h", period_type="monthly", metric="count", target=None)])
    return acts, logs, goals


def test_done_counts_unplanned_work_but_the_tally_does_not(spark):
    acts, logs, _ = _case(spark)
    week = Horizon(D(2024, 1, 1), D(2024, 1, 7))
    days = A.calendar_days(people(spark, 1), acts, logs, week)
    saturday = days.where(F.col("d") == D(2024, 1, 6))
    assert values(saturday, "planned", "done", "level") == [(1, 2, 3)]
    tally = A.day_tally(people(spark, 1), acts, logs, week, D(2024, 1, 6))
    assert values(tally.where(F.col("d") == D(2024, 1, 6)), "total", "done", "minutes", "tally") \
        == [(1, 1, 0, "1/1 done · 0m active")]
    assert values(tally.where(F.col("d") == D(2024, 1, 7)), "is_future", "tally") \
        == [(True, "0 planned")]


def test_agenda_rows(spark):
    acts, logs, goals = _case(spark)
    rows = O.agenda(acts, logs, Horizon(D(2024, 1, 3), D(2024, 1, 6))).where("owner_id = 1")
    assert values(rows, "d", "activity_id", "one_off", "logged", "completed", "note") == [
        (D(2024, 1, 3), "r", False, True, True, "n"),
        (D(2024, 1, 4), "r", False, False, False, None),
        (D(2024, 1, 5), "r", False, False, False, None),
        (D(2024, 1, 6), "o", True, True, True, None)]
    detail = R.day_detail(acts, logs, goals, Horizon(D(2024, 1, 3), D(2024, 1, 4)), D(2024, 1, 3))
    assert values(detail.where("owner_id = 1"), "d", "goal_title", "completed", "times") == [
        (D(2024, 1, 3), "g", True, "Planned —–— · actual 01:00–01:40"),
        (D(2024, 1, 4), "g", None, "Planned —–—")]
    # the goal belongs to owner 1, so owner 2's activity shows no title
    assert values(detail.where("owner_id = 2"), "goal_title") == [(None,), (None,)]


def test_agenda_over_month_borders(spark):
    acts = routine(spark)
    span = Horizon(D(2023, 12, 20), D(2024, 2, 10))
    logs = table(spark, "logs", [
        dict(owner_id=1, activity_id="1:weekday:1", log_date=d, completed=True)
        for d in (D(2023, 12, 20), D(2023, 12, 29), D(2024, 1, 1), D(2024, 2, 9), D(2024, 2, 12))])
    rows = O.agenda(acts, logs, span)
    assert values(rows, "owner_id", "activity_id", "d") \
        == values(O.occurrences(acts, span), "owner_id", "activity_id", "d")
    assert values(rows.where("completed"), "d") == [
        (D(2023, 12, 20),), (D(2023, 12, 29),), (D(2024, 1, 1),), (D(2024, 2, 9),)]


def test_goal_actuals_are_owner_checked_and_zero_rows_stay(spark):
    acts, logs, goals = _case(spark)
    got = G.goal_progress(goals, acts, logs, Horizon(D(2024, 1, 3), D(2024, 1, 9)))
    assert values(got, "goal_id", "period_start", "actual", "pct") == [
        (10, D(2024, 1, 1), 50, 0), (10, D(2024, 1, 8), 0, 0), (11, D(2024, 1, 1), 0, 0)]


def test_category_minutes_leave_out_empty_and_unplanned(spark):
    acts, logs, _ = _case(spark)
    assert values(A.category_minutes(acts, logs, JANUARY).where("owner_id = 1")) \
        == [(1, D(2024, 1, 3), "move", 40)]


def test_period_minutes_count_whole_periods(spark):
    logs = table(spark, "logs", [
        dict(owner_id=1, activity_id="a", log_date=d, actual_start_min=0, actual_end_min=m)
        for d, m in ((D(2024, 1, 31), 1), (D(2024, 2, 1), 2), (D(2024, 2, 29), 4),
                     (D(2024, 3, 1), 8))])
    got = A.period_minutes(logs, Horizon(D(2024, 2, 1), D(2024, 2, 2)))
    assert values(got) == [(1, "monthly", D(2024, 2, 1), 6), (1, "weekly", D(2024, 1, 29), 3)]


def test_month_grid_of_a_leap_february(spark):
    span = Horizon(D(2024, 2, 1), D(2024, 2, 29))
    grid = A.month_grid(A.calendar_days(people(spark, 1), routine(spark), no_logs(spark), span))
    rows = values(grid, "grid_row", "mon", "thu", "sun")
    assert rows[0] == (0, None, "1|0/7|0", "4|0/4|0")
    assert rows[-1] == (4, "26|0/7|0", "29|0/7|0", None)


def test_week_report_caption(spark):
    texts = table(spark, "reflections", [
        dict(owner_id=1, period_type="weekly", period_date=D(2024, 1, 8), content="fine")])
    got = R.week_report(people(spark, 1), routine(spark), no_logs(spark), texts,
                        Horizon(D(2024, 1, 1), D(2024, 1, 14)), D(2024, 1, 17))
    assert values(got, "caption", "first_day", "reflection") == [
        ("1 week ago", "Mon, Jan 8", "fine"), ("2 weeks ago", "Mon, Jan 1", None)]


def test_horizon_rejects_reversed_dates():
    try:
        Horizon(D(2024, 1, 2), D(2024, 1, 1))
    except ValueError:
        return
    raise AssertionError("accepted")


def test_expanded_days_are_neither_hashed_nor_shuffled(spark):
    span = Horizon(D(2024, 1, 1), D(2024, 1, 31))
    tables = people(spark, 3), routine(spark, 1), no_logs(spark)
    grid = A.month_grid(A.calendar_days(*tables, span))
    for df in (A.calendar_days(*tables, span), A.day_tally(*tables, span), grid):
        plan = df._jdf.queryExecution().executedPlan().toString()
        above = plan[:plan.index("Generate explode(")]
        assert "Exchange" not in above and (df is grid or "Aggregate" not in above)
