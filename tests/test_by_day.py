"""Pages of every day in one job equal the single runs; running totals by hand."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from helpers import D, table

from adhere.model import Horizon
from adhere.plans import by_day, publish, reports

HORIZON = Horizon(D(2024, 1, 25), D(2024, 2, 9))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    days = [D(2024, 1, 1) + dt.timedelta(days=k) for k in range(60)]
    profiles = [dict(owner_id=i, username=f"u{i}", share_code=None if i == 4 else f"CODE0{i}") for i in range(1, 5)]
    activities = [dict(activity_id=f"{o}:{k}", owner_id=o, title=f"t{k}", day_type=("weekday", "weekend")[k % 2],
                       category="rest", sort_order=k % 3, goal_id=o * 10 + k % 4 if k % 5 else None,
                       entry_date=rng.choice(days) if k > 6 else None, created_at=dt.datetime(2024, 1, 1, 0, k))
                  for o in (1, 2, 4) for k in range(10)]
    logs = {(a["owner_id"], a["activity_id"], d): dict(
        owner_id=a["owner_id"], activity_id=a["activity_id"], log_date=d, completed=rng.random() < .6, note="n /* x */",
        actual_start_min=rng.choice([None, 60]), actual_end_min=rng.choice([None, 50, 100]))
        for a in activities for d in rng.sample(days, 25)}
    goals = [dict(goal_id=o * 10 + k, owner_id=o, title=f"g{k}", period_type=("weekly", "monthly")[k % 2],
                  metric=("count", "hours")[k // 2 % 2], target=Decimal(k), created_at=dt.datetime(2024, 1, 1))
             for o in (1, 2, 4) for k in range(5)]
    texts = [dict(owner_id=o, period_type=p, period_date=d, content=f"{p} {d} /* p */")
             for o in (1, 3) for p, starts in (("daily", days[::3]), ("weekly", days[::7]),
                                               ("monthly", [D(2024, 1, 1), D(2024, 2, 1)])) for d in starts]
    rows = {"profiles": profiles, "activities": activities, "logs": list(logs.values()), "goals": goals,
            "reflections": texts}
    made = {}
    for name, some in rows.items():
        made[name] = table(spark, name, some).cache()
    return made


def documents(df, *more):
    return {tuple(r[k] for k in ("owner_id", *more, "part_no")): (r.share_code, r.part_count, r.document.asDict(True))
            for r in df.collect()}


@pytest.mark.parametrize("part_size", [1000, 2])
def test_progress_equals_single_runs(tables, part_size):
    t = tables
    args = t["profiles"], t["activities"], t["logs"], t["goals"], t["reflections"]
    every = documents(by_day.progress_by_day(*args, HORIZON, part_size), "d")
    assert {d for _, d, _ in every} == {HORIZON.start + dt.timedelta(days=k) for k in range(16)}
    # A month's last day, one's first, a Sunday, a Monday.
    for day in (D(2024, 1, 31), D(2024, 2, 1), D(2024, 2, 4), D(2024, 2, 5)):
        one = documents(publish.public_progress(*args, day, part_size))
        assert {(o, p): v for (o, d, p), v in every.items() if d == day} == one and len(one) >= 3


def test_goals_equal_single_runs(tables):
    t = tables
    every = by_day.goals_by_day(t["goals"], t["activities"], t["logs"], HORIZON).collect()
    assert len(every) == 15 * 16
    for day in (D(2024, 1, 28), D(2024, 1, 29), D(2024, 2, 1)):
        one = reports.goals_report(t["goals"], t["activities"], t["logs"], day).collect()
        assert {(r.goal_id, r.period_start, r.actual, r.pct, r.caption) for r in every if r.d == day} == {
            (r.goal_id, r.period_start, r.actual, r.pct, r.caption) for r in one}
    for r in every:
        before = [x.so_far for x in every if x.goal_id == r.goal_id and x.period_start == r.period_start and x.d < r.d]
        assert max(before, default=0) <= r.so_far <= r.actual
        assert r.d != r.period_end or r.so_far == r.actual


def test_totals_run_through_their_periods(tables):
    t = tables
    rows = by_day.totals_to_date(t["profiles"], t["activities"], t["logs"], HORIZON).collect()
    assert len(rows) == 4 * 16
    done = {}
    for r in t["logs"].where("completed").collect():
        done[r.owner_id, r.log_date] = done.get((r.owner_id, r.log_date), 0) + 1
    for r in rows:
        for start, got, whole in ((r.week_start, r.week_done_to_date, r.week_done), (r.month_start, r.month_done_to_date, r.month_done)):
            days = [start + dt.timedelta(days=k) for k in range((r.d - start).days + 1)]
            assert got == sum(done.get((r.owner_id, d), 0) for d in days) <= whole
        assert r.week_planned_to_date <= r.week_planned and r.month_planned_to_date <= r.month_planned


def test_spans_cover_each_day_once():
    found = by_day.spans(HORIZON)
    days = [a + dt.timedelta(days=k) for _, _, a, b in found for k in range((b - a).days + 1)]
    assert sorted(days) == [HORIZON.start + dt.timedelta(days=k) for k in range(16)]
    assert [(w, m) for w, m, _, _ in found] == [
        (D(2024, 1, 22), D(2024, 1, 1)), (D(2024, 1, 29), D(2024, 1, 1)), (D(2024, 1, 29), D(2024, 2, 1)),
        (D(2024, 2, 5), D(2024, 2, 1))]


def test_empty_tables(tables):
    none = {n: df.where("false") for n, df in tables.items()}
    assert by_day.progress_by_day(none["profiles"], none["activities"], none["logs"], none["goals"],
                                  none["reflections"], HORIZON).count() == 0
    bare = by_day.progress_by_day(tables["profiles"], none["activities"], none["logs"], none["goals"],
                                  none["reflections"], HORIZON).collect()
    assert len(bare) == 3 * 16 and all(r.document.goals == [] and r.document.week.planned == 0 for r in bare)


def test_days_and_texts_are_packed_once_per_owner(tables):
    t = tables
    docs = by_day.progress_by_day(t["profiles"], t["activities"], t["logs"], t["goals"], t["reflections"], HORIZON)
    plan = docs._jdf.queryExecution().executedPlan().toString()
    merged = [line for line in plan.splitlines() if "collect_list(today#" in line]
    assert merged and not any("_text#" in line or "collect_list(day" in line for line in merged)
