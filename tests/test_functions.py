import datetime as dt
import re

import pytest
from helpers import D, evaluate
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from adhere.functions import clock as C
from adhere.functions import dates as DT
from adhere.functions import names as N
from adhere.functions import private as P
from adhere.functions import progress as G


def _pairs(spark, pairs, schema):
    return spark.createDataFrame(pairs, schema)


def test_dates(spark):
    d = F.lit(D(2024, 1, 7))
    assert evaluate(
        spark, w=DT.week_start(d), e=DT.week_end(d), t=DT.day_type(d), m=DT.month_start(d),
        l=DT.month_end(F.lit(D(2024, 2, 10))), i=DT.iso_date(d), p=DT.parse_iso(F.lit("2024-01-07")),
        a=DT.long_label(d), b=DT.short_label(d), c=DT.month_label(d)) == {
        "w": D(2024, 1, 1), "e": D(2024, 1, 7), "t": "weekend", "m": D(2024, 1, 1),
        "l": D(2024, 2, 29), "i": "2024-01-07", "p": D(2024, 1, 7), "a": "Sunday, January 7",
        "b": "Sun, Jan 7", "c": "January 2024"}


def test_every_day_of_some_years(spark):
    """Closed forms against plain date arithmetic."""
    days = [D(2019, 12, 1) + dt.timedelta(days=k) for k in range(900)]
    df = _pairs(spark, [(d, d + dt.timedelta(days=i % 70)) for i, d in enumerate(days)],
                "s date, e date")
    got = df.select("s", "e", DT.weekdays_in(F.col("s"), F.col("e")).alias("n"),
                    DT.weekends_in(F.col("s"), F.col("e")).alias("m"),
                    DT.grid_row(F.col("s")).alias("row"), DT.grid_col(F.col("s")).alias("col"),
                    DT.day_type(F.col("s")).alias("t")).collect()
    for r in got:
        span = [r.s + dt.timedelta(days=k) for k in range((r.e - r.s).days + 1)]
        assert r.n == sum(x.weekday() < 5 for x in span)
        assert r.m == sum(x.weekday() >= 5 for x in span)
        assert r.row == (r.s.replace(day=1).weekday() + r.s.day - 1) // 7
        assert r.col == r.s.weekday()
        assert r.t == ("weekend" if r.s.weekday() >= 5 else "weekday")


def test_periods(spark):
    d = F.lit(D(2024, 2, 29))
    got = evaluate(spark, a=DT.period_start(F.lit("weekly"), d), b=DT.period_end(F.lit("weekly"), d),
                   c=DT.period_start(F.lit("monthly"), d), e=DT.period_end(F.lit("monthly"), d),
                   f=DT.period_start(F.lit("daily"), d))
    assert got == {"a": D(2024, 2, 26), "b": D(2024, 3, 3), "c": D(2024, 2, 1),
                   "e": D(2024, 2, 29), "f": D(2024, 2, 29)}


@pytest.mark.parametrize("offset,expected", [
    (0, "This week"), (-1, "1 week ago"), (-3, "3 weeks ago"), (1, "In 1 week"), (4, "In 4 weeks")])
def test_offset_label(spark, offset, expected):
    assert evaluate(spark, x=DT.offset_label(F.lit(offset), "week"))["x"] == expected


def test_offsets(spark):
    got = evaluate(spark, w=DT.weeks_from(F.lit(D(2024, 1, 17)), F.lit(D(2024, 1, 1))),
                   m=DT.months_from(F.lit(D(2024, 1, 17)), F.lit(D(2023, 11, 30))),
                   s=DT.shift_weeks(F.lit(D(2024, 1, 17)), -1),
                   n=DT.shift_months(F.lit(D(2024, 1, 31)), 1))
    assert got == {"w": -2, "m": -2, "s": D(2024, 1, 8), "n": D(2024, 2, 1)}


def test_local_date(spark):
    at = F.lit("2024-01-01 02:30:00").cast("timestamp")
    got = evaluate(spark, a=DT.local_date(at, F.lit("America/New_York")),
                   b=DT.local_date(at, F.lit("Asia/Tokyo")))
    assert got == {"a": D(2023, 12, 31), "b": D(2024, 1, 1)}


@pytest.mark.parametrize("start,end,minutes", [
    (450, 510, 60), (510, 450, 0), (None, 510, 0), (450, None, 0), (450, 450, 0)])
def test_span(spark, start, end, minutes):
    s, e = F.lit(start).cast("int"), F.lit(end).cast("int")
    assert evaluate(spark, x=C.span_minutes(s, e))["x"] == minutes


@pytest.mark.parametrize("minutes,label", [
    (0, "0m"), (45, "45m"), (60, "1h"), (65, "1h 5m"), (600, "10h")])
def test_duration_label(spark, minutes, label):
    assert evaluate(spark, x=C.duration_label(F.lit(minutes)))["x"] == label


@pytest.mark.parametrize("text,minutes", [
    ("07:30", 450), ("07:30:59", 450), ("00:00", 0), ("23:59", 1439), ("", None), ("24:00", None),
    ("x", None), (None, None)])
def test_parse_time(spark, text, minutes):
    assert evaluate(spark, x=C.parse_hhmm(F.lit(text)))["x"] == minutes


def test_time_text(spark):
    none = F.lit(None).cast("int")
    got = evaluate(spark, a=C.hhmm(F.lit(65)), b=C.hhmm(none), c=C.hhmm_or_blank(none),
                   d=C.hhmm_or_dash(none), e=C.hhmm(F.lit(1439)))
    assert got == {"a": "01:05", "b": None, "c": "", "d": "—", "e": "23:59"}


@pytest.mark.parametrize("done,planned,pct", [(29, 200, 14), (0, 0, 0), (3, 2, 150), (5, 0, 0),
                                              (1, 8, 13), (1, 3, 33)])
def test_percent(spark, done, planned, pct):
    assert evaluate(spark, x=G.percent(F.lit(done), F.lit(planned)))["x"] == pct


@pytest.mark.parametrize("done,planned,level", [
    (0, 5, 0), (1, 5, 1), (3, 5, 2), (5, 5, 3), (6, 5, 3), (2, 0, 1), (0, 0, 0)])
def test_heat(spark, done, planned, level):
    assert evaluate(spark, x=G.heat_level(F.lit(done), F.lit(planned)))["x"] == level


@pytest.mark.parametrize("actual,metric,target,pct,label", [
    (200, "hours", "2.50", 100, "3h 20m of 2.5h"), (75, "hours", "2.50", 50, "1h 15m of 2.5h"),
    (3, "count", "10.00", 30, "3 of 10 done"), (3, "count", "0.00", 0, "3 of 0 done"),
    (0, "hours", "100.00", 0, "0m of 100h")])
def test_goal_measures(spark, actual, metric, target, pct, label):
    a, m, t = F.lit(actual), F.lit(metric), F.lit(target).cast("decimal(10,2)")
    assert evaluate(spark, p=G.goal_percent(a, m, t), l=G.goal_label(a, m, t)) \
        == {"p": pct, "l": label}


@pytest.mark.parametrize("text,shown", [
    ("a /* x\ny */ b", "a  b"), ("keep /* open\nmore", "keep"), ("/*/", None),
    ("//*x*/*sec", None), (" \t\n", None), (None, None), ("/ /*x*/", "/"),
    ("/* a /* b */ c */ d", "c */ d"), ("a\r\n", "a\r"), ("plain", "plain"), ("", None)])
def test_hidden_blocks(spark, text, shown):
    assert evaluate(spark, x=P.hide_private(F.lit(text)))["x"] == shown


@pytest.mark.parametrize("text,shown", [
    ("a\n// b\nc", "a\nc"), ("  // only", None), ("a // b", "a // b"), ("", None), (None, None)])
def test_hidden_lines(spark, text, shown):
    assert evaluate(spark, x=P.hide_private(F.lit(text), "lines"))["x"] == shown


def _two_pass(text):
    closed = re.sub(r"/\*.*?\*/", "", text, flags=re.S)
    return re.sub(r"/\*.*", "", closed, flags=re.S).strip(" \t\n") or None


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="/* ab\n", max_size=30), min_size=200, max_size=300))
def test_hiding_equals_two_passes(spark, texts):
    got = spark.createDataFrame([(t,) for t in texts], "t string") \
        .select("t", P.hide_blocks(F.col("t")).alias("x")).collect()
    for r in got:
        assert r.x == _two_pass(r.t)
        assert r.x is None or "/*" not in r.x


def test_long_text_of_open_marks_is_quick(spark):
    text = F.repeat(F.lit("/* "), 400_000)
    assert evaluate(spark, x=P.hide_blocks(F.concat(F.lit("kept "), text)))["x"] == "kept"


def test_names(spark):
    none = F.lit(None).cast("string")
    got = evaluate(
        spark, a=N.owner_name(none, F.lit("u")), b=N.person_label(F.lit(""), none),
        c=N.person_label(F.lit(""), F.lit("u")), d=N.email_for(F.lit(" Ann "), "example.org"),
        e=N.username_of(F.lit("ann@example.org")), f=N.clean_code(F.lit(" ab2\t")),
        g=N.json_field(F.lit('{"username": "z"}'), "username"))
    assert got == {"a": "u", "b": "Someone", "c": "u", "d": "ann@example.org", "e": "ann",
                   "f": "AB2", "g": "z"}


def test_codes_are_distinct_and_well_formed(spark):
    df = spark.range(20000).select(N.code_of_number(F.col("id") * 36007 + 11).alias("c"))
    codes = [r.c for r in df.collect()]
    assert len(set(codes)) == 20000
    assert all(re.fullmatch("[A-HJ-NP-Z2-8]{6}", c) for c in codes)
