"""Upserts that touch only some months' files, and windows with a correction path."""

import datetime as dt
import random

import pytest
from helpers import D, values
from test_feeds import PATCH, patch
from test_streams import _drop, _stream

from adhere.operators.upserts import LOG_KEY, upsert
from adhere.sources import sinks
from adhere.streaming import log_feed as L

ROWS = "owner_id long, activity_id string, log_date date, completed boolean, note string, seq long, gone boolean"


def row(owner, month, seq, done=True, gone=False, key="a", day=5):
    return owner, key, D(2024, month, day), done, f"n{seq}", seq, gone


def files(path):
    return {str(p.relative_to(path)) for p in path.rglob("*.parquet")}


def read(spark, path, schema):
    return values(sinks.read_months(spark, str(path), schema))


def test_untouched_months_keep_their_files(spark, tmp_path):
    path = tmp_path / "logs"
    first = spark.createDataFrame([row(o, m, o + m) for o in range(20) for m in (1, 2, 3, 4)], ROWS).drop("gone")
    sinks.write_months(first, str(path))
    before = files(path)
    feed = spark.createDataFrame([row(1, 2, 99, False), row(1, 2, 98), row(77, 2, 1), row(2, 5, 1), row(3, 2, 0, False)],
                                 ROWS).drop("gone")
    want = values(upsert(first, feed, LOG_KEY, ["seq"]))
    assert sinks.upsert_months(feed, str(path), ["seq"]) == ["2024-02", "2024-05"]
    assert read(spark, path, first.schema) == want and len(want) == 82

    def untouched(names):
        return {f for f in names if "2024-02" not in f and "2024-05" not in f}

    assert untouched(files(path)) == untouched(before) and len(untouched(before)) >= 3
    # The same feed again changes nothing, nor does an empty one.
    assert sinks.upsert_months(feed, str(path), ["seq"]) == ["2024-02", "2024-05"]
    now = files(path)
    assert sinks.upsert_months(feed.limit(0), str(path), ["seq"]) == [] and files(path) == now
    assert read(spark, path, first.schema) == want


def test_a_month_may_lose_its_rows(spark, tmp_path):
    path = tmp_path / "logs"
    first = spark.createDataFrame([row(1, 1, 1), row(1, 2, 1), row(2, 2, 1)], ROWS).drop("gone")
    sinks.write_months(first, str(path))
    feed = spark.createDataFrame([row(1, 2, 5, gone=True), row(2, 2, 5, gone=True), row(9, 3, 5, gone=True),
                                  (4, "a", None, True, "x", 1, False)], ROWS)
    assert sinks.upsert_months(feed, str(path), ["seq"], "gone") == ["2024-02", "2024-03"]
    assert [r[:3] for r in read(spark, path, first.schema)] == [(1, "a", D(2024, 1, 5))]


def counted(rows):
    out = {}
    for r in rows:
        at = r[1]
        key = r[2], (at - dt.timedelta(days=at.weekday())).date()
        out[key] = out.get(key, 0) + 1
    return sorted((o, w, n) for (o, w), n in out.items())


@pytest.mark.parametrize("parts", [1, 4])
def test_windows_and_late_edits_are_all_edits(spark, tmp_path, parts):
    rng, src = random.Random(6), str(tmp_path / "in")
    rows = [list(patch(i, 0, completed=True)) for i in range(200)]
    for r in rows:
        r[1] = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(60 * 24 * 60))
        r[2] = rng.randrange(3)
    at, owner = [f.split()[0] for f in PATCH.split(", ")].index("ts"), PATCH.split(", ").index("owner_id long")
    assert (at, owner) == (1, 2)
    for k in range(parts):
        _drop(spark, src, f"f{k}", [tuple(r) for r in rows[k::parts]])
        if k % 2 or parts == 1:
            L.follow_windowed_weeks(_stream(spark, src), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = L.windowed_weeks(spark, f"{tmp_path}/out")
    assert values(got.select("owner_id", "week_start", "edits")) == counted(rows)
    late = got.agg({"late_edits": "sum"}).first()[0]
    assert late > 50 if parts > 1 else late == 0


def test_lateness_is_by_the_end_of_the_week(spark):
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 7, 23)), (2, dt.datetime(2024, 1, 8)), (3, None)],
                                 "owner_id long, ts timestamp_ntz")
    for behind, late in ((None, []), (dt.datetime(2024, 1, 14, 23), []), (dt.datetime(2024, 1, 15), [1])):
        got = L.split_by_lateness(rows, behind, "7 days").where("late").collect()
        assert [r.owner_id for r in got] == late
