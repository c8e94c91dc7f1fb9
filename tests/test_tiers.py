"""Tiers of batches, tallies from signed changes, and logs from the stream's own state."""

import random

import pytest
from helpers import D, table, values
from hypothesis import given
from hypothesis import strategies as st
from test_feeds import PATCH, patch
from test_streams import COLUMNS, _drop, _feed, _stream

from adhere.operators import upserts as U
from adhere.streaming import log_feed as L
from adhere.streaming import tiers


@given(st.integers(0, 3000), st.integers(2, 9))
def test_blocks_hold_each_batch_once(n, every):
    held = [b for t, k in tiers.blocks_before(n, every) for b in range(k * every ** t, (k + 1) * every ** t)]
    assert held == list(range(n))
    made = {(0, b) for b in range(n)} | {f for b in range(n + 1) for f in tiers.folds_due(b, every)}
    assert set(tiers.blocks_before(n, every)) <= made
    written = tiers.blocks_written(n, every)
    assert [b for t, k in written for b in range(k * every ** t, (k + 1) * every ** t)] == list(range(n))
    assert not set(written) & set(tiers.folds_due(n, every))
    gone = set(tiers.covered(n, every))
    # What may go is read neither by the next batch nor by a fold that is still to come.
    later = {x for b in range(n, n + 40) for x in tiers.blocks_before(b, every)}
    later |= {(t - 1, k * every + i) for b in range(n + 1, n + 40) for t, k in tiers.folds_due(b, every)
              for i in range(every)}
    assert not gone & (later | set(tiers.blocks_written(n + 1, every)))


@pytest.fixture(scope="module")
def activities(spark):
    return table(spark, "activities", [
        dict(activity_id="a", owner_id=1, day_type="weekday"), dict(activity_id="b", owner_id=1, day_type="weekend"),
        dict(activity_id="c", owner_id=1, day_type="weekday", entry_date=D(2024, 1, 3)),
        dict(activity_id="d", owner_id=1, day_type="weekday", entry_date=D(2024, 1, 4))]).cache()


def recounted(spark, activities, rows):
    """The tallies of all days that the patches touch, counted anew."""
    deltas = L.to_deltas(spark.createDataFrame(rows, PATCH))
    return values(L.touched_tallies(deltas, deltas, activities))


def test_changes_add_up_to_the_recount(spark, activities, tmp_path):
    rows, src = _feed(), str(tmp_path / "in")
    random.Random(4).shuffle(rows)
    args = activities, str(tmp_path / "t"), str(tmp_path / "cp"), 2
    for k in range(5):
        _drop(spark, src, f"f{k}", rows[k::5])
        L.follow_tally_changes(_stream(spark, src), *args)
        if k in (1, 4):
            seen = [r for j in range(k + 1) for r in rows[j::5]]
            got = L.tallies_from_changes(spark, args[1], activities, 2)
            assert values(got.select("owner_id", "d", "done", "total", "minutes")) == recounted(spark, activities, seen)
    folders = {p.parent.name + "/" + p.name for p in (tmp_path / "t" / "deltas").glob("*/*") if p.is_dir()}
    assert {"tier=2/block=0", "tier=1/block=1", "tier=0/block=4"} <= folders
    # A batch reads blocks, not all batches; months stay apart in every tier.
    assert all(p.name.startswith("log_month=") for p in (tmp_path / "t" / "deltas").glob("tier=2/block=0/*") if p.is_dir())


def test_replayed_batches_change_nothing(spark, activities, tmp_path):
    rows, src = _feed(), str(tmp_path / "in")
    for k in range(4):
        _drop(spark, src, f"f{k}", rows[k::4])
    path = str(tmp_path / "t")
    L.follow_tally_changes(_stream(spark, src), activities, path, f"{tmp_path}/cp", 2)
    want = recounted(spark, activities, rows)
    columns = ("owner_id", "d", "done", "total", "minutes")
    assert values(L.tallies_from_changes(spark, path, activities, 2), *columns) == want
    # The whole stream again into the same folders, as after a checkpoint that never got written.
    L.follow_tally_changes(_stream(spark, src), activities, path, f"{tmp_path}/cp-again", 2)
    assert values(L.tallies_from_changes(spark, path, activities, 2), *columns) == want


def test_batches_without_a_planned_log(spark, activities, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "t")
    _drop(spark, src, "f0", [patch(1, 1, key="b", completed=True)])  # not planned on that day
    L.follow_tally_changes(_stream(spark, src), activities, path, f"{tmp_path}/cp", 2)
    _drop(spark, src, "f1", [])
    L.follow_tally_changes(_stream(spark, src), activities, path, f"{tmp_path}/cp", 2)
    _drop(spark, src, "f2", [patch(2, 2, completed=True), patch(3, 3, start=60, end=90)])
    L.follow_tally_changes(_stream(spark, src), activities, path, f"{tmp_path}/cp", 2)
    _drop(spark, src, "f3", [patch(4, 4, completed=False)])  # taken back
    L.follow_tally_changes(_stream(spark, src), activities, path, f"{tmp_path}/cp", 2)
    got = values(L.tallies_from_changes(spark, path, activities, 2), "owner_id", "d", "done", "total", "minutes")
    assert got == [(1, D(2024, 1, 3), 0, 2, 30)]


def test_only_touched_months_are_read(spark, activities, tmp_path):
    known = L.to_deltas(spark.createDataFrame(_feed(), PATCH))
    known.unionByName(known.withColumn("log_month", L.F.lit("2019-05"))).write.partitionBy("log_month").parquet(
        str(tmp_path / "known"))
    read = L.of_months(spark.read.schema(L.DELTA_SCHEMA).parquet(str(tmp_path / "known")), known.limit(3))
    assert len(read.inputFiles()) and "2019-05" not in {r.log_month for r in read.collect()}
    plan = L.tally_changes(known.limit(1), read, activities)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_month" in plan and "(log_month" in plan


def test_state_goes_on_after_a_restart(spark, tmp_path):
    rows, src = _feed(), str(tmp_path / "in")
    random.Random(5).shuffle(rows)
    for k in range(4):
        _drop(spark, src, f"f{k}", rows[k::4])
        if k % 2:
            L.follow_log_state(_stream(spark, src), f"{tmp_path}/rows", f"{tmp_path}/cp")
            seen = [r for j in range(k + 1) for r in rows[j::4]]
            want = values(U.fold_log_patches(spark.createDataFrame(seen, PATCH)), *COLUMNS)
            assert values(L.logs_of_state(spark, f"{tmp_path}/rows"), *COLUMNS) == want
    # The last batch gave out the logs it touched and no others.
    last = L.read_batches(spark, f"{tmp_path}/rows", L.T.StructType(L.DELTA_SCHEMA.fields[:-1]))
    top = last.agg(L.F.max("batch")).first()[0]
    assert last.where(L.F.col("batch") == top).count() <= last.select(*U.LOG_KEY).distinct().count()
