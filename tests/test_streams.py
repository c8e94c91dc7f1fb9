import datetime as dt

from helpers import D, table, values
from test_feeds import PATCH, T0, patch

from adhere.operators import upserts as U
from adhere.streaming import log_feed as L

COLUMNS = ("owner_id", "activity_id", "log_date", "completed", "actual_start_min",
           "actual_end_min", "note")


def _drop(spark, folder, name, rows):
    spark.createDataFrame(rows, PATCH).coalesce(1).write.parquet(f"{folder}/{name}")


def _stream(spark, folder):
    schema = spark.createDataFrame([], PATCH).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", "true").parquet(folder)


def _feed():
    return [patch(i, (i * 37) % 50, key="abcd"[i % 4], **[
        {"completed": i % 2 == 0}, {"start": i, "end": None if i % 5 == 0 else i + 9},
        {"note": None if i % 7 == 0 else f"n{i}"}][i % 3]) for i in range(60)]


def test_stream_equals_batch(spark, tmp_path):
    rows, src = _feed(), str(tmp_path / "in")
    for k in range(6):
        _drop(spark, src, f"f{k}", rows[k::6])
    L.follow_logs(_stream(spark, src), f"{tmp_path}/deltas", f"{tmp_path}/cp")
    deltas = L.read_deltas(spark, f"{tmp_path}/deltas")
    assert deltas.select("batch").distinct().count() == 6
    want = values(U.fold_log_patches(spark.createDataFrame(rows, PATCH)), *COLUMNS)
    assert values(L.current_logs(deltas), *COLUMNS) == want
    # replaying a delta changes nothing
    assert values(L.current_logs(deltas.unionAll(deltas.where("batch = 2"))), *COLUMNS) == want
    # a compacted copy stands in for the batches it covers
    L.compact(spark, f"{tmp_path}/deltas", f"{tmp_path}/base", 3)
    mixed = L.read_deltas(spark, f"{tmp_path}/deltas", (f"{tmp_path}/base", 3))
    assert sorted(r.batch for r in mixed.select("batch").distinct().collect()) == [3, 4, 5]
    assert values(L.current_logs(mixed), *COLUMNS) == want


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    rows, src = _feed(), str(tmp_path / "in")
    _drop(spark, src, "f0", rows[:20])
    L.follow_logs(_stream(spark, src), f"{tmp_path}/deltas", f"{tmp_path}/cp")
    _drop(spark, src, "f1", rows[20:])
    L.follow_logs(_stream(spark, src), f"{tmp_path}/deltas", f"{tmp_path}/cp")
    deltas = L.read_deltas(spark, f"{tmp_path}/deltas")
    assert values(L.current_logs(deltas), *COLUMNS) \
        == values(U.fold_log_patches(spark.createDataFrame(rows, PATCH)), *COLUMNS)


def test_tallies_follow_corrections(spark, tmp_path):
    acts = table(spark, "activities", [
        dict(activity_id="a", owner_id=1, day_type="weekday"),
        dict(activity_id="b", owner_id=1, day_type="weekend"),
        dict(activity_id="c", owner_id=1, day_type="weekday", entry_date=D(2024, 1, 3)),
        dict(activity_id="d", owner_id=1, day_type="weekday", entry_date=D(2024, 1, 4))])
    src = str(tmp_path / "in")
    args = (acts, f"{tmp_path}/deltas", f"{tmp_path}/tallies", f"{tmp_path}/cp")

    def tally():
        L.follow_tallies(_stream(spark, src), *args)
        return values(L.current_tallies(spark, f"{tmp_path}/tallies"))

    _drop(spark, src, "f0", [patch(1, 1, completed=True), patch(2, 2, start=60, end=90),
                             patch(3, 3, key="b", completed=True)])
    assert tally() == [(1, D(2024, 1, 3), 1, 2, 30)]  # b is not planned on a Wednesday
    _drop(spark, src, "f1", [patch(4, 4, completed=False)])
    assert tally() == [(1, D(2024, 1, 3), 0, 2, 30)]
    _drop(spark, src, "f2", [patch(5, 0, completed=True)])  # older than the correction
    assert tally() == [(1, D(2024, 1, 3), 0, 2, 30)]


def test_week_counts(spark, tmp_path):
    src = str(tmp_path / "in")
    sunday, monday = dt.datetime(2024, 1, 7, 23, 59), dt.datetime(2024, 1, 8)
    rows = [(i, at, 1, *patch(0, 0)[3:]) for i, at in enumerate([sunday, monday, monday, T0])]
    _drop(spark, src, "f0", rows[:2])
    _drop(spark, src, "f1", rows[2:])
    L.follow_weekly_counts(_stream(spark, src), f"{tmp_path}/counts", f"{tmp_path}/cp")
    assert values(L.current_weekly_counts(spark, f"{tmp_path}/counts")) == [
        (1, D(2024, 1, 1), 2), (1, D(2024, 1, 8), 2)]


def test_week_counts_do_not_depend_on_batches(spark, tmp_path):
    """The newest file first, each its own batch, or all in one: no edit is lost."""
    rows = [(i, dt.datetime(2024, 3, 1) - dt.timedelta(days=i % 90), i % 3, *patch(0, 0)[3:])
            for i in range(1000)]
    newest_first = sorted(rows, key=lambda r: r[1], reverse=True)
    got = []
    for name, parts in (("one", 1), ("three", 3)):
        src, size = str(tmp_path / f"in-{name}"), -(-len(rows) // parts)
        for k in range(parts):
            _drop(spark, src, f"f{k}", newest_first[k * size:(k + 1) * size])
            L.follow_weekly_counts(_stream(spark, src), f"{tmp_path}/{name}", f"{tmp_path}/cp-{name}")
        got.append(values(L.current_weekly_counts(spark, f"{tmp_path}/{name}")))
    assert got[0] == got[1] and sum(r[2] for r in got[0]) == 1000


def test_live_counts_leave_out_rows_behind_the_watermark(spark, tmp_path):
    src = str(tmp_path / "in")

    def at(seq, *when):
        return (seq, dt.datetime(*when), 1, *patch(0, 0)[3:])

    for k, row in enumerate([at(1, 2024, 1, 3), at(2, 2024, 3, 1), at(3, 2024, 3, 2), at(4, 2024, 1, 4)]):
        _drop(spark, src, f"f{k}", [row])
        L.follow_live_weekly_counts(_stream(spark, src), f"{tmp_path}/counts", f"{tmp_path}/cp", "1 day")
    got = dict(values(L.live_counts(spark, f"{tmp_path}/counts"), "week_start", "edits"))
    assert got[D(2024, 1, 1)] == 1


def test_tallies_read_a_copy_and_few_batches(spark, tmp_path, monkeypatch):
    acts = table(spark, "activities", [dict(activity_id=k, owner_id=1, day_type="weekday") for k in "abcd"])
    rows, src = _feed(), str(tmp_path / "in")
    for k in range(7):
        _drop(spark, src, f"f{k}", rows[k::7])
    seen, plain = [], L.touched_tallies

    def watched(touched, deltas, activities):
        seen.append(sorted(r.batch for r in deltas.select("batch").distinct().collect()))
        return plain(touched, deltas, activities)

    monkeypatch.setattr(L, "touched_tallies", watched)
    L.follow_tallies(_stream(spark, src), acts, f"{tmp_path}/deltas", f"{tmp_path}/tallies",
                     f"{tmp_path}/cp", compact_every=2)
    # A copy is one batch, the last it covers.
    assert seen == [[0], [0, 1], [1, 2], [1, 2, 3], [3, 4], [3, 4, 5], [5, 6]]
    whole = str(tmp_path / "whole")
    _drop(spark, whole, "f", rows)
    L.follow_tallies(_stream(spark, whole), acts, f"{tmp_path}/d1", f"{tmp_path}/t1", f"{tmp_path}/c1")
    assert values(L.current_tallies(spark, f"{tmp_path}/tallies")) \
        == values(L.current_tallies(spark, f"{tmp_path}/t1"))


def test_touched_months_prune_the_deltas(spark, tmp_path):
    rows = [patch(1, 1, completed=True)]
    _drop(spark, str(tmp_path / "in"), "f0", rows)
    L.follow_logs(_stream(spark, str(tmp_path / "in")), f"{tmp_path}/deltas", f"{tmp_path}/cp")
    deltas = L.read_deltas(spark, f"{tmp_path}/deltas")
    out = L.touched_tallies(deltas.where("batch = 0"), deltas, table(spark, "activities", []))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruningexpression(log_month" in plan
