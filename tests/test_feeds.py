import datetime as dt

import pytest
from helpers import D, table, values
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from adhere.operators import template_edits as TE
from adhere.operators import upserts as U

PATCH = ("seq long, ts timestamp_ntz, owner_id long, activity_id string, log_date date, "
         "completed boolean, actual_start_min int, actual_end_min int, note string, "
         "sets_completed boolean, sets_times boolean, sets_note boolean")
T0 = dt.datetime(2024, 1, 3, 8)


def patch(seq, at, key="a", **fields):
    day = D(2024, 1, 3)
    return (seq, T0 + dt.timedelta(minutes=at), 1, key, day, fields.get("completed"),
            fields.get("start"), fields.get("end"), fields.get("note"), "completed" in fields,
            "start" in fields or "end" in fields, "note" in fields)


def folded(spark, rows):
    return values(U.fold_log_patches(spark.createDataFrame(rows, PATCH)),
                  "activity_id", "completed", "actual_start_min", "actual_end_min", "note")


def model(rows):
    """One dict per key; later patches overwrite what they set."""
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        log = out.setdefault(r[3], [None, None, None, None])
        if r[9]:
            log[0] = r[5]
        if r[10]:
            log[1:3] = r[6:8]
        if r[11]:
            log[3] = r[8]
    return sorted((k, bool(v[0]), *v[1:]) for k, v in out.items())


def test_explicit_null_is_a_value(spark):
    rows = [patch(1, 0, start=500, end=600), patch(2, 5, start=500, end=None), patch(3, 2, note="x")]
    assert folded(spark, rows) == [("a", False, 500, None, "x")]


def _patches():
    one = st.builds(
        lambda at, key, kind, flag, number: patch(
            0, at, key, **[{"completed": flag}, {"start": number, "end": None if flag else number + 5},
                           {"note": None if flag else str(number)}][kind]),
        st.integers(0, 6), st.sampled_from("abc"), st.integers(0, 2), st.booleans(),
        st.integers(0, 99))
    return st.lists(one, min_size=1, max_size=25).map(
        lambda rows: [(i, *r[1:]) for i, r in enumerate(rows)])


@settings(max_examples=8, deadline=None)
@given(_patches(), st.randoms())
def test_fold_in_any_order(spark, rows, rnd):
    def key(row):
        return [(v is not None, v) for v in row]
    want = sorted(model(rows), key=key)
    mixed = rows + rnd.sample(rows, len(rows) // 2)  # replayed edits
    rnd.shuffle(mixed)
    assert folded(spark, mixed) == want


def test_patches_over_current_rows(spark):
    current = table(spark, "logs", [
        dict(owner_id=1, activity_id="a", log_date=D(2024, 1, 3), completed=True, note="old",
             actual_start_min=1, actual_end_min=2),
        dict(owner_id=1, activity_id="z", log_date=D(2024, 1, 3), completed=True, note="kept")])
    feed = spark.createDataFrame([patch(1, 0, note=None), patch(2, 0, key="new", start=3, end=4)], PATCH)
    assert values(U.patch_current_logs(current, feed), "activity_id", "completed", "note",
                  "actual_start_min") == [("a", True, None, 1), ("new", False, None, 3),
                                          ("z", True, "kept", None)]


def _shares(spark, rows):
    return spark.createDataFrame(
        rows, "owner_id long, viewer_id long, permission string, ts timestamp_ntz, seq long, "
              "removed boolean")


def test_upsert_tombstones_and_replay(spark):
    current = _shares(spark, [(1, 2, "view", None, None, False), (1, 3, "view", None, None, False)]) \
        .drop("removed")
    feed = _shares(spark, [
        (1, 2, "edit", T0, 1, False), (1, 2, "view", T0, 2, False), (1, 3, "view", T0, 3, True),
        (4, 5, "view", T0, 4, True), (4, 5, "edit", T0 + dt.timedelta(1), 1, False)])
    once = U.upsert(current, feed, U.SHARE_KEY, ["ts", "seq"], removed="removed")
    want = [(1, 2, "view"), (4, 5, "edit")]
    assert values(once, "owner_id", "viewer_id", "permission") == want
    again = U.upsert(once, feed, U.SHARE_KEY, ["ts", "seq"], removed="removed")
    assert values(again, "owner_id", "viewer_id", "permission") == want


def test_late_edit_does_not_undo_a_newer_row(spark):
    current = _shares(spark, [(1, 2, "edit", T0 + dt.timedelta(1), 9, False)]).drop("removed")
    late = _shares(spark, [(1, 2, "view", T0, 1, False)])
    assert values(U.upsert(current, late, U.SHARE_KEY, ["ts", "seq"]), "permission") == [("edit",)]


def test_hot_key_upsert(spark):
    """A third of all edits on one key end as one row."""
    feed = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("owner_id"),
        F.lit(1).cast("long").alias("viewer_id"), F.col("id").cast("string").alias("permission"),
        F.lit(T0).cast("timestamp_ntz").alias("ts"), F.col("id").alias("seq"))
    got = U.upsert(feed.where("false"), feed, U.SHARE_KEY, ["ts", "seq"])
    assert got.count() == 20001
    assert values(got.where("owner_id = 0"), "permission") == [("29997",)]


def _list(spark, n, orders=None):
    return table(spark, "activities", [
        dict(activity_id=f"i{k:02d}", owner_id=1, title="t", day_type="weekday", category="rest",
             sort_order=(orders or list(range(n)))[k]) for k in range(n)])


MOVES = "owner_id long, d date, seq long, from_index int, to_index int"


def _spliced(orders, moves):
    """What a page does: each move takes an entry out and puts it in elsewhere."""
    ids, moved = [f"i{k:02d}" for k in range(len(orders))], False
    for start, end in moves:
        if start != end and 0 <= start < len(ids) and 0 <= end < len(ids):
            ids.insert(end, ids.pop(start))
            moved = True
    return {a: p for p, a in enumerate(ids) if moved and orders[int(a[1:])] != p}


@pytest.mark.parametrize("moves", [
    [(0, 3)], [(3, 0)], [(1, 2)], [(2, 2)], [(4, 0)], [(0, 9)], [(-1, 2)],
    [(0, 3), (3, 1)], [(4, 0), (0, 9), (0, 4)], [(1, 1), (2, 0), (0, 2), (3, 4)]])
def test_moves_are_splices(spark, moves):
    orders = [3, 3, 5, 8, 9]  # ties and gaps
    acts = _list(spark, 5, orders)
    made = spark.createDataFrame(
        [(1, D(2024, 1, 3), k, a, b) for k, (a, b) in enumerate(moves)][::-1], MOVES)
    got = dict(values(TE.reorder_changes(acts, made), "activity_id", "sort_order"))
    assert got == _spliced(orders, moves)


def test_a_day_list_mixes_both_kinds(spark):
    acts = table(spark, "activities", [
        dict(activity_id="r0", owner_id=1, day_type="weekday", sort_order=0),
        dict(activity_id="r1", owner_id=1, day_type="weekday", sort_order=5),
        dict(activity_id="one", owner_id=1, day_type="weekday", sort_order=2, entry_date=D(2024, 1, 3)),
        dict(activity_id="other", owner_id=1, day_type="weekday", sort_order=1, entry_date=D(2024, 1, 4)),
        dict(activity_id="we", owner_id=1, day_type="weekend", sort_order=1)])
    moves = spark.createDataFrame(
        [(1, D(2024, 1, 3), 1, 1, 0), (1, D(2024, 1, 6), 1, 0, 1)], MOVES)
    assert values(TE.reorder_changes(acts, moves), "d", "activity_id", "old_sort_order", "sort_order") \
        == [(D(2024, 1, 3), "one", 2, 0), (D(2024, 1, 3), "r0", 0, 1), (D(2024, 1, 3), "r1", 5, 2)]


FORM = ("seq long, created_at timestamp_ntz, owner_id long, entry_date date, title string, "
        "category string, planned_start string, planned_end string, goal_id string, color string")


def test_forms_and_positions(spark):
    acts = table(spark, "activities", [
        dict(activity_id="a", owner_id=1, day_type="weekday", title="t", category="c", sort_order=4),
        dict(activity_id="b", owner_id=1, day_type="weekend", title="t", category="c", sort_order=9),
        dict(activity_id="c", owner_id=1, day_type="weekday", title="t", category="c", sort_order=7,
             entry_date=D(2024, 1, 3))])
    day, other = D(2024, 1, 3), D(2024, 1, 4)
    forms = spark.createDataFrame([
        (1, T0, 1, day, " x ", " ", "08:05", "", "", ""),
        (2, T0, 1, day, " \t", "c", "", "", "", ""),
        (3, T0 - dt.timedelta(hours=1), 1, day, "y", "own", "", "bad", "12", "#fff"),
        (4, T0, 1, other, "z", "c", "", "", "", ""),
        (5, T0, 2, day, "w", "c", "", "", "", "")], FORM)
    cleaned = TE.clean_activity_forms(forms)
    assert values(cleaned, "seq", "title", "category", "planned_start_min", "planned_end_min",
                  "goal_id", "color") == [
        (1, "x", "rest", 485, None, None, None), (3, "y", "own", None, None, 12, "#fff"),
        (4, "z", "c", None, None, None, None), (5, "w", "c", None, None, None, None)]
    assert values(TE.place_one_offs(cleaned, acts), "seq", "sort_order") \
        == [(1, 9), (3, 8), (4, 5), (5, 1)]
    new = cleaned.withColumn("day_type", F.lit("weekday"))
    assert values(TE.place_in_template(new, acts), "seq", "sort_order") \
        == [(1, 6), (3, 5), (4, 7), (5, 1)]


def test_goal_forms(spark):
    forms = spark.createDataFrame(
        [(1, " g ", "2.5"), (2, "g", "0"), (3, "g", "-1"), (4, "g", "x"), (5, " ", "1"),
         (6, "g", "NaN"), (7, "g", "Infinity"), (8, "g", None), (9, "g", "123456789.125"),
         (10, "g", "0.004"), (11, "g", "0.000000000004"), (12, "g", " 1 ")],
        "seq long, title string, target string")
    got = TE.clean_goal_forms(forms)
    assert values(got, "seq", "title") == [(i, "g") for i in (1, 9, 10, 12)]
    assert values(got.select("seq", F.col("target").cast("double"))) == [
        (1, 2.5), (9, 123456789.125), (10, 0.004), (12, 1.0)]


TYPED = ("activity_id string, ts timestamp_ntz, seq long, title string, category string, color string, "
         "goal_id string, day_type string, planned_start string, planned_end string, sets_title boolean, "
         "sets_category boolean, sets_color boolean, sets_goal boolean, sets_day_type boolean, "
         "sets_times boolean")
TYPED_FIELDS = {"title": 10, "category": 11, "color": 12, "goal_id": 13, "day_type": 14,
                "planned_start": 15, "planned_end": 15}


def typed(key, seq, hours=0, **sets):
    row = [key, T0 + dt.timedelta(hours=hours), seq, *[None] * 7, *[False] * 6]
    for at, (name, mask) in enumerate(TYPED_FIELDS.items(), 3):
        if name in sets:
            row[at], row[mask] = sets[name], True
    return tuple(row)


def test_only_real_changes_come_out(spark):
    acts = table(spark, "activities", [
        dict(activity_id=k, owner_id=1, title="t", category="rest", color=None, goal_id=3,
             day_type="weekday", planned_start_min=60, planned_end_min=90) for k in "abcdefgh"])
    patches = spark.createDataFrame([
        typed("a", 1, title=" t ", category=""), typed("b", 2, title="  ", category="focus"),
        typed("c", 3, title="old"), typed("c", 4, hours=2, title="new", color="#f"),
        typed("c", 5, hours=1, title="late"), typed("d", 6, goal_id=""),
        typed("e", 7, goal_id="12"), typed("f", 8, planned_start="02:05", planned_end=""),
        typed("g", 9, day_type="weekend"), typed("g", 10, day_type="someday"),
        typed("zz", 11, title="nobody")], TYPED)
    changes = TE.activity_changes(acts, patches)
    fields = list(TE.ACTIVITY_PATCH_FIELDS)
    assert {r[0]: r[1:] for r in values(changes, "activity_id", *fields)} == {
        "b": ("t", "focus", None, 3, "weekday", 60, 90),
        "c": ("new", "rest", "#f", 3, "weekday", 60, 90),
        "d": ("t", "rest", None, None, "weekday", 60, 90),
        "e": ("t", "rest", None, 12, "weekday", 60, 90),
        "f": ("t", "rest", None, 3, "weekday", 125, None),
        "g": ("t", "rest", None, 3, "weekend", 60, 90)}
    after = U.apply_changes(acts, changes, ["activity_id"], fields)
    assert after.count() == 8
    assert values(U.changed_rows(acts, after, ["activity_id"], ["goal_id"]), "activity_id",
                  "old_goal_id", "goal_id") == [("d", 3, None), ("e", 3, 12)]


def test_seeding_twice_adds_nothing(spark):
    people = table(spark, "profiles", [dict(owner_id=1), dict(owner_id=2)])
    acts = table(spark, "activities", [dict(activity_id="a", owner_id=1)])
    seeded = TE.seed_defaults(people, acts)
    assert seeded.count() == 11 and values(seeded.select("owner_id").distinct()) == [(2,)]
    both = acts.unionByName(seeded, allowMissingColumns=True)
    assert TE.seed_defaults(people, both).isEmpty()


def test_unchanged_notes_do_not_come_out(spark):
    day = D(2024, 1, 3)
    current = table(spark, "logs", [
        dict(owner_id=1, activity_id=k, log_date=day, note=n)
        for k, n in (("a", "same"), ("b", "old"), ("c", None), ("d", "gone"))])
    feed = spark.createDataFrame([
        patch(1, 0, key="a", note="same"), patch(2, 0, key="b", note="new"),
        patch(3, 0, key="c", note=""), patch(4, 0, key="d", note="x"), patch(5, 1, key="d", note=""),
        patch(6, 0, key="e", note="first"), patch(7, 0, key="a", completed=True)], PATCH)
    assert values(U.note_changes(current, feed), "activity_id", "old_note", "note") == [
        ("b", "old", "new"), ("d", "gone", ""), ("e", None, "first")]
