import datetime as dt
from decimal import Decimal

import pytest
from helpers import D, table, values
from pyspark.sql import functions as F

from adhere import model
from adhere.model import Horizon
from adhere.operators import onboarding as OB
from adhere.operators import quality as Q
from adhere.operators import removals as RM
from adhere.operators import sharing as S
from adhere.sources import readers, sinks


def _tables(spark):
    return {
        "profiles": table(spark, "profiles", [
            dict(owner_id=i, email=f"{i}@example.org", username=f"u{i}", share_code=f"CODE{i}",
                 display_name=None if i == 2 else f"Name {i}") for i in (1, 2, 3)]),
        "activities": table(spark, "activities", [
            dict(activity_id="a", owner_id=1, title="t", day_type="weekday", category="c",
                 sort_order=1, goal_id=10),
            dict(activity_id="b", owner_id=2, title="t", day_type="weekend", category="c",
                 sort_order=1, entry_date=D(2024, 1, 6))]),
        "logs": table(spark, "logs", [
            dict(owner_id=1, activity_id="a", log_date=D(2024, 1, 3), completed=True),
            dict(owner_id=1, activity_id="a", log_date=D(2024, 2, 5), completed=False)]),
        "reflections": table(spark, "reflections", [
            dict(owner_id=2, period_type="daily", period_date=D(2024, 1, 3), content="x")]),
        "shares": table(spark, "shares", [
            dict(owner_id=1, viewer_id=2, permission="edit"),
            dict(owner_id=3, viewer_id=1, permission="view")]),
        "goals": table(spark, "goals", [
            dict(goal_id=10, owner_id=1, title="g", period_type="weekly", metric="hours",
                 target=Decimal("1.00"))]),
    }


# ---- sources and sinks

def test_logs_round_trip_and_month_pruning(spark, tmp_path):
    logs = _tables(spark)["logs"]
    path = str(tmp_path / "logs")
    sinks.write_logs(logs, path)
    assert values(readers.read_logs(spark, path)) == values(logs)
    january = readers.read_logs(spark, path, Horizon(D(2024, 1, 1), D(2024, 1, 31)))
    assert values(january, "log_date") == [(D(2024, 1, 3),)]
    plan = january._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_month" in plan
    assert "GreaterThanOrEqual(log_date,2024-01-01)" in plan
    with pytest.raises(Exception):
        sinks.write_logs(logs, path)  # a written table is never overwritten


def test_newest_row_of_a_key_written_twice(spark, tmp_path):
    at, day = dt.datetime(2024, 1, 3), D(2024, 1, 3)
    logs = table(spark, "logs", [
        dict(owner_id=1, activity_id="a", log_date=day, note="old", updated_at=at),
        dict(owner_id=1, activity_id="a", log_date=day, note="new", updated_at=at + dt.timedelta(1))])
    sinks.write_logs(logs, str(tmp_path / "logs"))
    newest = readers.read_logs(spark, str(tmp_path / "logs"), newest_only=True)
    assert newest.columns == logs.columns and values(newest, "note") == [("new",)]


def test_a_page_reads_one_owner_and_a_range(spark):
    logs = _tables(spark)["logs"]
    mine = readers.in_horizon(readers.of_owner(logs, 1), "log_date",
                              Horizon(D(2024, 2, 5), D(2024, 2, 5)))
    assert values(mine, "log_date") == [(D(2024, 2, 5),)]
    assert readers.of_owner(logs, 2).isEmpty()


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc", "csv"])
@pytest.mark.parametrize("name", list(model.TABLES))
def test_every_table_reads_back(spark, tmp_path, name, fmt):
    df = _tables(spark)[name]
    path = str(tmp_path / name)
    df.write.format(fmt).save(path)
    back = readers.read_table(spark, name, path, fmt)
    assert back.schema == model.TABLES[name].schema
    assert values(back) == values(df)


def test_older_files_gain_null_columns(spark, tmp_path):
    old = _tables(spark)["activities"].drop("color", "entry_date", "goal_id") \
        .withColumn("dropped_long_ago", F.lit(1))
    path = str(tmp_path / "old")
    old.write.parquet(path)
    for df in (readers.read_table(spark, "activities", path), readers.conform(old, "activities")):
        assert df.columns == model.ACTIVITIES.names
        assert values(df, "activity_id", "color", "goal_id") == [("a", None, None), ("b", None, None)]


def test_documents_keep_null_fields(spark, tmp_path):
    path = str(tmp_path / "docs")
    sinks.write_documents(spark.range(1).select(F.struct(
        F.lit(None).cast("string").alias("a"), F.lit(1).alias("b")).alias("doc")), path)
    assert spark.read.text(path).collect()[0][0] == '{"doc":{"a":null,"b":1}}'


def test_default_routine(spark):
    rows = readers.default_routine(spark)
    assert values(rows.groupBy("day_type").count()) == [("weekday", 7), ("weekend", 4)]
    assert values(rows.where("title = 'Exercise'"), "planned_start_min", "planned_end_min") \
        == [(990, 1050)]


def test_rows_round_trip(spark, tmp_path):
    path = str(tmp_path / "rows")
    sinks.write_rows(_tables(spark)["shares"], path)
    assert values(spark.read.parquet(path)) == values(_tables(spark)["shares"])


# ---- removals

def test_cascades(spark):
    t = _tables(spark)
    gone = spark.createDataFrame([("a",), ("a",)], "activity_id string")
    out = RM.delete_activities(t["activities"], t["logs"], gone)
    assert values(out["activities"], "activity_id") == [("b",)]
    assert out["logs"].isEmpty() and out["removed_logs"].count() == 2
    cut = RM.delete_goals(t["goals"], t["activities"],
                          spark.createDataFrame([(10,), (10,)], "goal_id long"))
    assert cut["goals"].isEmpty()
    assert values(cut["activities"], "activity_id", "goal_id") == [("a", None), ("b", None)]
    left = RM.erase_owners(t, spark.createDataFrame([(1,)], "owner_id long"))
    assert {k: v.count() for k, v in left.items()} == {
        "profiles": 2, "activities": 1, "logs": 0, "reflections": 1, "shares": 0, "goals": 0}
    assert all(v.columns == t[k].columns for k, v in left.items())


# ---- quality

def test_checks_split_rows_in_two(spark):
    bad = table(spark, "shares", [
        dict(owner_id=1, viewer_id=2, permission="view"), dict(owner_id=1, permission="own"),
        dict(owner_id=1, viewer_id=3)])
    checked = Q.with_violations(bad, "shares")
    assert values(Q.valid_rows(checked), "viewer_id") == [(2,)]
    assert values(Q.quarantined_rows(checked), "violations") == [
        (["permission missing"],), (["viewer_id missing", "permission not allowed"],)]


def test_clean_tables_pass_all_checks(spark):
    t = _tables(spark)
    for name, df in t.items():
        assert Q.quarantined_rows(Q.with_violations(df, name)).isEmpty()
    assert Q.orphans(t).isEmpty() and Q.all_duplicate_keys(t).isEmpty()


def test_orphans_and_duplicates(spark):
    t = _tables(spark)
    t["profiles"] = t["profiles"].where("owner_id <> 2")
    t["logs"] = t["logs"].unionAll(t["logs"].limit(1))
    assert values(Q.orphans(t)) == [
        ("activities", "owner_id -> profiles", "b", "2"),
        ("reflections", "owner_id -> profiles", "2|daily|2024-01-03", "2"),
        ("shares", "viewer_id -> profiles", "1|2", "2")]
    found = values(Q.all_duplicate_keys(t))
    assert [(r[0], r[1], r[3]) for r in found] == [("logs", "owner_id,activity_id,log_date", 2)]


def test_null_keys_do_not_clash(spark):
    df = table(spark, "profiles", [dict(owner_id=1), dict(owner_id=2)])
    assert Q.all_duplicate_keys({"profiles": df}).isEmpty()


# ---- onboarding

def test_signups(spark):
    feed = spark.createDataFrame([
        (1, "a@example.org", '{"username": "x", "display_name": "X"}'), (2, "b@example.org", "{}"),
        (3, "c@example.org", None)], "owner_id long, email string, raw_user_meta_data string")
    assert values(OB.profiles_from_signups(feed), "owner_id", "username", "display_name") == [
        (1, "x", "X"), (2, "b", "b"), (3, "c", "c")]


def test_backfill(spark):
    old = table(spark, "profiles", [dict(owner_id=1, email="a@example.org"),
                                    dict(owner_id=2, email="b@example.org", username="k")])
    assert values(OB.backfill_names(old), "username", "display_name") == [("a", "a"), ("k", "k")]


def test_codes_stay_unique_when_space_is_tight(spark, monkeypatch):
    monkeypatch.setattr(OB.N, "CODE_SPACE", 900)
    people = spark.range(300).select(F.col("id").alias("owner_id"),
                                     F.when(F.col("id") == 7, "AAAAAB").alias("share_code"))
    got = {r.owner_id: r.share_code for r in OB.assign_share_codes(people).collect()}
    assert len(got) == 300 and len(set(got.values())) == 300 and got[7] == "AAAAAB"
    again = OB.assign_share_codes(people.repartition(7, "share_code"))
    assert {r.owner_id: r.share_code for r in again.collect()} == got


def test_code_rounds_end(spark, monkeypatch):
    monkeypatch.setattr(OB.N, "CODE_SPACE", 2)
    monkeypatch.setattr(OB, "MAX_CODE_ROUNDS", 3)
    people = spark.range(3).select(F.col("id").alias("owner_id"),
                                   F.lit(None).cast("string").alias("share_code"))
    with pytest.raises(RuntimeError):
        OB.assign_share_codes(people)


# ---- sharing

def test_lists_and_grants(spark):
    t = _tables(spark)
    assert values(S.share_lists(t["profiles"], t["shares"]), "person_id", "direction", "other_name",
                  "permission") == [
        (1, "in", "Name 3", "view"), (1, "out", "u2", "edit"), (2, "in", "Name 1", "edit"),
        (3, "out", "Name 1", "view")]
    granted = S.grants(t["profiles"], t["shares"])
    assert values(S.editable(granted), "viewer_id", "owner_id") == [(1, 1), (2, 1), (2, 2), (3, 3)]
    viewers = spark.createDataFrame([(2,)], "viewer_id long")
    assert values(S.visible_to(t["activities"], granted, viewers), "activity_id") == [("a",), ("b",)]
    assert values(S.shared_template(t["activities"], granted, viewers), "activity_id") == [("a",)]
    assert values(S.shares_visible_to(t["shares"], viewers), "owner_id") == [(1,)]
    counted = S.visible_counts({n: t[n] for n in ("activities", "logs")}, t["shares"], granted)
    assert values(counted, "viewer_id", "activities", "logs", "shares") == [
        (1, 1, 2, 2), (2, 2, 2, 1), (3, 0, 0, 1)]


def test_requests_by_code(spark):
    t = _tables(spark)
    asked = spark.createDataFrame([
        (1, 1, " code2 ", "view"), (2, 1, "code1", "view"), (3, 1, "nope", "view"),
        (4, 1, "  ", "view"), (5, 1, "CODE2", "edit")],
        "seq long, owner_id long, code string, permission string") \
        .withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    resolved = S.resolve_requests(asked, t["profiles"])
    assert values(resolved, "seq", "outcome") == [
        (1, "granted"), (2, "own code"), (3, "unknown code"), (4, "blank"), (5, "granted")]
    assert values(S.granted_shares(resolved)) == [(1, 2, "edit")]


def test_public_schedule(spark):
    t = _tables(spark)
    assert values(S.public_schedule(t["profiles"], t["activities"]), "share_code", "owner_name",
                  "title") == [("CODE1", "Name 1", "t")]
    assert S.public_schedule(t["profiles"], t["activities"], recurring_only=False).count() == 2
    codes = spark.createDataFrame([(" code2",)], "code string")
    assert values(S.of_codes(t["profiles"], codes), "owner_id") == [(2,)]


def test_who_may_write(spark):
    t = _tables(spark)
    granted = S.grants(t["profiles"], t["shares"])
    edits = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (3, 1), (3, 3), (1, None)],
                                  "owner_id long, author_id long")
    assert values(S.with_permission(edits, granted).where("permitted"), "owner_id", "author_id") \
        == [(1, 1), (1, 2), (3, 3)]
    assert values(S.with_permission(edits, granted, own_only=True).where("permitted"), "owner_id") \
        == [(1,), (3,)]


def _graph(spark):
    from helpers import table as t
    return {
        "profiles": t(spark, "profiles", [dict(owner_id=i) for i in (1, 2, 3)]),
        "goals": t(spark, "goals", [dict(goal_id=i, owner_id=o) for i, o in ((10, 1), (11, 1), (20, 2))]),
        "activities": t(spark, "activities", [
            dict(activity_id=a, owner_id=o, goal_id=g) for a, o, g in (
                ("a", 1, 10), ("b", 1, None), ("c", 2, 20), ("d", 2, 10), ("e", 3, 99))]),
        "logs": t(spark, "logs", [dict(owner_id=o, activity_id=a, log_date=D(2024, 1, 1))
                                  for o, a in ((1, "a"), (2, "a"), (2, "c"), (3, "e"), (3, "zz"))]),
        "reflections": t(spark, "reflections", [
            dict(owner_id=o, period_type="daily", period_date=D(2024, 1, 1)) for o in (1, 3)]),
        "shares": t(spark, "shares", [dict(owner_id=a, viewer_id=b) for a, b in ((1, 2), (2, 3), (3, 1))]),
    }


def _keys_of(spark, name, *keys):
    from adhere.model import TABLES
    fields = [f for f in TABLES[name].schema if f.name in TABLES[name].key]
    return spark.createDataFrame([k if isinstance(k, tuple) else (k,) for k in keys], type(TABLES[name].schema)(fields))


def _left(tables):
    from adhere.model import TABLES
    return {n: sorted(tuple(r[k] for k in TABLES[n].key) for r in df.collect()) for n, df in tables.items()}


def test_removals_follow_the_references(spark):
    from adhere.operators import removals as R
    tables = _graph(spark)
    left, record = R.remove(tables, {"profiles": _keys_of(spark, "profiles", 1, 1, 77), "goals": _keys_of(spark, "goals", 20)})
    got = _left(left)
    assert got["profiles"] == [(2,), (3,)] and got["goals"] == []
    assert got["activities"] == [("c",), ("d",), ("e",)] and got["shares"] == [(2, 3)] and len(got["reflections"]) == 1
    assert [k[:2] for k in got["logs"]] == [(2, "c"), (3, "e"), (3, "zz")]
    assert {r.activity_id: r.goal_id for r in left["activities"].collect()} == {"c": None, "d": None, "e": 99}
    rows = {(r.table_name, r.row_key): (r.fate, r.cause) for r in record.collect()}
    assert rows["profiles", "1"] == ("removed", "given") and rows["goals", "10"] == ("removed", "owner_id -> profiles")
    assert rows["goals", "20"] == ("removed", "given") and rows["activities", "d"] == ("unlinked", "goal_id")
    assert rows["logs", "2|a|2024-01-01"] == ("removed", "activity_id -> activities")
    assert rows["shares", "3|1"] == ("removed", "viewer_id -> profiles") and len(rows) == record.count() == 13
    assert all(df.columns == tables[n].columns for n, df in left.items())


def test_removals_equal_the_single_ones_and_leave_no_orphans(spark):
    from adhere.operators import quality, removals as R
    tables = _graph(spark)
    gone = _keys_of(spark, "activities", "a", "c")
    one = R.delete_activities(tables["activities"], tables["logs"], gone)
    left, record = R.remove(tables, {"activities": gone})
    assert _left(left) | {} == _left(tables) | _left({n: one[n] for n in ("activities", "logs")})
    assert record.where("table_name = 'logs'").count() == one["removed_logs"].count() == 3
    erased = R.erase_owners(tables, _keys_of(spark, "profiles", 2))
    left, _ = R.remove(tables, {"profiles": _keys_of(spark, "profiles", 2)})
    # A log of another owner on an erased owner's activity goes as well.
    assert {n: v for n, v in _left(left).items() if n != "logs"} == {n: v for n, v in _left(erased).items() if n != "logs"}
    before = {tuple(r) for r in quality.orphans(tables).collect()}
    assert {tuple(r) for r in quality.orphans(left).collect()} <= before and len(before) == 2
    same, none = R.remove(tables, {})
    assert _left(same) == _left(tables) and none.count() == 0


def test_tables_come_after_what_they_refer_to():
    import pytest

    from adhere.model import PROFILES, TABLES, TableRules
    from adhere.operators import removals as R
    order = R.dependency_order(TABLES)
    assert sorted(order) == sorted(TABLES) and all(
        order.index(t) < order.index(n) for n in TABLES for _, t, _ in TABLES[n].references)
    ring = {"x": TableRules(PROFILES, ("owner_id",), references=((("a",), "y", ("b",)),)),
            "y": TableRules(PROFILES, ("owner_id",), references=((("b",), "x", ("a",)),))}
    with pytest.raises(ValueError, match="ring"):
        R.dependency_order(ring, ring)
    with pytest.raises(ValueError, match="goals"):
        R.remove({}, {"goals": None})


def _rows_scanned(df):
    """(rows found, rows the scan gave out before the filter)."""
    found = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    todo, scanned = [plan], 0
    while todo:
        node = todo.pop()
        if "FileSourceScan" in node.getClass().getSimpleName():
            scanned += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found, scanned


def test_one_code_reads_one_row_group(spark, tmp_path):
    from adhere.sources import readers, sinks
    rows = spark.range(60_000).selectExpr("concat('C', lpad(id % 20000 * 2, 6, '0')) AS share_code", "id AS owner",
                                          "repeat(md5(cast(id AS string)), 3) AS title")
    path = str(tmp_path / "codes")
    sinks.write_by_code(rows.repartition(3), path, group_bytes=256 << 10, codes_per_group=1000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found, scanned = _rows_scanned(readers.read_code(spark, path, rows.schema, " c012346\t"))
        assert sorted(r.owner for r in found) == [6173, 26173, 46173] and 3 <= scanned < 6000
        # A code between two that exist is ruled out by the filter of its group, or costs one group.
        nobody, scanned = _rows_scanned(readers.read_code(spark, path, rows.schema, "C012347"))
        assert nobody == [] and scanned < 6000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
