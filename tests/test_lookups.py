"""Lookups with frequent, null and unknown keys beside a plain join."""

import pytest

from adhere.operators.lookups import frequent_keys, lookup


def tables(spark):
    rows = [(i, "hot" if i % 3 == 0 else "gone" if i % 5 == 0 else None if i % 7 == 0 else f"k{i % 40}") for i in range(2000)]
    return (spark.createDataFrame(rows, "n long, code string"),
            spark.createDataFrame([("hot", 1, None), (None, 9, "z"), *((f"k{i}", i, "x") for i in range(0, 40, 3))],
                                  "entry string, owner long, more string"))


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("share", [1, 10, 1000])
def test_as_a_plain_join(spark, how, share):
    rows, entries = tables(spark)
    got = lookup(rows, entries, "code", "entry", how, share)
    want = rows.join(entries.where("entry IS NOT NULL"), rows.code == entries.entry, how).drop("entry")
    assert got.columns == want.columns == ["n", "code", "owner", "more"]
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_frequent_keys_are_few(spark):
    rows, _ = tables(spark)
    assert {r.frequent for r in frequent_keys(rows, "code", 4).collect()} == {"hot"}
    assert {r.frequent for r in frequent_keys(rows, "code", 10).collect()} == {"hot", "gone"}
    assert frequent_keys(rows.where("n < 0"), "code").count() == 0


def test_no_task_holds_a_frequent_key(spark):
    rows, entries = tables(spark)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold",
                                          "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        joined = lookup(rows, entries, "code", "entry", "left", 100)
        sizes = joined.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
        assert sum(sizes) == 2000 and len(sizes) == 8 and max(sizes) < 2 * 2000 / 8
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_empty_tables_and_wrong_kind(spark):
    rows, entries = tables(spark)
    assert lookup(rows.where("n < 0"), entries, "code", "entry", "left").count() == 0
    assert lookup(rows, entries.where("owner < 0"), "code", "entry").count() == 0
    with pytest.raises(ValueError):
        lookup(rows, entries, "code", "entry", "outer")
