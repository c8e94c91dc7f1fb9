"""Positions in groups of any size, and that a large group stays spread."""

from pyspark.sql import functions as F

from adhere.operators.ranking import with_positions


def rows(spark, n=3000):
    return spark.range(n).selectExpr("IF(id % 3 = 0, 'hot', IF(id % 7 = 0, NULL, concat('k', id % 50))) AS k",
                                     "id * 7919 % 3001 AS v", "id")


def test_positions_and_sizes(spark):
    got = with_positions(rows(spark), ["k"], [F.col("v"), F.col("id")], size="n").collect()
    groups = {}
    for r in got:
        groups.setdefault(r.k, []).append(r)
    assert len(got) == 3000 and len(groups["hot"]) == 1000
    for members in groups.values():
        by_value = sorted(members, key=lambda r: (r.v, r.id))
        assert [r.position for r in by_value] == list(range(len(members)))
        assert {r.n for r in members} == {len(members)}


def test_a_large_group_stays_spread(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold",
                                          "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "30")
        placed = with_positions(rows(spark, 30_000), ["k"], [F.col("v"), F.col("id")])
        sizes = placed.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
        # A third of all rows is one group: 10,000 rows; a task's even share is 1,000.
        assert sum(sizes) == 30_000 and max(sizes) < 5000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
