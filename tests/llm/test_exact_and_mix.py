"""Exact dedup against a persistent index, and mixing; both also beside their SQL."""

import hashlib
import shutil
from collections import defaultdict

import pytest
from compare import difference, duck
from llm_helpers import TABLES, by_id, documents

from adhere.llm import exact_dedup as E
from adhere.llm import mixing as M
from adhere.llm import queries
from adhere.llm import simhash as S


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_beside_its_sql(spark, name):
    df = queries.queries()[name](spark, TABLES)
    assert difference(df, duck(TABLES), queries.SQL[name]) is None


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op7_source_mix"])
def test_native_queries_run_no_python(spark, name):
    plan = queries.queries()[name](spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))


ROWS = [(1, "Abc"), (2, "aBC"), (3, "É"), (4, "é"), (5, None), (6, ""), (None, "abc"),
        (7, "x" * 100_000), (8, "X" * 100_000), (9, "same"), (9, "same")]


def test_largest_id_stays(spark):
    got = by_id(E.deduplicate(documents(spark, ROWS), E.new_index(spark)))
    assert got[1].keep_id == 2 and got[1].group_size == 3 and not got[1].kept and got[2].kept
    assert got[None].keep_id == 2 and not got[None].kept
    assert got[3].keep_id == 3 and got[4].keep_id == 4  # only A-Z are lower-cased
    assert got[5].keep_id == got[6].keep_id == 6
    assert got[7].keep_id == 8 and got[9].kept and got[9].group_size == 2
    assert got[1].text_sha256 == hashlib.sha256(b"abc").hexdigest()


def test_index_keeps_what_came_first(spark):
    index = E.new_index(spark)
    E.deduplicate(documents(spark, [(5, "old"), (6, "OLD")]), index)
    got = by_id(E.deduplicate(documents(spark, [(9, "old"), (10, "new")]), index))
    assert got[9].keep_id == 6 and not got[9].kept and got[10].kept
    assert index.entries().count() == 2
    again = E.DigestIndex(spark, index.path, index.buckets)
    assert E.kept_documents(documents(spark, [(11, "New"), (12, "third")]), again).select(
        "doc_id").collect() == [(12,)]


def test_index_opened_in_another_session(spark, tmp_path):
    first = documents(spark, [(i, f"text {i}") for i in range(60)])
    index = E.new_index(spark)
    E.deduplicate(first, index)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for other in ("3", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", other)
            again = E.DigestIndex(spark, index.path)
            assert again.buckets == index.buckets
            assert E.kept_documents(first.selectExpr("doc_id + 100 AS doc_id", "text"), again).count() == 0
            assert again.entries().count() == 60
        with pytest.raises(ValueError):
            E.DigestIndex(spark, index.path, index.buckets + 1)
        # Files of an index from before counts were kept.
        old = str(tmp_path / "old")
        shutil.copytree(index.path, old, ignore=shutil.ignore_patterns("_buckets"))
        with pytest.raises(ValueError):
            E.DigestIndex(spark, old)
        assert E.DigestIndex(spark, old, index.buckets).buckets == index.buckets
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_index_is_read_by_buckets(spark):
    index = E.new_index(spark)
    E.deduplicate(documents(spark, ROWS), index)
    new = index.new_of(E.counted(documents(spark, [(1, "q")]).selectExpr("doc_id", "sha2(text, 256) digest")))
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert plan.count("Exchange hashpartitioning") == 1  # of the new rows alone


def test_empty_tables(spark):
    none = documents(spark, [])
    assert E.deduplicate(none, E.new_index(spark)).count() == 0
    assert M.mix(none).count() == 0


def brute_targets(sizes, epochs=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    out, free, left = {}, set(names), sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= epochs * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = epochs * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (i % 7 + 1), None, ["a", "b", "c", "d", None][min(i % 40, 4)])
            for i in range(400)] + [(1000, None, None, "a"), (1001, " \t", None, "e")]
    got = M.mix(documents(spark, rows)).collect()
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += len((text or "").split())
    want, taken = brute_targets(sizes), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == pytest.approx(want[s], abs=1) for s in sizes)
    assert sorted(got, key=str) == sorted(M.mix(documents(spark, rows)).collect(), key=str)
    epochs = {r.source: int(r.target // r.source_size) for r in got if r.source_size}
    assert all(r.taken >= epochs[r.source] * r.size for r in got if r.size)


def test_heavier_documents_come_first(spark):
    rows = [(i, "w", None, "small" if i % 2 else "big") for i in range(3000)]
    rows += [(i, "w", None, "zlast") for i in range(3000, 3100)]
    docs = documents(spark, rows)
    weights = docs.selectExpr("doc_id", "IF(doc_id % 4 < 2, 4.0, 0.25) AS weight")
    got = [r for r in M.mix(docs, weights).collect() if r.source == "big"]
    heavy = [r.taken for r in got if r.doc_id % 4 < 2]
    light = [r.taken for r in got if r.doc_id % 4 >= 2]
    assert sum(heavy) / len(heavy) > sum(light) / len(light)


def test_slices_do_not_matter(spark, monkeypatch):
    rows = [(i, "w " * (i % 5), None, f"s{i % 3 and 1}") for i in range(300)]
    whole = sorted(M.mix(documents(spark, rows)).collect())
    monkeypatch.setattr(M, "SLICE_ROWS", 7)
    assert sorted(M.mix(documents(spark, rows)).collect()) == whole


def test_rows_that_share_an_id_are_not_multiplied(spark):
    docs = documents(spark, [(1, "a b"), (1, "a b"), (1, "c"), (None, "d")])
    taken = spark.createDataFrame([(1, 2, 4), (1, 2, 2), (1, 1, 1), (None, 1, 1)],
                                  "doc_id long, size long, taken long")
    got = M.mixed_documents(docs, taken).collect()
    assert sorted(str((r.doc_id, r.text)) for r in got) == sorted(
        ["(1, 'a b')"] * 4 + ["(1, 'c')", "(None, 'd')"])


def test_mixed_documents_repeat_and_stay_whole(spark):
    docs = documents(spark, [(1, "a  b c\td"), (2, "x y"), (3, "gone"), (4, "less than half"), (5, " ")])
    taken = spark.createDataFrame([(1, 4, 6), (2, 2, 4), (3, 1, 0), (4, 3, 1), (5, 0, 0)],
                                  "doc_id long, size long, taken long")
    got = M.mixed_documents(docs, taken)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [
        (1, "a  b c\td"), (1, "a  b c\td"), (2, "x y"), (2, "x y")]


def slice_sizes(spark, rows, weights):
    """Rows of each (source, slice) as the operator stores them."""
    seen = []
    plain = M.stored
    M.stored = lambda df, purpose: seen.append((purpose, plain(df, purpose))) or seen[-1][1]
    try:
        M.mix(documents(spark, rows), weights)
    finally:
        M.stored = plain
    return sorted(r["count"] for r in dict(seen)["mix-slices"].groupBy("source", "slice").count().collect())


def test_slices_are_even_for_any_weights(spark, monkeypatch):
    monkeypatch.setattr(M, "SLICE_ROWS", 500)
    rows = [(i, "w " * (i % 9), None, "hot" if i % 3 else f"s{i % 2}") for i in range(9000)]
    weights = spark.range(9000).selectExpr("id AS doc_id", "ELT(1 + id % 4, 0.5, 1, 2, 0) * 1.0 AS weight")
    sizes = slice_sizes(spark, rows, weights)
    assert len(sizes) >= 18 and sizes[-1] < 900


STAGE_ROWS = [(7, "one two three four"), (7, "another text altogether, of other words"), (9, "ONE two three four"),
              (None, "no id here at all"), (None, "no id here at all"), (8, "repeated row of words"),
              (8, "repeated row of words"), (8, "Repeated row of words"), (None, "one two three four"), (3, None), (4, "")]


def test_dedup_stages_keep_one_row_of_each_text(spark):
    docs = documents(spark, STAGE_ROWS)
    kept = E.kept_documents(docs, E.new_index(spark))
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, (r.text or "").lower()) for r in kept.collect()), key=str)
    assert got == sorted([(9, "one two three four"), (7, "another text altogether, of other words"),
                          (None, "no id here at all"), (8, "repeated row of words"), (4, "")], key=str)
    near = S.representatives(docs)
    got = sorted(((r.doc_id, (r.text or "").lower()) for r in near.collect()), key=str)
    assert near.columns == docs.columns and got == sorted([
        (7, "one two three four"), (7, "another text altogether, of other words"),
        (None, "no id here at all"), (8, "repeated row of words"), (3, "")], key=str)
    assert E.kept_documents(documents(spark, []), E.new_index(spark)).count() == 0
    assert S.representatives(documents(spark, [])).count() == 0
