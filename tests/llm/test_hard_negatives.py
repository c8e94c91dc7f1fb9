"""Hard negatives against brute force in plain Python; the query beside its SQL is in test_exact_and_mix."""

import math
import random

import pytest
from pyspark.sql import functions as F

from adhere.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<double>, number long, key string, score double"
RESULT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, anchors=100, positives=5, negatives=5):
    part = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows
            if i is not None and y is not None and v is not None
            and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, v in part:
        if a % anchors:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, y) for i, y, w in part if len(w) == len(v))
        for s, p in [(s, i) for s, i, y in scored if y == label and i != a][:positives]:
            fits = [(n, i) for n, i, y in scored if y != label and 80 * -s <= 100 * -n <= 100 * -s]
            out += [(a, p, k, i, -s, -n) for k, (n, i) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x", 1.0) for r in rows], SCHEMA)
    got = H.mine(df, F.col("vec_id") % 100 == 0, **more)
    assert got.columns == RESULT
    return sorted(tuple(r) for r in got.collect())


def some(n, dims=6, labels=3, seed=1, step=1):
    rng = random.Random(seed)
    return [(i * step, rng.randrange(labels), [round(rng.gauss(.2, .4), 1) for _ in range(dims)])
            for i in range(n)]


@pytest.mark.parametrize("block_bytes", [H.BLOCK_BYTES, 200])
def test_equals_brute_force(spark, block_bytes):
    rows = some(150, step=20)
    want = brute(rows)
    assert len(want) > 100 and mined(spark, rows, block_bytes=block_bytes) == want


def test_small_tiles_change_nothing(spark, monkeypatch):
    # Tasks read the constant in their own process, so the tiles are tried on the task's functions.
    import pyarrow as pa
    rows = some(300)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]),
         pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["vec_id", "label", "embedding"])
    (_, ids, labels, vectors), = H._rows(batch, 256)
    block = H.Block(ids[::100], ids[::100], labels[::100], vectors[::100])
    windows = H.np.tile(H.np.array([-5000, 20000]), (3, 2, 1))
    seen = []
    for cells in (1 << 20, 7):
        monkeypatch.setattr(H, "TILE_CELLS", cells)
        limits = H.Limits()
        seen.append([next(H.first_positives([batch], block, limits, 256)),
                     next(H.first_negatives([batch], block, windows, limits, 256))])
    assert [sorted(b["key"].to_pylist()) for b in seen[0]] == [sorted(b["key"].to_pylist()) for b in seen[1]]


def test_ties_and_hot_label(spark):
    # Few different vectors: most scores tie; one label has most rows.
    rng = random.Random(2)
    rows = [(i, 0 if i % 3 else rng.randrange(3), [float(rng.randrange(2)), 1.0]) for i in range(400)]
    assert mined(spark, rows) == brute(rows)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = some(40, step=10) + [
        (1000, None, [1.0] * 6), (1001, 1, None), (1002, 1, [None] + [1.0] * 5), (1003, 1, [nan] * 6),
        (1004, 1, [inf] * 6), (None, 1, [1.0] * 6), (1100, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]),
        (1200, 1, [1.0, 2.0]), (1201, 1, [1.0, 2.0]), (1202, 2, [1.0, 1.9]), (1300, 0, []), (1301, 0, []),
        (1302, 1, [])]
    got = mined(spark, rows)
    assert got == brute(rows)
    assert (1200, 1201, 1, 1202, 65536 + 262144, 65536 + 512 * 486) in got
    assert (1300, 1301, 1, 1302, 0, 0) in got


def test_repeated_rows_and_negative_ids(spark):
    rows = some(60, step=50) + [(-100, 1, [1.0] * 6), (-3, 1, [.9] * 6), (-5, 0, [.9] * 6)]
    rows += rows[:40] + rows[-3:]
    assert mined(spark, rows) == brute(rows)


def test_large_components(spark):
    # Scores beyond what doubles add without loss, then scores beyond 64 bits.
    rows = [(0, 1, [2.0 ** 21 + 3, 3.0]), (1, 1, [2.0 ** 21 + 1, 1.0]), (2, 2, [2.0 ** 21, 1.0]),
            (3, 2, [1.0, 1.0]), (4, 2, [2.0 ** 21 + 1, 1.0])]
    assert mined(spark, rows) == brute(rows)
    far = [(0, 1, [1e300]), (1, 1, [1e300]), (2, 2, [1e299])]
    assert mined(spark, far) == [(0, 1, 1, 2, 2 ** 63 - 1, 2 ** 63 - 1)]


def test_empty_tables(spark):
    assert mined(spark, []) == [] and mined(spark, some(20)[1:]) == []
    assert mined(spark, [(100, None, None)]) == []
