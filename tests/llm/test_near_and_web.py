"""Near duplicates, repeated passages, web archives, the pipeline: beside brute force."""

import base64
import gzip
import hashlib
import random

import duckdb
import numpy as np
import pytest
from compare import difference
from llm_helpers import TABLES, by_id, documents
from pyspark.sql import functions as F

import corpus_pipeline
from adhere.llm import components as C
from adhere.llm import projection_dedup as P
from adhere.llm import simhash as S
from adhere.llm import suffix_dedup as X
from adhere.llm import warc
from adhere.llm.common import table
from adhere.session import work_path


def roots(n, pairs):
    forest = C.LocalForest(n)
    if len(pairs):
        a, b = np.array(pairs).T
        forest.link(a, b)
    return forest.root.tolist()


def test_components(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    pairs += [(i, i + 1) for i in range(300, 380)] + [(400, i) for i in range(401, 450)]
    got = by_id(C.components(spark.createDataFrame(pairs, "a long, b long")), "node")
    want = roots(450, pairs)
    assert all(got[i].component == want[i] if i in got else want[i] == i for i in range(450))
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_as_spark_hashes(spark):
    text = "The cat SAT on the É mat and the cat sat"
    words = text.lower().replace("é", "É").split()
    shingles = [(" ".join(words[i:i + 3]),) for i in range(len(words) - 2)]
    hashes = [r[0] % 2 ** 64 for r in spark.createDataFrame(shingles, "s string").select(
        F.xxhash64("s")).collect()]
    want = sum(1 << bit for bit in range(64)
               if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))
    assert S.fingerprint(text) == want
    assert S.fingerprint(" \t\n") == 0 and S.fingerprint("one") == S.fingerprint(" ONE ")


def test_trees_find_all_links(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2 ** 63, 300, dtype=np.uint64)
    fps = [*base]
    for x in base[:150]:
        y = x
        for _ in range(rng.integers(1, 6)):
            y ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
            fps.append(y)
    # Many fingerprints with one half in common.
    fps += [np.uint64(x) for x in rng.integers(0, 2 ** 32, 200)]
    fps = np.unique(np.array(fps, np.uint64))
    q, s = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    want = roots(len(fps), list(zip(q, s)))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for rows in (20, 8192):
        got = by_id(C.components(S.links(df, rows)), "node")
        mine = [got[x].component if x in got else x for x in fps.view(np.int64).tolist()]
        assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_near_duplicates(spark):
    long = " ".join(f"word{i}" for i in range(3000))
    rows = [(5, long), (3, long), (7, long + " more"), (1, None), (2, " "), (4, "short"),
            (None, "short"), (6, "other"), (6, "other")]
    docs = documents(spark, rows)
    got = by_id(S.near_duplicates(docs))
    assert got[5].component_id == got[7].component_id == got[3].component_id == 3
    assert got[1].component_id == got[2].component_id == 1 and got[1].fingerprint == "0" * 16
    assert got[4].component_id == got[None].component_id == 4 and got[6].component_id == 6
    kept = S.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6, 6]
    assert S.near_duplicates(documents(spark, [])).count() == 0


def test_simhash_query_beside_brute_force(spark):
    rows = table(spark, TABLES, "documents").select("doc_id", "text").collect()
    ids = np.array([r.doc_id for r in rows])
    order = np.argsort(ids)
    fps = np.array([S.fingerprint(rows[i].text or "") for i in order], np.uint64)
    q, s = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    want = ids[order][roots(len(ids), list(zip(q, s)))]
    got = by_id(S.op8_simhash_vptree(spark, TABLES))
    assert [got[i].component_id for i in ids[order]] == want.tolist()


def near_vectors():
    rng = np.random.default_rng(8)
    rows, number = [], 0
    for label in (0, 1):
        for _ in range(60):
            x = rng.standard_normal(16)
            for _ in range(int(rng.integers(1, 6))):
                y = x + rng.standard_normal(16) * rng.choice([0, 0.05, 0.1, 0.3])
                rows.append((number, [float(v) for v in y.astype(np.float32)], label))
                number += 1
    return rows


def test_projection_passes(spark):
    rows = near_vectors()
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= P.COSINE) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    odd = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] + [1.0] * 15, 0),
           (1003, rows[0][1], None), (1004, [1.0, None], 0), (1005, [], 0), (1006, [1.0, 2.0], 0),
           (1007, [2.0, 4.0], 0), (None, rows[1][1], rows[1][2])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + odd],
                               "vec_id long, embedding array<float>, label int, node string, size int")
    got = by_id(P.near_duplicates(df), "vec_id")
    links = near.sum(axis=1)
    links[near[1]] += 1  # the null id repeats row 1
    links[1] += 1
    assert [got[r[0]].n_links for r in rows] == links.tolist()
    want = roots(len(rows), list(zip(*np.nonzero(near))))
    assert all(got[r[0]].component_id == want[i] for i, r in enumerate(rows))
    assert all(got[i].n_links == 0 and got[i].kept for i in (1000, 1001, 1002, 1003, 1004, 1005))
    assert got[1006].n_links == got[1007].n_links == 1 and got[1007].component_id == 1006
    assert P.near_duplicates(df.limit(0)).count() == 0


def test_projection_recall_with_small_windows(spark, monkeypatch):
    monkeypatch.setattr(P, "WINDOW", 32)
    monkeypatch.setattr(P, "BLOCK", 64)
    rows = near_vectors()
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= P.COSINE) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = by_id(P.near_duplicates(df), "vec_id")
    mine = np.array([got[r[0]].n_links for r in rows])
    assert (mine <= near.sum(axis=1)).all() and mine.sum() >= 0.9 * near.sum()


def clustered_vectors(seed, sizes, single):
    """Rows of one label: clusters of near copies, pairs just above the cosine, and single vectors."""
    rng = np.random.default_rng(seed)
    parts = [rng.standard_normal(16) + 0.03 * rng.standard_normal((n, 16)) for n in sizes]
    x = rng.standard_normal((single, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.standard_normal((single, 16))
    y -= (x * y).sum(axis=1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    angle = np.arccos(P.COSINE + 0.005)
    return np.concatenate([*parts, x, np.cos(angle) * x + np.sin(angle) * y])


def test_clusters_and_labels_of_many_windows(spark, monkeypatch):
    monkeypatch.setattr(P, "WINDOW", 16)
    monkeypatch.setattr(P, "BLOCK", 64)
    x = clustered_vectors(9, (400, 90), 1000)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)],
                               "vec_id long, embedding array<double>, label int")
    x = x / np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= P.COSINE
    np.fill_diagonal(near, False)
    got = by_id(P.near_duplicates(df), "vec_id")
    mine = np.array([got[i].n_links for i in range(len(x))])
    assert (mine <= near.sum(axis=1)).all()
    assert mine[:490].tolist() == near[:490].sum(axis=1).tolist()
    assert mine[490:].sum() >= 0.995 * near[490:].sum()
    want = roots(len(x), list(zip(*np.nonzero(near))))
    assert np.mean([got[i].component_id == want[i] for i in range(len(x))]) >= 0.995


def test_passes_follow_the_rows_of_a_label():
    assert P.plan_passes(1024, 0.93, 8, 1024) == (0, 8)
    for n in (10 ** 5, 10 ** 6, 4 * 10 ** 7):
        bits, passes = P.plan_passes(n, 0.93, 8, 1024)
        seen = (1 - np.arccos(0.93) / np.pi) ** bits
        assert n / 2 ** bits <= 1024 and 1 - (1 - seen) ** passes >= P.RECALL


def brute_removed(rows):
    first, out = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - X.LENGTH + 1):
            if first.setdefault(raw[s:s + X.LENGTH], (i, s)) != (i, s):
                gone[s:s + X.LENGTH] = b"\1" * X.LENGTH
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def repeating_rows():
    rng = random.Random(5)

    def words(n):
        return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(n))

    base, rows = [words(300) for _ in range(6)], []
    for i in range(80):
        parts = []
        for _ in range(rng.randint(0, 6)):
            text = rng.choice(base)
            start = rng.randint(0, len(text) - 150)
            parts += [text[start:start + rng.randint(60, 400)], words(rng.randint(0, 30))]
        rows.append((i, " ".join(parts)))
    return rows + [(200, None), (201, ""), (202, "a" * 500), (203, "ab" * 300), (204, rows[3][1]),
                   (205, rows[3][1]), (206, "a" * 99), (207, "a" * 100)]


@pytest.mark.parametrize("small, hot", [(False, 1 << 16), (True, 5)])
def test_repeats_go(spark, monkeypatch, small, hot):
    if small:  # many groups, buckets, blocks and hot anchors
        for name, value in (("GROUP_BYTES", 5000), ("CONTEXT_BUCKET", 20_000),
                            ("ANCHOR_BUCKET", 20_000), ("BLOCK_BYTES", 400)):
            monkeypatch.setattr(X, name, value)
    rows = repeating_rows()
    got = X.remove_repeats(documents(spark, rows).repartition(3), hot_least=hot).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: tuple(r)[1:5] for r in got} == brute_removed(rows)


def test_repeats_edge_cases(spark):
    text = repeating_rows()[10][1] + "z" * 120
    got = X.remove_repeats(documents(spark, [(1, text), (1, text), (None, text), (2, "x")]),
                           keep_bytes=True).collect()
    by = {(r.doc_id, r.n_removed) for r in got}
    alone = brute_removed([(1, text)])[1]
    assert by == {(1, alone[1]), (None, len(text.encode())), (2, 0)}
    assert X.remove_repeats(documents(spark, [])).count() == 0


def test_mixed_block_is_parted():
    data = np.frombuffer(b"a" * 100 + b"b" * 100 + b"a" * 100, np.uint8)
    block = X._verified(data, np.array([0, 100, 200]), np.array([0, 0, 0]), np.array([0]))
    assert block[0] == block[2] != block[1]


PAGES = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>y\r\n\r\nWARC/1.1</p>"),
         (3, None, "<p>x</p>"), (4, "http://a/4\r\nEvil: 1", None), (5, "http://é", ""),
         (6, "http://a/6", "é" * 50_000)]


def test_very_large_and_small_components_keep_their_angle(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1e-200, 0.0]), (3, [0.0, 1e-200]), (4, [1e300, 1e300]),
            (5, [1e-310, 1e-310]), (6, [5e-324, 0.0])]
    df = spark.createDataFrame([(i, 1, v) for i, v in rows], "vec_id long, label int, embedding array<double>")
    got = by_id(P.near_duplicates(df), "vec_id")
    assert [got[i].component_id for i in range(7)] == [0, 1, 0, 1, 4, 4, 0]
    assert [got[i].n_links for i in range(7)] == [2, 1, 2, 1, 1, 1, 2]


def test_archives_round_trip(spark):
    df = spark.createDataFrame([(*p, "x") for p in PAGES],
                               "page_id long, url string, html string, digest string")
    path = work_path(spark, "warc-test")
    warc.write_archives(df.repartition(3), path, file_records=1)
    records = warc.read_archives(spark, path, payloads=True)
    assert records.count() == 3 * len(PAGES)
    got = by_id(warc.assemble(records), "page_id")
    assert [(got[i].record_type, got[i].refers_to) for i in range(1, 7)] == [
        ("response", None), ("response", None), ("revisit", 1), ("response", None), ("revisit", 4),
        ("response", None)]
    for page, url, html in PAGES:
        raw = (html or "").encode()
        row = got[page]
        assert row.payload_bytes == len(raw)
        assert row.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert row.request.target_uri == row.response.target_uri == (
            url and url.replace("\r\n", "  "))
        assert row.metadata.fields == f"page_id: {page}\r\n"
    stored = {bytes(r.payload) for r in records.where("record_type = 'response'").collect()}
    assert stored == {(h or "").encode() for _, _, h in PAGES}


def test_small_payloads_are_written_again(spark):
    df = spark.createDataFrame(PAGES + [(7, "u", "é" * 50_000)], "page_id long, url string, html string")
    path = work_path(spark, "warc-test")
    warc.write_archives(df, path, min_bytes=100)
    got = by_id(warc.assemble(warc.read_archives(spark, path)), "page_id")
    assert [i for i in got if got[i].record_type == "revisit"] == [7] and got[7].refers_to == 6


def test_archives_edge_cases(spark):
    rows = [(None, "u", "a"), (None, "v", "b"), (1, "u", "same"), (1, "u", "same"), (1, "w", "same"), (2, "u", "same"),
            (2, "u", "same"), (None, "u", "a")]
    path = work_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = warc.assemble(warc.read_archives(spark, path)).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == [
        ("1", "response", None)] * 3 + [("2", "revisit", 1)] * 2 + [("None", "response", None)] * 3
    assert sorted(r.response.target_uri for r in got if r.page_id == 1) == ["u", "u", "w"]
    empty = work_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.assemble(warc.read_archives(spark, empty)).count() == 0


def test_repeated_rows_beside_the_sql(spark, tmp_path):
    # Every row is a record, also one that repeats an id and an html.
    rows = [(1, "u", "a"), (1, "u", "a"), (2, "u", "a"), (3, "u", None), (3, "u", ""), (4, "v", "b"), (4, "v", "c")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "p"))
    (tmp_path / "pages.parquet").symlink_to(next((tmp_path / "p").glob("*.parquet")))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    assert difference(warc.op6_warc_transactions(spark, str(tmp_path)), con, warc.ORACLE) is None


def test_files_are_bounded_in_bytes(spark):
    rows = [(i, "u", random.Random(i).randbytes(20_000).hex()) for i in range(40)]
    path = work_path(spark, "warc-test")
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, path, file_bytes=200_000)
    files = [r.length for r in spark.read.format("binaryFile").load(path).select("length").collect()]
    assert len(files) >= 8 and max(files) < 200_000
    assert warc.assemble(warc.read_archives(spark, path)).count() == 40


def test_members_are_read_in_steps(monkeypatch):
    record = (b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:%d>\r\n"
              b"Content-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n"
              b"HTTP/1.1 200 OK\r\n\r\n%b\r\n\r\n")
    plain = [record % (i, 19 + n, b"WARC/" * (n // 5)) for i, n in enumerate((0, 5, 50_000, 15))]
    monkeypatch.setattr(warc, "READ_BYTES", 7)
    for data in (b"".join(plain), gzip.compress(b"".join(plain)), b"".join(map(gzip.compress, plain))):
        assert [(r[0], r[8]) for r in warc._parse(data, False)] == [
            ("<urn:0>", 0), ("<urn:1>", 5), ("<urn:2>", 50_000), ("<urn:3>", 15)]


def test_foreign_archive():
    record = (b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:a>\r\n"
              b"Content-Type: application/http; msgtype=response\r\nContent-Length: 24\r\n\r\n"
              b"HTTP/1.1 200 OK\r\n\r\nhello\r\n\r\n")
    two = gzip.compress(record) + gzip.compress(record.replace(b"<urn:a>", b"<urn:b>"))
    assert [(r[0], r[8]) for r in warc._parse(two, False)] == [("<urn:a>", 5), ("<urn:b>", 5)]


def test_stages_on_empty_and_odd_documents(spark):
    odd = "doc_id long, text string, lang string, source string, n_chars long, row string, " \
          "kept_id string, id string, size string, taken string, copy string, _id string, fp string, " \
          "digest string, label string"
    more = ["x"] * 10
    docs = spark.createDataFrame([
        (1, "one two three", "en", "a", 1, *more), (1, "one two three", "en", "a", 1, *more),
        (None, "one two four", None, None, None, *more), (2, None, None, None, None, *[None] * 10),
        (3, "long words " * 50_000, "en", "b", 1, *more), (4, "", "en", "b", 0, *more)], odd)
    for rows, least in ((docs, 1), (docs.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = corpus_pipeline.stored(stage(spark, rows, TABLES), "odd-stage")
            assert rows.columns == docs.columns
        got = corpus_pipeline.STAGES[-1][1](spark, rows, TABLES).count()
        assert got >= least and (got == 0) == (least == 0)


def test_pipeline_stage_by_stage(spark):
    docs = table(spark, TABLES, "documents").unionByName(spark.createDataFrame(
        [(10_001, None, "en", "src1", 0), (10_002, "12 34", "en", "src1", 5), (10_003, "ЖЩЫЭЮЯ", "en", "src1", 6)],
        "doc_id long, text string, lang string, source string, n_chars long"))
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(corpus_pipeline.stored(stage(spark, frames[-1], TABLES), "test-stage"))
    rows = [f.collect() for f in frames]
    assert all(f.columns == docs.columns for f in frames[:-1])
    # 1: what has no letter or no known language goes.
    assert {r.doc_id for r in rows[0]} - {r.doc_id for r in rows[1]} == {10_001, 10_002, 10_003}
    # 2: the largest id of equal texts stays.
    best = {}
    for r in rows[1]:
        key = r.text.encode().lower()
        best[key] = max(best.get(key, -1), r.doc_id)
    assert sorted(r.doc_id for r in rows[2]) == sorted(best.values())
    # 3: the smallest id of fingerprints that link stays.
    ids = sorted(r.doc_id for r in rows[2])
    text = {r.doc_id: r.text for r in rows[2]}
    fps = np.array([S.fingerprint(text[i]) for i in ids], np.uint64)
    q, s = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    assert sorted(r.doc_id for r in rows[3]) == [ids[i] for i in sorted(set(roots(len(ids), list(zip(q, s)))))]
    # 4: words by source are those of the mix, but for half a document; texts stay whole.
    taken = corpus_pipeline.mixing.mix(frames[3], corpus_pipeline.mixing.quality_weights(
        table(spark, TABLES, "labels"))).groupBy("source").agg(
        F.sum("taken").alias("n"), F.max("size").alias("most")).collect()
    whole = {(r.doc_id, r.text) for r in rows[3]}
    words = {}
    for r in rows[4]:
        assert (r.doc_id, r.text) in whole
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    assert all(abs(words.get(r.source, 0) - r.n) <= r.most / 2 for r in taken)
    # 5: every row is encoded and decodes to its text.
    assert sorted(r.decoded_sha256 for r in rows[5]) == sorted(
        hashlib.sha256(r.text.encode()).hexdigest() for r in rows[4])
    assert all(len(r.ids) == r.n_tokens for r in rows[5])
