"""Token alignment against the libraries' own whole-text encoding and all pairs in plain Python."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import TABLES, documents

from adhere.llm import alignment as A
from adhere.llm import queries


@pytest.fixture(scope="module")
def sides():
    return A.tokenizers(A.BYTE_LEVEL, A.PIECES)


def brute(rows):
    """Rows of (doc_id, text) by whole texts and all pairs of tokens of a group."""
    a_side, b_side = A.tokenizers(A.BYTE_LEVEL, A.PIECES)
    out, count = [], Counter()
    for doc_id, text in rows:
        a = a_side.made.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.made.encode(text) if text else []
        whole = all(b"".join(s.bytes_of[i] for i in ids) == (" " + text).encode()
                    for s, ids in ((a_side, a), (b_side, b))) if text else False
        groups, links = [], []
        if whole:
            i = j = at_a = at_b = 0
            group = [], []
            while i < len(a) or j < len(b):
                if at_a <= at_b:
                    at_a += len(a_side.bytes_of[a[i]])
                    group[0].append(i)
                    i += 1
                else:
                    at_b += len(b_side.bytes_of[b[j]])
                    group[1].append(j)
                    j += 1
                if at_a == at_b:
                    groups.append(",".join(str(a[x]) for x in group[0]) + "|"
                                  + ",".join(str(b[x]) for x in group[1]))
                    group = [], []
            span = [np.cumsum([0, *(len(s.bytes_of[x]) for x in ids)]) for s, ids in ((a_side, a), (b_side, b))]
            first = 0
            for x in range(len(a)):
                while span[1][first + 1] <= span[0][x]:
                    first += 1
                y = first
                while y < len(b) and span[1][y] < span[0][x + 1]:
                    links.append((a[x], b[y]))
                    y += 1
        count.update(links)
        out.append((doc_id, len(a) if whole else 0, len(b) if whole else 0, len(groups), links,
                    hashlib.sha256(";".join(groups).encode()).hexdigest() if whole else ""))
    highest = Counter()
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    return sorted(((d, a, b, g, len(links), sum(count[p] == highest[p[1]] for p in links),
                    sum(count[p] for p in links), sha) for d, a, b, g, links, sha in out), key=repr)


def aligned(df):
    assert df.columns == ["doc_id", *A.COLUMNS, "groups_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()
    want = brute([tuple(r) for r in rows])
    assert aligned(queries.queries()["op11_token_alignment"](spark, TABLES)) == want


ODD = ["", None, " ", "  two  blanks ", "\tx\n\n y", "a▁b", "<|endoftext|> <s> </s> <unk> <0x41>", "naïve café",
       "日本語 の テキスト", "😀 x😀y 👩‍👩‍👧", "don't we'll I'M", "x" * 3000, "12345 6,789.01 #!?", "　wide blank ",
       "é ​ zero", "\x00 nul\x1f\x85", "tail ", "ﬁ ﬀ Å", "a b", "a b", "A B a"]


def test_odd_texts_repeated_rows_and_clashing_columns(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, "a b"), (None, None)]
    assert aligned(A.align(documents(spark, rows))) == brute(rows)


def test_long_texts_in_steps(spark):
    # Texts of many steps, one of them without tokens; chunks of few characters.
    rows = [(1, "alpha beta, gamma 12 " * 40), (2, "odd ▁ text " * 30), (3, "short"), (4, "q" * 500), (5, ""),
            (6, "alpha beta " * 3)]
    assert aligned(A.align(documents(spark, rows), chunk_chars=50)) == brute(rows)


def test_empty_tables(spark):
    assert aligned(A.align(documents(spark, []))) == []
    assert aligned(A.align(documents(spark, [(1, None)]))) == [(1, 0, 0, 0, 0, 0, 0, "")]


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.sampled_from("ab Z9.,'s▁\t\nüß日😀 ​́<>|"), max_size=40) | st.text(max_size=30))
def test_pieces_give_the_tokens_of_the_whole_text(sides, text):
    pieces = A.CUT.split(text)
    a, b = (side.ids(pieces) for side in sides)
    assert [i for ids in a for i in ids] == sides[0].made.encode(" " + text, add_special_tokens=False).ids
    if text and "▁" not in text:
        assert [i for ids in b for i in ids] == sides[1].made.encode(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=6),
                          st.lists(st.integers(1, 4), min_size=1, max_size=6)), max_size=5))
def test_overlaps_equal_all_pairs(texts):
    spans = [], []
    base = 0
    for number, both in enumerate(texts):
        length = max(map(sum, both))
        for side, lengths in zip(spans, both):
            at = base
            for n in [*lengths, length - sum(lengths)]:
                if n:
                    side.append((at, at + n, number))
                at += n
        base += length
    a, b = (np.array(s, np.int64).reshape(-1, 3) for s in spans)
    got = sorted(zip(*(x.tolist() for x in A.overlaps(a[:, 0], a[:, 2], b[:, 0], b[:, 2]))))
    assert got == [(i, j) for i, x in enumerate(a) for j, y in enumerate(b)
                   if x[2] == y[2] and x[0] < y[1] and y[0] < x[1]]


def test_equal_groups_are_compared_beyond_their_hash(monkeypatch):
    # With a hash that says nothing at first, the comparison finds it out and takes the next.
    plain = A._group_hashes
    monkeypatch.setattr(A, "_group_hashes", lambda i, p, starts, salt: np.zeros(len(starts), np.uint64) if salt < 3
                        else plain(i, p, starts, salt))
    kind, first = A._kinds(
        np.array([1, 2, 1]), np.array([0, 1, 2]), (np.array([0, 1, 2]), np.array([1, 2, 3])),
        np.array([7, 8, 9, 7]), np.array([0, 1, 1, 2]), (np.array([0, 1, 3]), np.array([1, 3, 4])))
    assert kind.tolist() == [0, 1, 0] and first.tolist() == [0, 1]


def test_pieces_are_forgotten_and_learned_anew(sides, monkeypatch):
    texts = [(i, f"w{i} common a▁b" if i % 9 == 0 else f"w{i} common words {i % 4}") for i in range(300)]
    whole = list(A.chunks(iter(texts), sides, 0, 1 << 20))
    monkeypatch.setattr(A, "KNOWN_PIECES", 20)
    parts = list(A.chunks(iter(texts), sides, 0, 200))
    assert len(whole) == 1 and len(parts) > 20

    def seen(batches):
        out = {}
        for b in (b.to_pylist()[0] for b in batches):
            counts = (np.frombuffer(b[c], np.int32).tolist() for c in ("n_a", "n_b"))
            out |= {d: x for d, *x in zip(b["doc_id"], *counts, b["digest"])}
        return out
    assert seen(whole) == seen(parts) and seen(whole)[9] == [0, 0, ""]
