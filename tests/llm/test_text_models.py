"""BPE, personal data, language, toxicity: beside other code, and accuracy on held-out rows."""

import base64
import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from llm_helpers import TABLES, by_id, documents

from adhere.llm import bpe, langid, pii, toxicity
from adhere.llm.common import table


@pytest.fixture(scope="module")
def reference_encoding():
    import public_tokenizers
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(
        bytes.split, open(public_tokenizers.path(bpe.RANKS), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


def odd_texts():
    rng = random.Random(1)
    return ["", "a", "  hello world's  \n\n", "aaaa" * 50, "🙂漢字" * 7, "<|endoftext|> x", "a" * 20_000,
            " " * 9_000 + "x", "".join(rng.choice("abcdefthe") for _ in range(9_000)),
            *("".join(rng.choice("abcdeßéthinger  \n.,0 1'sñ漢🙂") for _ in range(rng.randint(1, 60)))
              for _ in range(500))]


def test_bpe_as_the_public_library(reference_encoding):
    encoder = bpe.encoder(*bpe._public(bpe.RANKS))
    texts = odd_texts()
    for text, steps in zip(texts, encoder.encode_many(texts), strict=True):
        ids = [i for step in steps for i in step]
        assert ids == reference_encoding.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


def test_long_pieces_beside_each_other(reference_encoding):
    # Several of them in one batch cost no more than one after the other.
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefthe") for _ in range(40_000)) for _ in range(3)] + ["a" * 5000, "b" * 4097]
    start = time.perf_counter()
    got = [[i for step in steps for i in step] for steps in bpe.encoder(*bpe._public(bpe.RANKS)).encode_many(texts)]
    assert time.perf_counter() - start < 20
    assert got == [reference_encoding.encode_ordinary(t) for t in texts]


def test_cache_is_bounded_and_dropped(monkeypatch, reference_encoding):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 10_000)
    monkeypatch.setattr(bpe, "GROUP_CHARS", 100)
    encoder = bpe.Encoder(open(bpe._public(bpe.RANKS)[0], "rb"), bpe._public(bpe.RANKS)[1])
    texts = [" ".join(f"word{i}x{j}" for j in range(9)) for i in range(200)]
    sizes = []
    for text, steps in zip(texts, encoder.encode_many(texts), strict=True):
        assert [i for s in steps for i in s] == reference_encoding.encode_ordinary(text)
        sizes.append(encoder.cached)
    assert max(sizes) < 30_000
    encoder.forget()
    assert not encoder.cache and not encoder.cached


def test_bpe_query(spark, reference_encoding):
    rows = [(i, t) for i, t in enumerate(odd_texts()[:40])] + [(None, "null id"), (99, None)]
    got = by_id(bpe.encode_texts(documents(spark, rows), keep_ids=True))
    for i, text in rows:
        ids = reference_encoding.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids) and got[i].ids == ids
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode_texts(documents(spark, [])).count() == 0


BASE = {  # fixed values: the patterns asked for
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "ip" and any(int(x) > 255 for x in m.group().split("."))
                    or kind == "card" and not (16 <= len(digits) <= 19 and pii._luhn(digits))
                    or kind == "phone" and not 8 <= len(digits) <= 15):
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_plain_spans_as_the_patterns():
    rng = random.Random(2)
    parts = ["a", "B", "@", ".", "1", "25", "6", "+", " ", "-", "(", ")", "x.y", "@b.c", "255",
             "4111111111111111", "é", "_"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.plain_spans(text) == brute_spans(text)


@pytest.mark.parametrize("text, kind, span", [
    ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
    ("bob (AT) mail.example.com", "email", "bob (AT) mail.example.com"),
    ("john at example dot com", "email", "john at example dot com"),
    ("jοhn＠exаmple．com", "email", "jοhn＠exаmple．com"),
    ("j​ohn@ex​ample.com", "email", "j​ohn@ex​ample.com"),
    ("ring plus one nine eight eight five five five two four eight five ok", "phone",
     "plus one nine eight eight five five five two four eight five"),
    ("call +4９ 30 1234５678", "phone", "+4９ 30 1234５678"),
    ("at 10 dot 0 dot 0 dot 1", "ip", "10 dot 0 dot 0 dot 1"),
    ("four one" + " one" * 14, "card", "four one" + " one" * 14),
    ("fon +1 nine eight eight 555 two four eight five.", "phone",
     "+1 nine eight eight 555 two four eight five"),
    ("plus 4 nine three oh, one two 3 4 five", "phone", "plus 4 nine three oh, one two 3 4 five"),
    ("mas +cuatro nueve uno dos tres cuatro cinco seis", "phone",
     "+cuatro nueve uno dos tres cuatro cinco seis"),
    ("host one nine two dot one six eight dot zero dot one", "ip",
     "one nine two dot one six eight dot zero dot one"),
    ("𝐣𝐨𝐞@example.com", "email", "𝐣𝐨𝐞@example.com"),
    ("ann&#64;example&#46;org", "email", "ann&#64;example&#46;org"),
    ("ann.lee at example.org", "email", "ann.lee at example.org"),
    ("ann_at_example_dot_org", "email", "ann_at_example_dot_org"),
])
def test_disguises_map_back(text, kind, span):
    found = pii.disguised_spans(text, pii.plain_spans(text))
    assert [(k, text[a:b]) for k, a, b in found] == [(kind, span)]


@pytest.mark.parametrize("text", [
    "n" * 70 + " at host dot org", "n" * 3000 + " at " + "h" * 90 + " dot org", "ann at " + "a dot " * 12 + "org",
    "ann.lee at " + "h" * 90 + ".org", "n" * 70 + "_at_" + "h" * 70 + "_dot_org", "ann_at_" + "a_dot_" * 12 + "org",
    "n" * 70 + ".x at " + "a." * 12 + "org", "ann at host dot " + "o" * 80])
def test_no_part_of_a_disguised_address_is_too_long(text):
    found = pii.disguised_spans(f"see {text} now", pii.plain_spans(text))
    assert [(k, a, b) for k, a, b in found] == [("email", 4, 4 + len(text))]


def test_long_runs_cost_no_squares():
    for text in ("a." * 200_000, "a" * 400_000 + " at ", "a at " * 80_000, "a_at_b_dot_" * 40_000, "x dot " * 80_000,
                 "1 " * 200_000, "one two " * 50_000):
        start = time.perf_counter()
        pii.disguised_spans(text, [])
        assert time.perf_counter() - start < 10, text[:12]


def test_plain_text_has_no_disguise(spark):
    rows = table(spark, TABLES, "documents").where("text IS NOT NULL").select("text").collect()
    assert not any(pii.disguised_spans(r.text, pii.plain_spans(r.text)) for r in rows)
    for text in ("one or two of them", "we met at noon. at five", "look at this dot", "a @ b",
                 "meet me at example.com", "1, 2, 3, 4, 5, 6, 7, 8", "one two three 4 5 6 7 8",
                 "un un un un un un un un", "x_at_y", "AT&T; 5&6"):
        assert pii.disguised_spans(text, []) == []


def test_pii_rows(spark):
    text = "a@b.co 1.2.3.4 +1 (988) 555-2485 " + "x" * 100_000 + " c (at) d.org"
    got = by_id(pii.find(documents(spark, [(1, text), (1, text), (2, None), (None, "")])))
    base = "email:0:6,ip:7:14,phone:15:32"
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 0, 1)
    assert got[1].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert got[1].n_disguised == 1 and got[1].spans.startswith("email:0:6,email:100034:")
    assert got[2].spans == got[None].spans == "" and pii.find(documents(spark, [])).count() == 0


def brute_grams(text):
    count = Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        word = f" {word} "
        for n in (1, 2, 3):
            for i in range(len(word) - n + 1):
                if word[i:i + n] != " ":
                    packed = 0
                    for c in word[i:i + n]:
                        packed = packed << langid.BITS | ord(c)
                    count[packed] += 1
    return count


@pytest.mark.parametrize("step", [1 << 20, 40])
def test_ngram_counts(monkeypatch, step):
    monkeypatch.setattr(langid, "STEP_CHARS", step)
    rng = random.Random(3)
    texts = ["".join(rng.choice("abÉ ñ .12\nz漢  ") for _ in range(rng.choice([0, 1, 3, 10, 90])))
             for _ in range(100)]
    got = {}
    for text, gram, n in langid.count_grams(texts):
        for t, g, k in zip(text.tolist(), gram.tolist(), n.tolist()):
            got.setdefault(t, Counter())[g] = k
    assert [got.get(i, Counter()) for i in range(100)] == [brute_grams(t) for t in texts]


def test_language_of_held_out_documents(spark):
    docs = table(spark, TABLES.replace("0.001", "0.01"), "documents")
    got = langid.op5_language_id(spark, TABLES.replace("0.001", "0.01")).join(
        docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 150 and sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_prediction_as_the_formulas(spark):
    # Plain Python of rank-order profiles: places by falling count, ties by the n-gram; smallest sum of displacements.
    rng = random.Random(12)
    alphabet = {"en": "abcde  ", "de": "abxyz  ", "fr": "aeiou  "}
    rows = [(i, "".join(rng.choice(alphabet[lang]) for _ in range(60)), lang)
            for i, lang in enumerate(list(alphabet) * 12)] + [(900, "xy ab", None), (901, "aa", None), (902, "", "en")]
    size = 30
    docs = documents(spark, rows)
    profiles = langid.learn_profiles(docs, size)
    got = by_id(langid.identify(docs, profiles, size))

    def places(count):
        return {g: k for k, (g, _) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0]))[:size])}

    known = {lang: places(sum((brute_grams(t) for _, t, y in rows if y == lang), Counter())) for lang in sorted(alphabet)}
    for i, text, _ in rows:
        own = places(brute_grams(text))
        away = {lang: sum(min(abs(k - p.get(g, k + size)), size) for g, k in own.items()) for lang, p in known.items()}
        best = min(known, key=lambda lang: (away[lang], lang))
        want = (best, 1 - away[best] / (len(own) * size)) if own else ("und", 0.0)
        assert got[i].lang_pred == want[0] and abs(got[i].score - want[1]) < 1e-12


def test_language_edge_cases(spark):
    rows = [(1, "the house and the garden", "en"), (2, "das Haus und der Garten", "de"),
            (3, None, "en"), (4, "12 !", "de"), (None, "der Garten", None), (5, "x", None)]
    docs = documents(spark, rows)
    profiles = langid.learn_profiles(docs)
    got = by_id(langid.identify(docs, profiles))
    assert got[1].lang_pred == "en" and got[2].lang_pred == got[None].lang_pred == "de"
    assert (got[3].lang_pred, got[3].score) == (got[4].lang_pred, got[4].score) == ("und", 0.0)
    kept = langid.accepted(docs, profiles)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 2, None} and not kept.where("doc_id IN (3, 4)").count()
    none = documents(spark, [])
    assert langid.identify(docs, langid.learn_profiles(none)).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(none, profiles).count() == 0


def test_features_are_distinct_words_and_pairs():
    hasher = toxicity.Hasher(1 << 10)
    text, place = toxicity.features(["a b c", "A  b", "", "b", "a b a b"], hasher)
    of = [set(place[text == i].tolist()) for i in range(5)]
    assert [len(x) for x in of] == [6, 3, 0, 1, 6]  # a b c ab bc ac; a b ab; -; b; a b ab ba aa bb
    assert of[1] < of[0] and of[3] < of[1] and of[1] < of[4]


def test_long_text_has_the_same_features(monkeypatch):
    # Every word is another one, so a pair lost between two steps would be missed.
    texts = [" ".join(f"w{i}" for i in range(3000)), "x" * 9000 + " b " + "y" * 9000 + "  c", " " * 20_000 + "d e",
             "f" * 5000, ". " * 5000, "é" * 4000 + "-g-h"]
    whole = toxicity.features(texts, toxicity.Hasher(1 << 10))
    monkeypatch.setattr(toxicity, "STEP_BYTES", 1 << 8)
    parts = toxicity.features(texts, toxicity.Hasher(1 << 10))
    assert len(whole[0]) > 8900 and all((a == b).all() for a, b in zip(whole, parts, strict=True))


def brute_ftrl(rows, rounds):
    """The same formulas a document at a time with dictionaries: scores of (doc_id, text, label)."""
    from zlib import crc32
    learn = sorted((i, t, y) for i, t, y in rows if y is not None and crc32(str(i).encode()) % 5)
    shard_of = {r.id: r.s for r in SHARD_NUMBERS(tuple(i for i, _, _ in learn))}
    places = {i: sorted(set(toxicity.features([t], toxicity.Hasher(64))[1].tolist())) for i, t, _ in rows}
    z, n = Counter(), Counter()

    def weight(k, z, n):
        if abs(z[k]) <= toxicity.L1:
            return 0.0
        return -(z[k] - math.copysign(toxicity.L1, z[k])) / (
            (toxicity.BETA + math.sqrt(n[k])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(rounds):
        moved = []
        for shard in sorted(set(shard_of.values())):
            z1, n1 = Counter(z), Counter(n)
            for i, _, y in learn:
                if shard_of[i] == shard:
                    own = [*places[i], "bias"]
                    w = {k: weight(k, z1, n1) for k in own}
                    g = (1 / (1 + math.exp(-sum(w.values()))) - y) * (toxicity.POSITIVE_WEIGHT if y else 1)
                    for k in own:
                        step = (math.sqrt(n1[k] + g * g) - math.sqrt(n1[k])) / toxicity.ALPHA
                        z1[k] += g - step * w[k]
                        n1[k] += g * g
            moved.append((z1, n1))
        keys = {k for m in moved for k in m[0]}
        z, n = (Counter({k: sum(m[side][k] for m in moved) / len(moved) for k in keys}) for side in (0, 1))
    return {i: 1 / (1 + math.exp(-sum(weight(k, z, n) for k in [*places[i], "bias"]))) for i, _, _ in rows}


def test_toxicity_scores_as_the_formulas(spark):
    global SHARD_NUMBERS
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(12)) + " vile" * (i % 4 == 0), int(i % 4 == 0))
            for i in range(160)] + [(500, "a b vile", None), (501, "", None)]
    SHARD_NUMBERS = lambda ids: spark.createDataFrame([(i,) for i in ids], "id long").selectExpr(
        "id", f"pmod(xxhash64(13, id), {toxicity.SHARDS}) AS s").collect()
    docs = documents(spark, [(i, t) for i, t, _ in rows])
    marked = spark.createDataFrame([(i, y) for i, _, y in rows if y is not None], "doc_id long, toxic int")
    got = by_id(toxicity.score(docs, toxicity.fit(toxicity.pack_shards(
        toxicity.training_rows(docs, marked)), rounds=3)))
    want = brute_ftrl(rows, 3)
    assert len(got) == len(want) and want[500] > 0.5 > want[501]
    assert all(abs(got[i].score - s) < 1e-4 for i, s in want.items())


def test_toxicity_learns(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(1500):
        bad = i % 6 == 0
        text = [rng.choice(words) for _ in range(40)] + ["vileword"] * bad
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    docs = documents(spark, [*rows, (9000, None), (9001, ""), (None, "vileword here")])
    marked = spark.createDataFrame([*labels, (9000, 1), (None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.pack_shards(toxicity.training_rows(docs, marked)))
    got = by_id(toxicity.score(docs, model))
    assert len(got) == 1503 and got[9000].score == got[9001].score < 0.5
    wrong = [i for i, bad in labels if (got[i].score >= 0.5) != bool(bad)]
    assert len(wrong) < 15 and got[None].score >= 0.5
    assert len(model[0]) < 5000


def test_toxicity_without_labels(spark):
    docs = documents(spark, [(1, "a")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.pack_shards(toxicity.training_rows(docs, none)), rounds=1)
    assert [r.score for r in toxicity.score(docs, model).collect()] == [0.5]


def test_pair_table():
    left, right = np.array([1, 2, 3, 1]), np.array([2, 3, 4, 3])
    pairs = bpe.PairTable(left, right, np.array([10, 11, 12, 13]))
    assert pairs.ranks(left, right).tolist() == [10, 11, 12, 13]
    assert (pairs.ranks(np.array([[4, -1]]), np.array([[1, 2]])) == bpe.NO_RANK).all()


FILLER = "Ordinary words of a long page, with nothing private. " * 200
FAR_WORDS = "The point is a dot on the map, one of two @ home. "


@pytest.mark.parametrize("far", ["", FAR_WORDS])
@pytest.mark.parametrize("kind, span", [
    ("email", "ann.lee at\nexample.org"), ("email", "ann.lee at  example.org"),
    ("email", "ann.lee\tat\texample.org"), ("email", "xavier\n@\nhost.org"),
    ("email", "john at example dot com"), ("phone", "+1 555 one two 34567"),
    ("phone", "plus 49 30 12 four 5678"), ("card", "4111 1111 1111 111 one"),
    ("card", "4111 one 111 1111 1111"), ("ip", "192.168.one.10"), ("ip", "192 dot 168 dot one dot 10")])
def test_disguises_in_long_texts(far, kind, span):
    text = f"{far}{FILLER}see ({span}) there. {FILLER}{far}"
    found = pii.disguised_spans(text, pii.plain_spans(text))
    assert [(k, text[a:b]) for k, a, b in found] == [(kind, span)]


@pytest.mark.parametrize("far", ["", FAR_WORDS])
@pytest.mark.parametrize("clean", [
    "meet me at example.com", "one 555 two 34567", "4111 1111 1111 112 one", "look at\nexample.com"])
def test_clean_words_in_long_texts(far, clean):
    text = f"{far}{FILLER}{clean} today. {FILLER}{far}"
    assert pii.disguised_spans(text, pii.plain_spans(text)) == []
