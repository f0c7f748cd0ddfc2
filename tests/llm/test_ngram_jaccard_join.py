from __future__ import annotations

import random

import numpy as np

from vertexloom.llm import ngram_jaccard_join as J
from vertexloom.llm.common import words_of


def shingles(text):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_components_against_all_pairs(docs, corpus):
    assert result(J.jaccard_components(docs)) == brute(corpus)


def test_small_sets_take_the_light_path(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("abcdef", k=rng.randrange(5, 12)))) for i in range(60)]
    rows += [(100 + i, " ".join(["k%d" % j for j in range(12 + i % 3)])) for i in range(6)]
    monkeypatch.setattr(J, "choose_boundary", lambda histogram, scan: 8)
    assert result(J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_prefixes_meet():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(3, 60)
        x = set(rng.sample(range(1000), n))
        y = set(x)
        for _ in range(rng.randrange(0, n // 4 + 1)):
            y.discard(rng.choice(sorted(y)))
        if 4 * len(x & y) < 3 * len(x | y):
            continue
        for k in (1, 2):
            if len(y) >= 3:
                assert len(set(sorted(x)[: J.prefix(len(x), k)]) & set(sorted(y)[: J.prefix(len(y), k)])) >= k


def test_bitmap_distance_never_exceeds_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(100):
        x = rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.int64).astype(np.uint64)
        y = np.concatenate([x[: len(x) // 2], rng.integers(0, 2**63, rng.integers(0, 900), dtype=np.int64).astype(np.uint64)])
        assert J.distance(J.bitmap(x), J.bitmap(y)) <= len(set(x.tolist()) ^ set(y.tolist()))


def test_boundary_follows_cost():
    assert J.choose_boundary({4: 1000}, 50.0) > 4
    assert J.choose_boundary({200: 1000}, 0.5) <= 200


def test_empty_and_repeated_rows(spark, empty_docs):
    assert J.jaccard_components(empty_docs).count() == 0
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e f g h i j")]
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as key")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"]) == [(1, 1), (1, 1), (2, 1)] and len(got) == 4
    kept = J.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "None"]


def test_rows_with_equal_ids_are_documents_of_their_own(spark):
    a = " ".join(f"w{i}" for i in range(30))
    other = " ".join(f"o{i}" for i in range(30))
    rows = [(3, a), (5, a + " tail"), (5, other), (None, a), (6, None), (6, ""), (7, "x"), (7, "x"), (8, other + " tail"), (5, None), (9, "X")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as sig1", "3 as row", "4 as many")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in J.jaccard_components(df).collect())
    assert got == sorted([("3", 26, "3"), ("5", 27, "3"), ("5", 26, "5"), ("None", 26, "None"), ("6", 0, "6"), ("6", 0, "6"), ("7", 1, "7"), ("7", 1, "7"), ("8", 27, "5"), ("5", 0, "5"), ("9", 1, "7")])
    kept = sorted((str(r["doc_id"]), str(r["text"])) for r in J.keep_one(df).collect())
    assert kept == sorted([("3", a), ("5", other), ("None", a), ("6", "None"), ("6", ""), ("7", "x"), ("5", "None")])
    assert J.keep_one(df).columns == df.columns


def test_signatures_and_sets_of_slices(corpus):
    """Sets made of many texts at once equal those made text by text."""
    raw = [(t or "").encode() for _, t in corpus]
    words = words_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(x) for x in raw]), lower=True)
    flat, n = J.shingle_sets(words)
    parts = np.split(flat, np.cumsum(n)[:-1])
    for (_, t), part in zip(corpus, parts, strict=True):
        assert len(part) == len(shingles(t)) and (np.diff(part.astype(object)) > 0).all()
        alone, _ = J.shingle_sets(words_of(np.frombuffer((t or "").encode(), np.uint8), np.array([len((t or "").encode())]), lower=True))
        assert (alone == part).all()
