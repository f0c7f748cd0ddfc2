"""Quality classifier, language identification and language model."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import words
from vertexloom.llm import backoff_lm as B
from vertexloom.llm import language_id as L
from vertexloom.llm import quality_classifier as Q


@pytest.fixture(scope="module")
def labelled(spark):
    rng, rows, labels = random.Random(5), [], []
    for i in range(160):
        w = words(rng, rng.randrange(20, 200))
        good = i % 4 != 0
        rows.append((i, " ".join(w) + "." if good else " ".join(x + rng.choice(["***", "%%%", "###"]) for x in w)))
        labels.append((i, int(good)))
    rows += [(500, None), (501, ""), (502, "x " * 20000)]
    labels += [(500, None)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_on_the_held_out_fold(labelled):
    docs, labels = labelled
    got = {r["doc_id"]: r for r in Q.classify(docs, labels).collect()}
    want = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [r for i, r in got.items() if r["held_out"] and i < 500]
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    assert sum(r["predicted"] == want[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert len(got) == 163 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    kept = {r["doc_id"] for r in Q.keep_good(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if r["predicted"]}


def test_quality_without_labels(labelled, empty_docs):
    docs, labels = labelled
    none = labels.where("doc_id < 0")
    assert {r["predicted"] for r in Q.classify(docs, none).collect()} == {1}
    assert Q.classify(empty_docs, labels).count() == 0


def test_density_difference_against_the_formula(labelled):
    docs, labels = labelled
    model = Q.fit(Q.document_statistics(docs), labels)
    x = np.array([Q.statistics(b"some words here, and ### more of them")])
    log = []
    for k in (0, 1):
        inv = model["inverse"][k]
        cov = np.linalg.inv(inv.T @ inv)
        d = x[0] - model["mean"][k]
        log.append(model["log_prior"][k] - 0.5 * (np.linalg.slogdet(cov)[1] + d @ np.linalg.solve(cov, d)))
    assert abs(Q.scores(x, model)[0] - 1 / (1 + math.exp(min(700, max(-700, log[0] - log[1]))))) < 1e-6


def test_scores_against_moments_taken_from_the_rows(labelled):
    docs, labels = labelled
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    x = {i: Q.statistics((t or "").encode()) for i, t in texts.items()}
    own = [(x[r["doc_id"]], r["quality"]) for r in labels.collect() if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    sides = [np.array([v for v, q in own if q == k]) for k in (0, 1)]
    covs = [np.cov(s.T, bias=True) for s in sides]
    pooled = sum(len(s) * c for s, c in zip(sides, covs, strict=True)) / len(own)
    log = {}
    for k, (s, c) in enumerate(zip(sides, covs, strict=True)):
        shrunk = (1 - Q.SHRINK_POOLED - Q.SHRINK_ROUND) * c + Q.SHRINK_POOLED * pooled + Q.SHRINK_ROUND * np.diag(np.maximum(np.diag(pooled), 1e-6)) + 1e-8 * np.eye(len(c))
        for i, v in x.items():
            d = v - s.mean(0)
            log[i, k] = math.log(len(s) / len(own)) - 0.5 * (np.linalg.slogdet(shrunk)[1] + d @ np.linalg.solve(shrunk, d))
    for r in Q.classify(docs.selectExpr("*", "1 as score", "2 as x"), labels.selectExpr("*", "'t' as text")).collect():
        i = r["doc_id"]
        assert abs(r["score"] - 1 / (1 + math.exp(min(700, max(-700, log[i, 0] - log[i, 1]))))) < 1e-6


def test_statistics_of_a_text():
    got = dict(zip(Q.NAMES, Q.statistics(b"One two two,\n### 12 longest|\n### 12 longest|"), strict=True))
    chars, words_ = 36, 9
    assert math.isclose(got["words"], math.log1p(words_)) and math.isclose(got["word_len"], math.log1p(chars / words_)) and math.isclose(got["longest"], math.log1p(8))
    shares = {"upper": 1 / chars, "digit": 4 / chars, "symbol": 6 / chars, "pipe": 2 / chars, "punct": 1 / chars, "short": 6 / words_, "lines": 3 / words_, "line_dup": 1 / 3, "distinct": 6 / words_**0.75, "triples": 1 - 6 / 7}
    assert all(math.isclose(got[k], math.sqrt(v)) for k, v in shares.items())


def test_quality_repeated_ids_null_ids_and_ties(labelled, spark):
    docs, labels = labelled
    more = spark.createDataFrame([(None, "no id at all"), (1, "another text of id 1"), (1, "another text of id 1")], "doc_id long, text string")
    got = Q.classify(docs.union(more), labels).collect()
    assert len(got) == 166 and [r["held_out"] for r in got if r["doc_id"] is None] == [False] and sum(r["doc_id"] == 1 for r in got) == 3


LANGS = {"aa": "the of and to with for is that".split(), "bb": "der die und nicht zu mit ein ist".split(), "cc": "les des une pour dans que sur est".split()}


def test_languages(spark, empty_docs):
    rng, rows = random.Random(2), []
    for i in range(240):
        g = sorted(LANGS)[i % 3]
        rows.append((i, " ".join(rng.choices(LANGS[g], k=rng.randrange(8, 60))), g if i % 5 else None))
    rows += [(900, None, "aa"), (901, "123 !!", "aa"), (902, "", None), (903, "中", "aa"), (904, "the of and " * 30000, "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score")
    got = {r["doc_id"]: r for r in L.identify(df, fit_rows=90, landmarks=30).collect()}
    right = [got[i]["lang_pred"] == sorted(LANGS)[i % 3] for i in range(240)]
    assert sum(right) >= 0.98 * len(right)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[903]["lang_pred"] != "und" and got[904]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert L.identify(empty_docs).count() == 0
    assert {r["lang_pred"] for r in L.identify(df.where("lang is null")).collect()} == {"und"}


def test_presence_kernel_counts_common_ngrams():
    texts = [b"abcab", b"bcabc", b"zzz"]
    space = L.Spectrum(texts)
    p = space.presence(texts)
    want = [[len({t[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1)} & {u[i : i + n] for n in range(1, 5) for i in range(len(u) - n + 1)}) for u in texts] for t in texts]
    assert (p @ p.T).astype(int).tolist() == want


def test_scores_against_kernel_ridge_regression_of_sets():
    rng = random.Random(17)
    texts, langs = [], []
    for k in range(36):
        lang = ("aa", "bb", "cc")[k % 3]
        texts.append(" ".join(rng.choices([*LANGS[lang], *words(rng, 3), "A", "é"], k=rng.randrange(2, 15))).encode())
        langs.append(lang)
    fit_on, asked, m = 27, texts[27:], 4
    grams_ = lambda t: {t.lower()[i : i + n] for n in (1, 2, 3, 4) for i in range(len(t) - n + 1)}
    names = sorted(set(langs))
    marks = [g for name in names for g in [grams_(t) for t, x in zip(texts[:fit_on], langs, strict=False) if x == name][:m]]
    every = set().union(*marks)
    kernel = lambda x, z: len(x & z) / math.sqrt(max(1, len(x & every)) * len(z))
    kmm = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(kmm)
    assert values.min() > 1e-5  # all landmarks count
    root = vectors @ np.diag(values**-0.5)
    features = lambda ts: np.column_stack([np.array([[kernel(grams_(t), z) for z in marks] for t in ts]) @ root, np.ones(len(ts))])
    z, y = features(texts[:fit_on]), np.array([[1.0 if g == n else -1.0 for n in names] for g in langs[:fit_on]])
    f = features(asked) @ np.linalg.solve(z.T @ z + L.RIDGE * np.eye(z.shape[1]), z.T @ y)
    model = L.fit(texts[:fit_on], langs[:fit_on], landmarks=3 * m)
    got, score = L.predict(asked, model)
    assert got == [names[i] for i in f.argmax(1)]
    e = np.exp(4 * (f - f.max(1, keepdims=True)))
    assert np.allclose(score, 1 / e.sum(1), atol=1e-3)


def test_language_ties_repeats_and_null_ids(spark):
    rows = [(i, "abc abd", "xx" if i % 2 else "ww") for i in range(40)] + [(None, "abc abd", "xx"), (3, "abc abd", None), (3, None, "ww"), (3, "1 2 3", "ww")]
    got = L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'q' as lang_pred", "1 as k", "2.0 as bound")).collect()
    assert len(got) == 44 and sum(r["lang_pred"] == "und" and r["score"] == 0 for r in got) == 2
    assert len({(r["lang_pred"], round(r["score"], 6)) for r in got if r["score"]}) == 1 and not any(r["held_out"] for r in got if r["doc_id"] is None)


def test_languages_beyond_the_64_most_frequent_are_learned(spark):
    rng = random.Random(21)
    vocabularies = [words(rng, 8) for _ in range(80)]
    rows = [(i, " ".join(rng.choices(vocabularies[i % 80], k=30)), f"l{i % 80:02d}") for i in range(800)]
    got = {r["doc_id"]: r["lang_pred"] for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fit_rows=90, landmarks=30).collect()}
    right = [got[i] == g for i, _, g in rows]
    assert len({got[i] for i in got}) == 80 and sum(right) >= 0.95 * len(right)


def test_ngrams_that_share_a_slot_are_kept(monkeypatch):
    monkeypatch.setattr(L, "SLOT_BITS", 4)
    test_presence_kernel_counts_common_ngrams()


class Automaton:
    """The backoff automaton of training texts, state by state."""

    def __init__(self, texts):
        self.arcs, self.total = {}, 0
        for t in texts:
            w = self.tokens(t)
            self.total += len(w)
            for k in (0, 1, 2):
                for at in range(k, len(w)):
                    self.arcs.setdefault(tuple(w[at - k : at]), Counter())[w[at]] += 1
        self.words = self.arcs.get((), Counter())
        self.norm = self.total + len(self.words) + 1
        self.arcs = {s: a for s, a in self.arcs.items() if len(s) < 2 or a.total() >= B.LEAST}

    @staticmethod
    def tokens(t):
        return (t or "").encode().lower().split() + [b""]

    def p(self, w, state):
        if not state:
            return (self.words[w] + 1) / self.norm
        arcs = self.arcs.get(state, Counter())
        return (arcs[w] + B.PRIOR * self.p(w, state[1:])) / (sum(arcs.values()) + B.PRIOR)

    def read(self, tokens):
        """Left to right, along arcs and failure arcs."""
        total, state = 0.0, ()
        for w in tokens:
            while state and w not in self.arcs[state]:
                total += math.log10(B.PRIOR / (sum(self.arcs[state].values()) + B.PRIOR))
                state = state[1:]
            total += math.log10(self.p(w, state))
            state = (*state, w)[-2:]
            while state and state not in self.arcs:
                state = state[1:]
        return total

    def row(self, t):
        w = self.tokens(t)
        return len(w), sum(x in self.words for x in w), self.total, sum(math.log10((self.words[x] + 1) / self.norm) for x in w), self.read(w)


def test_automaton_is_a_distribution():
    rng = random.Random(4)
    model = Automaton([" ".join(rng.choices("abcd", [4, 3, 2, 1], k=rng.randrange(5, 40))) for _ in range(80)])
    for state in ((), (b"a",), (b"b", b"d"), (b"d", b"d")):
        assert abs(sum(model.p(w, state) for w in [*model.words, b"unseen"]) - 1) < 1e-12


def check_scores(df, rows):
    model = Automaton([t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2])
    want = sorted((str(i), *model.row(t)) for i, t in rows)
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in B.score(df).collect())
    assert len(got) == len(want)
    for x, y in zip(got, want, strict=True):
        assert x[:4] == y[:4] and abs(x[4] - y[4]) < 1e-6 and abs(x[5] - y[5]) < 1e-6, (x, y)


def test_scores_of_the_corpus(docs, corpus):
    check_scores(docs.selectExpr("*", "1 as held", "2 as words", "3 as chunk"), corpus)
    assert {r["held_out"]: r["ok"] for r in B.score(docs).groupBy("held_out").agg(F.bool_and(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2).alias("ok")).collect()} == {True: True, False: False}


@pytest.mark.parametrize("chunk", [40, 1_000_000])
def test_rare_ngrams_repeated_ids_and_chunks(spark, monkeypatch, chunk):
    rng = random.Random(12)
    pool = words(rng, 60)
    rows = [(i, " ".join(rng.choices(pool, [1 / (k + 1) for k in range(60)], k=rng.randrange(1, 40)))) for i in range(150)]
    rows += [(800, "never seen Zz words"), (801, None), (None, pool[0]), (5, rows[5][1]), (5, "another text"), (802, rows[9][1]), (803, " ".join(rng.choices(pool, k=6000)))]
    monkeypatch.setattr(B, "CHUNK_TOKENS", chunk)
    check_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)


def test_language_model_without_rows(empty_docs, spark):
    assert B.score(empty_docs).count() == 0
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    only = B.score(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert {(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in only} == {(3, 0, 0, 0.0)}
