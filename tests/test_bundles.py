"""Ranks read edges as lists of targets, a row a source, and lose none of them."""

from __future__ import annotations

import random
from collections import Counter

from tests.test_blocks import make
from vertexloom.operators import pagerank, transforms


def test_a_row_a_source(spark, monkeypatch):
    monkeypatch.setattr(transforms, "MOST_BUNDLED", 50)
    rng = random.Random(3)
    edges = [(7, rng.randrange(30)) for _ in range(120)] + [(rng.randrange(30), rng.randrange(30)) for _ in range(60)]
    rows = transforms.bundled(make(spark, 30, edges).edges).df.collect()
    assert Counter((r.src, d) for r in rows for d in r.dsts) == Counter(edges)
    assert max(len(r.dsts) for r in rows) <= 50 and Counter(r.src for r in rows)[7] >= 3
    assert all(n == 1 for s, n in Counter(r.src for r in rows).items() if s != 7)


def test_turns_join_lists(spark, monkeypatch):
    seen, staged = [], pagerank.Staged

    class Watched(staged):
        def _write(self, rows, by):
            seen.append(rows._jdf.queryExecution().executedPlan().toString())
            super()._write(rows, by)

    monkeypatch.setattr(pagerank, "Staged", Watched)
    pagerank.pagerank(make(spark, 30, [(v, (v * 7 + 1) % 30) for v in range(30)]), "async", max_rounds=1)
    turns = [p for p in seen if "staged_" in p]
    assert turns and all("dsts" in p for p in turns)
