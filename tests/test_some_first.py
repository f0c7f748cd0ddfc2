"""Components over many edges a vertex: some edges are contracted first, and of all edges only those between different roots."""

from __future__ import annotations

import random

import pytest

from tests.test_blocks import make, pairs
from vertexloom.operators import components


def least(n, edges):
    root = list(range(n))
    for _ in range(n):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return dict(enumerate(root))


@pytest.mark.parametrize("one_task", [0, 500])
def test_some_edges_first(spark, monkeypatch, one_task):
    given, contract = [], components.contract

    def watched(edges, *args, **options):
        given.append(edges.count())
        return contract(edges, *args, **options)

    monkeypatch.setattr(components, "contract", watched)
    rng = random.Random(one_task)
    # thirds of the ids with few ways between them, of which neither end is a source's smallest or largest target; vertex 119 is alone
    edges = [(a + 40 * k, b + 40 * k) for k in range(3) for a, b in ((rng.randrange(39), rng.randrange(39)) for _ in range(400))]
    edges += [(50, 45), (50, 90), (50, 79), (50, 118), (10, 10), (39, 5), (79, 60)]
    run = components.components_run(make(spark, 120, edges), one_task=one_task)
    assert run.converged and pairs(run.result, "id", "root") == least(120, edges)
    assert len(run.counts) == run.rounds and len(run.seconds) >= run.rounds
    assert len(given) == 2 and sum(given) < len(edges) / 2
