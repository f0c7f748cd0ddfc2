"""Directed minimum reachability against a sequential version."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tests import graphs as G
from tests.test_graph_operators import make, pairs
from vertexloom import PropertyGraph
from vertexloom.operators.reach import least_reached, min_reachable_label, min_reachable_run


def reached(n, edges):
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[a] = min(label[a], label[b])
    return dict(enumerate(label))


def shapes():
    r = random.Random(5)
    n = 60
    order = r.sample(range(n), n)
    path = list(zip(order, order[1:], strict=False))
    circle = [*path[:20], (order[20], order[0])]
    return {
        "path": path,
        "circle": circle + [(order[30 + i], order[i]) for i in range(20)] + [(order[55], order[54])],
        "tree": [(i, r.randrange(n)) for i in range(n)],
        "two targets": [(i, x) for i in range(n) for x in r.sample(range(n), 2 if i % 3 else 1)],
        "dense": G.random_graph(4, n, 300)[1],
        "chains of a kernel": path[:40] + [(order[i], order[j]) for i, j in ((3, 30), (3, 12), (39, 3), (39, 45), (45, 46), (45, 47))],
        "nothing": [(3, 3)],
    }


@pytest.mark.parametrize("name", shapes())
@pytest.mark.parametrize("one_task", [0, 15, 10**6])
def test_labels(spark, name, one_task):
    e = shapes()[name]
    run = min_reachable_run(make(spark, 60, e), one_task=one_task)
    assert run.converged and pairs(run.result, "id", "label") == reached(60, e)


def test_a_long_path_takes_few_rounds(spark):
    n = 10_000
    g = PropertyGraph.of(spark.range(n), spark.range(n - 1).selectExpr("id + 1 as src", "id as dst"))
    run = min_reachable_run(g, one_task=0)
    assert run.rounds < 40 and run.result.where("label != 0").count() == 0 and run.result.count() == n
    assert min_reachable_label(g).where("label != 0").isEmpty()


def test_one_task():
    r = np.random.default_rng(2)
    src, dst = r.integers(0, 80, 150), r.integers(0, 80, 150)
    assert dict(enumerate(least_reached(src, dst, np.arange(80)).tolist())) == reached(80, list(zip(src.tolist(), dst.tolist(), strict=True)))
