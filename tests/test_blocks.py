"""Colouring in blocks of bounded size."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from tests import graphs as G
from vertexloom.model import PropertyGraph
from vertexloom.operators import coloring
from vertexloom.operators.coloring import coloring_run, hybrid_coloring, settle


def pairs(df, a, b):
    return {r[a]: r[b] for r in df.collect()}


def make(spark, n, edges):
    return PropertyGraph.of(spark.range(n), spark.createDataFrame(edges, "src long, dst long"))


@pytest.mark.parametrize("block", [1, 3, 20])
@pytest.mark.parametrize("classes", [5, 70])
def test_blocks_of_any_size(spark, monkeypatch, block, classes):
    monkeypatch.setattr(coloring, "BLOCK_ROWS", block)
    monkeypatch.setattr(coloring, "CARRIED", 5)
    monkeypatch.setattr(coloring, "RANGE_ROWS", 60)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        rng = random.Random(block)
        edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(150)] + [(39, v) for v in range(39)] * 2
        assert pairs(hybrid_coloring(make(spark, 40, edges), classes), "id", "part") == G.first_fit(40, edges, classes)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_task_holds_a_block_only(monkeypatch):
    """A range of many blocks is gone through as it comes: results of early blocks are out before later rows are read."""
    monkeypatch.setattr(coloring, "BLOCK_ROWS", 1000)
    read = 0

    def batches():
        nonlocal read
        for k in range(100):
            ids = np.arange(1000) + 1000 * k
            read += 1
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(1000, pa.int64()), pa.array([[0]] * 1000, pa.list_(pa.int64())), pa.nulls(1000, pa.int32())], ["id", "lo", "used", "known"])

    out = settle(5)(batches())
    next(out)
    assert read < 5
    assert sum(b.num_rows for b in out) > 90_000


def test_later_blocks_see_earlier_ones(spark, monkeypatch):
    monkeypatch.setattr(coloring, "BLOCK_ROWS", 10)
    run = coloring_run(make(spark.newSession(), 400, [(v, v + 1) for v in range(399)]), 5)
    assert pairs(run.result, "id", "part") == {v: v % 2 + 1 for v in range(400)} and run.rounds < 8
