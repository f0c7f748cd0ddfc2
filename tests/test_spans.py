"""Edges lie sorted by source, so that a superstep reads those in the span of its frontier only."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vertexloom.model import PropertyGraph
from vertexloom.operators.levels import bfs
from vertexloom.operators.paths import sssp
from vertexloom.streaming.slices import in_memory, out_of_core


@pytest.fixture(scope="module")
def graph(spark):
    """Two rings, one of ids up to 99,999 and one behind it."""
    n = 100_000
    edges = spark.range(2 * n).select(F.col("id").alias("src"), F.when((F.col("id") + 1) % n == 0, F.col("id") + 1 - n).otherwise(F.col("id") + 1).alias("dst"), (1 + F.col("id") % 3).alias("weight"))
    return PropertyGraph.of(spark.range(2 * n), edges)


def scanned(df) -> int:
    """Rows that leave the scan of the edges."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    plan, found = [df._jdf.queryExecution().executedPlan()], []
    while plan:
        p = plan.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            plan.append(p.executedPlan())
        elif p.getClass().getSimpleName().endswith("QueryStageExec"):
            plan.append(p.plan())
        elif p.nodeName().startswith(("InMemoryTableScan", "Scan In-memory", "Scan parquet")):
            found.append(p.metrics().apply("numOutputRows").value())
        else:
            plan += [p.children().apply(i) for i in range(p.children().length())]
    return max(found)


def test_kept_edges_outside_the_span_are_skipped(spark, graph):
    kept = in_memory(graph, check=False)
    rows = spark.createDataFrame([(5,), (7,)], "src long")
    assert sorted(r.dst for r in kept.along(rows, span=(5, 7)).collect()) == [6, 8]
    assert scanned(kept.edges.where(F.col("src").between(5, 7))) <= 40_000 < scanned(kept.edges)
    joined = kept.along(rows.hint("merge"))
    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert plan.count("Sort [src") <= 1  # of the rows


@pytest.mark.parametrize("kind", [in_memory, out_of_core])
def test_spans_lose_nothing(spark, kind):
    """A frontier that runs down and up, over ids on both sides of the source."""
    way = [50, 3, 90, 1, 70, 2, 99, 0, 60]
    edges = spark.createDataFrame([(a, b, 1 + k % 4) for k, (a, b) in enumerate(zip(way, way[1:]))], "src long, dst long, weight long")
    g = kind(PropertyGraph.of(spark.range(100), edges))
    assert {r.id: r.level for r in bfs(g, 50).collect()} == {v: k + 1 for k, v in enumerate(way)}
    want, d = {50: (0, None)}, 0
    for k, (a, b) in enumerate(zip(way, way[1:])):
        want[b] = (d := d + 1 + k % 4, a)
    for delta in (None, 1, 2):
        assert {r.id: (r.dist, r.pred) for r in sssp(g, 50, delta=delta).collect()} == want
