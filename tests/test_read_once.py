"""What a graph's edges are made from is worked out once, by any layout."""

from __future__ import annotations

import pytest

from vertexloom.model import PropertyGraph
from vertexloom.streaming.slices import in_memory, out_of_core


@pytest.mark.parametrize("layout", [in_memory, out_of_core])
def test_edges_are_made_once(spark, layout):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    edges = spark.range(50).selectExpr("id as src", "(id + 1) % 50 as dst").mapInArrow(count, "src long, dst long")
    g = layout(PropertyGraph.of(spark.range(50), edges))
    assert g.edges.count() == 50 and g.edges.where("src = 3").count() == 1
    assert made.value == 50


def test_a_refused_graph_leaves_nothing(spark):
    with pytest.raises(ValueError):
        out_of_core(PropertyGraph.of(spark.range(2), spark.range(1).selectExpr("id as src", "7 as dst")))


def test_pairs_are_made_once(spark):
    from vertexloom.fixtures import cust_supp

    g = cust_supp(spark, "/root/testdata/sf0.001")
    assert all("lineitem" not in df._jdf.queryExecution().optimizedPlan().toString() and all("lineitem" not in f for f in df.inputFiles()) for df in (g.vertices, g.edges))
