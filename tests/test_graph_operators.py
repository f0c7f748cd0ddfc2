from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests import graphs as G
from vertexloom import PropertyGraph
from vertexloom.functions.report import bfs_histogram, bfs_summary, cc_count, cc_report
from vertexloom.functions.verify import verify_exact, verify_tolerance
from vertexloom.operators import coloring
from vertexloom.operators.coloring import clashes, coloring_run, hybrid_coloring
from vertexloom.operators.components import components_run, connected_components
from vertexloom.operators.levels import all_levels, bfs, bfs_run
from vertexloom.operators.pagerank import pagerank, pagerank_run
from vertexloom.operators.paths import all_distances, sssp
from vertexloom.operators.reach import min_reachable_label
from vertexloom.operators.transforms import adjacency, class_sizes, cut, degrees, expand, offsets, rebase, reverse, unit_weights
from vertexloom.plans import lineage
from vertexloom.streaming.slices import in_memory, out_of_core


def make(spark, n, edges):
    rows = [tuple(e) if len(e) == 3 else (*e, 1) for e in edges]
    return PropertyGraph.of(spark.range(n), spark.createDataFrame(rows, "src long, dst long, weight long"))


def pairs(df, *columns):
    return {r[0]: r[1] for r in df.select(*columns).collect()}


@pytest.mark.parametrize("name", ["empty_source", "path", "loops_dups"])
def test_levels_on_toys(spark, name):
    n, e = G.TOYS[name]
    g = make(spark, n, e)
    assert pairs(bfs(g, 3), "id", "level") == G.bfs(n, e, 3)
    full = pairs(all_levels(g, bfs(g, 3)), "id", "level")
    assert full == {v: G.bfs(n, e, 3).get(v, 0) for v in range(n)}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs_against_sequential_versions(spark, seed):
    n, e = G.random_graph(seed)
    w = [(a, b, 1 + (a * 7 + b * 13) % 10) for a, b in e]
    g = make(spark, n, w)
    levels = bfs(g, 3)
    assert pairs(levels, "id", "level") == G.bfs(n, e, 3)
    assert pairs(connected_components(g), "id", "root") == G.components(n, e)
    assert pairs(connected_components(reverse(g)), "id", "root") == G.components(n, e)
    dist, pred = G.shortest(n, w, 3)
    paths = sssp(g, 3)
    assert pairs(paths, "id", "dist") == dist
    assert pairs(paths.where("pred is not null"), "id", "pred") == pred
    unit = pairs(sssp(unit_weights(g), 3), "id", "dist")
    assert unit == {v: k - 1 for v, k in G.bfs(n, e, 3).items()}
    for p in (1, 3, 5):
        c = hybrid_coloring(g, p)
        assert pairs(c, "id", "part") == G.first_fit(n, e, p)
        assert clashes(g, c, p).isEmpty()


def test_reach_label_differs_from_weak_components(spark):
    n, e = G.TOYS["directed_v"]
    g = make(spark, n, e)
    assert pairs(min_reachable_label(g), "id", "label") == {0: 0, 1: 1, 2: 2, 3: 3}
    assert pairs(connected_components(g), "id", "root") == {0: 0, 1: 0, 2: 0, 3: 3}


def test_overflow_class_and_stats(spark):
    n, e = G.TOYS["clique6"]
    g = make(spark, n, e)
    c = hybrid_coloring(g, 5)
    assert pairs(c, "id", "part") == {0: 1, 1: 2, 2: 3, 3: 4, 4: 5, 5: 5}
    sizes = {r["part"]: (r["n_vertices"], r["n_edges"]) for r in class_sizes(g, c).collect()}
    assert sizes == {1: (1, 5), 2: (1, 4), 3: (1, 3), 4: (1, 2), 5: (2, 1)}
    assert cut(g, c).where("part = 1").count() == 5
    with pytest.raises(ValueError):
        hybrid_coloring(g, 0)


def test_class_sizes_count_sources_only(spark):
    """Each edge is counted once, by its source; isolated vertices and classes without edges have sizes too."""
    g = make(spark, *G.TOYS["loops_dups"])
    c = spark.createDataFrame([(0, 1), (1, 2), (2, 2), (3, 3)], "id long, part int")
    got = class_sizes(g, c)
    assert {tuple(r) for r in got.collect()} == {(1, 1, 1), (2, 2, 0), (3, 1, 3)}
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_rank_modes(spark):
    n, e = G.random_graph(5)
    g = make(spark, n, e)
    for mode, rounds, first in (("sync", 10, 0.15), ("sequential", 9, 0.0)):
        got, want = pairs(pagerank(g, mode), "id", "rank"), G.jacobi(n, e, rounds, 0.005, first)
        assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in want)
        assert min(got.values()) >= 0.15 - 1e-12
    with pytest.raises(ValueError):
        pagerank(g, "other")


def test_async_rank_freezes_where_the_colour_order_says(spark):
    n, e = G.FREEZE
    g = make(spark, n, e)
    part = G.first_fit(n, e, 5)
    want, rounds = G.in_place(n, e, 20, 0.005, part, 5)
    run = pagerank_run(g, "async")
    got = pairs(run.result, "id", "rank")
    assert all(abs(got[v] - want[v]) < 1e-9 for v in want)
    assert run.rounds == rounds == 4 and abs(got[0] - 0.1658) < 5e-5


def test_async_rank_with_a_last_class_of_neighbours(spark):
    n, e = G.random_graph(11, 25, 220)
    part = G.first_fit(n, e, 3)
    assert sum(p == 3 for p in part.values()) > 5
    want, rounds = G.in_place(n, e, 20, 0.005, part, 3)
    run = pagerank_run(make(spark, n, e), "async", classes=3)
    got = pairs(run.result, "id", "rank")
    assert run.rounds == rounds and all(abs(got[v] - want[v]) < 1e-9 for v in want)


def test_async_rank_keeps_one_table_a_class(spark, monkeypatch):
    n, e = G.random_graph(3)
    kept = []
    monkeypatch.setattr(lineage.Staged, "drop", lambda self: kept.append(self.path))
    run = pagerank_run(make(spark, n, e), "async", classes=4)
    # every table of a class but the last one is dropped
    assert run.rounds > 2 and len(kept) == len(set(kept)) >= (run.rounds - 1) * 2


def test_long_paths_are_coloured_in_few_rounds(spark):
    n = 10_000
    g = PropertyGraph.of(spark.range(n), spark.range(n - 1).selectExpr("id as src", "id + 1 as dst"))
    run = coloring_run(g, 5)
    assert run.rounds < 10 and run.converged
    assert run.result.where("part != id % 2 + 1").count() == 0 and run.result.count() == n


@pytest.mark.parametrize("seed", [1, 2])
def test_colours_across_ranges(spark, seed, monkeypatch):
    """Ranges of a few ids: chains cross many borders, and tables are merged on the way."""
    monkeypatch.setattr(coloring, "MERGE", 2)
    n, e = G.random_graph(seed, 80, 260)
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        run = coloring_run(make(spark, n, e), 4)
        assert pairs(run.result, "id", "part") == G.first_fit(n, e, 4) and run.rounds > 3
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_components_tell_whether_they_are_done(spark):
    n = 60
    g = make(spark, n, [(i, i + 1) for i in range(n - 1)])
    assert components_run(g).converged and components_run(g, one_task=0).converged
    run = components_run(g, max_rounds=1, one_task=0)
    short = run.result
    assert not run.converged and short.count() == n and short.where("root > id").count() == 0


def test_hubs_may_stay_spread(spark):
    n, e = G.TOYS["star_out"]
    g = make(spark, n, e)
    assert pairs(bfs(in_memory(g, hub_rows=7), 0), "id", "level") == pairs(bfs(in_memory(g), 0), "id", "level")


def test_weights(spark):
    n, e = G.DETOUR
    g = make(spark, n, e)
    assert pairs(all_distances(g, sssp(g, 3)), "id", "dist") == {0: 6, 1: 2, 2: 4, 3: 0, 4: 1}
    with pytest.raises(ValueError):
        sssp(make(spark, 4, [(3, 0, 0)]), 3)
    with pytest.raises(ValueError):
        bfs(g, 99)


def test_structure(spark):
    n, e = G.TOYS["loops_dups"]
    g = make(spark, n, e)
    assert sorted(map(tuple, reverse(reverse(g)).edges.select("src", "dst").collect())) == sorted(e)
    assert {r["id"]: (r["in_degree"], r["out_degree"]) for r in degrees(g).collect()} == {0: (2, 1), 1: (1, 0), 2: (0, 0), 3: (1, 3)}
    lists = adjacency(g)
    assert sorted(map(tuple, expand(lists).collect())) == sorted(e)
    assert sorted(map(tuple, expand(lists).collect())) == sorted(e)  # expanding leaves the lists as they were
    assert {r["id"]: (r["begin"], r["out_degree"]) for r in offsets(g).collect()} == {0: (0, 1), 1: (1, 0), 2: (1, 0), 3: (1, 3)}
    assert sorted(map(tuple, rebase(g, 1).edges.select("src", "dst").collect())) == sorted((a + 1, b + 1) for a, b in e)
    g.validate()
    with pytest.raises(ValueError):
        make(spark, 2, [(0, 5)]).validate()


def test_reports_and_comparisons(spark):
    n, e = G.TOYS["two_triangles"]
    g = make(spark, n, e)
    levels = bfs(g, 3)
    assert sorted(map(tuple, bfs_histogram(levels).collect())) == [(1, 1), (2, 1), (3, 1)]
    assert tuple(bfs_summary(levels, 3).first()) == (3, 3, 3)
    roots = connected_components(g)
    assert [tuple(r) for r in cc_report(roots).orderBy("idx").collect()] == [(0, 0, 3), (1, 3, 3), (2, 6, 1)]
    assert cc_count(roots).first()[0] == 3
    other = roots.withColumn("root", F.when(F.col("id") == 6, 5).otherwise(F.col("root")))
    assert verify_exact(roots, other, "root").first()[0] == 1
    rank = spark.createDataFrame([(0, 1.0), (1, 2.0)], "id long, rank double")
    bad = spark.createDataFrame([(0, 1.004), (1, float("nan"))], "id long, rank double")
    assert verify_tolerance(rank, bad).first()[0] == 1


def test_out_of_core_gives_the_same(spark):
    n, e = G.random_graph(7)
    g = make(spark, n, e)
    stored = out_of_core(g, slice_rows=10)
    assert verify_exact(bfs(in_memory(g), 3), bfs(stored, 3), "level").first()[0] == 0
    assert verify_exact(connected_components(g), connected_components(stored), "root").first()[0] == 0
    with pytest.raises(ValueError):
        out_of_core(g, 0)


def test_round_limit(spark):
    n, e = G.TOYS["path"]
    g = make(spark, n, e)
    run = bfs_run(g, 3, max_rounds=1)
    assert pairs(run.result, "id", "level") == {3: 1, 2: 2} and not run.converged


def test_graph_without_edges(spark):
    g = PropertyGraph.of(spark.range(4), spark.createDataFrame([], "src long, dst long"))
    assert pairs(connected_components(g), "id", "root") == {v: v for v in range(4)}
    assert pairs(bfs(g, 3), "id", "level") == {3: 1}
    assert set(pairs(hybrid_coloring(g), "id", "part").values()) == {1}
    assert set(pairs(pagerank(g), "id", "rank").values()) == {1 - 0.85}
