"""How supersteps run: layouts, plans, tables and rounds."""

from __future__ import annotations

import os
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import graphs as G
from tests.test_graph_operators import make, pairs
from vertexloom import PropertyGraph
from vertexloom.operators import coloring, components
from vertexloom.operators.coloring import coloring_run, hybrid_coloring
from vertexloom.operators.components import connected_components, forest
from vertexloom.operators.levels import bfs, bfs_run
from vertexloom.operators.pagerank import pagerank, pagerank_run
from vertexloom.operators.paths import sssp, sssp_run
from vertexloom.plans import known
from vertexloom.plans.journal import Journal
from vertexloom.plans.lineage import Bucketed, Staged, shared_dir, staging
from vertexloom.streaming.slices import in_memory, out_of_core


def weighted_graph(seed: int, n: int = 30, m: int = 90):
    r = random.Random(seed)
    return n, [(r.randrange(n), r.randrange(n), r.choice([1, 2, 3, 10, 40])) for _ in range(m)]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_stored_edges_stay_where_they_are(spark, no_broadcast):
    n, e = weighted_graph(1)
    stored = out_of_core(make(spark, n, e))
    rows = spark.range(5).select(F.col("id").alias("src"), (F.col("id") * 2).alias("x"))
    joined = stored.along(rows)
    said = plan(joined)
    assert "Bucketed: true" in said and said.count("Exchange hashpartitioning") == 1  # that of the rows
    assert joined.count() == sum(a < 5 for a, *_ in e)
    few = stored.along(rows, [0, 1])
    assert "SelectedBucketsCount: " in plan(few) and few.count() == sum(a < 2 for a, *_ in e)
    assert sorted(map(tuple, stored.edges.collect())) == sorted(e)


@pytest.mark.parametrize("layout", [lambda g: in_memory(g, hub_rows=4), lambda g: out_of_core(g, slice_rows=4), lambda g: out_of_core(g)])
def test_layouts_agree(spark, layout):
    """Hubs of over four edges are dealt out over several partitions or slices."""
    n, e = weighted_graph(2)
    e += [(7, i, 2) for i in range(25)]
    g = make(spark, n, e)
    laid = layout(g)
    assert pairs(bfs(laid, 3), "id", "level") == G.bfs(n, [x[:2] for x in e], 3)
    dist, pred = G.shortest(n, e, 3)
    paths = sssp(laid, 3)
    assert pairs(paths, "id", "dist") == dist and pairs(paths.where("pred is not null"), "id", "pred") == pred
    assert pairs(connected_components(laid), "id", "root") == G.components(n, [x[:2] for x in e])
    want = G.jacobi(n, [x[:2] for x in e], 10, 0.005, 0.15)
    got = pairs(pagerank(laid, "sync"), "id", "rank")
    assert all(abs(got[v] - want[v]) < 1e-9 for v in want)
    assert sorted(map(tuple, laid.edges.select("src", "dst", "weight").collect())) == sorted(e)
    if laid.hubs is not None:
        assert 7 in {r["src"] for r in laid.hubs.collect()} and laid.edges.where("src = 7").select("salt").distinct().count() > 1


def test_layouts_check_endpoints(spark):
    for bad in (make(spark, 2, [(0, 5)]), PropertyGraph.of(spark.range(3).union(spark.range(1)), make(spark, 3, [(0, 1)]).edges)):
        for layout in (in_memory, out_of_core):
            with pytest.raises(ValueError):
                layout(bad)
    assert bfs(in_memory(make(spark, 2, [(0, 1), (1, 5)]), check=False), 0).count() == 3
    g = PropertyGraph.of(spark.range(2), spark.createDataFrame([(0, None), (None, 1), (0, 1)], "src long, dst long"))
    with pytest.raises(ValueError):
        g.validate()
    assert bfs(g, 0).count() == sssp(g, 0).count() == 2


@pytest.mark.parametrize("delta", [1, 3, 15, 1000, None])
def test_delta_stepping(spark, delta):
    n, e = weighted_graph(4)
    dist, pred = G.shortest(n, e, 3)
    run = sssp_run(make(spark, n, e), 3, delta=delta)
    assert run.converged and pairs(run.result, "id", "dist") == dist
    assert pairs(run.result.where("pred is not null"), "id", "pred") == pred


def test_rounds_write_what_they_change(spark, monkeypatch):
    """A path: each round finds one vertex, and its table has one row, whatever has been found before."""
    sizes = []
    init = Staged.__init__

    def watched(self, df, name, by=None, **measures):
        init(self, df, name, by, **measures)
        if "here" in measures or name == "bfs" and measures:
            sizes.append(self.df.count())

    monkeypatch.setattr(Staged, "__init__", watched)
    g = make(spark, 12, [(i, i + 1, 3) for i in range(11)])
    assert pairs(sssp(g, 0), "id", "dist") == {i: 3 * i for i in range(12)}
    assert max(sizes) == 1
    sizes.clear()
    run = bfs_run(g, 0)
    assert run.counts == [1] * 11 + [0] and max(sizes) == 1


@pytest.mark.parametrize("base_rows", [4, 1000])
def test_known_tables_are_merged(spark, monkeypatch, base_rows):
    monkeypatch.setattr(known, "MERGE", 3)
    monkeypatch.setattr(known, "BASE_ROWS", base_rows)
    n = 24
    g = make(spark, n, [(i, i + 1, 1 + i % 3) for i in range(n - 1)] + [(0, 9, 50), (2, 20, 60)])
    with staging(spark):
        assert pairs(bfs(g, 0), "id", "level") == G.bfs(n, [x[:2] for x in [(i, i + 1) for i in range(n - 1)] + [(0, 9), (2, 20)]], 0)
        dist, _ = G.shortest(n, [tuple(r) for r in g.edges.collect()], 0)
        assert pairs(sssp(g, 0, delta=2), "id", "dist") == dist


def test_bucketed_tables_join_as_they_lie(spark, no_broadcast):
    a = Bucketed(spark.range(100).withColumn("x", F.col("id") % 7), "a", ["id"], 4)
    said = plan(a.df.join(spark.range(50), "id"))
    assert said.count("Exchange hashpartitioning") == 1 and a.df.count() == 100
    a.drop()
    assert not spark.catalog.tableExists(a.table)


def test_tables_go_with_their_scope(spark):
    n, e = weighted_graph(5)
    g = make(spark, n, e)
    here = lambda: set(os.listdir(shared_dir(spark)))
    before = here()
    jobs = [lambda: bfs(g, 3), lambda: sssp(g, 3), lambda: connected_components(out_of_core(g)), lambda: hybrid_coloring(g), lambda: pagerank(g, "async"), lambda: pagerank(in_memory(g, hub_rows=3), "sync")]
    for job in jobs:
        with staging(spark):
            assert job().count() > 0 and here() > before
        assert here() == before
    with pytest.raises(ValueError), staging(spark):
        Staged(g.edges, "lost")
        raise ValueError
    assert here() == before


class Lost(Exception):
    """The driver goes away."""


@pytest.mark.parametrize("job", ["bfs", "sync"])
def test_a_lost_run_goes_on_where_it_stood(spark, monkeypatch, job):
    monkeypatch.setattr(known, "MERGE", 2)
    n, e = 12, [(i, i + 1) for i in range(11)] + [(11, 3), (0, 5)]
    g = make(spark, n, e)
    journal = Journal(spark, f"{job}-{uuid.uuid4().hex}")
    go = (lambda: bfs_run(g, 0, journal=journal)) if job == "bfs" else (lambda: pagerank_run(g, "sync", tol=1e-9, journal=journal))
    whole = go()
    want = sorted(map(tuple, whole.result.collect()))
    journal.clear()
    save, written = Journal.save, []

    def dies(self, **state):
        written.append(state["round"])
        save(self, **state)
        if len(written) == 3:
            raise Lost

    monkeypatch.setattr(Journal, "save", dies)
    with pytest.raises(Lost):
        go()
    again = go()
    assert written[:3] == [1, 2, 3] and written[3] == 4 and again.rounds == whole.rounds
    assert sorted(map(tuple, again.result.collect())) == want
    assert go().rounds == whole.rounds and written[-1] == whole.rounds  # a finished run isn't run again
    account = again.account(spark).orderBy("round").collect()
    assert [r["round"] for r in account] == list(range(4, whole.rounds + 1)) and all(r["bytes_written"] > 0 for r in account)


# ---- union-find


@pytest.mark.parametrize("seed", range(4))
def test_forest(seed):
    r = np.random.default_rng(seed)
    u, v = r.integers(0, 60, 50), r.integers(0, 60, 50)
    keep = u != v
    ids, roots = forest(u[keep], v[keep])
    want = G.components(60, list(zip(u[keep].tolist(), v[keep].tolist(), strict=True)))
    assert dict(zip(ids.tolist(), roots.tolist(), strict=True)) == {a: b for a, b in want.items() if a != b}
    n = 50_000
    order = r.permutation(n)
    ids, roots = forest(order[1:], order[:-1])
    assert len(ids) == n - 1 and not roots.any()


@pytest.mark.parametrize("most, one_task", [(4, 0), (4, 10**6), (10**6, 0), (10**6, 30)])
def test_components_by_forests_and_stars(spark, monkeypatch, most, one_task):
    monkeypatch.setattr(components, "FOREST_LINKS", most)
    n, e = G.random_graph(9, 60, 50)
    g = make(spark, n, e)
    run = components.components_run(g, one_task=one_task)
    assert run.converged and pairs(run.result, "id", "root") == G.components(n, e)


# ---- colouring


def test_colouring_ends_on_broken_graphs(spark):
    lost = make(spark, 3, [(0, 1), (1, 2), (2, 7), (7, 1)])
    assert pairs(hybrid_coloring(PropertyGraph.of(spark.range(10), lost.edges)), "id", "part") == G.first_fit(10, [(0, 1), (1, 2), (2, 7), (7, 1)], 5)
    with pytest.raises(ValueError):
        hybrid_coloring(make(spark, 3, [(0, 1), (1, 2), (-4, 1)]))
    assert pairs(hybrid_coloring(lost), "id", "part") == {0: 1, 1: 2, 2: 1}
    twice = PropertyGraph.of(spark.range(3).union(spark.range(2)), make(spark, 3, [(0, 1), (1, 2)]).edges)
    rows = hybrid_coloring(twice).collect()
    assert len(rows) == 3 and {r["id"]: r["part"] for r in rows} == {0: 1, 1: 2, 2: 1}


@pytest.mark.parametrize("classes", [2, 5, 63, 64, 200])
def test_hubs_are_coloured_over_several_ranges(spark, monkeypatch, classes):
    conf = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    n, e = G.random_graph(6, 40, 120)
    e += [(39, i) for i in range(39)] + [(38, i) for i in range(38)]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        run = coloring_run(make(spark, n, e), classes)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert pairs(run.result, "id", "part") == G.first_fit(n, e, classes) and sum(run.counts) == n


def test_more_colours_than_a_word_has_bits(spark):
    n = 150
    e = [(i, j) for i in range(n) for j in range(i)]
    for classes in (70, 140):
        assert pairs(hybrid_coloring(make(spark, n, e), classes), "id", "part") == {v: min(v + 1, classes) for v in range(n)}


def test_long_chains_beside_wide_levels(spark, monkeypatch):
    monkeypatch.setattr(coloring, "NARROW", 3)
    n = 600
    e = [(i, i + 1) for i in range(300)] + [(a, b) for a, b in G.random_graph(8, 600, 900)[1]] + [(0, i) for i in range(1, 200)]
    assert pairs(hybrid_coloring(make(spark, n, e), 7), "id", "part") == G.first_fit(n, e, 7)
