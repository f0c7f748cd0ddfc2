"""Connected components of the undirected view of an edge table."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import PropertyGraph
from ..plans.lineage import Staged
from ..plans.superstep import Run


def _minimum(pairs: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m): m is the smallest of u and all its v. Sums up before the shuffle; a hot u can be split."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest neighbour of u."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    return _minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """u and every smaller neighbour of u are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    starred = _minimum(down)
    out = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).union(starred.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


#: Links that a task takes into one forest, and links that are few enough for a single task.
FOREST_LINKS, ONE_TASK = 1_000_000, 500_000
#: Edges a source from which some of them are contracted first.
MANY = 4


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, root) of every vertex of the links that isn't the smallest of its component: a disjoint-set forest on arrays.

    Each root with a smaller root beside it hooks onto the smallest one, then all paths are cut short,
    so at least half of the roots that can go do so in each round.
    """
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while not np.array_equal(short := root[root], root):
            root = short
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    mine = np.flatnonzero(root != np.arange(len(ids)))
    return ids[mine], ids[root[mine]]


def spanning(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Replaces a task's links by those of a forest: as many as it has vertices, at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = kept = 0

        def merge() -> tuple[np.ndarray, np.ndarray]:
            return forest(*(np.concatenate(x) for x in zip(*held, strict=True)))

        def out(links: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in links], ["u", "v"])

        for batch in batches:
            held.append(tuple(c.to_numpy() for c in batch.columns))
            n += batch.num_rows
            if n - kept >= most:
                held = [merge()]
                n = kept = len(held[0][0])
                if kept > most // 2:  # a forest that hardly shrinks is passed on
                    yield out(held[0])
                    held, n, kept = [], 0, 0
        if held:
            yield out(merge())

    return run


def contract(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int | None = None, one_task: int = ONE_TASK) -> Run:
    """`result`: (id, root) for every vertex of an edge that isn't its component's smallest vertex.

    Each task first turns its links into a forest, so that what is shuffled has at most a link for each
    vertex and task. Up to one_task links are then settled by one task. More of them are contracted by
    large-star and small-star in turn until the links stay as they are; rounds grow with the
    logarithm of the path length, and no vertex gathers its neighbours in one row. Stopped by
    max_rounds, `converged` is False and roots are only the smallest ids found so far.
    """
    run = Run()
    links = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u != v")
    trees = links.mapInArrow(spanning(FOREST_LINKS), "u long, v long")
    measures = {"n": F.count("*"), "mark": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    now, mark = Staged(trees, "cc", **measures), None
    while max_rounds is None or run.rounds < max_rounds:
        began = time.perf_counter()
        few = now.seen["n"] <= one_task
        if few:  # a bounded number of links
            after = Staged(now.df.coalesce(1).mapInArrow(spanning(2 * one_task), "u long, v long"), "cc", **measures)
        else:
            after = Staged(small_star(large_star(now.df)), "cc", **measures)
        now.drop()
        now = after
        run.note(now, now.seen["n"], began)
        if few or now.seen == mark:
            run.converged = True
            break
        mark = now.seen
    roots = now.df.select(F.col("u").alias("id"), F.col("v").alias("root"))  # one row a vertex, once converged
    run.result = roots if run.converged else roots.groupBy("id").agg(F.min("root").alias("root"))
    return run


def contract_some_first(edges: DataFrame, one_task: int = ONE_TASK) -> Run:
    """As `contract`, for many edges a vertex. Two edges of each source, to its smallest and its largest target, are contracted first; they join most
    of what belongs together, and of all edges only those between different roots are left, which are contracted then. Rounds of
    links so are about as many rows as there are vertices, and all edges are read twice, and moved by their target once."""
    ends = edges.where("src != dst").groupBy("src").agg(F.min("dst").alias("low"), F.max("dst").alias("high"), F.count("*").alias("n"))
    # the ends are read several times
    some = Staged(ends, "ends", sources=F.count("*"), edges=F.sum("n"))
    if (some.seen["edges"] or 0) <= max(MANY * some.seen["sources"], one_task):
        some.drop()
        return contract(edges, one_task=one_task)
    run = contract(some.df.select("src", F.explode(F.array("low", "high")).alias("dst")), one_task=one_task)
    first = run.result
    root = lambda end: F.coalesce(F.col(f"{end}_root"), F.col(end))
    roots = lambda end: first.select(F.col("id").alias(end), F.col("root").alias(f"{end}_root"))
    ends_ = edges.where("src != dst").select("src", "dst").join(roots("src"), "src", "left").join(roots("dst"), "dst", "left")
    rest = contract(ends_.select(root("src").alias("src"), root("dst").alias("dst")).where("src != dst"), one_task=one_task)
    # what has a root takes that root's root; roots that got a new one are no ids of the first links
    second = rest.result.select(F.col("id").alias("root"), F.col("root").alias("above"))
    moved = first.join(second, "root", "left").select("id", F.coalesce("above", "root").alias("root"))
    run.result = moved.union(rest.result.select("id", "root"))
    run.rounds += rest.rounds
    for all_, more in ((run.counts, rest.counts), (run.bytes, rest.bytes), (run.seconds, rest.seconds)):
        all_ += more
    some.drop()
    return run


def component_roots(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, root) for every vertex of an edge that isn't its component's smallest vertex."""
    return contract(edges, src, dst).result


def components_run(graph: PropertyGraph, max_rounds: int | None = None, one_task: int = ONE_TASK) -> Run:
    run = contract(graph.edges, max_rounds=max_rounds, one_task=one_task) if max_rounds is not None else contract_some_first(graph.edges, one_task)
    run.result = graph.vertices.join(run.result, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    return run


def connected_components(graph: PropertyGraph, max_rounds: int | None = None) -> DataFrame:
    """(id, root) of every vertex: the smallest id of its weak component."""
    return components_run(graph, max_rounds).result
