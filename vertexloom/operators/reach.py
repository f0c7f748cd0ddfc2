"""The smallest vertex that each vertex reaches along edges."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import PropertyGraph
from ..plans.lineage import Staged
from ..plans.superstep import Run, iterate
from .components import ONE_TASK

#: Chains are contracted while at least this share of the sources lies on them.
CHAIN_SHARE = 0.1


def least_reached(src: np.ndarray, dst: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For vertices 0 .. n-1, the smallest value that each reaches: from the smallest value on, all that still reach it, backwards."""
    order = np.argsort(dst, kind="stable")
    begin = np.searchsorted(dst[order], np.arange(len(value) + 1)).tolist()
    before, out = src[order].tolist(), [None] * len(value)
    for v in np.argsort(value, kind="stable").tolist():
        if out[v] is not None:
            continue
        x, todo = value[v], [v]
        out[v] = x
        while todo:
            w = todo.pop()
            for u in before[begin[w] : begin[w + 1]]:
                if out[u] is None:
                    out[u] = x
                    todo.append(u)
    return np.array(out, np.int64)


def _in_one_task(edges: DataFrame, label: DataFrame) -> DataFrame:
    """(id, label) of the edges' vertices; the edges are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            src, dst, a, b = (c.to_numpy() for c in pa.Table.from_batches(held).columns)
            ids, first, at = np.unique(np.r_[src, dst], return_index=True, return_inverse=True)
            found = least_reached(at[: len(src)], at[len(src) :], np.r_[a, b][first])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(found)], ["id", "label"])

    rows = edges.join(label.toDF("src", "a"), "src").join(label.toDF("dst", "b"), "dst").select("src", "dst", "a", "b")
    return rows.coalesce(1).mapInArrow(run, "id long, label long")


def _chains(edges: DataFrame, label: DataFrame, run: Run) -> DataFrame | None:
    """(id, next, m, done) of the vertices with one target: the first vertex behind its chain that has none or several, the smallest
    label on the way to it, and whether there is such a vertex: a chain may also run into a circle. None: too few of them."""
    single = edges.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("next"))
    found = Staged(single.select(F.col("src").alias("id"), "next", "n"), "degree", one=F.count_if(F.col("n") == 1), n=F.count("*"))
    n_one = found.seen["one"]
    if n_one < max(1, CHAIN_SHARE * found.seen["n"]):
        found.drop()
        return None
    one = found.df.where("n = 1").select("id", "next")
    ends = one.select(F.col("id").alias("next"), F.lit(False).alias("end"))
    start = one.join(ends, "next", "left").join(label.withColumnRenamed("label", "m"), "id").select("id", "next", "m", F.coalesce("end", F.lit(True)).alias("done"))

    def step(now: DataFrame, _: int) -> DataFrame:
        """Twice as far in each round."""
        far = now.select(F.col("id").alias("next"), F.col("next").alias("next2"), F.col("m").alias("m2"), F.col("done").alias("done2"))
        on = now.where("not done").join(far, "next").select("id", F.col("next2").alias("next"), F.least("m", "m2").alias("m"), F.col("done2").alias("done"))
        return now.where("done").union(on)

    # after so many rounds a pointer has gone all around any circle
    jumped = iterate(start, step, ~F.col("done"), n_one.bit_length() + 1, "chains")
    found.drop()
    run.rounds += jumped.rounds
    run.counts += jumped.counts
    run.bytes += jumped.bytes
    run.seconds += jumped.seconds
    return jumped.result


def min_reachable_run(graph: PropertyGraph, max_rounds: int | None = None, one_task: int = ONE_TASK) -> Run:
    """`result`: (id, label), the smallest id that each vertex reaches, itself included.

    Up to one_task edges are settled by one task, backwards from the smallest ids. With more, vertices
    with a single target are contracted by pointer jumping, which halves a chain in each round, and
    their labels pass to those before them, as do the labels of vertices without targets. What is left
    in the end, if still large, passes labels on along edges round by round, by the vertices that changed;
    this takes as many rounds as the longest shortest path that a label has to go. max_rounds: limits
    the passing on only, and `converged` tells whether it was enough.
    """
    run = Run()
    began = time.perf_counter()
    edges = Staged(graph.edges.select("src", "dst").where("src != dst").distinct(), "reach", n=F.count("*"))
    label = graph.vertices.select("id", F.col("id").alias("label"))
    done: list[DataFrame] = []
    while edges.seen["n"] > one_task:
        chains = _chains(edges.df, label, run)
        if chains is None:
            break
        done.append(chains)
        c = chains.select(F.col("id").alias("dst"), "next", "m", "done")
        rest = edges.df.join(chains.select(F.col("id").alias("src")), "src", "left_anti")
        met = Staged(rest.join(c, "dst", "left").select("src", F.when(F.col("m").isNull(), F.col("dst")).when(F.col("done"), F.col("next")).alias("dst"), "m"), "met")
        sources = met.df.select(F.col("src").alias("dst"), F.lit(True).alias("goes_on")).distinct()
        # a target that goes nowhere gives its label away for good
        ends = met.df.where("dst is not null").select("src", "dst").join(sources, "dst", "left").where("goes_on is null").join(label.toDF("dst", "m"), "dst").select("src", "m")
        offers = met.df.where("m is not null").select("src", "m").union(ends).groupBy(F.col("src").alias("id")).agg(F.min("m").alias("m"))
        after = Staged(label.join(offers, "id", "left").select("id", F.least("label", "m").alias("label")), "label")
        fewer = Staged(met.df.where("dst is not null and src != dst").select("src", "dst").join(sources.select("dst"), "dst", "left_semi").select("src", "dst").distinct(), "reach", n=F.count("*"))
        met.drop()
        edges.drop()
        edges, label = fewer, after.df
        run.note(fewer, fewer.seen["n"], began)
        began = time.perf_counter()
    run.converged = True
    if 0 < edges.seen["n"] <= one_task:
        found = Staged(_in_one_task(edges.df, label), "label", n=F.count("*"))
        run.note(found, found.seen["n"], began)
        label = label.join(found.df.withColumnRenamed("label", "l"), "id", "left").select("id", F.coalesce("l", "label").alias("label"))
    elif edges.seen["n"]:
        start = label.withColumn("changed", F.lit(True))

        def step(state: DataFrame, _: int) -> DataFrame:
            moved = state.where("changed").select(F.col("id").alias("dst"), F.col("label").alias("l"))
            offers = edges.df.join(moved, "dst").groupBy(F.col("src").alias("id")).agg(F.min("l").alias("l"))
            return state.join(offers, "id", "left").select("id", F.least("label", "l").alias("label"), F.coalesce(F.col("l") < F.col("label"), F.lit(False)).alias("changed"))

        passed = iterate(start, step, F.col("changed"), max_rounds, "label")
        label, run.converged = passed.result.select("id", "label"), passed.converged
        run.rounds += passed.rounds
        run.counts += passed.counts
        run.bytes += passed.bytes
        run.seconds += passed.seconds
    for chains in reversed(done):
        behind = chains.join(label.toDF("next", "l"), "next", "left")
        mine = behind.select("id", F.when(F.col("done"), F.least("m", "l")).otherwise(F.col("m")).alias("own"))
        label = label.join(mine, "id", "left").select("id", F.coalesce("own", "label").alias("label"))
    run.result = label
    return run


def min_reachable_label(graph: PropertyGraph, max_rounds: int | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """(id, label): the smallest id that each vertex reaches along edges, itself included."""
    return min_reachable_run(graph, max_rounds, one_task).result
