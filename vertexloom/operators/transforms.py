"""Structural operators: reversal, degrees, adjacency, offsets, weights, rebasing and cutting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import PropertyGraph
from ..plans.lineage import Bucketed, Staged

#: Targets that a row of `bundled` has at most.
MOST_BUNDLED = 1000


def reverse(graph: PropertyGraph) -> PropertyGraph:
    return PropertyGraph(graph.vertices, graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def degrees(graph: PropertyGraph) -> DataFrame:
    """(id, in_degree, out_degree) of every vertex; both counts share one aggregation."""
    ends = graph.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o")))).alias("e"))
    counts = ends.groupBy("e.id").agg(F.sum(1 - F.col("e.o")).alias("in_degree"), F.sum("e.o").alias("out_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return graph.vertices.join(counts, "id", "left").select("id", zero("in_degree"), zero("out_degree"))


def adjacency(graph: PropertyGraph) -> DataFrame:
    """(id, nbrs): targets of each vertex's edges in ascending order; empty for sinks."""
    lists = graph.edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))
    return graph.vertices.join(lists, graph.vertices.id == lists.src, "left").select("id", F.coalesce("nbrs", F.array().cast("array<bigint>")).alias("nbrs"))


def bundle(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (keys, dsts) from rows (keys, dst) sorted by keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            first = np.zeros(batch.num_rows, bool)
            first[::MOST_BUNDLED] = True
            for c in columns:
                value = c.to_numpy()
                first[1:] |= value[1:] != value[:-1]
            at = np.flatnonzero(first)
            dsts = pa.ListArray.from_arrays(pa.array(np.r_[at, batch.num_rows].astype(np.int32)), batch.column(batch.schema.get_field_index("dst")))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in columns), dsts], [*keys, "dsts"])

    return run


def bundled(edges: DataFrame, by: str | None = None) -> Bucketed:
    """Edges as rows (src[, by], dsts) in buckets of their source, for what reads all of them in some 20 rounds: a join has a row a source
    to sort and match, not one an edge. A row has MOST_BUNDLED targets at most, so a source may have several; edges
    without an end are left out."""
    buckets = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*[by] * bool(by), "src"]
    rows = edges.where("src is not null and dst is not null").select(*keys, "dst").repartition(buckets, "src").sortWithinPartitions(*keys)
    packed = rows.mapInArrow(bundle(keys), ", ".join([f"{k} {kind}" for k, kind in rows.dtypes[:-1]] + ["dsts array<long>"]))
    return Bucketed(packed, "edges", ["src"], buckets, by=by, dealt=True)


def expand(lists: DataFrame) -> DataFrame:
    """(src, dst) from (id, nbrs); the lists are left as they are."""
    return lists.select(F.col("id").alias("src"), F.explode("nbrs").alias("dst"))


def running_total(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Adds the sum of `value` over all rows of smaller `order`, which must be unique.

    Two passes instead of one unpartitioned window: rows are split into ranges, each range sums up,
    and only one number a range is added in order. The ranges are written, so that both passes see the same ones.
    """
    rows = Staged(df, "rows")  # dealing out by ranges reads them twice
    ranged = Staged(rows.df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()), "ranges").df
    rows.drop()
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"), F.min(order).alias("_low"))
    # as many rows as there are partitions
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_within", within).join(F.broadcast(before), "_part").withColumn(out, (F.col("_before") + F.col("_within")).cast("long")).select(*df.columns, out)


def offsets(graph: PropertyGraph) -> DataFrame:
    """(id, begin, out_degree): where each vertex's edges begin among the edges in order of source."""
    counts = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    d = graph.vertices.join(counts, "id", "left").select("id", F.coalesce("out_degree", F.lit(0)).cast("long").alias("out_degree"))
    return running_total(d, "id", "out_degree", "begin").select("id", "begin", "out_degree")


def unit_weights(graph: PropertyGraph) -> PropertyGraph:
    return PropertyGraph(graph.vertices, graph.edges.withColumn("weight", F.lit(1).cast("long")))


def rebase(graph: PropertyGraph, by: int) -> PropertyGraph:
    return PropertyGraph(
        graph.vertices.select((F.col("id") + by).alias("id")), graph.edges.select((F.col("src") + by).alias("src"), (F.col("dst") + by).alias("dst"), "weight")
    )


def cut(graph: PropertyGraph, classes: DataFrame) -> DataFrame:
    """Edges with the class of their source: (part, src, dst, weight), ids as in the whole graph."""
    return graph.edges.join(classes.withColumnRenamed("id", "src"), "src").select("part", "src", "dst", "weight")


def class_sizes(graph: PropertyGraph, classes: DataFrame) -> DataFrame:
    """(part, n_vertices, n_edges) of every class."""
    out = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out"))
    of = graph.vertices.select("id").join(classes, "id").join(out, "id", "left")
    return of.groupBy("part").agg(F.count("*").alias("n_vertices"), F.coalesce(F.sum("out"), F.lit(0)).alias("n_edges"))
