"""ASCII graphs: a header `p sp V E`, then lines `a src dst weight`, ids from 1."""

from __future__ import annotations

import warnings

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import PropertyGraph
from ..operators.transforms import adjacency
from ..plans.lineage import Staged
from .binary import assemble, place

HEADER = r"^\s*p\D*(\d+)\s+(\d+)"
ARC = r"^\s*a\s+(\d+)\s+(\d+)"


def read_graph(spark: SparkSession, path: str) -> PropertyGraph:
    """Vertices 0 .. V-1 of the header and one edge a line; the third number is ignored, all weights are 1.

    Edges may stand in any order. A file with fewer edges than its header names gives a warning.
    """
    lines = spark.read.text(path)
    head = lines.where(F.col("value").rlike(HEADER)).select(*[F.regexp_extract("value", HEADER, k).cast("long") for k in (1, 2)]).first()
    if head is None or head[0] < 1 or head[1] < 1:
        raise ValueError("the file has no header with positive numbers of vertices and edges")
    ends = [F.regexp_extract("value", ARC, k).cast("long") - 1 for k in (1, 2)]
    edges = lines.where(F.col("value").rlike(ARC)).select(ends[0].alias("src"), ends[1].alias("dst"))
    if (n := edges.count()) != head[1]:
        warnings.warn(f"the header names {head[1]} edges, the file has {n}", stacklevel=2)
    return PropertyGraph.of(spark.range(head[0]), edges)


def read_csr(spark: SparkSession, path: str) -> DataFrame:
    """The same file as adjacency lists (id, nbrs)."""
    return adjacency(read_graph(spark, path))


def write_graph(graph: PropertyGraph, path: str) -> None:
    """A folder of text files that together, in order of their names, are the ASCII graph, in order of source."""
    n, m = graph.vertices.count(), graph.edges.count()
    head = graph.spark.range(1, numPartitions=1).select(F.lit(f"p sp {n} {m}").alias("value"))
    arcs = graph.edges.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst")
    head.union(arcs.select(F.concat_ws(" ", F.lit("a"), F.col("src") + 1, F.col("dst") + 1, F.lit(1)).alias("value"))).write.mode("overwrite").text(path)


def write_file(graph: PropertyGraph, path: str) -> None:
    """The ASCII graph as one file, streamed together from its parts; it is there when it is whole."""
    parts = Staged.folder(graph.spark, "ascii")
    write_graph(graph, parts)
    system, inner = place(parts)
    files = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(inner)) if f.base_name.startswith("part-"))
    assemble(graph.spark, path, [(parts, files)])
    system.delete_dir(inner)
