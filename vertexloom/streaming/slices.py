"""Out-of-core mode: the edge table stays in storage, in slices of bounded size that no superstep moves.

The table is bucketed by source, a bucket a slice: joins with the vertices that changed read it as it
lies, with the columns they need, and only the vertices' side is shuffled. Nothing of it is cached.
Where the sources of a superstep are few, the other buckets aren't read. Results equal those of graphs
in memory.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import functions as F

from ..model import PropertyGraph
from ..plans.lineage import Bucketed, Staged

#: Edges that a slice or partition should hold; a vertex with more of them is dealt out over several.
SLICE_ROWS = 5_000_000


def out_of_core(graph: PropertyGraph, slice_rows: int = SLICE_ROWS, check: bool = True) -> PropertyGraph:
    """The graph over a stored edge table of slices of about slice_rows edges, and files of that many at most. check: endpoints must be vertices."""
    if slice_rows < 1:
        raise ValueError("a slice must hold at least one edge")
    # where the edges come from is read once; all else reads what was stored
    flat = Staged(graph.edges, "edges", n=F.count("*"))
    try:
        graph = replace(graph, edges=flat.df)
        if check:
            graph.validate()
        dealt = graph.spread(slice_rows)
        # fewer buckets than shuffle partitions would be shuffled anew
        buckets = max(int(graph.spark.conf.get("spark.sql.shuffle.partitions")), -(-flat.seen["n"] // slice_rows))
        stored = Bucketed(dealt.edges, "edges", dealt.source_keys, min(buckets, MOST_BUCKETS), slice_rows)
    finally:
        flat.drop()
    return replace(dealt, edges=stored.df, bucketed=True)


#: Spark's own limit.
MOST_BUCKETS = 100_000


def in_memory(graph: PropertyGraph, hub_rows: int = SLICE_ROWS, check: bool = True) -> PropertyGraph:
    """Edges clustered by source and kept in memory, what doesn't fit on disk; a vertex with over hub_rows edges is dealt out. check: endpoints must be vertices."""
    # where the edges come from is read once; all else reads what is kept
    kept = graph.clustered(StorageLevel.MEMORY_AND_DISK)
    if check:
        kept.validate()
    dealt = kept.spread(hub_rows)
    return kept if dealt is kept else dealt.clustered(StorageLevel.MEMORY_AND_DISK)
