"""The data model: a graph is a vertex frame and an edge frame."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.lineage import Staged

#: Hubs up to which their table is broadcast.
MOST_HUBS = 1_000_000


@dataclass(frozen=True)
class PropertyGraph:
    """`vertices(id bigint)` and `edges(src bigint, dst bigint, weight bigint)`: a directed multigraph.

    Parallel edges and self-loops stay. Vertices without an edge exist because the vertex frame
    names them; `from_edges` can only know the endpoints.
    """

    vertices: DataFrame
    edges: DataFrame
    #: (src, shares) of vertices whose edges are dealt out over several partitions, by the edges' column `salt`; None: no such vertex.
    hubs: DataFrame | None = None
    #: Edges lie in buckets of `src` in storage, so that few sources need few files.
    bucketed: bool = False

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @staticmethod
    def of(vertices: DataFrame, edges: DataFrame) -> PropertyGraph:
        weight = F.col("weight") if "weight" in edges.columns else F.lit(1)
        return PropertyGraph(
            vertices.select(F.col("id").cast("long").alias("id")),
            edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), weight.cast("long").alias("weight")),
        )

    @staticmethod
    def from_edges(edges: DataFrame) -> PropertyGraph:
        ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
        return PropertyGraph.of(ends, edges)

    def with_edges(self, edges: DataFrame) -> PropertyGraph:
        return PropertyGraph.of(self.vertices, edges)

    def clustered(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> PropertyGraph:
        """Edges hash-partitioned by source, sorted and kept, so that every superstep joins them without moving or sorting them, and skips those outside its span of sources."""
        return replace(self, edges=self.edges.repartition(*self.source_keys).sortWithinPartitions(*self.source_keys).persist(level))

    def stored(self) -> PropertyGraph:
        """Edges written once to the shared folder, for what reads them several times; a graph out of core has them there."""
        return self if self.bucketed else replace(self, edges=Staged(self.edges, "edges").df)

    @property
    def source_keys(self) -> list[str]:
        return ["src", "salt"] if self.hubs else ["src"]

    def spread(self, hub_rows: int) -> PropertyGraph:
        """The graph with the edges of each vertex that has more than hub_rows of them dealt out in shares of about that many."""
        many = self.edges.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > hub_rows)
        found = Staged(many.select("src", F.ceil(F.col("n") / hub_rows).cast("int").alias("shares")), "hubs", n=F.count("*"))
        if not found.seen["n"]:
            found.drop()
            return self
        # a hub has hub_rows edges at least, so there are few of them
        hubs = F.broadcast(found.df) if found.seen["n"] <= MOST_HUBS else found.df
        salt = F.coalesce(F.pmod(F.xxhash64("dst", F.monotonically_increasing_id()), F.col("shares")), F.lit(0)).cast("int")
        return replace(self, edges=self.edges.join(hubs, "src", "left").withColumn("salt", salt).drop("shares"), hubs=hubs)

    def along(self, rows: DataFrame, few: list[int] | None = None, span: tuple[int, int] | None = None) -> DataFrame:
        """Edges joined with rows by `src`, as the edges lie. few: all sources there are in rows, if they are few: only their files are read.
        span: bounds of the sources in rows; as edges lie sorted by source, in memory and in files, what is outside is skipped."""
        edges = self.edges if few is None or not self.bucketed else self.edges.where(F.col("src").isin(few))
        edges = edges if span is None else edges.where(F.col("src").between(*span))
        if self.hubs is None:
            return edges.join(rows, "src")
        shares = F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))
        return edges.join(rows.join(self.hubs, "src", "left").withColumn("salt", shares).drop("shares"), ["src", "salt"]).drop("salt")

    def validate(self) -> None:
        """Raises ValueError on null or repeated vertex ids and on endpoints outside the vertex set. One pass, summed up before the shuffle."""
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id"), F.lit(0).alias("v"), F.lit(1).alias("e"))
        both = self.vertices.select("id", F.lit(1).alias("v"), F.lit(0).alias("e")).union(ends)
        seen = both.groupBy("id").agg(F.sum("v").alias("v"), F.max("e").alias("e"))
        bad = seen.agg(F.count_if((F.col("v") > 1) | F.col("id").isNull() & (F.col("v") > 0)).alias("ids"), F.count_if((F.col("e") > 0) & ((F.col("v") == 0) | F.col("id").isNull())).alias("ends")).first()
        if bad["ids"]:
            raise ValueError("vertex ids must be unique and not null")
        if bad["ends"]:
            raise ValueError("every edge must join two vertices of the graph")

    def require_vertex(self, vertex: int) -> None:
        if self.vertices.where(F.col("id") == vertex).isEmpty():
            raise ValueError(f"vertex {vertex} is not in the graph")
