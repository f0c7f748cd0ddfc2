"""Graphs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .model import PropertyGraph
from .plans.lineage import Staged


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_chain(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Parts of an order in line order; a cyclic multigraph with self-loops."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"))
    return PropertyGraph.of(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), lines.where("dst is not null"))


def event_chain(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Events of a user in time order; long paths, one component a user."""
    events = _table(spark, sf_dir, "events")
    chain = events.select(F.col("event_id").alias("src"), F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("dst"))
    return PropertyGraph.of(events.select(F.col("event_id").alias("id")), chain.where("dst is not null"))


def cust_supp(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Customers (even ids) and the suppliers (odd ids) of their orders."""
    joined = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    pairs = joined.select((2 * F.col("o_custkey")).alias("src"), (2 * F.col("l_suppkey") + 1).alias("dst")).distinct()
    # vertices and edges are both read from them
    return PropertyGraph.from_edges(Staged(pairs, "pairs").df)


def weighted(graph: PropertyGraph) -> PropertyGraph:
    return graph.with_edges(graph.edges.withColumn("weight", 1 + (F.col("src") * 7 + F.col("dst") * 13) % 10))
