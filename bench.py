"""Headline graph queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from vertexloom.fixtures import event_chain, part_chain
from vertexloom.operators.coloring import hybrid_coloring
from vertexloom.operators.components import connected_components
from vertexloom.operators.levels import bfs
from vertexloom.operators.pagerank import pagerank
from vertexloom.operators.paths import sssp
from vertexloom.streaming.slices import in_memory, out_of_core


def main() -> None:
    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    parts, events = in_memory(part_chain(spark, sf)), in_memory(event_chain(spark, sf))
    parts.edges.count(), events.edges.count()
    stored = out_of_core(part_chain(spark, sf))
    jobs = {
        "bfs": lambda: bfs(parts),
        "bfs_outofcore": lambda: bfs(stored),
        "cc": lambda: connected_components(events),
        "sssp": lambda: sssp(parts),
        "pagerank_sync": lambda: pagerank(parts, "sync"),
        "coloring": lambda: hybrid_coloring(parts),
    }
    took = {}
    for name, job in jobs.items():
        runs = []
        for _ in range(repeats + 1):  # the first warms up
            began = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
            if runs[0] > 60:
                break
        took[name] = round(statistics.median(runs[1:] or runs), 3)
        print(name, took[name], file=sys.stderr)
    print(json.dumps({"metric": "graph queries, total seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1], "cores": cpus}))


if __name__ == "__main__":
    main()
