"""Registered queries over the graphs derived from the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli
from .fixtures import cust_supp, event_chain, part_chain, weighted
from .functions.report import bfs_histogram, bfs_summary, cc_count, cc_report
from .functions.verify import verify_exact, verify_tolerance
from .model import PropertyGraph
from .operators.coloring import IN_MEMORY, OUT_OF_CORE, clashes, hybrid_coloring
from .operators.components import connected_components
from .operators.levels import all_levels, bfs
from .operators.pagerank import pagerank
from .operators.paths import all_distances, sssp
from .operators.reach import min_reachable_label
from .operators.transforms import adjacency, class_sizes, cut, degrees, expand, offsets, reverse
from .plans.lineage import Staged
from .sources import binary, dimacs
from .streaming.slices import in_memory, out_of_core

SOURCE = 3
Query = Callable[[SparkSession, str], DataFrame]


def _levels(g: PropertyGraph) -> DataFrame:
    return all_levels(g, bfs(g, SOURCE)).select("id", F.col("level").cast("int").alias("level"))


def _distances(g: PropertyGraph) -> DataFrame:
    return all_distances(g, sssp(g, SOURCE)).select("id", "dist")


def _ranks(g: PropertyGraph, mode: str) -> DataFrame:
    return pagerank(g, mode).select("id", F.round("rank", 6).alias("rank"))


def _file(spark: SparkSession, name: str) -> str:
    """A new file in the shared folder."""
    at = Staged.folder(spark, "files")
    system, inner = binary.place(at)
    system.create_dir(inner)
    return f"{at}/{name}"


def _counted(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n"))


def _ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Staged.folder(spark, "ascii")
    dimacs.write_graph(part_chain(spark, sf_dir), path)
    return _counted(dimacs.read_graph(spark, path).edges)


def _ascii_csr(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _file(spark, "graph.gr")
    dimacs.write_file(part_chain(spark, sf_dir), path)
    return _counted(expand(dimacs.read_csr(spark, path)))


def _convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = Staged.folder(spark, "ascii"), _file(spark, "graph.bin")
    dimacs.write_graph(part_chain(spark, sf_dir), source)
    binary.convert(spark, source, target)
    return _counted(binary.read_graph(spark, target).edges)


def _two_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The algorithms over two files in a row: whether each came to its end, and vertices that got a result."""
    rows, g = [], part_chain(spark, sf_dir).stored()
    for k, graph in enumerate((g, reverse(g))):
        path = _file(spark, "graph.bin")
        binary.write_graph(graph, path)
        done = cli.run(spark, path, "out-of-core", SOURCE)
        rows += [(k, name, r.converged or name == "pagerank", r.rows) for name, r in done.items()]
    return spark.createDataFrame(rows, "file int, algorithm string, finished boolean, n_rows long")


def _in_memory_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The algorithms over one file in memory, ranks class by class: rows and the sum of each result."""
    path = _file(spark, "graph.bin")
    binary.write_graph(part_chain(spark, sf_dir).stored(), path)
    done = cli.run(spark, path, "in-memory", SOURCE)
    value = {"bfs": "level", "cc": "root", "sssp": "dist", "pagerank": "rank"}
    rows = [r.result.agg(F.lit(k).alias("algorithm"), F.count("*").alias("n_rows"), F.round(F.sum(F.col(value[k]).cast("double")), 3).alias("total")) for k, r in done.items()]
    return reduce(DataFrame.union, rows)


def _binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, lists = _file(spark, "g.bin"), _file(spark, "g.csr")
    binary.write_graph(event_chain(spark, sf_dir), graph)
    binary.write_csr(event_chain(spark, sf_dir), lists)
    return _counted(binary.read_graph(spark, graph).edges.union(binary.read_csr(spark, lists).edges))


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, path = part_chain(spark, sf_dir).stored(), _file(spark, "g.part")
    binary.write_table(g, hybrid_coloring(g), path, IN_MEMORY)
    return binary.read_table(spark, path)


def _on_classes(spark: SparkSession, sf_dir: str, what: Callable[[PropertyGraph, DataFrame], DataFrame]) -> DataFrame:
    g = part_chain(spark, sf_dir).stored()
    return what(g, Staged(hybrid_coloring(g), "classes").df)


def _independence(g: PropertyGraph, classes: DataFrame) -> DataFrame:
    """Edges inside independent classes, and the vertices that have a class."""
    return clashes(g, classes, IN_MEMORY).agg(F.count("*").alias("n_clashes")).join(classes.agg(F.count("part").alias("n_coloured")))


def _same_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels in memory against those out of core, every seventh of which is set wrong."""
    g = part_chain(spark, sf_dir).stored()
    wrong = bfs(out_of_core(g), SOURCE).withColumn("level", F.when(F.col("id") % 7 == 0, -1).otherwise(F.col("level")))
    return verify_exact(bfs(in_memory(g), SOURCE), wrong, "level")


def _near_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of two modes, every seventh of which is moved by twice the tolerance and every fifth by half of it."""
    g = in_memory(part_chain(spark, sf_dir))
    moved = F.col("rank") + F.when(F.col("id") % 7 == 0, 0.01).when(F.col("id") % 5 == 0, 0.0025).otherwise(0.0)
    return verify_tolerance(pagerank(g, "sync"), pagerank(g, "sequential", max_rounds=10).withColumn("rank", moved))


QUERIES: dict[str, Query] = {
    "bfs_levels": lambda s, d: _levels(in_memory(part_chain(s, d))),
    "bfs_histogram": lambda s, d: bfs_histogram(bfs(in_memory(part_chain(s, d)), SOURCE)),
    "bfs_summary": lambda s, d: bfs_summary(bfs(in_memory(part_chain(s, d)), SOURCE), SOURCE),
    "bfs_outofcore": lambda s, d: _levels(out_of_core(part_chain(s, d))),
    "sssp_unit": lambda s, d: _distances(in_memory(part_chain(s, d))),
    "sssp_weighted": lambda s, d: _distances(in_memory(weighted(part_chain(s, d)))),
    "sssp_predecessor": lambda s, d: sssp(in_memory(weighted(part_chain(s, d))), SOURCE).select("id", "dist", F.coalesce("pred", F.lit(-1)).alias("pred")),
    "sssp_outofcore": lambda s, d: _distances(out_of_core(weighted(part_chain(s, d)))),
    "cc_labels": lambda s, d: connected_components(event_chain(s, d)),
    "cc_report": lambda s, d: cc_report(connected_components(event_chain(s, d))),
    "cc_count": lambda s, d: cc_count(connected_components(cust_supp(s, d))),
    "cc_outofcore": lambda s, d: connected_components(out_of_core(event_chain(s, d))),
    "min_reachable_label": lambda s, d: min_reachable_label(in_memory(part_chain(s, d))),
    "pagerank_sync": lambda s, d: _ranks(in_memory(part_chain(s, d)), "sync"),
    "pagerank_sequential": lambda s, d: _ranks(in_memory(part_chain(s, d)), "sequential"),
    "pagerank_async": lambda s, d: _ranks(part_chain(s, d), "async"),
    "pagerank_outofcore": lambda s, d: _ranks(out_of_core(part_chain(s, d)), "sync"),
    "reverse_edges": lambda s, d: reverse(part_chain(s, d)).edges,
    "degrees": lambda s, d: degrees(cust_supp(s, d)),
    "csr_offsets": lambda s, d: offsets(part_chain(s, d)),
    "csr_expand": lambda s, d: expand(adjacency(part_chain(s, d))),
    "partition_classes": lambda s, d: hybrid_coloring(part_chain(s, d)),
    "partition_classes_outofcore": lambda s, d: hybrid_coloring(out_of_core(part_chain(s, d)), OUT_OF_CORE),
    "partition_stats": lambda s, d: _on_classes(s, d, class_sizes),
    "cut_edges": lambda s, d: _on_classes(s, d, lambda g, c: cut(g, c).groupBy("part").agg(F.count("*").alias("n"))),
    "hybrid_independence": lambda s, d: _on_classes(s, d, _independence),
    "verify_exact": _same_modes,
    "verify_tolerance": _near_ranks,
    "ascii_roundtrip": _ascii,
    "ascii_csr": _ascii_csr,
    "convert": _convert,
    "two_files": _two_files,
    "run_in_memory": _in_memory_run,
    "binary_roundtrip": _binary,
    "table_roundtrip": _table,
}

_PART = """pc as (select l_partkey as src, d as dst, 1 + (l_partkey * 7 + d * 13) % 10 as w from (
  select l_partkey, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as d
  from lineitem) where d is not null)"""
_EVENT = """ec as (select event_id as src, d as dst from (
  select event_id, lead(event_id) over (partition by user_id order by ts, event_id) as d from events) where d is not null)"""
_BFS = f"""with recursive {_PART}, r(id, level) using key (id) as (
  select 3::bigint, 1 union select distinct pc.dst, r.level + 1 from r join pc on pc.src = r.id
  where not exists (select 1 from recurring.r v where v.id = pc.dst))"""
_LEVELS = f"{_BFS} select p_partkey as id, coalesce(level, 0)::int as level from part left join r on r.id = p_partkey"


def _sssp(weight: str) -> str:
    return f"""with recursive {_PART}, r(id, dist) using key (id) as (
  select 3::bigint, 0::bigint union select pc.dst, min(r.dist + {weight})::bigint from r join pc on pc.src = r.id
  left join recurring.r v on v.id = pc.dst where v.dist is null or r.dist + {weight} < v.dist group by pc.dst)"""


def _all(weight: str) -> str:
    return f"{_sssp(weight)} select p_partkey as id, coalesce(dist, -1)::bigint as dist from part left join r on r.id = p_partkey"


def _rank(rounds: int) -> str:
    steps = [
        f"""r{k} as materialized (select p_partkey as id, 0.15 + 0.85 * coalesce(s, 0) as rank from part left join (
  select pc.dst, sum(rank / n) as s from pc join r{k - 1} on r{k - 1}.id = pc.src join deg on deg.src = pc.src group by pc.dst) on dst = p_partkey)"""
        for k in range(1, rounds + 1)
    ]
    return f"""with {_PART}, deg as (select src, count(*)::double as n from pc group by src),
r0 as (select p_partkey as id, 0.15::double as rank from part), {", ".join(steps)} select id, round(rank, 6) as rank from r{rounds}"""


def _coloured(classes: int) -> str:
    """First fit in the order of ids, a vertex a step."""
    free = " ".join(f"when used & {1 << c} = 0 then {c + 1}" for c in range(classes - 1))
    return f"""with recursive {_PART}, near as materialized (select distinct greatest(src, dst) as hi, least(src, dst) as lo from pc where src <> dst),
v as (select p_partkey as id, row_number() over (order by p_partkey) as k from part),
r(id, k, part) using key (id) as (
  select id, k, 1::int from v where k = 1
  union
  select id, k, (case {free} else {classes} end)::int from (
    select v.id, v.k, coalesce(bit_or(1::bigint << (u.part - 1)), 0) as used
    from r join v on v.k = r.k + 1 left join near on near.hi = v.id left join recurring.r u on u.id = near.lo group by v.id, v.k))"""


def _rank_in_place(rounds: int = 20, classes: int = IN_MEMORY, tol: float = 0.005) -> str:
    """Class by class with freezing, unrolled; a round runs if some vertex moved in the one before."""
    steps, last = [], "s0"
    for k in range(1, rounds + 1):
        steps.append(f"g{k} as materialized (select bool_or(moved) as go from {last})")
        for p in range(1, classes + 1):
            steps.append(f"""s{k}_{p} as materialized (select id, part, deg, case when turn then new else rank end as rank,
  case when turn and deg > 0 then new / deg else share end as share, frozen or (turn and abs(new - rank) < {tol}) as frozen,
  case when go and part = {p} then turn and abs(new - rank) > {tol} else moved end as moved
  from (select {last}.*, go, part = {p} and not frozen and go as turn, 0.15 + 0.85 * coalesce(s, 0) as new
    from g{k}, {last} left join (select pc.dst, sum(u.share) as s from pc join {last} u on u.id = pc.src group by pc.dst) x on x.dst = {last}.id))""")
            last = f"s{k}_{p}"
    return f"""{_coloured(classes)}, deg as materialized (select src, count(*) as n from pc group by src),
s0 as materialized (select r.id, r.part, coalesce(n, 0) as deg, 0::double as rank, 0::double as share, false as frozen, true as moved from r left join deg on deg.src = r.id),
{", ".join(steps)} select id, round(rank, 6) as rank from {last}"""


_ROOTS = "select event_id as id, min(event_id) over (partition by user_id) as root from events"

ORACLES: dict[str, str] = {
    "bfs_levels": _LEVELS,
    "bfs_outofcore": _LEVELS,
    "bfs_histogram": f"{_BFS} select level::int as level, count(*) as n from r group by level",
    "bfs_summary": f"{_BFS} select 3::bigint as source, max(level)::int as max_level, count(*) as visited from r",
    "sssp_unit": _all("1"),
    "sssp_weighted": _all("pc.w"),
    "sssp_outofcore": _all("pc.w"),
    "sssp_predecessor": f"""{_sssp("pc.w")} select r.id, r.dist, coalesce(p.pred, -1)::bigint as pred from r left join (
  select b.id, min(a.id) as pred from r a join pc on pc.src = a.id join r b on b.id = pc.dst where a.dist + pc.w = b.dist and b.dist > 0 group by b.id) p on p.id = r.id""",
    "cc_labels": _ROOTS,
    "cc_outofcore": _ROOTS,
    "cc_report": f"select (row_number() over (order by root) - 1)::int as idx, root, n from (select root, count(*) as n from ({_ROOTS}) group by root order by root limit 21)",
    "cc_count": """with recursive e as (select distinct 2 * o_custkey as a, 2 * l_suppkey + 1 as b from orders join lineitem on o_orderkey = l_orderkey),
b as (select a, b from e union all select b, a from e),
r(id, root) using key (id) as (select a, a from b union select b.b, min(r.root) from r join b on b.a = r.id join recurring.r v on v.id = b.b where r.root < v.root group by b.b)
select count(distinct root) as n_components from r""",
    "min_reachable_label": f"""with recursive {_PART}, r(id, label) using key (id) as (
  select p_partkey, p_partkey from part union select pc.src, min(r.label) from r join pc on pc.dst = r.id join recurring.r v on v.id = pc.src where r.label < v.label group by pc.src)
select id, label from r""",
    "pagerank_sync": _rank(10),
    "pagerank_outofcore": _rank(10),
    "pagerank_async": _rank_in_place(),
    "pagerank_sequential": _rank(9),
    "reverse_edges": f"with {_PART} select dst as src, src as dst, 1::bigint as weight from pc",
    "degrees": """with e as (select distinct 2 * o_custkey as src, 2 * l_suppkey + 1 as dst from orders join lineitem on o_orderkey = l_orderkey)
select id, sum(i)::bigint as in_degree, sum(o)::bigint as out_degree from (select src as id, 0 as i, 1 as o from e union all select dst, 1, 0 from e) group by id""",
    "csr_offsets": f"""with {_PART}, d as (select p_partkey as id, count(src) as n from part left join pc on src = p_partkey group by p_partkey)
select id, (sum(n) over (order by id) - n)::bigint as begin, n as out_degree from d""",
    "csr_expand": f"with {_PART} select src, dst from pc",
    "partition_classes": f"{_coloured(IN_MEMORY)} select id, part from r",
    "partition_classes_outofcore": f"{_coloured(OUT_OF_CORE)} select id, part from r",
    "partition_stats": f"""{_coloured(IN_MEMORY)} select part, count(*) as n_vertices, sum(n)::bigint as n_edges from (
  select id, part, count(src) as n from r left join pc on src = id group by id, part) group by part""",
    "cut_edges": f"{_coloured(IN_MEMORY)} select part, count(*) as n from pc join r on id = src group by part",
    "hybrid_independence": "select 0::bigint as n_clashes, count(*) as n_coloured from part",
    "verify_exact": f"{_BFS} select count(*) as n_mismatch from r where id % 7 = 0",
    "verify_tolerance": "select count(*) as n_mismatch from part where p_partkey % 7 = 0",
    "ascii_roundtrip": f"with {_PART} select src, dst, count(*) as n from pc group by src, dst",
    "ascii_csr": f"with {_PART} select src, dst, count(*) as n from pc group by src, dst",
    "convert": f"with {_PART} select src, dst, count(*) as n from pc group by src, dst",
    "two_files": f"""with recursive {_PART}, there(id) as (select 3::bigint union select dst from pc join there on src = id),
back(id) as (select 3::bigint union select src from pc join back on dst = id),
f(file, reached) as (select 0, count(*) from there union all select 1, count(*) from back)
select file::int as file, a.algorithm, true as finished, (case when a.algorithm in ('bfs', 'sssp') then reached else (select count(*) from part) end)::bigint as n_rows
from f, (values ('bfs'), ('cc'), ('sssp'), ('pagerank')) a(algorithm)""",
    "run_in_memory": f"""select 'bfs' as algorithm, count(*) as n_rows, round(sum(level)::double, 3) as total from ({_BFS} select level from r)
union all select 'cc', count(*), round(sum(root)::double, 3) from (with recursive {_PART}, b as (select src as a, dst as b from pc union all select dst, src from pc),
  r(id, root) using key (id) as (select p_partkey, p_partkey from part union select b.b, min(r.root) from r join b on b.a = r.id join recurring.r v on v.id = b.b where r.root < v.root group by b.b) select root from r)
union all select 'sssp', count(*), round(sum(dist)::double, 3) from ({_sssp("1")} select dist from r)
union all select 'pagerank', count(*), round(sum(rank)::double, 3) from ({_rank_in_place()})""",
    "binary_roundtrip": f"with {_EVENT} select src, dst, 2 * count(*) as n from ec group by src, dst",
    "table_roundtrip": f"{_coloured(IN_MEMORY)} select id, part from r",
}
