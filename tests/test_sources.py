from __future__ import annotations

import numpy as np
import pytest

from tests.graphs import random_graph
from tests.test_graph_operators import make
from vertexloom import cli
from vertexloom.operators.coloring import hybrid_coloring
from vertexloom.sources import binary, dimacs

EDGES = [(3, 3), (3, 0), (3, 0), (0, 1), (1, 4)]


def rows(df):
    return sorted((r["src"], r["dst"]) for r in df.collect())


def test_ascii_round_trip(spark, tmp_path):
    g = make(spark, 6, EDGES)
    dimacs.write_graph(g, str(tmp_path / "g.gr"))
    back = dimacs.read_graph(spark, str(tmp_path / "g.gr"))
    assert rows(back.edges) == sorted(EDGES) and back.vertices.count() == 6
    assert {r["id"]: r["nbrs"] for r in dimacs.read_csr(spark, str(tmp_path / "g.gr")).collect()}[3] == [0, 0, 3]


def test_ascii_as_one_file(spark, tmp_path):
    dimacs.write_file(make(spark, 6, EDGES), str(tmp_path / "one.gr"))
    lines = (tmp_path / "one.gr").read_text().splitlines()
    assert lines[0] == "p sp 6 5" and lines[1:] == [f"a {a + 1} {b + 1} 1" for a, b in sorted(EDGES)]
    assert rows(dimacs.read_graph(spark, str(tmp_path / "one.gr")).edges) == sorted(EDGES)


def test_numbers_beyond_the_format_are_refused():
    assert binary.as_ints([2**31 - 1, -(2**31)]).dtype == np.int32
    for n in (2**31, -(2**31) - 1):
        with pytest.raises(OverflowError):
            binary.as_ints(np.array([0, n]))


def test_ascii_oddities(spark, tmp_path):
    (tmp_path / "short.gr").write_text("c note\np sp 3 5\na 2 1 7\na 1 3 9\n")
    with pytest.warns(UserWarning, match="5 edges"):
        g = dimacs.read_graph(spark, str(tmp_path / "short.gr"))
    assert rows(g.edges) == [(0, 2), (1, 0)] and {r["weight"] for r in g.edges.collect()} == {1}
    for text in ("p sp 0 1\na 1 1 1\n", "a 1 2 1\n"):
        (tmp_path / "bad.gr").write_text(text)
        with pytest.raises(ValueError):
            dimacs.read_graph(spark, str(tmp_path / "bad.gr"))


def test_binary_layouts(spark, tmp_path):
    g = make(spark, 6, EDGES)
    binary.write_graph(g, str(tmp_path / "g.bin"))
    begin = [0, 1, 2, 2, 5, 5, 5]
    got = np.fromfile(tmp_path / "g.bin", np.int32).tolist()
    assert got == [40, 4, 6, 5, *begin, 0, 1, 3, 3, 3, 1, 4, 0, 0, 3]
    binary.write_csr(g, str(tmp_path / "g.csr"))
    assert np.fromfile(tmp_path / "g.csr", np.int32).tolist() == [24, 4, 6, 5, *begin, 1, 4, 0, 0, 3]
    for back in (binary.read_graph(spark, str(tmp_path / "g.bin")), binary.read_csr(spark, str(tmp_path / "g.csr"))):
        assert rows(back.edges) == sorted(EDGES) and back.vertices.count() == 6
    with pytest.raises(ValueError):
        binary.read_graph(spark, str(tmp_path / "g.csr"))
    (tmp_path / "cut.bin").write_bytes((tmp_path / "g.bin").read_bytes()[:-4])
    with pytest.raises(ValueError):
        binary.read_graph(spark, str(tmp_path / "cut.bin"))


def test_small_slices_meet_at_every_edge(spark, tmp_path, monkeypatch):
    g = make(spark, 6, EDGES)
    binary.write_csr(g, str(tmp_path / "g.csr"))
    reader = binary._Reader(str(tmp_path / "g.csr"), binary.LISTS)
    found = []
    for low in range(5):
        for batch in reader.read(binary._Range(low, low + 1)):
            found += list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    assert sorted(found) == sorted(EDGES)


def test_files_by_uri_and_with_no_half_of_one(spark, tmp_path, monkeypatch):
    g = make(spark, 6, EDGES)
    uri = f"file://{tmp_path}/by_uri.bin"
    binary.write_graph(g, uri)
    assert rows(binary.read_graph(spark, uri).edges) == sorted(EDGES)
    dimacs.write_file(g, f"file://{tmp_path}/by_uri.gr")
    assert rows(dimacs.read_graph(spark, f"file://{tmp_path}/by_uri.gr").edges) == sorted(EDGES)
    parts = binary._parts(g.edges.select("src", "dst"), "src", "dst")
    assert parts.rows == 5
    before = sorted(p.name for p in tmp_path.iterdir())
    lost = [*parts.files[0], "not-there.ints"]
    with pytest.raises(Exception, match="not-there"):
        binary.assemble(spark, str(tmp_path / "half.bin"), [[1, 2], (parts.folder, lost)])
    assert sorted(p.name for p in tmp_path.iterdir()) == before
    large = make(spark, 3, [(0, 1), (1, 2), (2, 2**31)])
    with pytest.raises(Exception, match="32-bit"):
        binary.write_graph(large, str(tmp_path / "large.bin"))
    gap = make(spark, 3, [(0, 1)])
    with pytest.raises(ValueError):
        binary.write_graph(type(g)(gap.vertices.where("id != 1"), gap.edges.where("src = 0")), str(tmp_path / "gap.bin"))
    assert sorted(p.name for p in tmp_path.iterdir()) == before


def test_parts_of_many_ranges_keep_their_order(spark, tmp_path):
    n, e = random_graph(12, 500, 3000)
    conf = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        binary.write_graph(make(spark, n, e + [(7, i) for i in range(400)]), str(tmp_path / "g.bin"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = np.fromfile(tmp_path / "g.bin", np.int32)
    src, dst = got[5 + n : 5 + n + 3400], got[5 + n + 3400 :]
    assert list(zip(src.tolist(), dst.tolist(), strict=True)) == sorted(e + [(7, i) for i in range(400)])
    assert (got[4 : 5 + n] == np.searchsorted(src, np.arange(n + 1))).all()


@pytest.mark.parametrize("kind", ["graph", "lists"])
def test_bounds_of_sources_are_read_only(spark, tmp_path, monkeypatch, kind):
    n, e = random_graph(13, 50, 400)
    path = str(tmp_path / "g")
    (binary.write_graph if kind == "graph" else binary.write_csr)(make(spark, n, e), path)
    edges = (binary.read_graph if kind == "graph" else binary.read_csr)(spark, path).edges
    for where, keep in (("src between 10 and 12", lambda a: 10 <= a <= 12), ("src > 47", lambda a: a > 47), ("src = 3 and dst > 5", lambda a: a == 3), ("src < 2", lambda a: a < 2), ("src > 99", lambda a: False), ("src < -1", lambda a: False)):
        assert rows(edges.where(where)) == sorted(x for x in e if keep(x[0]) and ("dst" not in where or x[1] > 5))
        reader = binary._Reader(path, binary.GRAPH if kind == "graph" else binary.LISTS)
        bounds = {"src between 10 and 12": [binary.GreaterThanOrEqual(("src",), 10), binary.LessThanOrEqual(("src",), 12)], "src > 47": [binary.GreaterThan(("src",), 47)]}.get(where)
        if bounds:
            assert list(reader.pushFilters(bounds)) == bounds
            assert sum(p.high - p.low for p in reader.partitions()) == sum(keep(a) for a, _ in e)


def test_partition_table(spark, tmp_path):
    g = make(spark, 6, EDGES)
    c = hybrid_coloring(g, 3)
    binary.write_table(g, c, str(tmp_path / "t"), 3)
    want = {r["id"]: r["part"] for r in c.collect()}
    assert {r["id"]: r["part"] for r in binary.read_table(spark, str(tmp_path / "t")).collect()} == want
    raw = np.fromfile(tmp_path / "t", np.int32).tolist()
    assert raw[:5] == [48, 4, 6, 5, 3] and sum(raw[5:8]) == 6 and sum(raw[8:11]) == 5
    assert raw[17:] == sorted(range(6), key=lambda v: (want[v], v))


def test_command_line(spark, tmp_path, capsys):
    dimacs.write_graph(make(spark, 6, EDGES), str(tmp_path / "g.gr"))
    cli.main(["convert", str(tmp_path / "g.gr"), str(tmp_path / "g.bin")])
    cli.main(["run", "--mode", "out-of-core", "--out", str(tmp_path / "out"), str(tmp_path / "g.bin")])
    said = capsys.readouterr().out
    assert "bfs" in said and "steps" in said and "max_level" not in said
    cli.main(["run", "--report", str(tmp_path / "g.bin"), str(tmp_path / "g.bin")])
    said = capsys.readouterr().out
    assert said.count("max_level") == said.count("n_components") == 2
    assert spark.read.parquet(str(tmp_path / "out/bfs")).count() == 4
