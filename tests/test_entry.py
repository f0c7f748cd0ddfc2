from __future__ import annotations

import subprocess
import sys

import __spark_entry__ as entry
from tests.conftest import ROOT
from vertexloom import queries


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) <= set(entry.queries())


def test_import_needs_no_session():
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(); e.oracle_sql()"], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_entry_runs(spark):
    rows = sorted(map(tuple, entry.entry(spark).collect()))
    assert rows == [(1, 1), (2, 26), (3, 167), (4, 6)]
