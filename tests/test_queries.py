"""Every registered query against its SQL on DuckDB, row for row."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest
from compare import compare, connection

import __spark_entry__ as entry_points
from workload.fixtures import with_views
from workload.irls import irls
from workload.oracle_views import ORACLE_VIEWS
from workload.registry import ORACLES as SQL
from workload.registry import QUERIES

# Fits need the larger folder: at the smallest size their last segments are separable.
ORACLES = {name: with_views(sql, ORACLE_VIEWS) for name, sql in SQL.items()}
FITS = {n for n, sql in ORACLES.items() if "fit_" in sql}


@pytest.fixture(scope="module")
def duck():
    open_ones = {}

    def at(sf_dir):
        if sf_dir not in open_ones:
            open_ones[sf_dir] = connection(sf_dir)
        return open_ones[sf_dir]

    return at


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())


def test_queries_stand_without_tokenizers():
    """Where a package of the training-data operators is missing, all other queries are still there."""
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    root = os.path.dirname(os.path.abspath(entry_points.__file__))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120, check=True)
    assert out.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    sf_dir = sf("0.01" if name in FITS else "0.001")
    ok, message = compare(spark, duck(sf_dir), QUERIES[name], ORACLES[name], sf_dir)
    assert ok, message
    assert "types" not in message, message
    assert not message.startswith("0 rows"), "empty result"


def test_entry(spark, sf):
    sf("0.001")
    assert entry_points.entry(spark).count() > 0


def test_sql_fit_solves_the_normal_equations():
    """The SQL fit itself, on a table whose answer is known in closed form: a 0/1 feature."""
    import duckdb

    body = irls("f", "t", ["x"]).replace("{f}", "f").replace("{t}", "t")
    rows = [(0, 1)] * 2 + [(0, 0)] * 6 + [(1, 1)] * 5 + [(1, 0)] * 5
    values = ", ".join(f"({x}, {y})" for x, y in rows)
    sql = f"with recursive t(x, y) as (values {values}), f as ({body}) select b0, b1 from f order by step desc limit 1"
    b0, b1 = duckdb.connect().execute(sql).fetchall()[0]
    from math import log

    assert b0 == pytest.approx(log(2 / 6)) and b1 == pytest.approx(-log(2 / 6))
