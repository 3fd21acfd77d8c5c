"""Every query with a SQL counterpart gives the same rows as DuckDB."""

import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import differences, oracle_connection


@pytest.fixture(scope="module")
def connection(sf_dir):
    return oracle_connection(sf_dir)


def check_plan(name, plan):
    """No product of tables, no Python per row, no window over a whole table."""
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    assert "EvalPython" not in plan
    for window in re.findall(r"Window \[.*", plan):
        assert re.search(r"\], \[[^\]]+\], \[", window), window


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_oracle(spark, sf_dir, connection, name):
    frame = queries()[name](spark, sf_dir)
    if not name.startswith(("m", "s9")):  # fitted models predict in functions of their own
        check_plan(name, frame._jdf.queryExecution().executedPlan().toString())
    problem = differences(frame, connection, oracle_sql()[name])
    assert problem is None, problem


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 10
    assert [r["n_rows"] for r in rows] == sorted((r["n_rows"] for r in rows), reverse=True)
