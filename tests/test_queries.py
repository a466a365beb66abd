"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from fleet_queries.check import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    line, ok, _ = compare(spark, con, name, QUERIES[name], ORACLE.get(name), SF)
    assert ok, line


def test_every_query_has_sql():
    """Every query of the library has check SQL; of the others, only those SQL can express."""
    assert {q for q in QUERIES if not q.startswith("op") and q != "pipeline"} <= set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["scan_id", "artifact_type", "flagged", "review", "clear", "worst_score"] and df.count() > 0
