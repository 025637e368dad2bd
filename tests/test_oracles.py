"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck
from fichaflow.plans import registry

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQLS = registry.QUERIES, registry.ORACLES


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQLS)
    assert set(QUERIES) <= set(entry.queries()) and set(SQLS) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["machine_id", "date", "income"] and df.count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, FOLDER, QUERIES[name], SQLS[name]) is None
