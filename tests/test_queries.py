"""Every registered query against its SQL twin, on the smallest tables."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as contract
from benchloom.plans import ORACLES, QUERIES
from tools.check_oracle import normal

FOLDER = pathlib.Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="benchmark tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in sorted(FOLDER.glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, str(FOLDER))
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    relation = duck.execute(ORACLES[name])
    assert got == normal([d[0] for d in relation.description], relation.fetchall())


def test_entry(spark):
    assert contract.entry(spark).columns == ["run_id", "feature", "value"]


def test_every_twin_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.queries())
