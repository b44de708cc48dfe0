"""Every registered query against its SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as contract
from logweir.plans.oracles import statements
from logweir.plans.queries import registered

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def test_every_log_query_has_sql():
    assert set(registered()) == set(statements())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).columns == ["message_prefix", "entries"]


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    def order(found):
        return sorted(found, key=lambda row: [(x is None, str(x)) for x in row])

    result = contract.queries()[name](spark, SF)
    columns = sorted(result.columns)
    got = order(tuple(r) for r in result.select(*columns).collect())
    cursor = duck.execute(contract.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == order(tuple(r[i] for i in at) for r in cursor.fetchall())
