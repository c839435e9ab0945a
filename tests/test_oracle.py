"""Every registered query with SQL gives the rows DuckDB gives."""

import oracle
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(spark, sf):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    yield oracle.connect(sf)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    assert oracle.compare(name, entry.queries()[name](spark, sf), con, SQL[name]) == []


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() == 7
    assert df.columns == ["year", "mean", "max", "min", "phase"]


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())
