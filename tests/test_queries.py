"""Every registered query against its SQL, over whole tables."""

import pytest

import __spark_entry__ as entry_module
from rollcall.plans import queries as registry
from compare import compare, database


@pytest.fixture(scope="module")
def connection(small_dir):
    return database(small_dir)


def test_every_query_has_sql():
    assert set(registry.registered()) <= set(entry_module.queries())
    assert set(registry.registered()) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.registered()))
def test_query_matches_sql(spark, connection, small_dir, name):
    compare(spark, connection, name, small_dir)


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0
