"""Every query with SQL gives the same rows as DuckDB; the others give rows."""

import pytest
from oracle import connect, difference

from tidemark.plans import registry

SF = "/root/testdata/sf0.01"
ENTRIES = registry.entries()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n, (_, s) in ENTRIES.items() if s])
def test_same_as_sql(spark, duck, name):
    query, sql = ENTRIES[name]
    assert difference(query(spark, SF).toPandas(), duck.sql(sql).df()) == ""


@pytest.mark.parametrize("name", [n for n, (_, s) in ENTRIES.items() if not s])
def test_rows(spark, name):
    assert ENTRIES[name][0](spark, SF).count() > 0


def test_entry(spark):
    assert registry.entry(spark, "/root/testdata/sf0.001").count() > 0
