"""Every registered query of the library against its SQL, or for rows where it has none."""

import os

import duckdb
import pytest

from marquee.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    base = duckdb.connect()
    for name in os.listdir(SF):
        base.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return base


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, oracle, name):
    found = registry.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted((tuple(map(plain, r)) for r in found.select(*columns).collect()), key=repr)
    if name not in registry.SQL:
        assert rows
        return
    expected = oracle.sql(f"SELECT {', '.join(columns)} FROM ({registry.SQL[name]})")
    assert sorted(oracle.sql(registry.SQL[name]).columns) == columns
    assert rows == sorted((tuple(map(plain, r)) for r in expected.fetchall()), key=repr)
