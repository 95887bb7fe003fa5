"""Every registered query of the sequence engine against its SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from kinstrand.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        path = f"{SF}/{name}" + ("/*.parquet" if os.path.isdir(f"{SF}/{name}") else "")
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return value


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    found = catalogue.queries()[name](spark, SF)
    cursor = sql.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    order = sorted(columns)
    left = sorted((tuple(plain(r[c]) for c in order) for r in found.collect()), key=str)
    right = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in cursor.fetchall()), key=str)
    assert left == right


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
