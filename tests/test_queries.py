"""Every registered query against its SQL on the smallest tables."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from objcat.queries.fixtures import TABLES
from tools.agree import bag

FOLDER = os.environ.get("OBJCAT_TESTDATA", "/root/testdata/sf0.001")
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    rows = bag(frame.columns, frame.collect())
    assert rows
    if name in ORACLE:
        result = duck.execute(ORACLE[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(frame.columns)
        assert rows == bag(columns, result.fetchall())


def test_every_operator_has_a_query():
    registered = {q.operator for q in entry._all()}
    wanted = [f"{letter}{n}" for letter, last in zip("ABCDEFGHIJKL", (13, 15, 9, 10, 16, 24, 11, 12, 10, 11, 5, 3)) for n in range(1, last + 1)]
    assert [w for w in wanted if w not in registered] == []


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["path", "objects", "bytes"] and frame.count() > 0


def test_names_are_plain():
    assert all(re.fullmatch(r"[a-z][a-z0-9_]*", name) for name in QUERIES)
