"""Registered queries against their SQL, row by row, and the driver's contract."""

import os
from collections import Counter

import pytest

import __spark_entry__ as entry
from nasaq.plans.oracles import ORACLE_SQL
from nasaq.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(path := f"{SF}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return c


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types)))
    assert {c: KINDS[k] for c, k in got.dtypes} == kinds
    a = Counter(tuple(r) for r in got.select(*cols).collect())
    b = Counter(want.select(", ".join(f'"{c}"' for c in cols)).fetchall())
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])


def test_queries_without_sql_give_rows(spark):
    for name in sorted(set(QUERIES) - set(ORACLE_SQL)):
        assert QUERIES[name](spark, SF).count(), name


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
