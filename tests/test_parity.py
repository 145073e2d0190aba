"""Every registered query that has SQL gives the same rows as that SQL; the others run."""

import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()
DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 7)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.isoformat()[:19] if hasattr(v, "isoformat") else v


def rows(names, got):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([(names[i], plain(r[i])) for i in order]) for r in got)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", [n for n in SQL if not re.match(r"p\d+_", n)])
def test_same_rows_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    rel = duck.execute(SQL[name])
    want = rows([c[0] for c in rel.description], rel.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want


@pytest.mark.parametrize("name", ["p7_found", "p7_changed", "p7_committed_runs", "p7_gaps"])
def test_incremental_queries(spark, duck, name):
    test_same_rows_as_sql.__wrapped__(spark, duck, name) if hasattr(test_same_rows_as_sql, "__wrapped__") else test_same_rows_as_sql(spark, duck, name)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
