from __future__ import annotations

import math
import os

import duckdb
import pytest

from folioflow.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, list | tuple) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[k]) for k in order) for r in found.fetchall())


def test_line_cluster_keeps_every_word(spark):
    words = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert sum(len(r.text.split()) for r in QUERIES["line_cluster"](spark, DATA).collect()) == words


def test_entry_point():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
