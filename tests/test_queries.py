"""Every query with SQL against DuckDB, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = {k: v for k, v in __spark_entry__.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}
# at this size (l_orderkey, l_partkey, l_suppkey, l_linenumber) and region names are unique too


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    got = sorted(repr([norm(v) for v in r]) for r in df.select(*[f"`{c}`" for c in sorted(df.columns)]).collect())
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    columns = ", ".join(f'"{c}"' for c in sorted(df.columns))
    want = sorted(repr([norm(v) for v in r]) for r in duck.sql(f"SELECT {columns} FROM ({SQL[name]})").fetchall())
    assert got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["name", "barcode", "n"]
