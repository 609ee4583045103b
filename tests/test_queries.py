"""Every core query with SQL gives the rows of its SQL on the smallest tables; entry() and the contract hold."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from corpusql.plans import catalog, corpus, problems, retrieval

SF = "/root/testdata/sf0.001"
MODULES = (problems, catalog, retrieval, corpus)
CORE = {k: q for m in MODULES for k, q in m.QUERIES.items()}
CORE_SQL = {k: q for m in MODULES for k, q in m.SQL.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def _plain(v):
    if v is None or v is pd.NaT or isinstance(v, float) and v != v:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return tuple(_plain(x) for x in v)
    if isinstance(v, bool):
        return str(v)
    return round(float(v), 5) if isinstance(v, (int, float)) else str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(CORE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    ours = CORE[name](spark, SF)
    theirs = duck.sql(CORE_SQL[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _rows(ours.columns, [tuple(r) for r in ours.collect()]) == _rows(theirs.columns, theirs.fetchall())


def test_contract(spark):
    assert set(CORE) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["src", "row_key", "identifier", "period", "status"]


def test_core_does_not_import_llm():
    for folder, _, files in os.walk(os.path.dirname(os.path.dirname(problems.__file__))):
        if not folder.endswith("llm"):
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as text:
                        assert "corpusql.llm" not in text.read(), f
