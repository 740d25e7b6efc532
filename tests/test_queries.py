"""Every registered engine query runs, and equals its SQL in DuckDB."""

import os

import duckdb
import pytest

from fieldloom.plans import catalog
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def same(a, b):
    return a == b or (a is None and b is None)


def rows(records):
    return sorted((tuple(r) for r in records), key=repr)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in ("refine_step", "refine_chain")])
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SMALL)
    got = df.collect()
    if name in catalog.ORACLE_SQL:
        want = duck.sql(catalog.ORACLE_SQL[name])
        columns = sorted(df.columns)
        table = want.to_arrow_table().to_pylist()
        assert sorted(table[0] if table else df.columns) == columns
        assert rows([r[c] for c in columns] for r in got) == rows([r[c] for c in columns] for r in table)
    else:
        assert got


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
def test_refine_step_gives_all_output_months(spark, monkeypatch):
    all_days = catalog.fx.days
    monkeypatch.setattr(catalog.fx, "days", lambda *a: all_days(*a).filter("year = 1995 and day(day) < 3"))
    got = catalog.QUERIES["refine_step"](spark, SMALL).selectExpr("month(day) AS month").distinct().collect()
    assert sorted(r["month"] for r in got) == [5, 6, 7, 8, 9]
