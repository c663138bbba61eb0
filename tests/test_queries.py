"""Every query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest
from quarryline import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def canonical(rows):
    def text(v):
        if isinstance(v, float) and v.is_integer():
            v = int(v)
        return "~" if v is None else str(v)

    return sorted(tuple(map(text, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    names = sorted(got.columns)
    wanted = duck.sql(SQL[name])
    assert sorted(wanted.columns) == names
    order = [wanted.columns.index(c) for c in names]
    assert canonical(got.select(*[f"`{c}`" for c in names]).collect()) == canonical([tuple(r[i] for i in order) for r in wanted.fetchall()])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).columns


def test_rows_survive_enrichment(spark):
    rows = registry.queries()["enriched_feed"](spark, SF)
    part = spark.read.parquet(f"{SF}/part.parquet")
    assert rows.count() == part.count() == rows.select("row_index").distinct().count()
    assert rows.where("confidence < 0 OR confidence > 1").isEmpty()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
