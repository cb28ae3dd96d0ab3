"""Every registered query against its oracle in DuckDB, on the smallest tables; no optional parts."""

import os

import duckdb
import pytest
from freightgraph.plans import registry
from freightgraph.plans.tables import Tables

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def canon(df):
    def cell(v):
        if v is None or v != v or str(v) in ("NaT", "<NA>"):
            return "~"
        if hasattr(v, "item") and not hasattr(v, "isoformat"):
            v = v.item()
        return str(v) if isinstance(v, (bool, str)) or hasattr(v, "isoformat") else repr(round(float(v), 6) + 0.0)

    return sorted(tuple(map(cell, row)) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name in registry.ORACLES:
        want = duck.sql(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canon(got) == canon(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(registry.ORACLES) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert os.path.isdir(DATA)


def test_checks_find_something(spark):
    run = lambda name: registry.QUERIES[name](spark, DATA)
    assert {"id collision", "unknown banned country", "unknown mode"} <= {r["check"] for r in run("d9_check_airspace").collect()}
    assert run("d5_check_coverage").count() > 0 and run("d15_audit_medium").count() > 0 and run("n8_needs_geometry").count() > 0
    sea = Tables(spark, DATA).f_edge.where("mode = 'sea'")
    assert run("r15_connected_components").count() == sea.select("src").union(sea.select("dst")).distinct().count()
