import os

import duckdb
import pytest

import __spark_entry__ as entry


def norm(p):
    def cell(v):
        if v is None or v != v:
            return ""
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(cell, r)) for r in p[sorted(p.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) & set(entry.queries())))
def test_against_sql(spark, tiny, name):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in os.listdir(tiny):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{tiny}/{f}')")
    got, want = entry.queries()[name](spark, tiny).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got) == norm(want)


def test_entry(spark, tiny):
    assert entry.entry(spark).count() > 0


def test_core_needs_no_llm():
    root = os.path.join(os.path.dirname(entry.__file__), "tieout")
    for base, _, files in os.walk(root):
        if os.sep + "llm" in base:
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(base, f)) as h:
                    assert "tieout.llm" not in h.read(), f
