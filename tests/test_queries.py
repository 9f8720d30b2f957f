"""Every registered query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CORE = entry._core()


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return f"{float(v):.6g}" if type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(CORE.ORACLES))
def test_query(spark, name):
    df = CORE.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    out = con.sql(CORE.ORACLES[name])
    at = {c: i for i, c in enumerate(out.columns)}
    assert sorted(at) == cols
    assert got == sorted(tuple(plain(r[at[c]]) for c in cols) for r in out.fetchall())


@pytest.mark.parametrize("name", sorted(set(CORE.QUERIES) - set(CORE.ORACLES)))
def test_query_runs(spark, name):
    assert CORE.QUERIES[name](spark, SF).columns


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert set(e._core().ORACLES) <= set(e._core().QUERIES)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
