"""Registered queries against their SQL on the smallest tables, where these are there."""

import glob
import os

import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_queries_match_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as from '{p}'")
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q)

    def key(r):
        return tuple((x is None, f"{x:.6g}" if isinstance(x, float) else str(x)) for x in r)

    for name in ("flagship_split_census", "s1_split_document", "s2_split_random", "c2_cohorts", "g11_family_values", "p6_found"):
        df = q[name](spark, FOLDER)
        cols = sorted(df.columns)
        got = sorted(key([r[x] for x in cols]) for r in df.collect())
        rel = c.sql(sql[name])
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(x) for x in cols]
        assert got == sorted(key([r[i] for i in at]) for r in rel.fetchall()), name
    assert entry.entry(spark).count() == 3


def test_core_needs_no_optional_package():
    """With the optional folder hidden the entry point and all other modules import, and their queries are there."""
    import subprocess
    import sys

    code = """
import importlib, pkgutil, sys
sys.modules["lapidary.llm"] = None
import __spark_entry__ as entry, lapidary
for m in pkgutil.walk_packages(lapidary.__path__, "lapidary."):
    if not m.name.startswith("lapidary.llm"):
        importlib.import_module(m.name)
assert set(entry.oracle_sql()) <= set(entry.queries()) and "flagship_split_census" in entry.queries() and "p1_found" not in entry.queries()
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=300)
