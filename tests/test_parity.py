"""Every query with SQL gives what DuckDB gives on sf0.001."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from trialframe import registry

SF = "/root/testdata/sf0.001"


def shown(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = sorted(tuple(shown(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name in registry.oracle_sql():
        r = duck.execute(registry.oracle_sql()[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == sorted(df.columns)
        assert got == sorted(tuple(shown(x[names.index(c)]) for c in sorted(names)) for x in r.fetchall())
