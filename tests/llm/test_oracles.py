"""The operators' SQL gives what their queries give, on awkward rows and on the small driver tables."""

from __future__ import annotations

import collections
import glob
import os
import random

import duckdb
import pytest

from tests.llm.test_operators import texts, words
from trialframe.llm import queries

SF = "/root/testdata/sf0.001"


def awkward(folder: str, spark) -> str:
    rng = random.Random(12)
    item = words(rng, 40)
    rows = [(d, t, f"s{i % 3}" if i % 5 else None) for i, (d, t) in enumerate(texts())]
    rows += [(300, words(rng, 20) + " " + item, "s1"), (301, " ".join(w if i % 7 else "x" for i, w in enumerate(item.split())), "s2"), (302, None, None)]
    rows += [(310 + i, f"to 9.9.9.{i % 2} quagga and key AKIA{'Q' * 20}\nx", "s0") for i in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    bench = [(1, item), (2, None), (3, ""), (4, "one"), (5, words(rng, 14)), (None, "x y"), (6, item + " more")]
    spark.createDataFrame(bench, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return folder


def views(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{files}'")
    return con


def compared(spark, folder: str, name: str) -> None:
    df = queries.queries()[name](spark, folder)
    found = views(folder).execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = collections.Counter(tuple(r[names.index(c)] for c in df.columns) for r in found.fetchall())
    assert collections.Counter(map(tuple, df.collect())) == want


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    return awkward(str(tmp_path_factory.mktemp("awkward")), spark)


@pytest.mark.parametrize("name", ["op1_pii", "op2_decontamination", "op5_secret_scan"])
def test_awkward_rows(spark, rows, name):
    compared(spark, rows, name)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_driver_tables(spark, name):
    compared(spark, SF, name)
