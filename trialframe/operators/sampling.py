"""Sampling and preparation of problems."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_cohort(rows: DataFrame, key: str, n: int, seed: int, most: int = 1_000_000) -> list[str]:
    """Q1, R6 exact: distinct ids in code-point order; all if there are at most ``n``, else a seeded sample of the standard generator, sorted. It needs all ids on the driver: more than ``most`` is an error, and ``hashed_cohort`` is the way."""
    ids = [r[0] for r in rows.select(F.col(key).cast("string")).distinct().limit(most + 1).collect()]
    if len(ids) > most:
        raise ValueError(f"more than {most} ids; use hashed_cohort")
    ids.sort()
    return ids if n >= len(ids) else sorted(random.Random(seed).sample(ids, n))


def _order(key: str, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)


def hashed_cohort(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Q1, Q2 at scale: the ``n`` ids with the smallest seeded hashes; a top-n, so no full sort. Not the sample of ``exact_cohort``."""
    return rows.orderBy(_order(key, seed)).limit(n)


def stratified(rows: DataFrame, tier: str, key: str, n: int, seed: int) -> DataFrame:
    """Q3: ``n`` of each tier by seeded hash."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(tier).orderBy(_order(key, seed))).cast("long")).filter(F.col("place") <= n)


def visible(cases: DataFrame, first: int = 3) -> DataFrame:
    """Q4: a task's visible cases: those whose input its prompt holds, else the first ones; (task_id, no, input, prompt)."""
    hit = F.col("prompt").contains(F.col("input"))
    some = F.bool_or(hit).over(Window.partitionBy("task_id"))
    return cases.withColumn("is_visible", F.when(some, hit).otherwise(F.col("no") <= first))


def partitioned_cases(cases: DataFrame) -> DataFrame:
    """Q5: the indices of each outcome of a task."""
    g = cases.groupBy("task_id", "outcome").agg(F.array_sort(F.collect_list("no")).alias("no"))
    return g.select("task_id", "outcome", F.array_join("no", ",").alias("indices"))


def case_literal(text: str, most: int = 4096) -> Column:
    """Q7: a quoted literal, or the hash of a long text."""
    c = F.col(text)
    quoted = F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n"))
    return F.when(F.length(c) > most, F.concat(F.lit("sha256:"), F.sha2(c, 256))).otherwise(F.concat(F.lit("'"), quoted, F.lit("'")))


def duplicate_ids(tasks: DataFrame, key: str = "task_id") -> DataFrame:
    """Ids that occur more than once."""
    return tasks.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def of_tiers(problems: DataFrame, tiers: list[str], column: str = "difficulty") -> DataFrame:
    """Problems of the tiers, in any case; a filter that reaches the scan."""
    return problems.filter(F.lower(column).isin(*(t.lower() for t in tiers)))


def lookup(problems: DataFrame, name: str, *columns: str) -> DataFrame:
    """The first problem whose id, in any case and under any of its names, is ``name``."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | (F.lower(c) == name.lower())
    return problems.filter(hit).orderBy(*columns).limit(1)
