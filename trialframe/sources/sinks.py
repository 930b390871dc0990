"""Sinks. Spark's commit protocol makes a write whole; what replaces rows rewrites only their partitions."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import redacted
from .readers import BadInput


def upsert(rows: DataFrame, path: str, key: list[str], partition: str, keep: tuple[str, ...] = ()) -> None:
    """Rows replace those with their key, in the partitions that they touch; ``keep`` columns stay as first written (a round's created_at)."""
    spark = rows.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        rows.write.partitionBy(partition).parquet(path)
        return
    old = spark.read.parquet(path).select(*rows.columns)
    old = old.join(rows.select(partition).distinct(), partition, "left_semi").select(*rows.columns)
    new = rows
    if keep:
        first = old.select(*key, *(F.col(c).alias(f"_{c}") for c in keep))
        new = new.join(first, key, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in keep else F.col(c) for c in rows.columns))
    whole = old.join(rows.select(*key), key, "left_anti").select(*rows.columns).unionByName(new.select(*rows.columns))
    # what is read is also what is overwritten: the new version is written beside it first
    beside = f"{path}.next"
    whole.write.mode("overwrite").parquet(beside)
    spark.read.parquet(beside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    q = spark._jvm.org.apache.hadoop.fs.Path(beside)
    q.getFileSystem(spark._jsc.hadoopConfiguration()).delete(q, True)


def register_run(run: DataFrame, path: str) -> None:
    """Adds runs whose id is new; one that is there must have the same configuration, byte for byte."""
    spark = run.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        there = spark.read.parquet(path).select("run_id", F.col("config_json").alias("was"))
        other = run.join(there, "run_id").filter(~F.col("config_json").eqNullSafe(F.col("was"))).limit(1).collect()
        if other:
            raise BadInput(f"run {other[0]['run_id']!r} is registered with another configuration")
        run = run.join(there, "run_id", "left_anti")
    run.write.mode("append").parquet(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Appends JSON lines."""
    rows.write.mode("append").json(path)


def write_document(path: str, document: dict) -> None:
    """One small JSON document, replaced as a whole; NaN and infinities are errors."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(document, f, ensure_ascii=False, allow_nan=False)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def write_jsonl(rows: DataFrame, path: str) -> None:
    """JSON lines, written whole; a NaN or infinity is an error."""
    for c, kind in rows.dtypes:
        if kind in ("double", "float"):
            bad = F.isnan(c) | (F.abs(c) == float("inf"))
            rows = rows.withColumn(c, F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(f"{c} is not finite")).cast(kind)).otherwise(F.col(c)))
    rows.write.json(path)


def write_csv(rows: DataFrame, path: str, secrets: list[str] = ()) -> None:
    """A report as one CSV file with a header, redacted. Reports have a few dozen rows; anything larger should be written without ``coalesce``."""
    shown = [redacted(F.col(c), secrets).alias(c) if kind == "string" else F.col(c) for c, kind in rows.dtypes]
    rows.select(*shown).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown(title: str, rows: DataFrame, most: int = 1000) -> str:
    """A small report as a Markdown table; null is N/A."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise BadInput(f"a table of more than {most} rows is not a report")
    cell = lambda v: "N/A" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in got]) + "\n"


#: The sections of a report, by the names of their files.
SECTIONS = (
    ("pass_rates", "1. Benchmark Pass Rates vs Paper DeepSeek-R1 Baseline"), ("bug_distribution", "2. Bug Distribution & Resolution (Taxonomy A.1 to C.4)"), ("repair_success_rate", "3. Repair Success Rate (RSR)"),
    ("bug_evolution_matrix", "4. Bug Evolution Matrix (Figure 7: R0 -> R1 Transition)"), ("code_statistics", "5. Code Quality & Complexity vs Canonical Solutions"), ("token_and_cost_summary", "6. Resource Utilization & Token Costs"),
)


def report_document(tables: dict[str, DataFrame], heads: dict[str, str]) -> str:
    """Title, what the run was, and the six sections."""
    top = ["# Measured Benchmark Report", "", *(f"- **{k}**: `{v}`" for k, v in heads.items()), ""]
    return "\n".join(top) + "\n" + "\n".join(markdown(title, tables[name]) for name, title in SECTIONS)


def write_report(tables: dict[str, DataFrame], folder: str, secrets: list[str] = ()) -> None:
    """One CSV file for each table, in folders named like them."""
    for name, _ in SECTIONS:
        write_csv(tables[name], f"{folder}/{name}.csv", secrets)


def exported(rows: DataFrame, *columns: str) -> DataFrame:
    """Each row as a JSON text."""
    return rows.select(F.to_json(F.struct(*(columns or rows.columns))).alias("json"))


def jdbc_append(rows: DataFrame, url: str, table: str) -> None:
    """Appends to a table of a database, with a driver on the class path."""
    rows.write.format("jdbc").option("url", url).option("dbtable", table).mode("append").save()


#: What ``described`` holds: path to (length, time of change) and description.
_DESCRIBED: dict[str, tuple[tuple[int, int], object]] = {}


def described(path: str, describe):
    """K6: ``describe(path)`` of a driver's file, made anew only if its length or time of change differ from the last time."""
    at = os.stat(path)
    key = (at.st_size, at.st_mtime_ns)
    if path not in _DESCRIBED or _DESCRIBED[path][0] != key:
        _DESCRIBED[path] = (key, describe(path))
    return _DESCRIBED[path][1]


def no_sessions_left(spark: SparkSession) -> None:
    """Drops what catalog queries have cached (K6)."""
    spark.catalog.clearCache()
