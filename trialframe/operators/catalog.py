"""The catalog of runs: order, status, pages, comparability, validation."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: identifiers that runs may have.
RUN_ID = r"\A[A-Za-z0-9][A-Za-z0-9_.-]{0,99}\z"
PAGE, TAIL = 50, 200
#: States in which a run has ended, and modes that a manifest may name.
TERMINAL, LLM_MODES = ("completed", "failed", "cancelled"), ("mock", "live")
MANIFEST = "start_time string, repair_mode string, feedback_regime string, k int, model string, sample_size int, llm_mode string, dataset_sha256 string, generation_cache struct<sha256:string>, seed int, completed boolean"


def listed(runs: DataFrame) -> DataFrame:
    """K1: runs with a valid id, by start time (or folder time) from the newest, ties by id from the last; ``place`` is the order."""
    key = F.coalesce("started_at", "folder_time") if "folder_time" in runs.columns else F.col("started_at")
    ok = runs.filter(F.col("run_id").rlike(RUN_ID)).withColumn("key", key)
    # one list over all runs: it has a row for each run, not for each record of a run
    return ok.withColumn("place", F.row_number().over(Window.orderBy(F.desc("key"), F.desc("run_id"))).cast("long"))


def status() -> Column:
    """K2: active before a terminal sidecar, before the manifest's ``completed``; without a manifest a summary file tells a finished run."""
    by_manifest = F.when(F.coalesce("completed", F.lit(False)), "completed").otherwise("failed")
    return F.when(F.col("active"), "running").when(F.col("sidecar").isin(*TERMINAL), F.col("sidecar")).when(F.col("has_manifest"), by_manifest).when(F.col("has_summary"), "completed").otherwise("failed")


def rsr_list(json: Column | str) -> Column:
    """K3: array of rates from JSON, or null if any element is malformed: three whole numbers, and ``pct`` that is there as a number or null."""
    c = F.col(json) if isinstance(json, str) else json
    parsed, keys = F.from_json(c, "array<struct<iteration:int,num:int,den:int,pct:double>>"), F.from_json(c, "array<map<string,string>>")
    whole = F.forall(parsed, lambda x: x["iteration"].isNotNull() & x["num"].isNotNull() & x["den"].isNotNull())
    stated = F.forall(F.arrays_zip(parsed.alias("x"), keys.alias("m")), lambda z: F.map_contains_key(z["m"], "pct") & (z["m"]["pct"].isNull() | z["x"]["pct"].isNotNull()))
    return F.when(whole & stated, parsed)


def run_items(runs: DataFrame, manifests: DataFrame, summaries: DataFrame) -> DataFrame:
    """One row of 14 columns for each run. ``runs``: run_id, active, sidecar, has_summary; the others: run_id and the JSON text, if a run has one."""
    m = manifests.select("run_id", F.from_json("manifest", MANIFEST).alias("m")).filter("m is not null").dropDuplicates(["run_id"])
    s = summaries.select("run_id", F.get_json_object("summary", "$.rsr").alias("rsr_json")).dropDuplicates(["run_id"])
    j = runs.select("run_id", "active", "sidecar", "has_summary").join(m, "run_id", "left").join(s, "run_id", "left").withColumn("has_manifest", F.col("m").isNotNull()).withColumn("completed", F.col("m.completed"))
    plain = ("start_time", "repair_mode", "feedback_regime", "k", "model", "sample_size", "dataset_sha256", "seed")
    return j.select(
        "run_id", F.when(F.col("has_manifest"), "manifest").otherwise("legacy").alias("provenance"), status().alias("status"), rsr_list("rsr_json").alias("rsr"), *(F.col(f"m.{c}").alias(c) for c in plain),
        F.when(F.col("m.llm_mode").isin(*LLM_MODES), F.col("m.llm_mode")).alias("llm_mode"), F.col("m.generation_cache.sha256").alias("generation_cache_sha256"),
    )


def page(entries: DataFrame, number: int, size: int = PAGE, order: str = "ord") -> DataFrame:
    """K4: the rows of a page, from 1, of one log in order of writing; none beyond the last."""
    first = entries.orderBy(order).limit(number * size)  # a top-n; only these rows are numbered
    return first.withColumn("row", F.row_number().over(Window.orderBy(order)).cast("long")).filter(F.col("row") > (number - 1) * size)


def tail(lines: DataFrame, size: int = TAIL, order: str = "ord") -> DataFrame:
    """K5: the last lines."""
    return lines.orderBy(F.desc(order)).limit(size)


def warnings(runs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """K7: fields that have several display values among the runs; null and blank are one, "not available"."""
    shown = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("not available"))
    tall = runs.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), shown(c).alias("value")) for c in fields))).alias("x")).select("x.*")
    g = tall.groupBy("field").agg(F.collect_set("value").alias("v"), F.count("*").alias("n"))
    return g.filter((F.col("n") > 1) & (F.size("v") > 1)).select("field", F.array_join(F.array_sort("v"), ", ").alias("values"))


def max_iterations(runs: DataFrame) -> DataFrame:
    """K8: the most iterations of any run, at least 1."""
    return runs.agg(F.greatest(F.lit(1), F.coalesce(F.max(F.greatest("k", "last_iteration")), F.lit(1))).cast("long").alias("iterations"))


def reordered(values: Column, states: Column, wanted: tuple[str, ...] = ("A", "B", "C", "PASS")) -> Column:
    """Values by state in the wanted order, null where a state is missing."""
    return F.array(*(F.get(values, F.nullif(F.array_position(states, s), F.lit(0)).cast("int") - 1) for s in wanted))


def mismatches(caches: DataFrame, wanted: dict) -> DataFrame:
    """cache_id and every compared field whose value is not exactly the wanted one; a missing field is a mismatch, and a boolean equals no number."""
    differs = [F.when(~F.col(c).cast("string").eqNullSafe(F.lit(v).cast("string")) | F.col(c).isNull(), c) for c, v in wanted.items()]
    return caches.select("run_id", F.array_join(F.array_compact(F.array(*differs)), ",").alias("fields"))


def problems(settings: DataFrame, surface: str = "api") -> DataFrame:
    """Settings outside their bounds: ``api`` and ``web`` give all of them in order, ``cli`` the first."""
    top_k, hot = (3, 1.0) if surface == "web" else (10, 2.0)
    k = (F.col("k") < 1) if surface == "cli" else ~F.col("k").between(1, top_k)
    checks = [F.when(F.col("k").isNull() | k, "k"), F.when(~F.col("temperature").between(0, hot), "temperature")]
    if surface != "web":
        checks.append(F.when(~F.col("n").between(1, 10000), "n"))
    found = F.array_compact(F.array(*checks))
    return settings.select("run_id", F.array_join(F.slice(found, 1, 1) if surface == "cli" else found, ",").alias("problems"))


def iteration_count() -> Column:
    """Of the summary's configuration, else the manifest, else the most seen, else 0."""
    return F.coalesce("summary_k", "manifest_k", "seen_k", F.lit(0))


def guarded(root: str, relative: str) -> str:
    """The path of ``relative`` under the driver's folder ``root``; an error for absolute paths, drive letters, control and invalid characters, segments that start with a space or end with one or a dot, and whatever leads out by ``..`` or a link."""
    if not root.strip() or not relative.strip():
        raise ValueError("no path")
    if re.search(r'[<>:"|?*\x00-\x1f\x7f-\x9f]', relative) or relative[0] in "/\\":
        raise ValueError("not a relative path without drive letters or invalid characters")
    parts = [p for p in re.split(r"[/\\]", relative) if p not in ("", ".")]
    if any(p != ".." and (p[0] == " " or p[-1] in " .") for p in parts):
        raise ValueError("a segment starts with a space or ends with a space or a dot")
    top = os.path.abspath(root)
    full = os.path.normpath(os.path.join(top, *parts))
    inside = lambda path, folder: path != folder and os.path.commonpath([path, folder]) == folder
    if not inside(full, top) or not inside(os.path.realpath(full), os.path.realpath(top)):
        raise ValueError("leads out of the folder")
    return full
