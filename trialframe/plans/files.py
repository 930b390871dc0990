"""Queries of groups 2.1, 2.10 and 2.11 over real files: adapters are written in a source's format and read back by its reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as r
from ..operators import trajectory as t
from ..sources import readers, sinks
from ..sources.shared import scratch
from ..streaming import logs
from ..registry import SQL, query
from . import reports


def _landed(df, name, writer=lambda w, p: w.json(p)):
    path = scratch(df.sparkSession, name)
    writer(df.write, path)
    return df.sparkSession, path


def _tasks(p):
    spark, path = _landed(p.select(F.concat(F.lit("T/"), "task_id").alias("task_id"), F.col("benchmark").alias("prompt"), F.lit("h").alias("hidden_tests")), "tasks")
    return readers.tasks(spark, path).select("task_id", "prompt")


query("s1_tasks", "a_problem_runs", _tasks, "SELECT 'T/' || task_id AS task_id, benchmark AS prompt FROM a_problem_runs")


def _evalplus(reader):
    def run(f):
        spark, path = _landed(f.select(F.concat(F.lit("T/"), "file_id").alias("task_id"), F.col("path").alias("prompt"), F.lit("!").alias("canonical_solution")), "evalplus")
        return readers.benchmark(spark, reader, path).select("task_id", "canonical_solution")

    return run


query("s2_humaneval", "a_files", _evalplus("HumanEval+"), "SELECT 'T/' || file_id AS task_id, path || '!' AS canonical_solution FROM a_files")
query("s3_mbpp", "a_files", _evalplus("mbpp_plus"), "SELECT 'T/' || file_id AS task_id, '!' AS canonical_solution FROM a_files")


def _apps(p):
    spark, path = _landed(p.filter("sub_tier is not null").select(F.col("task_id").cast("string").alias("problem_id"), F.col("sub_tier").alias("difficulty")), "apps")
    return readers.benchmark(spark, "APPS+", path).transform(lambda d: d.filter(F.lower("difficulty") == "interview")).select("problem_id", "difficulty")


query("s5_alias", "a_problem_runs", _apps, "SELECT task_id::VARCHAR AS problem_id, sub_tier AS difficulty FROM a_problem_runs WHERE lower(sub_tier) = 'interview'")


def _cache(s):
    entry = F.struct(F.col("task_id").cast("string").alias("task_id"), F.lit(True).alias("had_code_block"), F.struct((F.col("s0") == "PASS").alias("passed"), F.col("s0").alias("state")).alias("hidden"))
    # a file for each cache: no cache grows with the table
    one = s.groupBy(F.floor(F.col("task_id") / 100).alias("cache")).agg(F.collect_list(entry).alias("entries")).select(F.lit("v1").alias("schema"), F.lit("m").alias("model"), F.lit("a" * 64).alias("dataset_sha256"), F.lit("mock").alias("llm_mode"), F.lit("s").alias("generation_prompt_style"), "entries")
    return _landed(one, "cache", lambda w, p: w.option("maxRecordsPerFile", 1).json(p))


query("s11_cache", "a_steps", lambda s: readers.cache(*_cache(s)).select("task_id", "hidden.passed", "hidden.state"), "SELECT task_id::VARCHAR AS task_id, s0 = 'PASS' AS passed, s0 AS state FROM a_steps")
query("s14_caches", "a_steps", lambda s: readers.caches(*_cache(s)).select("model", "llm_mode", F.col("entries").cast("long").alias("entries")), "SELECT 'm' AS model, 'mock' AS llm_mode, count(*) AS entries FROM a_steps GROUP BY task_id // 100")


def _objects(d):
    spark, path = _landed(d.select("run_id", F.col("k").cast("int").alias("k"), "model").repartition(6, "run_id"), "objects", lambda w, p: w.partitionBy("k").option("maxRecordsPerFile", 1).json(p))
    return readers.objects(spark, f"{path}/*/*.json", "run_id string, model string").select("run_id", "model")


query("s12_objects", "a_runs", _objects, "SELECT run_id, model FROM a_runs")
query("s17_counted", "a_runs", lambda d: readers.counted(d.select("run_id"), 25), "SELECT run_id FROM a_runs")
query("s18_synthetic", "a_runs", lambda d: readers.synthetic(d.sparkSession).select("task_id"), "SELECT 'rwpb/' || i AS task_id FROM range(0, 140) t(i)")


def _datasets(d):
    path = scratch(d.sparkSession, "datasets")
    d.select("run_id").orderBy("run_id").coalesce(1).write.json(path)
    # the format names its files .json; every one of them is a dataset here
    return readers.datasets(d.sparkSession, path, "*.json").select("tasks", "sha256")


query("s13_dataset", "a_runs", _datasets, "SELECT count(*) AS tasks, sha256(string_agg('{\"run_id\":\"' || run_id || '\"}' || chr(10), '' ORDER BY run_id)) AS sha256 FROM a_runs")


def _upserted(p):
    path = scratch(p.sparkSession, "upsert")
    first = p.select("task_id", "run_id", F.lit("t0").alias("created_at"), "passed_round")
    sinks.upsert(first, path, ["task_id"], "run_id", keep=("created_at",))
    sinks.upsert(first.filter("task_id % 3 = 0").withColumn("created_at", F.lit("t1")).withColumn("passed_round", F.lit(9).cast("long")), path, ["task_id"], "run_id", keep=("created_at",))
    return p.sparkSession.read.parquet(path).select("task_id", "created_at", "passed_round")


query("w1_upsert", "a_problem_runs", _upserted, "SELECT task_id, 't0' AS created_at, CASE WHEN task_id % 3 = 0 THEN 9 ELSE passed_round END AS passed_round FROM a_problem_runs")


def _registered(d):
    path = scratch(d.sparkSession, "runs")
    rows = d.select("run_id", F.to_json(F.struct("seed", "k")).alias("config_json"))
    sinks.register_run(rows.filter("length(run_id) > 6"), path)
    sinks.register_run(rows, path)
    return d.sparkSession.read.parquet(path).select("run_id", "config_json")


query("w2_registered", "a_runs", _registered, "SELECT run_id, '{\"seed\":' || seed || ',\"k\":' || k || '}' AS config_json FROM a_runs")


def _appended(d):
    path = scratch(d.sparkSession, "log")
    for k in (1, 2):
        sinks.append_jsonl(d.filter(F.col("k") == k).select("run_id", "k"), path)
    return readers.jsonl(d.sparkSession, path, "run_id string, k bigint")


query("w3_appended", "a_runs", _appended, "SELECT run_id, k FROM a_runs")


def _finite(d):
    path = scratch(d.sparkSession, "finite")
    sinks.write_jsonl(d.select("run_id", (F.col("n") / 4).alias("x")), path)
    return readers.jsonl(d.sparkSession, path, "run_id string, x double")


query("w5_finite", "a_runs", _finite, "SELECT run_id, n / 4 AS x FROM a_runs")


def _csv(p):
    path = scratch(p.sparkSession, "csv")
    sinks.write_csv(r.bug_histogram(p), path, ["A.1"])
    return p.sparkSession.read.schema("bug string, n bigint").csv(path, header=True)


query("r10_csv", "a_problem_runs", _csv, "SELECT replace(initial_bug_sub, 'A.1', '[REDACTED]') AS bug, count(*) AS n FROM a_problem_runs WHERE initial_bug_sub IS NOT NULL GROUP BY 1")
query("r11_markdown", "a_problem_runs", lambda p: p.sparkSession.createDataFrame([(sinks.markdown("Bugs", r.bug_histogram(p).orderBy("bug")),)], "text string"), "SELECT '## Bugs' || chr(10) || chr(10) || '| bug | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || bug || ' | ' || n || ' |' || chr(10), '' ORDER BY bug) AS text FROM (SELECT initial_bug_sub AS bug, count(*) AS n FROM a_problem_runs WHERE initial_bug_sub IS NOT NULL GROUP BY 1)")
#: Codes of which DuckDB can count everything: ifs, calls, comments and lines.
_CODE = "concat('# a', repeat(concat(chr(10), '# b'), cast(task_id % 3 as int)), chr(10), 'def f(x):', repeat(concat(chr(10), '    if x:', chr(10), '        g(x)'), cast(task_id % {m} as int)), chr(10), '    return x')"
_MEAN = "(SELECT task_id, len(l) AS loc, (1 + len(regexp_extract_all(x, '\\bif\\b')))::DOUBLE AS cc, len(regexp_extract_all(x, 'g\\(')) AS calls, (2000 * c + len(l)) // (2 * len(l)) / 10.0 AS comments FROM (SELECT task_id, x, string_split(x, chr(10)) AS l, len(regexp_extract_all(x, '#')) AS c FROM (SELECT task_id, {code} AS x FROM a_problem_runs WHERE task_id % {skip} > 0)))"


def _codes(p, m, skip):
    return r.code_metrics(p.select("task_id", F.expr(f"if(task_id % {skip} = 0, '', {_CODE.format(m=m)})").alias("code")), "task_id", "code")


def _tables(p, x):
    return r.report_tables(p, x, _codes(p, 4, 5), _codes(p, 5, 7), p.filter("passed_round <> 0 and task_id % 2 = 0"))


_R8 = "SELECT unnest([" + ", ".join(f"'{n}'" for _, n in r.CODE_METRICS) + "]) AS metric, " + ", ".join("unnest([" + ", ".join(f"round(avg({s}.{m}), 2)" for m, _ in r.CODE_METRICS) + f"]) AS {n}" for s, n in (("g", "generated"), ("c", "canonical"))) + " FROM " + _MEAN.format(code=_CODE.format(m=4), skip=5) + " g JOIN " + _MEAN.format(code=_CODE.format(m=5), skip=7) + " c USING (task_id)"
query("r8_code_statistics", "a_problem_runs", lambda p: r.code_statistics(_codes(p, 4, 5), _codes(p, 5, 7)), _R8)


def _reread(name):
    """The table of a report as its CSV file gives it back."""

    def run(p, x):
        one = _tables(p, x)[name]
        path = scratch(p.sparkSession, name)
        sinks.write_csv(one, path)
        return p.sparkSession.read.schema(one.schema).csv(path, header=True)

    return run


def _document(p, x):
    text = sinks.report_document(_tables(p, x), {"Run ID": "r"})
    return p.sparkSession.createDataFrame([(text,)], "text string").select(F.explode(F.slice(F.split("text", r"(?m)^## "), 2, 9)).alias("s")).select(F.element_at(F.split("s", "\n"), 1).alias("section"), (F.regexp_count("s", F.lit(r"(?m)^\|")) - 2).cast("long").alias("n"))


for _name, _sql in (("bug_distribution", "r4_bug_distribution"), ("repair_success_rate", "r5_cohorts"), ("bug_evolution_matrix", "r7_round_matrix"), ("token_and_cost_summary", "r9_tokens_time")):
    query(f"r10_{_name}", "a_problem_runs a_rounds", _reread(_name))
    SQL[f"r10_{_name}"] = SQL[_sql]
query("r10_code_statistics", "a_problem_runs a_rounds", _reread("code_statistics"), _R8)
query("r10_pass_rates", "a_problem_runs a_rounds", _reread("pass_rates"), f"SELECT x.*, p AS target, CASE WHEN n = s THEN round(pct_r0 - p, 1) END AS delta_r0, CASE WHEN n = s THEN round(pct_r2 - p, 1) END AS delta_r2 FROM ({reports._R2}) x JOIN (VALUES {reports._T}) t(g, p, s) ON g = grp")
query("r11_document", "a_problem_runs a_rounds", _document, "SELECT unnest([" + ", ".join(f"'{t}'" for _, t in sinks.SECTIONS) + "]) AS section, unnest([7, 12, (SELECT 2 + count(DISTINCT initial_bug_primary) FROM a_problem_runs WHERE passed_round <> 0), 4, 4, 1]) AS n")
query("w8_exported", "a_runs", lambda d: sinks.exported(d, "run_id", "k"), "SELECT '{\"run_id\":\"' || run_id || '\",\"k\":' || k || '}' AS json FROM a_runs")


def _log(s):
    """The states as log files: one for each iteration, as batches of entries land, each with a line that was cut off."""
    path = scratch(s.sparkSession, "trajectories")
    rows = s.select(F.to_json(F.struct(F.lit("v1").alias("schema"), F.lit("r").alias("run_id"), F.col("task_id").cast("string").alias("task_id"), F.col("i").cast("int").alias("iteration"), F.struct((F.col("state") == "PASS").alias("passed")).alias("hidden"))).alias("value"), "i")
    for i in (0, 1, 2):
        rows.filter(F.col("i") == i).select("value").unionAll(s.sparkSession.createDataFrame([('{"task_id": "cut',)], "value string")).write.mode("append").text(path)
    return s.sparkSession, path


def _streamed(s):
    spark, path = _log(s)
    out = scratch(spark, "streamed")
    logs.start(logs.entries(spark, path), out, scratch(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(out).select("task_id", F.col("iteration").cast("long").alias("iteration"))


def _absorbed(s):
    spark, path = _log(s)
    out = scratch(spark, "state")
    logs.start_upsert(logs.passed_state(spark, path), out, scratch(spark, "checkpoint"), ["run_id", "task_id"], "run_id").awaitTermination()
    return spark.read.parquet(out).select("task_id", F.col("passed_at").cast("long").alias("passed_at"), F.col("last_iteration").cast("long").alias("last_iteration"))


query("z1_streamed_log", "a_states", _streamed, "SELECT task_id::VARCHAR AS task_id, i AS iteration FROM a_states")
query("z5_passed_state", "a_states", _absorbed, "SELECT task_id::VARCHAR AS task_id, min(CASE WHEN state = 'PASS' THEN i END) AS passed_at, max(i) AS last_iteration FROM a_states GROUP BY task_id")


def _batch_log(s):
    return readers.trajectories(*_log(s)).select("task_id", F.col("iteration").cast("long").alias("iteration"))


query("k4_log_entries", "a_states", _batch_log, "SELECT task_id::VARCHAR AS task_id, i AS iteration FROM a_states")


def _progress(s):
    path = scratch(s.sparkSession, "progress")
    s.select(F.concat(F.lit("r"), F.col("task_id") % 5).alias("run_id"), "state", F.col("i").cast("int").alias("completed"), F.lit(3).alias("total"), F.lpad(F.col("event_id").cast("string"), 9, "0").alias("updated_at")).withColumnRenamed("state", "phase").write.json(path)
    out = scratch(s.sparkSession, "last")
    logs.start_upsert(logs.progress(s.sparkSession, path), out, scratch(s.sparkSession, "checkpoint"), ["run_id"], "run_id").awaitTermination()
    return s.sparkSession.read.parquet(out).select("run_id", "phase", "updated_at")


query("z2_progress", "a_states", _progress, "SELECT 'r' || (task_id % 5) AS run_id, arg_max(state, event_id) AS phase, lpad(max(event_id)::VARCHAR, 9, '0') AS updated_at FROM a_states GROUP BY 1")
query("m2_rsr_big", "a_states_big", lambda s: t.rsr(t.tall(t.initially_failing(t.outcomes(s)), 4)),
      "SELECT i, num, den, ((2000 * num + den) // (2 * den)) / 10.0 AS pct FROM (SELECT k.i::BIGINT AS i, count(*) FILTER (p <= k.i) AS num, count(*) AS den FROM (SELECT task_id, min(CASE WHEN state = 'PASS' THEN i END) AS p FROM a_states_big GROUP BY task_id HAVING p IS NULL OR p > 0), range(1, 5) k(i) GROUP BY k.i)")


def _problems(p):
    spark, plus = _landed(p.filter("benchmark <> 'appsplus'").select(F.concat(F.lit("T/"), "task_id").alias("task_id"), F.lit("q").alias("prompt"), F.expr("if(task_id % 2 = 0, concat('f', task_id), null)").alias("entry_point"), F.lit("s").alias("canonical_solution")), "plus")
    _, apps = _landed(p.filter("benchmark = 'appsplus'").select(F.col("task_id").cast("string").alias("problem_id"), F.col("sub_tier").alias("difficulty"), F.col("run_id").alias("prompt")), "apps")
    return readers.problem_list(spark, {"HumanEval+": plus, "APPS+": apps})


query("s6_problem_list", "a_problem_runs", _problems,
      "SELECT CASE WHEN benchmark = 'appsplus' THEN task_id::VARCHAR ELSE 'T/' || task_id END AS id, CASE WHEN benchmark = 'appsplus' THEN run_id WHEN task_id % 2 = 0 THEN 'f' || task_id ELSE 'T/' || task_id END AS title, sub_tier AS tier, CASE WHEN benchmark = 'appsplus' THEN 'APPS+' ELSE 'HumanEval+' END AS benchmark FROM a_problem_runs")


def _tail(f):
    path = scratch(f.sparkSession, "output")
    f.select(F.col("finding_id").cast("string")).coalesce(1).sortWithinPartitions(F.col("finding_id").cast("long")).write.text(path)
    return logs.output_tail(f.sparkSession, path, 150).select(F.col("value").cast("long").alias("finding_id"))


query("z4_output_tail", "a_findings", _tail, "SELECT finding_id FROM a_findings ORDER BY 1 DESC LIMIT 150")
