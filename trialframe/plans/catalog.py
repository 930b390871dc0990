"""Queries of groups 2.1, 2.6 and 2.9: scans, catalog, sampling, preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rates import maintainability, rate_text
from ..operators import catalog as k
from ..operators import sampling as s
from ..operators.classify import portable
from ..registry import query

_PATTERNS = (r"a\d+[x-z]*", r"(a|b)\.py", r"(?:a)", r"(a)\1", r"a++", "\u00e9", r"\bdef\b")

query("k1_listed", "a_runs", lambda d: k.listed(d).select("run_id", "place"), "SELECT run_id, row_number() OVER (ORDER BY started_at DESC, run_id DESC) AS place FROM a_runs WHERE regexp_matches(run_id, '^[A-Za-z0-9][A-Za-z0-9_.-]{0,99}$')")
query("k2_status", "a_runs", lambda d: d.withColumn("has_manifest", F.col("n") % 2 == 1).withColumn("sidecar", F.expr("if(n = 14, 'starting', sidecar)")).select("run_id", k.status().alias("status")),
      "SELECT run_id, CASE WHEN active THEN 'running' WHEN sidecar IS NOT NULL AND n <> 14 THEN sidecar WHEN n % 2 = 1 THEN CASE WHEN completed THEN 'completed' ELSE 'failed' END WHEN has_summary THEN 'completed' ELSE 'failed' END AS status FROM a_runs")
_rsr = lambda: F.concat(F.lit('[{"iteration":1,"num":2,"den":30,"pct":6.7},{"iteration":2,"num":'), F.expr("if(n % 3 = 0, 'null', string(n))"), F.lit(',"den":30'), F.expr("""case n % 4 when 0 then '' when 1 then ',"pct":null' when 2 then ',"pct":"6"' else ',"pct":6.5' end"""), F.lit("}]"))
query("k3_rsr_list", "a_runs", lambda d: d.select("run_id", F.size(k.rsr_list(_rsr())).cast("long").alias("n"), F.get(k.rsr_list(_rsr()), 1)["pct"].alias("pct")),
      "SELECT run_id, CASE WHEN n % 3 = 0 OR n % 4 IN (0, 2) THEN NULL ELSE 2::BIGINT END AS n, CASE WHEN n % 3 <> 0 AND n % 4 = 3 THEN 6.5::DOUBLE END AS pct FROM a_runs")
_manifest = lambda: F.to_json(F.struct(F.col("started_at").alias("start_time"), F.lit("dou").alias("repair_mode"), F.col("regime").alias("feedback_regime"), "k", "model", F.col("n").alias("sample_size"), F.expr("if(n % 2 = 0, 'mock', 'other')").alias("llm_mode"), F.lit("d").alias("dataset_sha256"), F.expr("if(n % 4 = 0, null, named_struct('sha256', concat('c', n)))").alias("generation_cache"), "seed", "completed"))
query("p1_run_items", "a_runs", lambda d: k.run_items(d, d.filter("n % 5 <> 0").select("run_id", _manifest().alias("manifest")), d.filter("n % 3 <> 1").select("run_id", F.concat(F.lit('{"rsr":'), _rsr(), F.lit("}")).alias("summary"))).withColumn("rsr", F.size("rsr").cast("long")),
      """SELECT run_id, CASE WHEN m THEN 'manifest' ELSE 'legacy' END AS provenance, CASE WHEN active THEN 'running' WHEN sidecar IS NOT NULL THEN sidecar WHEN m THEN CASE WHEN completed THEN 'completed' ELSE 'failed' END WHEN has_summary THEN 'completed' ELSE 'failed' END AS status,
        CASE WHEN n % 3 = 1 OR n % 3 = 0 OR n % 4 IN (0, 2) THEN NULL ELSE 2::BIGINT END AS rsr, CASE WHEN m THEN started_at END AS start_time, CASE WHEN m THEN 'dou' END AS repair_mode, CASE WHEN m THEN regime END AS feedback_regime, CASE WHEN m THEN k::INT END AS k, CASE WHEN m THEN model END AS model,
        CASE WHEN m THEN n::INT END AS sample_size, CASE WHEN m THEN 'd' END AS dataset_sha256, CASE WHEN m THEN seed::INT END AS seed, CASE WHEN m AND n % 2 = 0 THEN 'mock' END AS llm_mode, CASE WHEN m AND n % 4 <> 0 THEN 'c' || n END AS generation_cache_sha256 FROM (SELECT *, n % 5 <> 0 AS m FROM a_runs)""")
query("k4_page", "a_findings", lambda f: k.page(f.filter("report_id = 7"), 2, 10).select("finding_id", "row"), "SELECT finding_id, ord AS row FROM a_findings WHERE report_id = 7 AND ord BETWEEN 11 AND 20")
query("k5_tail", "a_findings", lambda f: k.tail(f.select("finding_id"), 200, "finding_id"), "SELECT finding_id FROM a_findings ORDER BY 1 DESC LIMIT 200")
query("k7_warnings", "a_runs", lambda d: k.warnings(d, ("model", "regime", "seed", "k")), "SELECT field, string_agg(v, ', ' ORDER BY v) AS \"values\" FROM (SELECT DISTINCT field, coalesce(nullif(trim(v), ''), 'not available') AS v FROM (SELECT unnest(['model', 'regime', 'seed', 'k']) AS field, unnest([model, regime, seed::VARCHAR, k::VARCHAR]) AS v FROM a_runs)) GROUP BY field HAVING count(*) > 1")
query("k8_max_iterations", "a_runs", lambda d: k.max_iterations(d.withColumn("last_iteration", F.col("seed") + 1)), "SELECT greatest(1, max(greatest(k, seed + 1)))::BIGINT AS iterations FROM a_runs")
query("k9_rate_text", "a_steps", lambda x: x.select("task_id", rate_text(F.expr("if(task_id % 5 = 0, 0, task_id % 7)"), F.expr("if(task_id % 5 = 0, 0, task_id % 7 + n)")).alias("text")), "SELECT task_id, CASE WHEN task_id % 5 = 0 THEN 'not available' ELSE printf('%.1f%% (%d/%d)', ((2000 * a + b) // (2 * b)) / 10.0, a, b) END AS text FROM (SELECT task_id, task_id % 7 AS a, task_id % 7 + n AS b FROM a_steps)")
query("k10_reordered", "a_runs", lambda d: d.select("run_id", F.array_join(k.reordered(F.array("n", "k"), F.array(F.lit("PASS"), F.lit("A"))), ",", "-").alias("row")), "SELECT run_id, k || ',-,-,' || n AS row FROM a_runs")
query("k11_mismatches", "a_runs", lambda d: k.mismatches(d, {"model": "m1", "regime": "ASIA", "seed": 1, "k": 2}), "SELECT run_id, array_to_string(list_filter([CASE WHEN model IS DISTINCT FROM 'm1' THEN 'model' END, CASE WHEN regime IS DISTINCT FROM 'ASIA' THEN 'regime' END, CASE WHEN seed <> 1 THEN 'seed' END, CASE WHEN k <> 2 THEN 'k' END], lambda x: x IS NOT NULL), ',') AS fields FROM a_runs")
query("k12_run_ids", "a_runs", lambda d: d.select("run_id", F.concat(F.expr("if(n % 3 = 0, '../', '')"), "run_id").rlike(k.RUN_ID).alias("ok")), "SELECT run_id, regexp_matches(CASE WHEN n % 3 = 0 THEN '../' ELSE '' END || run_id, '^[A-Za-z0-9][A-Za-z0-9_.-]{0,99}$') AS ok FROM a_runs")
for _s, _k, _t, _n in (("api", "NOT k BETWEEN 1 AND 10", "2.0", "NOT n BETWEEN 1 AND 10000"), ("web", "NOT k BETWEEN 1 AND 3", "1.0", "false"), ("cli", "k < 1", "2.0", "NOT n BETWEEN 1 AND 10000")):
    query(f"k13_settings_{_s}", "a_runs", lambda d, _s=_s: k.problems(d.select("run_id", (F.col("n") % 6).alias("k"), (F.col("n") / 10.0).alias("temperature"), F.col("n")), _s),
          f"SELECT run_id, array_to_string({'list_slice(' if _s == 'cli' else ''}list_filter([CASE WHEN {_k} THEN 'k' END, CASE WHEN NOT t BETWEEN 0 AND {_t} THEN 'temperature' END, CASE WHEN {_n} THEN 'n' END], lambda x: x IS NOT NULL){', 1, 1)' if _s == 'cli' else ''}, ',') AS problems FROM (SELECT run_id, n % 6 AS k, n / 10.0 AS t, n FROM a_runs)")
query("k14_iterations", "a_runs", lambda d: d.select("run_id", F.expr("if(n % 2 = 0, k, null)").alias("summary_k"), F.expr("if(n % 3 = 0, seed, null)").alias("manifest_k"), F.expr("if(n % 5 = 0, n, null)").alias("seen_k")).select("run_id", k.iteration_count().cast("long").alias("k")), "SELECT run_id, CASE WHEN n % 2 = 0 THEN k WHEN n % 3 = 0 THEN seed WHEN n % 5 = 0 THEN n ELSE 0 END AS k FROM a_runs")
query("t13_maintainability", "a_runs", lambda d: d.select("run_id", maintainability(F.expr("n * 4 - 1")).alias("band")), "SELECT run_id, CASE WHEN n = 0 THEN 'Unavailable' WHEN n * 4 - 1 >= 80 THEN 'Excellent' WHEN n * 4 - 1 >= 65 THEN 'Good' WHEN n * 4 - 1 >= 20 THEN 'Moderate' ELSE 'Low' END AS band FROM a_runs")

query("s1_duplicates", "a_findings", lambda f: s.duplicate_ids(f.withColumnRenamed("message", "task_id")), "SELECT message AS task_id, count(*) AS n FROM a_findings GROUP BY message HAVING count(*) > 1")
query("s4_tiers", "a_problem_runs", lambda p: s.of_tiers(p, ["INTRODUCTORY", "Interview"], "sub_tier").select("task_id", "sub_tier"), "SELECT task_id, sub_tier FROM a_problem_runs WHERE lower(sub_tier) IN ('introductory', 'interview')")
query("s7_lookup", "a_runs", lambda d: s.lookup(d, "nation_7", "run_id").select("run_id", "n"), "SELECT run_id, n FROM a_runs WHERE lower(run_id) = 'nation_7'")
query("s15_suites", "a_files documents", lambda f, d: f.select("file_id", F.sha2("content", 256).alias("h")).join(d.select(F.sha2("text", 256).alias("h")).distinct(), "h").select("file_id", "h"), "SELECT file_id, sha256(content) AS h FROM a_files WHERE sha256(content) IN (SELECT sha256(text) FROM documents)")

query("q1_cohort", "a_steps", lambda x: s.hashed_cohort(x.filter("s0 <> 'PASS'"), "task_id", 40, 7).select("task_id"), "SELECT task_id FROM a_steps WHERE s0 <> 'PASS' ORDER BY sha256('7:' || task_id) LIMIT 40")
query("q2_shuffled", "a_problem_runs", lambda p: s.hashed_cohort(p, "task_id", 25, 11).select("task_id", "benchmark"), "SELECT task_id, benchmark FROM a_problem_runs ORDER BY sha256('11:' || task_id) LIMIT 25")
query("q3_stratified", "a_problem_runs", lambda p: s.stratified(p.filter("not (task_id % 4 = 0)"), "benchmark", "task_id", 20, 3).select("benchmark", "task_id", "place"), "SELECT benchmark, task_id, place FROM (SELECT benchmark, task_id, row_number() OVER (PARTITION BY benchmark ORDER BY sha256('3:' || task_id)) AS place FROM a_problem_runs WHERE task_id % 4 <> 0) WHERE place <= 20")
query("q4_split", "a_findings", lambda f: s.visible(f.select(F.col("report_id").alias("task_id"), F.col("ord").alias("no"), F.col("file").alias("input"), F.lit("see m1.py and m2.py").alias("prompt"))).select("task_id", "no", "is_visible"), "SELECT report_id AS task_id, ord AS no, CASE WHEN bool_or(file IN ('m1.py', 'm2.py')) OVER (PARTITION BY report_id) THEN file IN ('m1.py', 'm2.py') ELSE ord <= 3 END AS is_visible FROM a_findings")
query("q5_cases", "a_findings", lambda f: s.partitioned_cases(f.select(F.col("report_id").alias("task_id"), F.col("ord").alias("no"), F.expr("case when line = 0 then 'timeout' when line = 1 then 'exception' else 'ok' end").alias("outcome"))), "SELECT report_id AS task_id, outcome, string_agg(ord, ',' ORDER BY ord) AS indices FROM (SELECT *, CASE WHEN line = 0 THEN 'timeout' WHEN line = 1 THEN 'exception' ELSE 'ok' END AS outcome FROM a_findings) GROUP BY ALL")
query("q6_failed_suites", "a_findings", lambda f: f.filter("severity = 'CRITICAL'").select("report_id", "file").distinct(), "SELECT DISTINCT report_id, file FROM a_findings WHERE severity = 'CRITICAL'")
query("q7_suite_text", "a_files", lambda f: f.select("file_id", s.case_literal("content").alias("literal")), "SELECT file_id, CASE WHEN length(content) > 4096 THEN 'sha256:' || sha256(content) ELSE '''' || replace(replace(replace(content, '\\', '\\\\'), '''', '\\'''), chr(10), '\\n') || '''' END AS literal FROM a_files")
query("q9_sorted", "a_problem_runs", lambda p: p.orderBy("benchmark", F.asc_nulls_first("sub_tier"), "task_id").select("task_id"), "SELECT task_id FROM a_problem_runs ORDER BY benchmark, sub_tier NULLS FIRST, task_id")
query("r6_sample", "a_problem_runs", lambda p: p.sparkSession.createDataFrame([(x,) for x in s.exact_cohort(p.filter("passed_round <> 0"), "task_id", 1 << 30, 42)], "id string"), "SELECT task_id::VARCHAR AS id FROM a_problem_runs WHERE passed_round <> 0")
query("c2_portable", "a_runs", lambda d: d.sparkSession.createDataFrame([(x, portable(x)) for x in _PATTERNS], "pattern string, portable boolean"), "SELECT unnest([" + ", ".join("'" + x.replace("'", "''") + "'" for x in _PATTERNS) + "]) AS pattern, unnest([true, true, false, false, false, false, true]) AS portable")
