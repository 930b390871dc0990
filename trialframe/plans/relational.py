"""Queries of group 2.2: filters, joins, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rates import band
from ..operators import relational as r
from ..operators.classify import distinct_first
from ..registry import query
from ..taxonomy import REFERENCE_ROWS

query("p2_search", "a_runs", lambda d: r.search(d, "Me", "run_id", "model", "regime").select("run_id"), "SELECT run_id FROM a_runs WHERE contains(lower(run_id), 'me') OR contains(lower(coalesce(model, '')), 'me') OR contains(lower(coalesce(regime, '')), 'me')")
query("p3_search", "a_runs", lambda d: r.search(d, "RI", "run_id", "regime").select("run_id"), "SELECT run_id FROM a_runs WHERE contains(lower(run_id), 'ri') OR contains(lower(regime), 'ri')")
query("p4_benchmark", "a_problem_runs", lambda p: p.filter("benchmark = 'mbppplus'").select("task_id"), "SELECT task_id FROM a_problem_runs WHERE benchmark = 'mbppplus'")
_NORM = "regexp_replace(path, '^(\\./)+', '')"
query("p5_test_files", "a_files", lambda f: f.select("file_id", r.normal_path().alias("path"), r.is_test_file().alias("is_test")), f"SELECT file_id, {_NORM} AS path, lower(category) = 'test' OR regexp_matches(regexp_extract(path, '([^/]*)$', 1), '^(test_.*|.*_test)\\.py$|^conftest\\.py$') AS is_test FROM a_files")
query("p6_capped", "a_findings", lambda f: r.first_of(f.filter("severity <> 'LOW'"), ["report_id", "technique"], "ord", 3).select("report_id", "technique", "ord", "place"), "SELECT * FROM (SELECT report_id, technique, ord, row_number() OVER (PARTITION BY report_id, technique ORDER BY ord) AS place FROM a_findings WHERE severity <> 'LOW') WHERE place <= 3")
query("q8_caps", "a_findings", lambda f: r.first_of(f, "report_id", "ord", 5).select("report_id", "ord", "place"), "SELECT report_id, ord, ord AS place FROM a_findings WHERE ord <= 5")
query("p8_merge_gate", "a_findings", lambda f: r.merge_gate(f), "SELECT report_id, CASE WHEN bool_or(severity = 'CRITICAL') THEN 'BLOCKED' WHEN bool_or(severity = 'HIGH') THEN 'PASS_WITH_WARNINGS' ELSE 'APPROVED' END AS gate, CASE WHEN bool_or(severity = 'CRITICAL') THEN 'CRITICAL' WHEN bool_or(severity = 'HIGH') THEN 'HIGH' WHEN bool_or(severity = 'MEDIUM') THEN 'MEDIUM' ELSE 'LOW' END AS risk, coalesce(array_to_string(list_slice(list(message ORDER BY ord) FILTER (severity IN ('CRITICAL', 'HIGH')), 1, 3), '; '), '') AS top FROM a_findings GROUP BY report_id")
_S = "CASE WHEN ord % 7 = 0 THEN 'FAIL' WHEN ord % 11 = 0 THEN 'ERROR' WHEN report_id % 5 = 0 THEN 'SKIP' ELSE 'PASS' END"
query("p9_verdict", "a_findings", lambda f: r.verdict(f.filter("ord <= 2 + report_id % 13").select("report_id", F.expr("CASE WHEN ord % 2 = 0 THEN 'tests' ELSE 'x' END").alias("technique"), F.expr(_S).alias("status"), F.col("line").alias("n_total"), (F.col("line") % 3).alias("n_failed"))), f"SELECT report_id, CASE WHEN bool_or(s = 'FAIL') THEN 'FAIL' WHEN bool_or(s = 'ERROR') THEN 'ERROR' WHEN bool_or(ord % 2 = 0 AND s = 'PASS' AND line > 0 AND line % 3 = 0) AND NOT bool_or(s = 'SKIP') THEN 'VERIFIED' ELSE 'NOT_VERIFIED' END AS verdict FROM (SELECT *, {_S} AS s FROM a_findings WHERE ord <= 2 + report_id % 13) GROUP BY report_id")
_ST = "CASE WHEN finding_id % 5 = 0 THEN 'FAIL' WHEN finding_id % 5 = 1 THEN 'SKIP' ELSE 'PASS' END"
query("p10_outcome", "a_findings", lambda f: f.select("finding_id", F.expr(_ST).alias("p"), F.expr("CASE WHEN line = 3 THEN 'FAIL' ELSE 'PASS' END").alias("s"), F.lit("PASS").alias("m"), "line", F.expr("ord % 2").alias("failed")).select("finding_id", r.test_outcome("p", "s", "m", "line", "failed").alias("ok")), f"SELECT finding_id, CASE WHEN {_ST} = 'FAIL' OR line = 3 THEN false WHEN {_ST} = 'PASS' AND line > 0 AND ord % 2 = 0 THEN true END AS ok FROM a_findings")
query("p11_issues", "a_findings", lambda f: r.flat_issues(f.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("ord", "technique", F.expr("CASE WHEN line = 1 THEN 'FAIL' ELSE 'PASS' END").alias("status"), "message", F.expr("CASE WHEN line < 6 THEN severity END").alias("severity"), F.expr("CASE WHEN line > 2 THEN file END").alias("file")))).alias("x")).select("report_id", F.expr("transform(x, y -> struct(y.technique as name, y.status as status, array(struct(y.message, y.severity, y.file)) as issues))").alias("techniques"))).select("report_id", F.col("t_no").cast("long").alias("t_no"), "title", "severity", "file"),
      "SELECT report_id, ord - 1 AS t_no, technique || ': ' || substr(message, 1, 75) AS title, CASE WHEN line < 6 THEN severity WHEN line = 1 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CASE WHEN line > 2 THEN file ELSE 'project' END AS file FROM a_findings")
query("p12_score", "a_findings", lambda f: f.groupBy("report_id").agg(F.collect_list(F.expr(_ST)).alias("s")).withColumn("s", F.expr("if(report_id % 4 = 0, s, array())")).withColumn("p", F.expr("report_id % 3 * (report_id % 2)")).withColumn("q", F.expr("report_id % 2")).withColumn("v", F.expr("if(report_id % 3 = 0, 'VERIFIED', 'FAIL')")).select("report_id", r.round_score("s", "p", "q", "v").alias("score")), f"SELECT report_id, CASE WHEN report_id % 4 = 0 THEN floor(100.0::DOUBLE * count(*) FILTER ({_ST} = 'PASS') / count(*) + 0.5)::BIGINT WHEN report_id % 2 = 1 THEN floor(100.0::DOUBLE * (report_id % 3) / (report_id % 3 + 1) + 0.5)::BIGINT WHEN report_id % 3 = 0 THEN 100 ELSE 0 END AS score FROM a_findings GROUP BY report_id")
query("p13_fallback", "a_steps", lambda s: s.select("task_id", F.coalesce(F.expr("CASE WHEN n > 2 THEN s2 END"), F.expr("CASE WHEN n > 1 THEN s1 END"), "s0").alias("state")), "SELECT task_id, s2 AS state FROM a_steps")
query("p14_bands", "a_steps", lambda s: s.select("task_id", band(F.expr("CASE WHEN task_id % 9 > 0 THEN task_id % 100 END")).alias("band")), "SELECT task_id, CASE WHEN task_id % 9 = 0 THEN 'none' WHEN task_id % 100 >= 80 THEN 'high' WHEN task_id % 100 >= 50 THEN 'medium' ELSE 'low' END AS band FROM a_steps")
_TECH = "CASE line WHEN 1 THEN 'Radon metrics' WHEN 2 THEN 'Security scan' ELSE technique END"
query("p15_explanations", "a_findings", lambda f: f.withColumn("technique", F.expr(_TECH)).select("finding_id", r.explanation().alias("kind")),
      "SELECT finding_id, CASE " + " ".join(f"WHEN contains(m, '{w}') THEN '{k}'" for w, k in r.MESSAGE_KINDS) + " " + " ".join(f"WHEN contains(t, '{w}') THEN '{k}'" for w, k in r.TECHNIQUE_KINDS) + f" ELSE '{r.OTHER_KIND}' END AS kind FROM (SELECT finding_id, lower(message) AS m, {_TECH} AS t FROM a_findings)")
query("p16_verified", "a_problem_runs", lambda p: p.agg(F.count_if(F.expr("CASE WHEN passed THEN 'Verified' ELSE 'no' END").contains("Verified")).alias("n")), "SELECT count(*) FILTER (passed) AS n FROM a_problem_runs")
query("p17_path_tree", "a_files", r.path_tree, f"SELECT node, depth, min(file_id) AS file_id FROM (SELECT array_to_string(p[1:d], '/') AS node, d AS depth, CASE WHEN d = len(p) THEN file_id END AS file_id FROM (SELECT file_id, p, unnest(range(1, len(p) + 1)) AS d FROM (SELECT file_id, string_split({_NORM}, '/') AS p FROM a_files))) GROUP BY ALL")
query("j4_code_pairs", "a_files a_problem_runs", lambda f, p: f.select(F.col("file_id").alias("task_id"), F.length("content").alias("n")).join(p.select("task_id", "benchmark"), "task_id").groupBy("benchmark").agg(F.avg("n").alias("mean"), F.count("*").alias("n")), "SELECT benchmark, avg(length(content)) AS mean, count(*) AS n FROM a_files f JOIN a_problem_runs p ON f.file_id = p.task_id GROUP BY benchmark")
query("j5_cache_outcomes", "a_steps a_problem_runs", lambda s, p: s.select("task_id", (F.col("s0") == "PASS").alias("x")).join(p.filter("task_id % 2 = 0").select("task_id", "passed"), "task_id", "left").select("task_id", F.coalesce("passed", "x").alias("passed")), "SELECT task_id, CASE WHEN task_id % 2 = 0 THEN passed_round >= 0 ELSE s0 = 'PASS' END AS passed FROM a_steps")
_HALF = "replace(path, './', '')"
query("j6_versions", "a_files", lambda f: r.paired(f.filter("file_id % 5 > 0"), f.filter("file_id % 4 > 0").withColumn("content", F.expr("if(file_id % 3 = 0, concat(content, '!'), content)"))), "SELECT coalesce(a.path, b.path) AS path, a.file_id AS old_id, b.file_id AS new_id, (a.content IS DISTINCT FROM b.content) AS changed FROM (SELECT * FROM a_files WHERE file_id % 5 > 0) a FULL JOIN (SELECT path, file_id, CASE WHEN file_id % 3 = 0 THEN content || '!' ELSE content END AS content FROM a_files WHERE file_id % 4 > 0) b ON a.path = b.path")
query("j7_changed", "a_files", lambda f: r.paired(f.filter("file_id % 5 > 0"), f.filter("file_id % 4 > 0").withColumn("content", F.expr("if(file_id % 3 = 0, concat(content, '!'), content)"))).filter("new_id is not null and changed").select("path"), "SELECT path FROM a_files WHERE file_id % 4 > 0 AND (file_id % 5 = 0 OR file_id % 3 = 0)")
_REF = ", ".join(f"('{a}', {x}::DOUBLE, {y}::DOUBLE, true)" for a, x, y in REFERENCE_ROWS)
query("j8_ablation", "a_runs", lambda d: r.ablation(d.filter("n < 4").select("run_id", F.col("n").cast("double").alias("rsr1"), F.col("k").cast("double").alias("rsr2"))), f"SELECT run_id, n::DOUBLE AS rsr1, k::DOUBLE AS rsr2, false AS published FROM a_runs WHERE n < 4 UNION ALL SELECT * FROM (VALUES {_REF})")
query("x1_accounting", "a_findings", lambda f: r.accounting(f.filter("is_before"), f.filter("not is_before"), "report_id", ["signal", "file"]), "SELECT report_id, sum(b)::BIGINT AS found, sum(least(a, b))::BIGINT AS remaining, sum(greatest(0, b - a))::BIGINT AS resolved, sum(greatest(0, a - b))::BIGINT AS introduced FROM (SELECT report_id, count(*) FILTER (is_before) AS b, count(*) FILTER (NOT is_before) AS a FROM a_findings GROUP BY report_id, signal, file) GROUP BY report_id")
query("x2_category_changes", "a_findings", lambda f: r.category_changes(f.filter("is_before").withColumnRenamed("signal", "category"), f.filter("not is_before").withColumnRenamed("signal", "category"), "report_id"), "SELECT report_id, coalesce(string_agg(signal, ',' ORDER BY signal) FILTER (NOT b), '') AS introduced, coalesce(string_agg(signal, ',' ORDER BY signal) FILTER (NOT a), '') AS resolved FROM (SELECT report_id, signal, bool_or(is_before) AS b, bool_or(NOT is_before) AS a FROM a_findings GROUP BY ALL) GROUP BY report_id")
query("x3_distinct_first", "a_findings", lambda f: distinct_first(f, ["signal", "file", "line", "message"], "report_id").select("finding_id"), "SELECT arg_min(finding_id, ord) AS finding_id FROM a_findings GROUP BY report_id, signal, file, line, message")
query("x5_history", "a_findings", lambda f: r.history(f, "message", "finding_id"), "SELECT message, max(finding_id) AS finding_id FROM a_findings GROUP BY message ORDER BY 2 DESC LIMIT 30")
query("x6_merged", "a_states", lambda s: r.merged(s.withColumn("source", F.lit(0)).unionByName(s.filter("event_id % 3 = 0").withColumn("state", F.lit("Z")).withColumn("source", F.lit(1))), ["task_id", "i"], "source", "state"), "SELECT task_id, i, CASE WHEN event_id % 3 = 0 THEN 'Z' ELSE state END AS state FROM a_states")
query("x7_missing", "a_states", lambda s: r.missing_iterations(s.groupBy("task_id").agg(F.max("i").alias("done"), F.collect_list(F.expr("CASE WHEN event_id % 2 = 0 THEN i END")).alias("seen")), "done", "seen"), "SELECT task_id, coalesce(string_agg(i, ',' ORDER BY i) FILTER (i > 0 AND event_id % 2 = 1), '') AS missing FROM a_states GROUP BY task_id")
query("x8_known_set", "a_states", lambda s: r.same_multiset(s.filter("event_id % 3 > 0").select("task_id", "state"), s.filter("event_id % 2 > 0").select("task_id", "state")), "SELECT task_id, state, 'left' AS side FROM (SELECT task_id, state FROM a_states WHERE event_id % 3 > 0 EXCEPT ALL SELECT task_id, state FROM a_states WHERE event_id % 2 > 0) UNION ALL SELECT task_id, state, 'right' FROM (SELECT task_id, state FROM a_states WHERE event_id % 2 > 0 EXCEPT ALL SELECT task_id, state FROM a_states WHERE event_id % 3 > 0)")
