"""Queries of group 2.4 and of the scans and joins that reports are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as r
from ..registry import query
from ..taxonomy import CATEGORIES, TARGETS

_rate = lambda n, d: f"CASE WHEN {d} = 0 THEN NULL ELSE ((2000 * {n} + {d}) // (2 * {d})) / 10.0 END"
_COUNTS = "count(passed_round) AS n, count(*) FILTER (passed_round = 0) AS r0, count(*) FILTER (passed AND passed_round <= 1) AS r1, count(*) FILTER (passed AND passed_round <= 2) AS r2"
_GROUPS = "(SELECT *, benchmark AS grp FROM a_problem_runs UNION ALL SELECT *, 'overall' FROM a_problem_runs UNION ALL SELECT *, lower(sub_tier) FROM a_problem_runs WHERE benchmark = 'appsplus')"
_T = ", ".join(f"('{g}', {p}::DOUBLE, {n})" for g, p, n in TARGETS)
_SMALL = [(g, p, n) for (g, p, _), n in zip(TARGETS, (50, 50, 16, 17, 17, 50, 150))]
_TS = ", ".join(f"('{g}', {p}::DOUBLE, {n})" for g, p, n in _SMALL)
_R2 = f"SELECT g AS grp, n, r0, r1, r2, {_rate('r0', 'n')} AS pct_r0, {_rate('r1', 'n')} AS pct_r1, {_rate('r2', 'n')} AS pct_r2 FROM (SELECT g, {_COUNTS} FROM (VALUES {_T}) t(g, p, s) LEFT JOIN {_GROUPS} ON grp = g GROUP BY g)"
query("r1_pass_stats", "a_problem_runs", lambda p: p.groupBy("benchmark").agg(*r.pass_counts()), f"SELECT benchmark, {_COUNTS} FROM a_problem_runs GROUP BY benchmark")
query("r2_pass_rates", "a_problem_runs", r.pass_rates, _R2)
query("r3_deltas", "a_problem_runs", lambda p: r.deltas(p, tuple(_SMALL)), f"SELECT x.grp, x.n, p AS target, CASE WHEN x.n = s THEN round(pct_r0 - p, 1) END AS delta_r0, CASE WHEN x.n = s THEN round(pct_r2 - p, 1) END AS delta_r2 FROM ({_R2}) x JOIN (VALUES {_TS}) t(g, p, s) ON g = x.grp")
_CATS = ", ".join(f"('{c}')" for c in CATEGORIES)
query("r4_bug_distribution", "a_problem_runs", r.bug_distribution, f"SELECT c AS category, i AS n_initial, {_rate('i', 'f')} AS pct_failing, {_rate('i', 'a')} AS pct_all, u AS unresolved, x AS fixed, {_rate('x', 'i')} AS pct_resolved FROM (SELECT c, (SELECT count(*) FROM a_problem_runs WHERE initial_bug_sub = c) AS i, (SELECT count(*) FROM a_problem_runs WHERE passed_round <> 0) AS f, (SELECT count(*) FROM a_problem_runs) AS a, (SELECT count(*) FROM a_problem_runs WHERE final_bug_sub = c AND NOT passed) AS u, (SELECT count(*) FROM a_problem_runs WHERE initial_bug_sub = c AND passed AND passed_round > 0) AS x FROM (VALUES {_CATS}) t(c))")
query("r5_cohorts", "a_problem_runs", lambda p: r.cohorts(p, p.filter("passed_round <> 0 and task_id % 2 = 0")), f"SELECT cohort, den, r1, r2, {_rate('r1', 'den')} AS pct_r1, {_rate('r2', 'den')} AS pct_r2 FROM (SELECT cohort, count(*) AS den, count(*) FILTER (passed AND passed_round = 1) AS r1, count(*) FILTER (passed AND passed_round <= 2) AS r2 FROM (SELECT *, unnest(['all', 'type ' || initial_bug_primary] || CASE WHEN task_id % 2 = 0 THEN ['sample'] ELSE [] END) AS cohort FROM a_problem_runs WHERE passed_round <> 0) GROUP BY cohort)")
_ST = lambda p: f"CASE WHEN {p}.passed THEN 'Passed' ELSE 'Type ' || coalesce({p}.bug_primary, 'B') END"
query("r7_round_matrix", "a_rounds", r.round_matrix, f"SELECT s AS from_state, count(*) FILTER (t = 'Passed') AS passed, count(*) FILTER (t = 'Type A') AS type_a, count(*) FILTER (t = 'Type B') AS type_b, count(*) FILTER (t = 'Type C') AS type_c FROM (SELECT unnest(['Passed', 'Type A', 'Type B', 'Type C']) AS s) LEFT JOIN (SELECT {_ST('x')} AS f, CASE WHEN y.task_id IS NULL THEN {_ST('x')} ELSE {_ST('y')} END AS t FROM a_rounds x LEFT JOIN a_rounds y ON y.task_id = x.task_id AND y.round_number = 1 WHERE x.round_number = 0) ON f = s GROUP BY s")
query("r9_tokens_time", "a_problem_runs a_rounds", r.tokens_and_time, "SELECT sum(token_count)::BIGINT AS tokens, avg(token_count) AS avg_tokens, sum(duration_ms)::BIGINT AS ms, avg(duration_ms) AS avg_ms, sum(token_count) / count(DISTINCT task_id) AS tokens_per_problem, sum(duration_ms) / 1000 AS seconds, sum(duration_ms) / 60000 AS minutes FROM a_rounds JOIN a_problem_runs USING (task_id)")
query("r12_console", "a_problem_runs", r.console_summary, f"SELECT *, {_rate('(r2 - r0)', '(total - r0)')} AS pct_repaired FROM (SELECT count(*) AS total, count(*) FILTER (passed AND passed_round <= 0) AS r0, count(*) FILTER (passed AND passed_round <= 1) AS r1, count(*) FILTER (passed AND passed_round <= 2) AS r2 FROM a_problem_runs)")
query("r12_histogram", "a_problem_runs", r.bug_histogram, "SELECT initial_bug_sub AS bug, count(*) AS n FROM a_problem_runs WHERE initial_bug_sub IS NOT NULL GROUP BY 1")
query("s9_latest_run", "a_runs", lambda d: r.latest_run(d.filter("model is not null")).select("run_id", "started_at"), "SELECT run_id, started_at FROM a_runs WHERE model IS NOT NULL ORDER BY started_at DESC, run_id DESC LIMIT 1")
query("p7_demo_candidates", "a_problem_runs", r.demo_candidates, "SELECT task_id, CASE WHEN passed AND passed_round = 0 THEN 'passes first try' WHEN passed THEN 'fails, both modes fix' ELSE 'unresolved' END AS category, CASE WHEN passed AND passed_round = 0 THEN 'Initial generation passed all tests at Round 0 in ' || total_duration_ms || ' ms.' WHEN passed THEN 'Failed at Round 0 with ' || coalesce(initial_bug_sub, initial_bug_primary, 'Bug') || ', repaired successfully in Round ' || passed_round || '.' ELSE 'Failed Round 0 with ' || coalesce(initial_bug_sub, initial_bug_primary, 'Bug') || ', remained unresolved after iterations.' END AS note FROM a_problem_runs")
query("j1_rounds_of_problems", "a_rounds a_problem_runs", lambda x, p: x.join(p.filter("run_id = 'run1'").select("task_id", "benchmark"), "task_id").select("task_id", "round_number", "benchmark", "token_count"), "SELECT task_id, round_number, benchmark, token_count FROM a_rounds JOIN a_problem_runs USING (task_id) WHERE run_id = 'run1'")
query("j2_resume", "a_problem_runs a_steps", lambda p, s: s.join(p.filter("passed").select("task_id"), "task_id", "left_anti").select("task_id", "n"), "SELECT task_id, n FROM a_steps WHERE task_id NOT IN (SELECT task_id FROM a_problem_runs WHERE passed)")
query("s10_completed", "a_problem_runs", lambda p: p.groupBy("run_id", "benchmark").agg(F.count_if("passed").alias("completed")), "SELECT run_id, benchmark, count(*) FILTER (passed) AS completed FROM a_problem_runs GROUP BY ALL")
query("j3_problems_with_runs", "a_problem_runs a_runs", lambda p, d: d.select("run_id", "model", "n").join(p.select("task_id", "benchmark", (F.col("task_id") % 25).alias("n")), "n").select("task_id", "benchmark", "run_id", "model"), "SELECT task_id, benchmark, d.run_id, model FROM a_problem_runs p JOIN a_runs d ON p.task_id % 25 = d.n")
query("s8_latest_of_run", "a_problem_runs a_rounds", lambda p, x: x.join(p.filter("run_id = 'run2'").select("task_id"), "task_id").select("task_id", "round_number", "passed"), "SELECT task_id, round_number, x.passed FROM a_rounds x JOIN a_problem_runs p USING (task_id) WHERE run_id = 'run2'")
