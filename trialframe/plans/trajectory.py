"""Queries of group 2.3: trajectory metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trajectory as t
from ..registry import query
from ..taxonomy import CATEGORIES, TECHNIQUES

K = 2
RATE = "CASE WHEN den = 0 THEN NULL ELSE ((2000 * num + den) // (2 * den)) / 10.0 END"
TALL = "(SELECT task_id, 1 AS i, s0 AS f, s1 AS t FROM a_steps WHERE s0 <> 'PASS' UNION ALL SELECT task_id, 2, s1, s2 FROM a_steps WHERE s0 <> 'PASS')"


def steps(states):
    return t.tall(t.initially_failing(t.outcomes(states)), K)


def labelled(runs, states):
    return t.initially_failing(t.outcomes(states)).join(runs.select("task_id", F.col("initial_bug_sub").alias("initial_category")), "task_id")


query("m2_rsr", "a_states", lambda s: t.rsr(steps(s)), f"SELECT i::BIGINT AS i, num, den, {RATE} AS pct FROM (SELECT i, count(*) FILTER (t = 'PASS') AS num, count(*) AS den FROM {TALL} GROUP BY i)")
query("m1_rate", "a_steps", lambda s: s.select("task_id", t.rate((F.col("task_id") % 7), F.col("task_id") % 7 + F.col("n") - 1).alias("pct")), f"SELECT task_id, {RATE} AS pct FROM (SELECT task_id, task_id % 7 AS num, task_id % 7 + n - 1 AS den FROM a_steps)")
query("m3_conditional", "a_states", lambda s: t.conditional(steps(s)), f"SELECT i::BIGINT AS i, num, den, {RATE} AS pct FROM (SELECT i, count(*) FILTER (f <> 'PASS' AND t = 'PASS') AS num, count(*) FILTER (f <> 'PASS') AS den FROM {TALL} WHERE i >= 2 GROUP BY i)")
query("m4_per_primary", "a_states", lambda s: t.per_primary(steps(s), K), f"SELECT i, from_state, num, den, {RATE} AS pct FROM (SELECT x.i::BIGINT AS i, p AS from_state, count(*) FILTER (t = 'PASS') AS num, count(f) AS den FROM (SELECT unnest(['A','B','C']) AS p, i FROM range(1, 3) r(i)) x LEFT JOIN {TALL} y ON y.i = x.i AND f = p GROUP BY ALL)")
_CATS = ", ".join(f"('{c}', {i + 1})" for i, c in enumerate((*CATEGORIES, "UNMAPPED")))
query("m5_per_category", "a_problem_runs a_states", lambda r, s: t.per_category(labelled(r, s), K), f"SELECT category, priority, num, den, {RATE} AS pct FROM (SELECT category, priority::BIGINT AS priority, count(*) FILTER (passed) AS num, count(task_id) AS den FROM (VALUES {_CATS}) c(category, priority) LEFT JOIN a_problem_runs ON initial_bug_sub = category GROUP BY ALL)")
query("m6_evolution", "a_states", lambda s: t.evolution(steps(s), K), f"SELECT *, 100.0::DOUBLE * to_a / nullif(total, 0) AS pct_a, 100.0::DOUBLE * to_b / nullif(total, 0) AS pct_b, 100.0::DOUBLE * to_c / nullif(total, 0) AS pct_c, 100.0::DOUBLE * to_pass / nullif(total, 0) AS pct_pass FROM (SELECT x.i::BIGINT AS i, p AS from_state, count(*) FILTER (t = 'A') AS to_a, count(*) FILTER (t = 'B') AS to_b, count(*) FILTER (t = 'C') AS to_c, count(*) FILTER (t = 'PASS') AS to_pass, count(f) AS total FROM (SELECT unnest(['A','B','C','PASS']) AS p, i FROM range(1, 3) r(i)) x LEFT JOIN {TALL} y ON y.i = x.i AND f = p GROUP BY ALL)")
query("m7_unmapped", "a_states", lambda s: t.unmapped(s.groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "event_id", "state"))), lambda x: (x["state"] == "C") & (x["event_id"] % 3 == 0)).alias("unmapped_as_c")), K), "SELECT r.i::BIGINT AS i, count(event_id) AS n FROM range(0, 3) r(i) LEFT JOIN a_states s ON s.i = r.i AND state = 'C' AND event_id % 3 = 0 GROUP BY r.i")
query("m8_pass_at_1", "a_steps a_states", lambda e, s: t.pass_at_one(e.select("task_id", (F.col("s0") == "PASS").alias("passed")), t.initially_failing(t.outcomes(s)).filter("task_id % 2 = 0"), K), "SELECT before, after, n, ((2000 * before + n) // (2 * n)) / 10.0 AS pct_before, ((2000 * after + n) // (2 * n)) / 10.0 AS pct_after FROM (SELECT count(*) FILTER (s0 = 'PASS') AS before, count(*) FILTER (CASE WHEN s0 <> 'PASS' AND task_id % 2 = 0 THEN s2 ELSE s0 END = 'PASS') AS after, count(*) AS n FROM a_steps)")
query("m9_cost", "a_calls", lambda c: t.cost(c, 120), "SELECT calls, w AS without_usage, CASE WHEN calls > 0 AND calls = w THEN NULL ELSE coalesce(p, 0)::BIGINT END AS prompt_tokens, CASE WHEN calls > 0 AND calls = w THEN NULL ELSE coalesce(q, 0)::BIGINT END AS completion_tokens, calls / 120 AS calls_per_program FROM (SELECT count(*) AS calls, count(*) FILTER (prompt_tokens IS NULL AND completion_tokens IS NULL) AS w, sum(prompt_tokens) AS p, sum(completion_tokens) AS q FROM a_calls WHERE phase = 'repair')")
_RANK = "CASE category " + " ".join(f"WHEN '{c}' THEN {i + 1}" for i, c in enumerate(CATEGORIES)) + " ELSE 13 END"
_SUBS = "(SELECT run_id, coalesce(initial_bug_sub, 'UNMAPPED') AS category FROM a_problem_runs WHERE task_id % 5 <> 1)"
query("m10_best_category", "a_problem_runs", lambda r: t.best_category(r.filter("task_id % 5 <> 1").select("run_id", F.coalesce("initial_bug_sub", F.lit("UNMAPPED")).alias("category")), "run_id").select("run_id", "category"), f"SELECT run_id, arg_min(category, {_RANK}) AS category FROM {_SUBS} GROUP BY run_id")
query("m17_primary_state", "a_problem_runs", lambda r: t.best_category(r.select("task_id", F.coalesce("initial_bug_sub", F.lit("UNMAPPED")).alias("category")), "task_id"), "SELECT task_id, category, CASE WHEN category = 'UNMAPPED' THEN 'C' ELSE substr(category, 1, 1) END AS state, category = 'UNMAPPED' AS unmapped_as_c FROM (SELECT task_id, coalesce(initial_bug_sub, 'UNMAPPED') AS category FROM a_problem_runs)")
query("m11_summary", "a_states a_calls", lambda s, c: t.summary(steps(s), c, K, 120).select("json"))
_BROKEN = "CASE WHEN task_id % 4 = 0 THEN 'X' WHEN task_id % 4 = 1 AND i = 2 THEN 'A' ELSE state END"
query("m12_violations", "a_states", lambda s: t.violations(t.outcomes(s.withColumn("state", F.expr(_BROKEN)).unionByName(s.filter("state = 'PASS' and task_id % 3 = 1").withColumn("i", F.col("i") + 1).withColumn("state", F.lit("B"))))),
      f"SELECT task_id, CASE WHEN bool_or(state NOT IN ('A','B','C','PASS')) THEN 'unknown' WHEN min(CASE WHEN state = 'PASS' THEN i END) = 0 THEN 'initial_pass' ELSE 'not_absorbing' END AS rule FROM (SELECT task_id, i, {_BROKEN} AS state FROM a_states UNION ALL SELECT task_id, i + 1, 'B' FROM a_states WHERE state = 'PASS' AND task_id % 3 = 1) GROUP BY task_id HAVING bool_or(state NOT IN ('A','B','C','PASS')) OR min(CASE WHEN state = 'PASS' THEN i END) = 0 OR min(CASE WHEN state = 'PASS' THEN i END) < max(CASE WHEN state <> 'PASS' THEN i END)")
query("m13_passed_by", "a_states", lambda s: t.passed_by(s.select("task_id", "i", (F.col("state") == "PASS").alias("passed"))), "SELECT task_id, i, bool_or(state = 'PASS') OVER (PARTITION BY task_id ORDER BY i) AS passed_by FROM a_states")
query("m14_transitions", "a_states", lambda s: t.transitions(s.select("task_id", "i", F.expr("CASE WHEN i > 0 AND event_id % 5 = 0 THEN NULL ELSE state END").alias("state"))), "SELECT task_id, i, from_state, to_state, to_state IS NOT NULL AS available FROM (SELECT task_id, i, state AS to_state, last_value(state IGNORE NULLS) OVER (PARTITION BY task_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS from_state, first_value(state) OVER (PARTITION BY task_id ORDER BY i) AS f FROM (SELECT task_id, i, CASE WHEN i > 0 AND event_id % 5 = 0 THEN NULL ELSE state END AS state FROM a_states)) WHERE i > 0 AND f IS DISTINCT FROM 'PASS'")
query("m15_repair_result", "a_states", lambda s: t.repair_result(s.select("task_id", "i", (F.col("state") == "PASS").alias("passed"))), "SELECT task_id, CASE WHEN s0 = 'PASS' THEN 'not_applicable' WHEN passed_round >= 0 THEN 'repaired' ELSE 'not_repaired' END AS result FROM a_steps")
_MAP = "map_from_entries(filter(array(struct('syntax' as k, true as v), struct('imports' as k, task_id % 3 > 0 as v), struct('tests' as k, task_id % 4 > 0 as v), struct(if(task_id % 5 = 0, 'other', 'runtime') as k, true as v)), x -> true))"
query("m16_gate", "a_steps", lambda s: t.gates(s.select(F.col("task_id").alias("report_id"), F.expr(_MAP).alias("complete"), (F.col("n") - 1).alias("n_findings")), TECHNIQUES), "SELECT task_id AS report_id, c AS is_complete, c AND n = 1 AS gate FROM (SELECT task_id, n, task_id % 3 > 0 AND task_id % 4 > 0 AND task_id % 5 > 0 AS c FROM a_steps)")
query("m18_evolution_points", "a_states", lambda s: t.evolution_points(s.select("task_id", "i", F.expr("CASE WHEN event_id % 5 = 0 THEN NULL ELSE state END").alias("state"))), "SELECT task_id, i, CASE WHEN event_id % 5 <> 0 THEN CASE state WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'C' THEN 2 ELSE 3 END::BIGINT END AS level FROM a_states")
query("m19_legacy_summary", "a_states a_steps", lambda s, p: t.legacy_summary(s.filter("state <> 'PASS'").join(p.select("task_id", "passed_round"), "task_id").select("task_id", F.col("state").alias("category"), (F.col("passed_round") >= 0).alias("repaired"))), "SELECT category, num, den, floor(1000.0::DOUBLE * num / den + 0.5) / 1000.0 AS share FROM (SELECT state AS category, count(DISTINCT CASE WHEN passed_round >= 0 THEN task_id END) AS num, count(*) AS den FROM a_states JOIN a_steps USING (task_id) WHERE state <> 'PASS' GROUP BY state)")
query("m20_usage_defaults", "a_calls", lambda c: t.with_defaults(c).select("conv_id", "turn", "prompt_tokens", "completion_tokens", "total"), "SELECT conv_id, turn, coalesce(prompt_tokens, 0) AS prompt_tokens, coalesce(completion_tokens, 0) AS completion_tokens, coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0) AS total FROM a_calls")
