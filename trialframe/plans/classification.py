"""Queries of group 2.5: classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify as c
from ..registry import query
from ..taxonomy import CATEGORIES, LIBRARIES, RULES, WEB_LIBRARIES

q = lambda s: "'" + s.replace("'", "''") + "'"
_hit = lambda r: f"regexp_matches(signal, {q(chr(92) + 'A(?:' + r[1] + ')' + chr(92) + 'z')})" + (f" AND regexp_matches(message, {q(r[2])})" if r[2] else "")
_CAT = "CASE WHEN technique = 'advisory' THEN NULL " + " ".join(f"WHEN {_hit(r)} THEN '{r[3]}'" for r in RULES) + " ELSE 'UNMAPPED' END"
_RULE = "CASE WHEN technique = 'advisory' THEN NULL " + " ".join(f"WHEN {_hit(r)} THEN '{r[0]}'" for r in RULES) + " END"
_SURE = "CASE rule_id " + " ".join(f"WHEN '{r[0]}' THEN {r[4]}::DOUBLE" for r in RULES) + " END"
FOUND = f"(SELECT *, {_SURE} AS confidence FROM (SELECT *, {_CAT} AS category, {_RULE} AS rule_id FROM a_findings))"
_RANK = "CASE category " + " ".join(f"WHEN '{x}' THEN {i + 1}" for i, x in enumerate(CATEGORIES)) + " ELSE 13 END"
query("c1_rules", "a_findings", lambda f: c.classified(f).select("finding_id", "category", "rule_id", "confidence"), f"SELECT finding_id, category, rule_id, confidence FROM {FOUND}")
query("j9_first_rule", "a_findings", lambda f: c.classified(f).groupBy("rule_id").agg(F.count("*").alias("n")), f"SELECT rule_id, count(*) AS n FROM {FOUND} GROUP BY rule_id")
query("c3_diagnoses", "a_findings", lambda f: c.diagnoses(c.classified(f)).select("report_id", "category", "priority", "confidence", "summary", F.array_join("signals", ",").alias("signals"), F.array_join("rules", ",").alias("rules")),
      f"SELECT report_id, category, ({_RANK})::BIGINT AS priority, max(confidence) AS confidence, arg_min(message, ord) AS summary, (SELECT string_agg(s, ',' ORDER BY o) FROM (SELECT s, min(o) AS o FROM (SELECT unnest(list(signal)) AS s, unnest(list(ord)) AS o) GROUP BY s)) AS signals, coalesce((SELECT string_agg(s, ',' ORDER BY o) FROM (SELECT s, min(o) AS o FROM (SELECT unnest(list(rule_id)) AS s, unnest(list(ord)) AS o) WHERE s IS NOT NULL GROUP BY s)), '') AS rules FROM {FOUND} WHERE category IS NOT NULL GROUP BY report_id, category")
_has = lambda *w: "(" + " OR ".join(f"contains(message, {q(x)})" for x in w) + ")"
_in = lambda v: "(" + ", ".join(q(x) for x in v) + ")"
_NAME = r"regexp_extract(message, 'NameError:\s+name\s+''([^'']+)''\s+is not defined', 1)"
_BATCH = (
    f"CASE WHEN {_has('TimeoutExpired', 'time limit')} THEN 'B.5' WHEN {_has('IndentationError', 'TabError')} THEN 'A.2' WHEN {_has('SyntaxError')} THEN 'A.1' WHEN {_NAME} IN {_in(LIBRARIES)} THEN 'A.3' WHEN {_NAME} <> '' THEN 'B.2' "
    r"WHEN regexp_matches(message, 'TypeError:\s+.*(?:takes\s+\d+\s+positional argument|missing\s+\d+\s+required positional argument)') THEN 'B.4' "
    f"WHEN {_has('IndexError', 'KeyError', 'ZeroDivisionError', 'RecursionError', 'OverflowError')} THEN 'B.3' WHEN {_has('AttributeError', 'TypeError', 'ValueError', 'ModuleNotFoundError', 'ImportError')} THEN 'B.1' WHEN {_has('AssertionError', 'assert ', 'FAILED')} THEN 'C.1' WHEN {_has('Traceback (most recent call last):')} THEN 'B.1' ELSE 'C.1' END"
)
query("c4_batch", "a_findings", lambda f: f.select("finding_id", c.batch().alias("category")), f"SELECT finding_id, {_BATCH} AS category FROM a_findings")
_N = "CASE ord % 4 WHEN 0 THEN 'Pytest' WHEN 1 THEN 'Radon CC' WHEN 2 THEN 'Import check' ELSE 'x' END"
_nh = lambda w: f"contains(nm, '{w}')"
_NE = _has("NameError", "UnboundLocalError")
_WEB = (
    f"CASE WHEN {_has('IndentationError', 'TabError')} THEN 'A.2' WHEN {_has('ModuleNotFoundError', 'ImportError')} OR {_nh('Import')} THEN 'A.3' WHEN {_has('SyntaxError', 'unexpected EOF', 'invalid syntax')} OR {_nh('AST')} THEN 'A.1' "
    f"WHEN {_NE} AND regexp_matches(message, 'name ''({'|'.join(WEB_LIBRARIES)})'' is not defined') THEN 'A.3' WHEN {_NE} THEN 'B.2' WHEN {_has('IndexError', 'KeyError', 'ZeroDivisionError', 'ValueError', 'OverflowError')} THEN 'B.3' "
    f"WHEN {_has('TypeError')} AND {_has('takes', 'positional', 'argument', 'missing required')} THEN 'B.4' WHEN {_has('AttributeError', 'TypeError')} THEN 'B.1' WHEN {_has('Timeout', 'RecursionError', 'RuntimeError')} THEN 'B.5' WHEN {_has('assert', 'AssertionError')} OR {_nh('Pytest')} THEN 'C.1' "
    f"WHEN {_has('format')} OR ({_has('expected')} AND {_has('tuple', 'list', 'dict', 'str')}) THEN 'C.3' WHEN {_nh('Radon')} OR {_nh('Semgrep')} THEN 'C.4' " + " ".join(f"WHEN line = {k} THEN '{v}'" for k, v in c.WEB_FALLBACK.items()) + " ELSE 'C.1' END"
)
query("c5_web", "a_findings", lambda f: f.withColumn("technique_name", F.expr(_N)).select("finding_id", c.web(number="line").alias("category")), f"SELECT finding_id, {_WEB} AS category FROM (SELECT *, {_N} AS nm FROM a_findings)")
query("c6_report", "a_findings", lambda f: f.select("finding_id", c.interpreter_report().alias("report")), "SELECT finding_id, CASE WHEN contains(message, 'Traceback (most recent call last):') THEN 'Traceback (most recent call last):' || chr(10) || '  File x' || chr(10) || 'E   KeyError: 1' || chr(10) || 'KeyError: 1' ELSE substr(message, 1, 500) END AS report FROM a_findings")
query("c7_signals", "a_findings", lambda f: f.select("finding_id", F.split("signal", ":")[0].alias("stage"), F.try_element_at(F.split("signal", ":"), F.lit(2)).alias("exc"), F.expr("if(line = 1, 'candidate', 'x')").alias("module"), F.expr("if(line = 2, 'candidate', 'y')").alias("name"), (F.col("line") > 5).alias("std")).select("finding_id", c.enriched_signal("stage", "exc", "module", "name", F.col("std")).alias("signal")),
      "SELECT finding_id, concat_ws(':', s, e, CASE WHEN line = 1 THEN 'llm_defined' WHEN e = 'NameError' AND line > 5 THEN 'stdlib_unbound' WHEN e = 'ImportError' AND line = 2 THEN 'candidate' WHEN e = 'ImportError' THEN 'external' END) AS signal FROM (SELECT *, split_part(signal, ':', 1) AS s, nullif(split_part(signal, ':', 2), '') AS e FROM a_findings)")
query("c8_last_error", "a_findings", lambda f: f.select("finding_id", c.last_error().alias("signal")), r"SELECT finding_id, 'collection:' || coalesce(list_last(regexp_extract_all(message, '(?m)^E   ([A-Za-z_][A-Za-z0-9_.]*): ', 1)), 'unknown') AS signal FROM a_findings")
_X4 = "SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY ord) AS place FROM (SELECT report_id, signal, message, min(ord) AS ord, sum(occurrences)::BIGINT AS occurrences FROM a_findings {} GROUP BY ALL)"
query("x4_grouped", "a_findings", c.grouped, f"SELECT * FROM ({_X4.format('')}) WHERE place <= 5")
query("c9_report_findings", "a_findings", c.report_findings, f"SELECT report_id, signal, message, ord, occurrences FROM ({_X4.format(chr(32).join(['WHERE signal LIKE', q('collection:%'), 'OR signal LIKE', q('runtime:%')]))}) WHERE place <= 5 UNION ALL SELECT report_id, arg_min(signal, ord), arg_min(message, ord), min(ord), sum(occurrences)::BIGINT FROM a_findings WHERE signal LIKE 'functional:%' GROUP BY report_id")
_OUT = "CASE ord % 3 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' ELSE 'collection_error' END"
query("c11_test_counts", "a_findings", lambda f: c.test_counts(f.withColumn("outcome", F.expr(_OUT))), "SELECT report_id, count(*) FILTER (ord % 3 = 0) AS passed, count(*) FILTER (ord % 3 <> 0) AS failed FROM a_findings GROUP BY report_id")
query("c12_stdlib", "a_findings", lambda f: f.filter(F.regexp_extract("message", "name '([^']+)'", 1).isin(*LIBRARIES)).groupBy("report_id").agg(F.count("*").alias("n")), f"SELECT report_id, count(*) AS n FROM a_findings WHERE regexp_extract(message, 'name ''([^'']+)''', 1) IN {_in(LIBRARIES)} GROUP BY report_id")
_DIST = f"(SELECT DISTINCT report_id, category, file, line, message FROM {FOUND} WHERE category IS NOT NULL)"
query("c13_bug_report", "a_findings", lambda f: c.bug_report(c.classified(f).filter("category is not null")).select("report_id", "total", "type_a", "type_b", "type_c", F.size("by_category").cast("long").alias("categories")), f"SELECT report_id, count(*) AS total, count(*) FILTER (category LIKE 'A%') AS type_a, count(*) FILTER (category LIKE 'B%') AS type_b, count(*) FILTER (category LIKE 'C%') AS type_c, count(DISTINCT category) AS categories FROM {_DIST} GROUP BY report_id")
_CAT = "concat(CASE finding_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END, '.1')"
query("c14_optimization", "a_findings", lambda f: (lambda d: c.optimization(d.filter("is_before"), d.filter("not is_before and ord % 3 = 0")))(f.withColumn("category", F.expr(_CAT))),
      "SELECT report_id, b AS n_before, a AS n_after, " + ", ".join(f"greatest(0, b{x} - a{x}) AS fixed{x}, CASE WHEN b{x} > 0 THEN ((2000 * greatest(0, b{x} - a{x}) + b{x}) // (2 * b{x})) / 10.0 END AS pct_fixed{x}" for x in ("", "_a", "_b", "_c"))
      + ", CASE WHEN b > 0 THEN CASE WHEN a = 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END END AS rsr FROM (SELECT report_id, " + ", ".join(f"count(*) FILTER (is_before{w}) AS b{x}, count(*) FILTER (NOT is_before AND ord % 3 = 0{w}) AS a{x}" for x, w in (("", ""), ("_a", " AND finding_id % 3 = 0"), ("_b", " AND finding_id % 3 = 1"), ("_c", " AND finding_id % 3 = 2")))
      + " FROM a_findings GROUP BY report_id) WHERE a + b > 0")
_COUNTS = f"(SELECT report_id, line % 4 AS i, {_CAT} AS category, count(*) AS n FROM a_findings GROUP BY ALL)"
query("c14_decreases", "a_findings", lambda f: c.decreases(f.select("report_id", (F.col("line") % 4).alias("iteration"), F.expr(_CAT).alias("category"))),
      f"SELECT report_id, i AS iteration, category, n - m AS fewer FROM (SELECT x.report_id, x.i, x.category, x.n, coalesce(y.n, 0) AS m, max(x.i) OVER (PARTITION BY x.report_id) AS last FROM {_COUNTS} x LEFT JOIN {_COUNTS} y ON y.report_id = x.report_id AND y.category = x.category AND y.i = x.i + 1) WHERE i < last AND n > m")
query("c15_winner", "a_problem_runs", lambda p: p.withColumn("b", F.expr("cast(task_id % 4 - 1 as long)")).withColumn("t", F.lit(3000)).select("task_id", c.winner("passed_round", "b", "total_duration_ms", "t").alias("winner")),
      "SELECT task_id, CASE WHEN x = 0 OR y = 0 OR x < 0 AND y < 0 THEN 'tie' WHEN l < m THEN 'a' WHEN m < l THEN 'b' WHEN d < 3000 THEN 'a' WHEN d > 3000 THEN 'b' ELSE 'tie' END AS winner FROM (SELECT task_id, passed_round AS x, task_id % 4 - 1 AS y, total_duration_ms AS d, CASE WHEN passed_round < 0 THEN 99 ELSE passed_round END AS l, CASE WHEN task_id % 4 = 0 THEN 99 ELSE task_id % 4 - 1 END AS m FROM a_problem_runs)")
query("c16_token_estimate", "a_calls", lambda x: x.select("conv_id", "turn", c.token_estimate("text", "phase").alias("tokens")), "SELECT conv_id, turn, ((length(text) + length(phase) + 3) // 4)::BIGINT AS tokens FROM a_calls")
