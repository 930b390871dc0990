"""Queries of groups 2.7 and 2.8: text, code and values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import audit, prompts
from ..functions import scanners as sc
from ..functions import text as t
from ..functions import values as v
from ..registry import query

q = lambda s: "'" + s.replace("'", "''") + "'"
_BOX = "concat('intro', chr(10), '```python', chr(10), 'def f', cast(file_id as varchar(19)), '(): pass', chr(10), '```', chr(10), 'mid', chr(10), '```', chr(10), 'x = 1', chr(10), '```')"
_TAGGED = "concat('intro', chr(10), '```python', chr(10), 'def f', cast(file_id as varchar(19)), '(): pass', chr(10), '```', chr(10), 'mid', chr(10), '```', CASE file_id % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'py' ELSE '' END, chr(10), 'x = ', cast(file_id as varchar(19)), chr(10), '```')"
query("t1_last_python", "a_files", lambda f: f.select("file_id", F.expr(_TAGGED).alias("x")).select("file_id", sc.as_column(lambda x: sc.last_python(x)[0], "string", "x").alias("code")), f"SELECT file_id, regexp_extract_all({_TAGGED}, '```(?:python3|python|py)?\\n((?s:.*?))\\n```', 1)[-1] AS code FROM a_files")
query("t2_best_def", "a_files", lambda f: f.select("file_id", F.expr(_BOX).alias("x")).select("file_id", t.best_block("x").alias("code")), "SELECT file_id, 'def f' || file_id || '(): pass' || chr(10) AS code FROM a_files")
_NAMED = "concat('### File: p', cast(file_id % 5 as varchar(19)), '.py', chr(10), '```', chr(10), 'x = ', cast(file_id as varchar(19)), chr(10), '```', chr(10), CASE WHEN file_id % 2 = 0 THEN concat('## File: q.py', chr(10)) ELSE '' END, '```py', chr(10), 'y = 2', chr(10), 'z', chr(10), '```')"
query("t3_named_files", "a_files", lambda f: sc.scanned(f.select("file_id", F.expr(_NAMED).alias("content")), sc.named_files, "path string, body string"),
      f"SELECT file_id, CASE WHEN i = 1 THEN names[1] ELSE names[-1] END AS path, bodies[i] AS body FROM (SELECT file_id, regexp_extract_all(x, '#+ File: (\\S+)', 1) AS names, regexp_extract_all(x, '```\\w*\\n((?s:.*?))\\n```', 1) AS bodies FROM (SELECT file_id, {_NAMED} AS x FROM a_files)), range(1, 3) t(i)")
query("t4_repaired", "a_files", lambda f: sc.scanned(f.select("file_id", F.expr(f"concat('### File: ./a.py', chr(10), {_BOX})").alias("content")), lambda x: list(sc.repaired_files(x).items()), "path string, body string"), "SELECT file_id, 'a.py' AS path, 'x = 1' AS body FROM a_files")
query("t5_legacy_block", "a_files", lambda f: f.select("file_id", F.expr(f"if(file_id % 2 = 0, {_BOX}, path)").alias("x")).select("file_id", t.last_block("x").alias("code")), "SELECT file_id, CASE WHEN file_id % 2 = 0 THEN 'x = 1' || chr(10) ELSE path END AS code FROM a_files")
_I = "concat('intro', chr(10), CASE WHEN file_id % 2 = 0 THEN concat('Name: g', cast(file_id as varchar(19)), chr(10)) ELSE '' END, 'signature: (x)', chr(10), 'def h', cast(file_id as varchar(19)), '(x):')"
query("t6_interface", "a_files", lambda f: f.select("file_id", F.expr(_I).alias("x")).select("file_id", t.interface("x")[0].alias("name"), t.interface("x")[1].alias("signature")), "SELECT file_id, CASE WHEN file_id % 2 = 0 THEN 'g' ELSE 'h' END || file_id AS name, '(x)' AS signature FROM a_files")
query("t7_examples", "a_files", lambda f: sc.scanned(f.select("file_id", F.expr("concat('>>> f(', file_id, ')', chr(10), '3', chr(10), 'f(1) == 2', chr(10), 'f(1) -> 5')").alias("content")), sc.examples, "input string, output string"), "SELECT file_id, unnest(['f(' || file_id || ')', 'f(1)']) AS input, unnest(['3', '2']) AS output FROM a_files")
query("t8_test_hash", "a_files", lambda f: f.select("file_id", t.test_hash(F.concat(F.replace("content", F.lit("\n"), F.lit("\r\n")), F.lit(" \n"))).alias("h")), "SELECT file_id, sha256(regexp_replace(content, '\\s+$', '')) AS h FROM a_files")
query("t9_split_hash", "a_files", lambda f: f.select("file_id", t.split_hash("content").alias("h")), "SELECT file_id, sha256(trim(regexp_replace(content, '[ \\t\\r\\f\\v]+\\n', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) || chr(10)) AS h FROM a_files")
query("t10_test_count", "a_files", lambda f: f.select("file_id", t.test_count(F.concat("content", F.expr("repeat('def test_a (x):', cast(file_id % 4 as int))"))).alias("n")), "SELECT file_id, file_id % 4 AS n FROM a_files")
_SUITE = "concat('import m', chr(10), repeat(concat('def test_a(x):', chr(10), '    assert x ', repeat('+ 1', 200), chr(10)), cast(1 + file_id % 8 as int)))"
query("t10_preview", "a_files", lambda f: f.select("file_id", F.expr(_SUITE).alias("x")).select("file_id", t.test_preview("x").alias("text")),
      f"SELECT file_id, rtrim(array_to_string(list_transform(CASE WHEN k > 5 THEN l[1:11] ELSE l END, lambda y: CASE WHEN length(y) > 500 THEN y[1:500] || ' # ... preview truncated' ELSE y END), chr(10)) || CASE WHEN k > 5 THEN chr(10) || '# ... [Remaining tests omitted from preview. 5+ tests verified in sandbox]' ELSE '' END, ' ' || chr(10)) AS text FROM (SELECT file_id, string_split({_SUITE}, chr(10)) AS l, len(regexp_extract_all({_SUITE}, 'def test_')) AS k FROM a_files)")
_M = lambda f: f.select("file_id", t.line_metrics(F.concat("content", F.lit("\n# x\n")))[0].alias("n"), t.line_metrics(F.concat("content", F.lit("\n# x\n")))[1].alias("comments"), t.line_metrics(F.concat("content", F.lit("\n# x\n")))[2].alias("pct"))
query("t11_line_metrics", "a_files", _M, "SELECT file_id, n, c AS comments, ((2000 * c + n) // (2 * n)) / 10.0 AS pct FROM (SELECT file_id, count(*) AS n, count(*) FILTER (regexp_matches(l, '^\\s*#')) AS c FROM (SELECT file_id, unnest(string_split(content || chr(10) || '# x' || chr(10), chr(10))) AS l FROM a_files) WHERE regexp_matches(l, '\\S') GROUP BY file_id)")
_CODE = "concat('import os', chr(10), 'def f(x):', chr(10), '    if x and ', file_id, ':', chr(10), '        return g(x)', chr(10))"
_BRANCHES = "concat(repeat(concat('import m', chr(10)), cast(file_id % 2 as int)), 'import os', chr(10), 'def f(x):', repeat(concat(chr(10), '    if x and y:', chr(10), '        g(x)'), cast(file_id % 4 as int)), chr(10), '    return x', chr(10))"
query("t12_complexity", "a_files", lambda f: sc.scanned(f.select("file_id", F.expr(_BRANCHES).alias("content")), lambda c: [sc.complexity(c)], "mean double, most long, calls long, imports long"),
      f"SELECT file_id, cc::DOUBLE AS mean, cc::BIGINT AS most, len(regexp_extract_all(x, 'g\\('))::BIGINT AS calls, len(list_distinct(regexp_extract_all(x, 'import (\\w+)', 1)))::BIGINT AS imports FROM (SELECT file_id, x, 1 + len(regexp_extract_all(x, '\\bif\\b')) + len(regexp_extract_all(x, '\\band\\b')) AS cc FROM (SELECT file_id, {_BRANCHES} AS x FROM a_files))")
query("t14_line_diff", "a_files", lambda f: sc.scanned(f, lambda c: [sc.line_diff(c, "first\n" + c + "\nlast")], "added long, removed long, same long"), "SELECT file_id, CASE WHEN content = '' THEN 3 ELSE 2 END::BIGINT AS added, 0::BIGINT AS removed, CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) END::BIGINT AS same FROM a_files")
_DEFS = "concat(repeat(concat('# a', chr(10)), cast(file_id % 3 as int)), 'def f(x):', repeat(concat(chr(10), '    y = x'), cast(1 + file_id % 5 as int)), CASE WHEN file_id % 2 = 0 THEN concat(chr(10), '    return y') ELSE '' END, chr(10), 'z = 1')"
query("t15_functions", "a_files", lambda f: sc.scanned(f.select("file_id", F.expr(_DEFS).alias("content")), lambda c: [(x["name"], x["line"], x["end_line"], x["has_return"]) for x in sc.functions_of(c)], "name string, line long, end_line long, has_return boolean"),
      f"SELECT file_id, regexp_extract(x, 'def (\\w+)', 1) AS name, list_position(l, 'def f(x):')::BIGINT AS line, (len(l) - 1)::BIGINT AS end_line, contains(x, 'return') AS has_return FROM (SELECT file_id, {_DEFS} AS x, string_split({_DEFS}, chr(10)) AS l FROM a_files)")
_LINES = "(SELECT file_id, path, n::BIGINT AS n, l AS line FROM (SELECT file_id, path, unnest(string_split(content, chr(10))) AS l, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM {}))"
def _hits(rules) -> str:
    def one(name, severity, rule_id, needs, excludes, path):
        hit = " AND ".join([*(f"regexp_matches(line, {q(p)})" for p in needs), *(f"NOT regexp_matches(line, {q(p)})" for p in excludes), *([f"regexp_matches(path, {q(path)})"] if path else [])])
        title = f"replace(replace({q(name)}, '{{length}}', length(line)::VARCHAR), '{{word}}', regexp_extract(line, '#\\s*(TODO|FIXME|HACK|XXX|WARN)', 1))"
        return f"CASE WHEN {hit} THEN {{'title': {title}, 'severity': {q(severity)}, 'rule_id': {q(rule_id)}, 'rule': {q(name)}}} END"

    return "unnest(list_filter([" + ", ".join(one(*r) for r in rules) + "], lambda x: x IS NOT NULL)) AS f"


_flat = "SELECT file_id, n, f.title AS title, f.severity AS severity, f.rule_id AS rule_id, f.rule AS rule FROM "
query("t16_secret_lines", "a_files", lambda f: t.line_findings(t.line_table(f), t.SECRET_RULES), f"{_flat} (SELECT file_id, n, {_hits(t.SECRET_RULES)} FROM {_LINES.format('a_files')})")
_PY = "concat(content, chr(10), CASE file_id % 5 WHEN 0 THEN 'try: x' WHEN 1 THEN 'except:  # noqa' WHEN 2 THEN 'y = eval(z)  # TODO x' WHEN 3 THEN 'def f(a=[]): print(1)' ELSE 'f = open(p); yaml.load(s)' END)"
_FILES = f"(SELECT file_id, path, {_PY} AS content FROM a_files)"
query("t17_line_rules", "a_files", lambda f: t.line_findings(t.line_table(f.withColumn("content", F.expr(_PY))), t.LINE_RULES), f"{_flat} (SELECT file_id, n, {_hits(t.LINE_RULES)} FROM {_LINES.format(_FILES)})")
_RULES = lambda f: t.line_findings(t.line_table(f.withColumn("content", F.expr(_PY))), t.LINE_RULES).select("file_id", "n", F.col("rule").alias("title"))
query(
    "t21_matrix", "a_files", lambda f: t.technique_matrix(_RULES(f), tuple(r[0] for r in t.LINE_RULES)),
    f"SELECT r AS title, count(rule) AS n, CASE WHEN count(rule) = 0 THEN 'PASS' ELSE 'FINDINGS' END AS status FROM (SELECT unnest([{', '.join(q(r[0]) for r in t.LINE_RULES)}]) AS r) LEFT JOIN (SELECT f.rule AS rule FROM (SELECT {_hits(t.LINE_RULES)} FROM {_LINES.format(_FILES)})) ON r = rule GROUP BY r",
)
_AUDIT = r"""concat(content, chr(10), CASE file_id % 8 WHEN 0 THEN 'import os' WHEN 1 THEN concat('import os', chr(10), 'os.x') WHEN 2 THEN concat('from typing import Any', chr(10), 'x: Any') WHEN 3 THEN 'allow_origins=["*"], allow_credentials=True' WHEN 4 THEN 'requests.get(u)' WHEN 5 THEN concat('requests.get(u)', chr(10), 'if __name__ == "__main__":') WHEN 6 THEN concat('import leftpad', chr(10), 'x = "a', chr(92), 'd"') ELSE concat('from _x import y', chr(10), 'x = r"a', chr(92), 'd"') END)"""
_AL = _LINES.format(f"(SELECT file_id, path, {_AUDIT} AS content FROM a_files)")
_rule = lambda r, title=None: f"{title or q(r[0])} AS title, {q(r[1])} AS severity, {q(r[2])} AS rule_id, {q(r[0])} AS rule"
_AUDITED = f"""(WITH l AS {_AL} SELECT file_id, max(CASE WHEN own THEN n END) AS n, {_rule(audit.UNUSED_IMPORT, "'Unused import ' || chr(39) || w || chr(39) || ' (F401)'")}, max(CASE WHEN own THEN line END) AS line
  FROM (SELECT file_id, n, line, w, regexp_extract(line, '^import\\s+(\\w+)$', 1) = w AS own FROM (SELECT file_id, n, line, unnest(list_distinct(regexp_extract_all(line, '\\w+'))) AS w FROM l)) GROUP BY file_id, w HAVING count(*) = 1 AND bool_or(own)
UNION ALL SELECT file_id, n, {_rule(audit.UNKNOWN_IMPORT, "'Unverified import ' || chr(39) || m || chr(39)")}, line FROM (SELECT *, regexp_extract(line, '^(?:import|from)\\s+([a-zA-Z0-9_]+)', 1) AS m FROM l) WHERE m <> '' AND m NOT LIKE '\\_%' ESCAPE '\\' AND m NOT IN ({', '.join(map(q, audit.KNOWN_MODULES))})
UNION ALL SELECT file_id, n, {_rule(audit.ESCAPE)}, line FROM l WHERE regexp_matches(regexp_extract(line, {q(audit.QUOTED)}, 1), {q(audit.BAD_ESCAPE)}) AND NOT starts_with(line, '#') AND NOT regexp_matches(line, {q(audit.RAW_STRING)})
UNION ALL SELECT file_id, min(n) FILTER (regexp_matches(line, '\\bAny\\b')), {_rule(audit.LOOSE_ANY)}, arg_min(line, n) FILTER (regexp_matches(line, '\\bAny\\b')) FROM l GROUP BY file_id HAVING bool_or(regexp_matches(line, {q(audit.ANY_IMPORT)}))
UNION ALL SELECT file_id, min(n) FILTER (regexp_matches(line, {q(audit.STAR_ORIGIN)})), {_rule(audit.CORS)}, arg_min(line, n) FILTER (regexp_matches(line, {q(audit.STAR_ORIGIN)})) FROM l GROUP BY file_id HAVING bool_or(regexp_matches(line, {q(audit.STAR_ORIGIN)})) AND bool_or(contains(line, 'allow_credentials=True'))
UNION ALL SELECT file_id, NULL, {_rule(audit.MAIN_GUARD)}, '' FROM l GROUP BY file_id, path HAVING bool_or(regexp_matches(line, {q(audit.SIDE_EFFECT)})) AND NOT bool_or(regexp_matches(line, {q(audit.GUARD)})) AND path LIKE '%.py' AND NOT contains(path, '__init__'))"""
_audited = lambda f: f.withColumn("content", F.expr(_AUDIT))
query("t17_file_rules", "a_files", lambda f: audit.line_audit(t.line_table(_audited(f))).unionByName(audit.unused_imports(_audited(f))).unionByName(audit.file_audit(_audited(f))), f"SELECT file_id, n, title, severity, rule_id, rule, line FROM {_AUDITED}")
_EVERY = f"(SELECT title, line FROM {_AUDITED} UNION ALL SELECT f.title, line FROM (SELECT line, {_hits((*t.LINE_RULES, *t.SECRET_RULES))} FROM {_AL}))"
query("t21_checklist", "a_files", lambda f: audit.checklist(audit.static_findings(_audited(f))),
      "SELECT i AS ord, c.label AS label, NOT failed[i] AS passed FROM (SELECT [" + ", ".join(f"coalesce(bool_or(regexp_matches({where}, {q(p)})), false)" for _, where, p in audit.CHECKLIST) + f"] AS failed FROM {_EVERY}), (SELECT unnest([{', '.join(q(c[0]) for c in audit.CHECKLIST)}]) AS label, unnest(range(1, 16)) AS i) c")
_DEP = "concat(CASE file_id % 4 WHEN 0 THEN 'numpy>=1.2' WHEN 1 THEN 'numpy>=1.2,<2' WHEN 2 THEN 'pandas==1.*' ELSE 'x==1.0' END, '')"
query("t18_dependencies", "a_files", lambda f: t.floating_dependencies(t.line_table(f.select("file_id", F.expr("if(file_id % 3 = 0, 'a/requirements-dev.txt', path)").alias("path"), F.expr(_DEP).alias("content")))), "SELECT file_id, 1::BIGINT AS n, CASE file_id % 4 WHEN 0 THEN 'numpy' ELSE 'pandas' END AS name, CASE file_id % 4 WHEN 0 THEN 'floating' ELSE 'wildcard' END AS kind FROM a_files WHERE file_id % 3 = 0 AND file_id % 4 IN (0, 2)")
_LOOP = "concat('for x in y:', repeat(concat(chr(10), '  pass'), cast(file_id % 10 as int)), chr(10), '  db.query(x)', chr(10), 's += ''a''', chr(10), 's += ''b''')"
query("t19_loop_queries", "a_files", lambda f: t.loop_queries(t.line_table(f.withColumn("content", F.expr(_LOOP)))), "SELECT file_id, 1::BIGINT AS n FROM a_files WHERE file_id % 10 < 8")
query("t19_loop_strings", "a_files", lambda f: sc.scanned(f.select("file_id", F.expr(_LOOP).alias("content")), sc.loop_concatenations, "line long"), "SELECT file_id, 3 + file_id % 10 AS line FROM a_files")
_TYPED = "concat('def ', CASE WHEN file_id % 5 = 0 THEN 'test_f' ELSE 'f' END, '(self, x', CASE WHEN file_id % 2 = 0 THEN ': int' ELSE '' END, ')', CASE WHEN file_id % 3 = 0 THEN ' -> int' ELSE '' END, ':', repeat(concat(chr(10), '    y = x'), cast(file_id % 40 as int)), chr(10), '    pass')"
query("t20_function_rules", "a_files", lambda f: sc.scanned(f.select("file_id", F.expr(_TYPED).alias("content")), sc.function_findings, "title string, line long"),
      f"SELECT file_id, unnest(list_filter([CASE WHEN NOT contains(x, '->') THEN 'Missing return type' END, CASE WHEN NOT contains(x, 'x: int') THEN 'Untyped parameters' END, CASE WHEN contains(x, 'test_') AND len(l) = 2 THEN 'Empty test' END, CASE WHEN len(l) > 30 THEN 'Long function' END, CASE WHEN len(l) > 5 THEN 'Missing docstring' END], lambda y: y IS NOT NULL)) AS title, 1::BIGINT AS line FROM (SELECT file_id, {_TYPED} AS x, string_split({_TYPED}, chr(10)) AS l FROM a_files)")
query("t22_rendered", "a_files", lambda f: f.select("file_id", prompts.filled("see {the path} {other} {n}", {"the path": F.concat("path", F.lit("{n}")), "n": F.length("content").cast("string")}).alias("text")), "SELECT file_id, 'see ' || path || '{n} {other} ' || length(content) AS text FROM a_files")
query("t23_feedback", "a_findings", lambda f: f.groupBy("report_id").agg(F.bool_or((F.col("signal") == "timeout") & (F.col("ord") < 9)).alias("late"), F.array_sort(F.collect_list(F.when((F.col("severity") == "CRITICAL") & (F.col("ord") < 9), F.struct("ord", "message")))).alias("e")).select("report_id", t.feedback(F.col("late"), F.transform("e", lambda x: x["message"])).alias("text")),
      "SELECT report_id, CASE WHEN bool_or(signal = 'timeout' AND ord < 9) THEN 'The execution of the code has exceeded the time limit' WHEN count(*) FILTER (severity = 'CRITICAL' AND ord < 9) > 0 THEN array_to_string(list_slice(list(message ORDER BY ord) FILTER (severity = 'CRITICAL' AND ord < 9), 1, 3), chr(10) || chr(10)) ELSE 'The functionality of code is incorrect' END AS text FROM a_findings GROUP BY report_id")
#: Templates of a test; real ones come from a taxonomy file.
_TEMPLATES = {
    "dou_critique": "P {prompt}\nS {solution}\nE {error log}\n{checklist}|", "generic_repair": "{spec}/{code}/{evidence_block}", "tivr_repair": "{spec}/{code}/{iteration} of {budget}\n{diagnosis_block}\n{evidence_block}\n{lessons_block}.",
    "diagnosis_line": "* {primary} -> {secondary} ({confidence})", "guidance_line": "  {repair_hint}", "evidence_line": "* {signal}{location}: {message}", "lessons_header": "## Lessons\n",
}


def _reports(f):
    """A row for each report with its first four findings, and diagnoses and lessons made of them."""
    kept = f.filter("ord <= 4").select("report_id", F.struct("ord", "technique", "signal", F.expr("if(ord = 3, null, file)").alias("file"), F.expr("if(ord = 2, null, line)").alias("line"), "message", F.expr("if(finding_id % 2 = 0, concat('ev', ord, chr(10)), ' ')").alias("evidence")).alias("f"))
    r = kept.groupBy("report_id").agg(F.array_sort(F.collect_list("f")).alias("f"))
    diagnoses = F.transform(F.filter("f", lambda x: x["technique"] != "advisory"), lambda x: F.struct(x["signal"].alias("primary"), F.lit("s").alias("secondary"), F.when(x["ord"] != 2, x["ord"] / 8).alias("confidence"), x["message"].alias("repair_hint")))
    return r.select("report_id", "f", diagnoses.alias("d"), F.transform("f", lambda x: x["signal"]).alias("l"), (F.col("report_id") % 3 + 1).alias("i"))


def _prompts(f):
    r = _reports(f)
    args = (_TEMPLATES, F.lit(" p "), F.concat(F.lit("c{spec}"), "report_id"), F.col("f"), F.col("d"), F.col("l"), F.col("i"), 2)
    return r.select("report_id", *(prompts.repair_prompt(m, *args, feedback=F.get("l", F.lit(0)), checklist="1.\n2.").alias(m) for m in prompts.MODE_TEMPLATES))


_R = """(SELECT report_id, report_id % 3 + 1 AS i, array_agg(signal ORDER BY ord) AS l,
  coalesce(string_agg('* ' || signal || ' -> s (' || CASE ord WHEN 1 THEN '0.13' WHEN 2 THEN 'n/a' WHEN 3 THEN '0.38' ELSE '0.50' END || ')' || chr(10) || '  ' || message, chr(10) ORDER BY ord) FILTER (technique <> 'advisory'), '* No diagnosis produced.') AS d,
  string_agg('* ' || signal || CASE ord WHEN 1 THEN ' [' || file || ':' || line || ']' WHEN 2 THEN ' [' || file || ']' ELSE '' END || ': ' || message || CASE WHEN finding_id % 2 = 0 THEN chr(10) || '```' || chr(10) || 'ev' || ord || chr(10) || '```' ELSE '' END, chr(10) ORDER BY ord) FILTER (ord <= 3) AS e,
  string_agg(CASE WHEN finding_id % 2 = 0 THEN 'ev' || ord || chr(10) ELSE message END, chr(10) || chr(10) ORDER BY ord) FILTER (ord <= 3) AS g
  FROM a_findings WHERE ord <= 4 GROUP BY report_id)"""
_TIVR = "'p/c{spec}' || report_id || '/' || i || ' of 2' || chr(10) || %s || chr(10) || %s || chr(10) || %s || '.'"
query("t24_prompt", "a_findings", _prompts,
      "SELECT report_id, " + ", ".join(f"'P  p ' || chr(10) || 'S c{{spec}}' || report_id || chr(10) || 'E ' || l[1] || chr(10) || {c} || '|' AS {m}" for m, c in (("dou", "'1.' || chr(10) || '2.'"), ("dou_no_bt", "''")))
      + ", 'p/c{spec}' || report_id || '/' || g AS generic, " + _TIVR % ("'* (see evidence below)'", "e", "''") + " AS evidence_only, " + _TIVR % ("d", "'(withheld in this configuration)'", "''") + " AS taxonomy_only, "
      + _TIVR % ("d", "e", "CASE WHEN i >= 2 THEN chr(10) || '## Lessons' || chr(10) || array_to_string(l[-2:], chr(10)) || chr(10) ELSE '' END") + f' AS "full" FROM {_R}')
query("t25_redacted", "a_files", lambda f: f.select("file_id", t.redacted("path", ["d1", "d12", ".py"]).alias("path")), "SELECT file_id, replace(replace(replace(path, '.py', '[REDACTED]'), 'd12', '[REDACTED]'), 'd1', '[REDACTED]') AS path FROM a_files")
query("t26_exposures", "a_files benchmark", lambda f, b: sc.exposures(f, b.select(F.col("item_id").alias("token_id"), F.col("text").alias("token"))), "SELECT file_id, item_id AS token_id FROM a_files JOIN benchmark ON contains(content, benchmark.text)")
_FILES_JSON = "concat('{\"files\": [{\"name\": \"f', cast(file_id as varchar(19)), '.py\", \"content\": ', CASE WHEN file_id % 2 = 0 THEN concat('\"\"\"x = \"1\"', chr(10), 'y\"\"\"') ELSE '\"x = 1\"' END, '}, {\"path\": \"a.toml\"}]}')"
_quoted = "replace(replace(replace({}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n')"
_ENVELOPE = f"CASE file_id % 3 WHEN 0 THEN concat('Groq 400: {{\"error\": {{\"failed_generation\": \"', {_quoted.format(_FILES_JSON)}, '\"}}}} end') WHEN 1 THEN concat('{{\"choices\": [{{\"message\": {{\"content\": \"Here: ', {_quoted.format(_FILES_JSON)}, '\"}}}}]}}') ELSE '{{\"files\": [{{}}]}}' END"
query("t27_envelope", "a_files", lambda f: sc.scanned(f.select("file_id", F.expr(_ENVELOPE).alias("content")), lambda x: [(y["name"], y["path"], y["language"], y["category"], y["content"]) for y in sc.enveloped_files(x)], "name string, path string, language string, category string, body string"),
      "SELECT file_id, unnest(CASE WHEN file_id % 3 = 2 THEN ['file_1.py'] ELSE ['f' || file_id || '.py', 'file_2.py'] END) AS name, unnest(CASE WHEN file_id % 3 = 2 THEN ['file_1.py'] ELSE ['f' || file_id || '.py', 'a.toml'] END) AS path, unnest(CASE WHEN file_id % 3 = 2 THEN ['python'] ELSE ['python', 'toml'] END) AS language, 'other' AS category, unnest(CASE WHEN file_id % 3 = 2 THEN [''] WHEN file_id % 2 = 0 THEN ['x = \"1\"' || chr(10) || 'y', ''] ELSE ['x = 1', ''] END) AS body FROM a_files")
query("t28_trimmed", "a_files", lambda f: f.select("file_id", t.trimmed("content", 5, 2).alias("x")).select("file_id", F.sha2("x", 256).alias("h")), "SELECT file_id, sha256(CASE WHEN len(l) <= 5 THEN content ELSE array_to_string(l[1:2] || ['...'] || l[-2:], chr(10)) END) AS h FROM (SELECT file_id, content, string_split(content, chr(10)) AS l FROM a_files)")
query("t29_snippet", "a_files", lambda f: f.select("file_id", t.snippet("content", F.lit(2), 1).alias("x")), "SELECT file_id, CASE WHEN len(l) >= 2 THEN '     1 | ' || l[1] || chr(10) || '>    2 | ' || l[2] || CASE WHEN len(l) >= 3 THEN chr(10) || '     3 | ' || l[3] ELSE '' END END AS x FROM (SELECT file_id, string_split(content, chr(10)) AS l FROM a_files)")
_P = "concat('=== ', CASE WHEN file_id % 3 > 0 THEN concat(cast(file_id % 7 as varchar(9)), ' passed, ') ELSE '' END, CASE WHEN file_id % 2 > 0 THEN concat(cast(file_id % 5 as varchar(9)), ' failed') ELSE '' END)"
query("t30_pytest", "a_files", lambda f: f.select("file_id", F.expr(_P).alias("x")).select("file_id", t.pytest_counts("x")[0].alias("passed"), t.pytest_counts("x")[1].alias("failed"), t.pytest_counts("x")[2].alias("pct")), "SELECT file_id, p AS passed, f AS failed, CASE WHEN p + f > 0 THEN ((2000 * p + p + f) // (2 * (p + f))) / 10.0 END AS pct FROM (SELECT file_id, CASE WHEN file_id % 3 > 0 THEN file_id % 7 ELSE 0 END AS p, CASE WHEN file_id % 2 > 0 THEN file_id % 5 ELSE 0 END AS f FROM a_files)")
_RUN = "concat(repeat(concat('FAILED pkg/a.py:', cast(file_id as varchar(19)), ' - x', chr(10), 'ok', chr(10), '  assert y', chr(10)), cast(file_id % 8 as int)), CASE WHEN file_id % 3 = 0 THEN '4 passed, 2 skipped' WHEN file_id % 3 = 1 THEN '3 failed, 1 passed' ELSE '7 passed' END)"
_EXIT = "CAST(CASE file_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN -1 ELSE 1 END AS INT) AS code, CASE WHEN file_id % 10 = 2 THEN 'it Timed Out' ELSE '' END AS err"
query("t30_pytest_report", "a_files", lambda f: f.selectExpr("file_id", f"{_RUN} AS x", *(e for e in (_EXIT.split(", CASE WHEN")[0], "CASE WHEN" + _EXIT.split(", CASE WHEN")[1]))).select("file_id", *(c.alias(n) for c, n in zip(t.pytest_report("x", "code", "err"), ("status", "details", "issues"), strict=True))).select("file_id", "status", "details", F.coalesce(F.size("issues"), F.lit(0)).cast("long").alias("n"), F.get("issues", F.lit(0))["line"].alias("line"), F.try_element_at("issues", F.lit(-1))["message"].alias("last")),
      f"SELECT file_id, status, CASE WHEN status = 'FAIL' THEN CASE WHEN late THEN 'The execution of the code has exceeded the time limit (timeout)' ELSE coalesce(nullif(regexp_extract(x, '(\\d+) failed', 1), ''), '?') || ' test(s) failed, ' || regexp_extract(x, '(\\d+) passed', 1) || ' passed' END WHEN code = 5 THEN 'No test functions found in generated code' WHEN status = 'PASS' THEN regexp_extract(x, '(\\d+) passed', 1) || ' test(s) passed' END AS details, CASE WHEN status = 'FAIL' THEN len(hits) ELSE 0 END::BIGINT AS n, CASE WHEN status = 'FAIL' AND len(hits) > 0 THEN file_id END AS line, CASE WHEN status = 'FAIL' AND len(hits) > 0 THEN trim(hits[-1]) END AS last FROM (SELECT *, contains(lower(err), 'timed out') AS late, CASE WHEN code < 0 AND NOT contains(lower(err), 'timed out') THEN 'ERROR' WHEN code = 0 AND contains(x, 'skipped') THEN 'SKIP' WHEN code = 0 THEN 'PASS' WHEN code = 5 THEN 'SKIP' ELSE 'FAIL' END AS status, list_filter(string_split(x, chr(10)), lambda y: contains(y, 'FAILED') OR contains(y, 'assert'))[1:10] AS hits FROM (SELECT file_id, {_RUN} AS x, {_EXIT} FROM a_files))")
_MYPY = "concat('Found x', chr(10), repeat(concat('pkg', chr(92), 'a.py:', cast(file_id as varchar(19)), ':7: error: bad thing  [arg-type]', chr(10), 'b.py:3: note: y', chr(10), 'c.py:4: error: z', chr(10)), cast(file_id % 5 as int)))"
query("t31_mypy", "a_files", lambda f: f.select("file_id", F.posexplode(t.mypy_findings(F.expr(_MYPY))).alias("ord", "m")).select("file_id", (F.col("ord") + 1).cast("long").alias("ord"), "m.*"),
      "SELECT file_id, i AS ord, CASE WHEN i % 2 = 1 THEN 'pkg/a.py' ELSE 'c.py' END AS file, CASE WHEN i % 2 = 1 THEN file_id ELSE 4 END AS line, CASE WHEN i % 2 = 1 THEN 'mypy:arg-type' ELSE 'mypy:error' END AS signal, CASE WHEN i % 2 = 1 THEN 'bad thing' ELSE 'z' END AS message FROM a_files, range(1, 6) t(i) WHERE i <= 2 * (file_id % 5)")
query("t32_collected", "a_files", lambda f: f.select("file_id", F.expr("case file_id % 5 when 0 then 'Collected 7 tests' when 1 then '9 items collected' when 2 then 'a.py::test_x b.py::test_y' when 3 then concat('collected 0 items', chr(10), ' def test_a():') else concat('def test_a():', chr(10), '  def test_b(): def test_c():') end").alias("x")).select("file_id", t.collected("x").alias("n")), "SELECT file_id, CASE file_id % 5 WHEN 0 THEN 7 WHEN 1 THEN 9 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 2 END::BIGINT AS n FROM a_files")
_STUB = "concat('a.py::test_', cast(file_id as varchar(19)), ' PASSED', chr(13), chr(10), 'a.py::test_b FAILED', chr(10), CASE WHEN file_id % 2 = 0 THEN 'test_c passed' ELSE '' END)"
query("t32_passed_on_stub", "a_files", lambda f: f.select("file_id", F.explode(t.passed_on_stub(F.expr(_STUB))).alias("name")), f"SELECT file_id, regexp_extract(l, 'test_\\w+') AS name FROM (SELECT file_id, unnest(string_split({_STUB}, chr(10))) AS l FROM a_files) WHERE contains(upper(l), 'PASSED')")
_CUT = "concat('{\"k\": [', repeat('[1, ', cast(file_id % 3 as int)), cast(file_id as varchar(19)), CASE WHEN file_id % 2 = 0 THEN ',' ELSE ', \"ab' END)"
query("t33_truncated", "a_files", lambda f: f.select("file_id", F.expr(_CUT).alias("x")).select("file_id", sc.as_column(sc.closed_json, "string", "x").alias("json")), f"SELECT file_id, rtrim(x, ',') || CASE WHEN len(string_split(x, '\"')) % 2 = 0 THEN '\"' ELSE '' END || repeat(']', len(string_split(x, '[')) - 1) || repeat('}}', len(string_split(x, '{{')) - 1) AS json FROM (SELECT file_id, {_CUT} AS x FROM a_files)")


def _sources(f):
    # every other report's findings are of its tests
    r = _reports(f.withColumn("technique", F.expr("if(report_id % 2 = 0 and ord % 2 = 0, 'tests', 'runtime')")))
    c, spec = F.col("f"), prompts.specification(F.lit(" p "), F.expr("if(report_id % 3 = 0, 'f(x)', ' ')"))
    return r.select("report_id", prompts.tagged(spec, prompts.visible_tests(c, False, _TEMPLATES), prompts.history(F.expr("if(report_id % 5 = 0, array(), l)"), F.col("i"), F.size("f"))).alias("counted"), prompts.visible_tests(c, True, _TEMPLATES).alias("detailed"))


_K = """(SELECT report_id, report_id % 3 + 1 AS i, array_agg(signal ORDER BY ord) AS l, count(*) AS n, count(*) FILTER (report_id % 2 = 0 AND ord % 2 = 0) AS k,
  string_agg('- Test Failure in `' || file || '`: ' || message || CASE WHEN finding_id % 2 = 0 THEN chr(10) || '```' || chr(10) || 'ev' || ord || chr(10) || '```' ELSE '' END, chr(10) ORDER BY ord) FILTER (report_id % 2 = 0 AND ord % 2 = 0) AS tests,
  string_agg('* ' || signal || CASE ord WHEN 1 THEN ' [' || file || ':' || line || ']' WHEN 2 THEN ' [' || file || ']' ELSE '' END || ': ' || message || CASE WHEN finding_id % 2 = 0 THEN chr(10) || '```' || chr(10) || 'ev' || ord || chr(10) || '```' ELSE '' END, chr(10) ORDER BY ord) FILTER (ord <= 3) AS e
  FROM a_findings WHERE ord <= 4 GROUP BY report_id)"""
query("t34_sources", "a_findings", _sources, f"""SELECT report_id, '## [prompt-only] Problem Specification & Interface Contract' || chr(10) || 'p' || CASE WHEN report_id % 3 = 0 THEN chr(10) || chr(10) || '### Confirmed Function Interface:' || chr(10) || '```python' || chr(10) || 'f(x)' || chr(10) || '```' ELSE '' END
  || chr(10) || chr(10) || '## [visible-test-detail] Test Verification Summary' || chr(10) || CASE WHEN k > 0 THEN '- ' || k || ' test assertion(s) failed against the locked test suite.' || chr(10) || '  (Detailed test traceback and assertion inputs withheld to prevent test fitting).' ELSE '- Program failed pre-test correctness checks (syntax, imports, or runtime crash).' END
  || CASE WHEN i >= 2 THEN chr(10) || chr(10) || '## [history] Previous Repair Round Critique & Unresolved Issues' || chr(10) || CASE WHEN report_id % 5 = 0 THEN '- Round ' || (i - 1) || ' attempt left ' || n || ' unresolved issue(s). Do not repeat the same logic error.' ELSE '- ' || array_to_string(l[-2:], chr(10) || '- ') END ELSE '' END AS counted,
  '## [visible-test-detail] Test Failure Execution Details' || chr(10) || coalesce(tests, e) AS detailed FROM {_K}""")
query("s16_non_finite", "a_runs", lambda d: d.select("run_id", F.get_json_object(t.whole_json(F.expr("concat('{\"a\": ', if(n % 2 = 0, 'NaN', string(n)), ', \"b\": \"NaN\"}')")), "$.a").alias("a")), "SELECT run_id, CASE WHEN n % 2 = 1 THEN n::VARCHAR END AS a FROM a_runs")

_A, _B = "concat('[', file_id % 3, ', 1.0, (2,)]')", "concat('[', file_id % 2, ', 1, (2,)]')"
_pair = lambda f: f.select("file_id", F.expr(_A).alias("a"), F.expr(_B).alias("b"))
query("v1_equivalent", "a_files", lambda f: _pair(f).select("file_id", v.compared(v.equivalent, "a", "b").alias("same")), "SELECT file_id, file_id % 3 = file_id % 2 AS same FROM a_files")
query("v2_normalized", "a_files", lambda f: f.select("file_id", F.expr("concat('[1, ', file_id % 3, ']')").alias("a"), F.lit("('2', 1.0)").alias("b")).select("file_id", v.compared(v.equal_after_normalization, "a", "b").alias("same")), "SELECT file_id, file_id % 3 = 2 AS same FROM a_files")
query("v3_rounding", "a_files", lambda f: f.select("file_id", F.expr("concat('2.34', file_id % 10)").alias("a"), F.lit("2.35").alias("b")).select("file_id", v.compared(v.rounding_equal, "a", "b").alias("same")), "SELECT file_id, file_id % 10 >= 5 AS same FROM a_files")
query("v4_source", "a_files", lambda f: f.select("file_id", F.expr("concat('{3, ', file_id % 9 + 10, ', 1}')").alias("a")).select("file_id", sc.as_column(lambda x: v.to_source(v.from_source(x)), "string", "a").alias("source")), "SELECT file_id, '{1, ' || (file_id % 9 + 10) || ', 3}' AS source FROM a_files")
query("v5_differential", "a_files", lambda f: v.differential(f.filter("file_id % 4 > 0").select(F.col("file_id").alias("input"), F.col("path").alias("output")), f.filter("file_id % 5 > 0").select(F.col("file_id").alias("input"), F.expr("if(file_id % 3 = 0, '<KeyError>', path)").alias("output"))).select("input"), "SELECT file_id AS input FROM a_files WHERE file_id % 4 > 0 AND file_id % 5 = 0 OR file_id % 5 > 0 AND (file_id % 4 = 0 OR file_id % 3 = 0)")
query("c10_functional_kind", "a_files", lambda f: v.functional_kind(f.select((F.col("file_id") % 60).alias("report_id"), F.expr("if(file_id % 20 = 3, null, '1.0')").alias("actual"), F.expr("if(file_id % 7 = 2, '3', '\"1\"')").alias("expected"))), "SELECT r AS report_id, CASE WHEN r % 20 = 3 THEN 'unextractable' WHEN bool_or(file_id % 7 = 2) THEN 'logic' ELSE 'format' END AS kind FROM (SELECT file_id, file_id % 60 AS r FROM a_files) GROUP BY r")
