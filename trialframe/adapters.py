"""Driver tables as trial data. A test harness for the queries, not a capability: real inputs go through ``sources``.

Each adapter is one SELECT that Spark and DuckDB both run; ``{div}`` is integer division.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_STATE = "CASE event_type WHEN 'signup' THEN 'A' WHEN 'click' THEN 'B' WHEN 'purchase' THEN 'PASS' ELSE 'C' END"

ADAPTERS: dict[str, tuple[tuple[str, ...], str]] = {}

ADAPTERS["a_states"] = (("events",), f"""
SELECT task_id, i, state, event_id FROM (
  SELECT task_id, i, state, event_id, max(CASE WHEN state = 'PASS' THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done
  FROM (SELECT user_id AS task_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS i, {_STATE} AS state, event_id FROM events) e
  WHERE i <= 2) x WHERE coalesce(done, 0) = 0""")
#: One row per program and iteration 0..2, carried forward.
ADAPTERS["a_steps"] = (("events",), """
SELECT task_id, max(CASE WHEN i = 0 THEN state END) AS s0, coalesce(max(CASE WHEN i = 1 THEN state END), max(CASE WHEN i = 0 THEN state END)) AS s1,
  coalesce(max(CASE WHEN i = 2 THEN state END), max(CASE WHEN i = 1 THEN state END), max(CASE WHEN i = 0 THEN state END)) AS s2, CAST(count(*) AS BIGINT) AS n,
  CAST(coalesce(min(CASE WHEN state = 'PASS' THEN i END), -1) AS BIGINT) AS passed_round
FROM a_states GROUP BY task_id""")
ADAPTERS["a_problem_runs"] = (("events",), """
SELECT task_id, CASE WHEN task_id % 3 = 0 THEN 'humanevalplus' WHEN task_id % 3 = 1 THEN 'mbppplus' ELSE 'appsplus' END AS benchmark,
  CASE WHEN task_id % 3 = 2 THEN CASE (task_id {div} 3) % 3 WHEN 0 THEN 'Introductory' WHEN 1 THEN 'interview' ELSE 'competition' END END AS sub_tier,
  passed_round, passed_round >= 0 AS passed,
  CASE WHEN s0 <> 'PASS' THEN s0 END AS initial_bug_primary, CASE WHEN s0 = 'A' THEN concat('A.', CAST(1 + task_id % 3 AS VARCHAR(9))) WHEN s0 = 'B' THEN concat('B.', CAST(1 + task_id % 5 AS VARCHAR(9))) WHEN s0 = 'C' THEN concat('C.', CAST(1 + task_id % 4 AS VARCHAR(9))) END AS initial_bug_sub,
  CASE WHEN s2 <> 'PASS' THEN s2 END AS final_bug_primary, CASE WHEN s2 = 'A' THEN concat('A.', CAST(1 + task_id % 3 AS VARCHAR(9))) WHEN s2 = 'B' THEN concat('B.', CAST(1 + task_id % 5 AS VARCHAR(9))) WHEN s2 = 'C' THEN concat('C.', CAST(1 + task_id % 4 AS VARCHAR(9))) END AS final_bug_sub,
  CAST(1000 + task_id * 7 % 5000 AS BIGINT) AS total_duration_ms, CONCAT('run', CAST(task_id % 4 AS VARCHAR(9))) AS run_id
FROM a_steps""")
ADAPTERS["a_rounds"] = (("events",), """
SELECT s.task_id, s.i AS round_number, s.state = 'PASS' AS passed, CASE WHEN s.state <> 'PASS' THEN s.state END AS bug_primary,
  CAST(e.event_id % 977 AS BIGINT) AS token_count, CAST(floor(e.value * 1000) AS BIGINT) AS duration_ms, e.props AS response
FROM a_states s JOIN events e ON e.event_id = s.event_id""")
ADAPTERS["a_calls"] = (("conversations",), """
SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'repair' ELSE 'generation' END AS phase,
  CASE WHEN turn % 5 <> 0 THEN CAST(length(coalesce(text, '')) {div} 4 AS BIGINT) END AS prompt_tokens,
  CASE WHEN turn % 7 <> 0 THEN CAST(length(coalesce(text, '')) {div} 5 AS BIGINT) END AS completion_tokens, coalesce(text, '') AS text
FROM conversations""")
_SIGNALS = ["no_code_output", "syntax:IndentationError", "syntax:SyntaxError", "runtime:SyntaxError", "runtime:MyError:llm_defined", "import:ModuleNotFoundError", "collection:ImportError:external", "runtime:ImportError:candidate", "runtime:NameError:stdlib_unbound", "runtime:NameError", "runtime:TypeError", "collection:TypeError", "runtime:AttributeError", "runtime:KeyError", "timeout", "runtime:RecursionError", "functional:format", "functional:logic", "advisory:style"]
_MESSAGES = ["'(' was never closed", "import * only allowed at module level", "f() takes 2 positional arguments but 3 were given", "TypeError: f() missing 1 required positional argument: 'x'", "NameError: name 'math' is not defined", "NameError: name 'foo' is not defined", "IndexError: list index out of range", "RecursionError: maximum depth", "ValueError: bad", "AssertionError: assert 1 == 2", "Traceback (most recent call last):\n  File x\nE   KeyError: 1\nE   KeyError: 1", "Timeout after 5 s; time limit"]
_pick = lambda what, values: "CASE " + what + " " + " ".join("WHEN {} THEN {}".format(i, " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in v.split("\n"))) for i, v in enumerate(values)) + " END"
ADAPTERS["a_findings"] = (("events",), f"""
SELECT event_id AS finding_id, user_id AS report_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS ord,
  {_pick("event_id % 19", _SIGNALS)} AS signal, {_pick("(event_id {div} 3) % 12", _MESSAGES)} AS message,
  CASE WHEN event_id % 19 = 18 THEN 'advisory' ELSE 'correctness' END AS technique, CASE event_id % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  concat('m', CAST(event_id % 5 AS VARCHAR(9)), '.py') AS file, CAST(event_id % 11 AS BIGINT) AS line, CAST(1 + event_id % 3 AS BIGINT) AS occurrences, event_id % 2 = 0 AS is_before
FROM events""")
ADAPTERS["a_files"] = (("documents",), """
SELECT doc_id AS file_id, concat(CASE WHEN doc_id % 3 = 0 THEN './src/d' WHEN doc_id % 3 = 1 THEN 'pkg/sub/d' ELSE 'd' END, CAST(doc_id AS VARCHAR(19)), CASE WHEN doc_id % 7 = 0 THEN '_test.py' ELSE '.py' END) AS path,
  CASE WHEN doc_id % 31 = 0 THEN 'TEST' ELSE 'code' END AS category, coalesce(text, '') AS content FROM documents""")
ADAPTERS["a_runs"] = (("nation", "region"), """
SELECT n_name AS run_id, concat('2026-0', CAST(1 + n_nationkey % 3 AS VARCHAR(9)), '-01T00:00:00Z') AS started_at, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE concat('m', CAST(n_nationkey % 2 AS VARCHAR(9))) END AS model,
  CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE r_name END AS regime, CAST(n_nationkey % 3 AS BIGINT) AS seed, CAST(n_nationkey % 2 + 1 AS BIGINT) AS k, CAST(n_nationkey AS BIGINT) AS n, n_nationkey % 6 = 0 AS active,
  CASE WHEN n_nationkey % 6 = 1 THEN 'failed' WHEN n_nationkey % 6 = 2 THEN 'cancelled' END AS sidecar, n_nationkey % 6 = 3 AS completed, n_nationkey % 6 = 4 AS has_summary
FROM nation JOIN region ON n_regionkey = r_regionkey""")
ADAPTERS["a_states_big"] = (("lineitem",), """
SELECT task_id, i, state FROM (SELECT task_id, i, state, max(CASE WHEN state = 'PASS' THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done
  FROM (SELECT l_orderkey AS task_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS BIGINT) AS i,
    CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_linestatus = 'F' THEN 'A' ELSE 'B' END WHEN l_returnflag = 'R' THEN 'C' WHEN l_linestatus = 'F' THEN 'C' ELSE 'PASS' END AS state FROM lineitem) e
  WHERE i <= 4) x WHERE coalesce(done, 0) = 0""")
#: Adapters that an adapter is built on.
BASES = {"a_steps": ("a_states",), "a_problem_runs": ("a_states", "a_steps"), "a_rounds": ("a_states",)}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or an adapter as a DataFrame; names of views are bound in this statement only."""
    if name not in ADAPTERS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tables, sql = ADAPTERS[name]
    parts = {t: frame(spark, sf_dir, t) for t in (*tables, *BASES.get(name, ()))}
    text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(parts)})\b", r"\1 {\2}", sql.replace("{div}", "div"))
    return spark.sql(text, **parts)


def duck(sql: str) -> str:
    """``sql`` for DuckDB, preceded by the adapters that it names."""
    need = [a for a in ADAPTERS if a in sql]
    every = [a for a in ADAPTERS if a in need or any(a in BASES.get(n, ()) for n in need)]
    # "a_states_big" holds the name "a_states": both are harmless to define
    return "WITH RECURSIVE " + ", ".join(f"{a} AS ({ADAPTERS[a][1].replace('{div}', '//').strip()})" for a in every) + " " + sql if every else sql
