"""Published and property facts of the metrics, on frames made here."""

from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trialframe import adapters
from trialframe.functions import scanners, values
from trialframe.functions.rates import rate, rate_text
from trialframe.operators import classify, relational, sampling
from trialframe.operators import trajectory as t
from trialframe.taxonomy import RULES, STATES


def outcomes(spark, rows):
    return spark.createDataFrame([(f"t{i}", s, c) for i, (s, c) in enumerate(rows)], "task_id string, states array<string>, initial_category string")


PAPER = [(["C", "PASS", "PASS"], "C.1")] * 29 + [(["B", "C", "PASS"], "B.1")] * 6 + [(["C", "C", "C"], "C.1")] * 85


def by(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def test_paper_cohort(spark):
    o = outcomes(spark, PAPER)
    tall = t.tall(o, 2).cache()
    r = by(t.rsr(tall), "i")
    assert [(r[(i,)]["num"], r[(i,)]["pct"]) for i in (1, 2)] == [(29, 24.2), (35, 29.2)]
    c = by(t.conditional(tall), "i")
    assert list(c) == [(2,)] and (c[(2,)]["num"], c[(2,)]["den"], c[(2,)]["pct"]) == (6, 91, 6.6)
    p = by(t.per_primary(tall, 2), "i", "from_state")
    assert [(p[(1, s)]["num"], p[(1, s)]["den"], p[(1, s)]["pct"]) for s in "ABC"] == [(0, 0, None), (0, 6, 0.0), (29, 114, 25.4)]
    k = by(t.per_category(o, 2), "category")
    assert len(k) == 13 and (k[("C.1",)]["num"], k[("C.1",)]["den"]) == (29, 114) and (k[("B.1",)]["num"], k[("B.1",)]["den"]) == (6, 6)


def test_matrices_carry_forward(spark):
    o = outcomes(spark, [(["A", "PASS"], "A.1"), (["B", "C", "PASS"], "B.1"), (["C"], "C.1"), (["C", "B", "B", "C"], "C.1")])
    m = by(t.evolution(t.tall(o, 3), 3), "i", "from_state")
    row = lambda i, s: [m[(i, s)][f"to_{x.lower()}"] for x in STATES]
    assert row(1, "C") == [0, 1, 1, 0] and row(2, "PASS") == [0, 0, 0, 1] and row(3, "B") == [0, 0, 1, 0]
    assert m[(2, "A")]["total"] == 0 and m[(2, "A")]["pct_a"] is None and m[(1, "C")]["pct_b"] == 50.0


def test_rates(spark):
    got = spark.createDataFrame([(1, 16), (29, 120), (0, 0), (0, 6)], "n long, d long").select(rate("n", "d").alias("p"), rate_text("n", "d").alias("t")).collect()
    assert [r["p"] for r in got] == [6.3, 24.2, None, 0.0] and [r["t"] for r in got][1:3] == ["24.2% (29/120)", "not available"]
    with pytest.raises(Exception, match="0 <= num <= den"):
        spark.createDataFrame([(2, 1)], "n long, d long").select(rate("n", "d")).collect()


def test_invalid_outcomes(spark):
    o = outcomes(spark, [(["PASS"], ""), (["C", "PASS", "B"], ""), (["C", "X"], ""), ([], ""), (["C", "PASS", "PASS"], "")])
    assert [r["rule"] for r in t.violations(o).orderBy("task_id").collect()] == ["initial_pass", "not_absorbing", "unknown", "empty"]
    with pytest.raises(Exception, match="unknown category"):
        t.per_category(outcomes(spark, [(["C"], "Z.9")]), 2).collect()


def test_cost_keeps_null_and_zero_apart(spark):
    calls = lambda rows: spark.createDataFrame(rows, "prompt_tokens long, completion_tokens long, phase string")
    r = t.cost(calls([(1000, 500, "generation"), (100, 40, "repair"), (200, 60, "repair"), (None, None, "repair"), (None, None, "repair")]), 2).first()
    assert (r["calls"], r["without_usage"], r["prompt_tokens"], r["completion_tokens"], r["calls_per_program"]) == (4, 2, 300, 100, 2.0)
    r = t.cost(calls([(None, None, "repair")]), 0).first()
    assert r["prompt_tokens"] is None and r["calls_per_program"] is None
    assert t.cost(calls([(1, 1, "generation")]), 1).first()["prompt_tokens"] == 0


def test_multisets(spark):
    frame = lambda rows: spark.createDataFrame([("r", *x) for x in rows], "report_id string, category string, signal string, file string")
    before = frame([("A.1", "s", "m"), ("A.1", "s", "m"), ("B.1", "s2", "m"), ("C.1", "s", "a")])
    after = frame([("A.1", "s", "m"), ("C.1", "s", "b"), ("U", "new", "m")])
    r = relational.accounting(before, after, "report_id", ["category", "signal", "file"]).first()
    assert (r["found"], r["remaining"], r["resolved"], r["introduced"]) == (4, 1, 3, 2)


def test_classifiers_disagree_where_they_should(spark):
    f = spark.createDataFrame([("runtime:RecursionError", "RecursionError: x", "t"), ("runtime:ValueError", "ValueError: x", "t"), ("advisory", "", "advisory")], "signal string, message string, technique string")
    rows = classify.classified(f.withColumn("technique_name", F.lit("")).withColumn("technique_id", F.lit(0))).select("category", classify.batch().alias("b"), classify.web().alias("w")).collect()
    assert [tuple(r) for r in rows[:2]] == [("B.5", "B.3", "B.5"), ("B.3", "B.1", "B.3")] and rows[2]["category"] is None


def test_a_signal_must_match_as_a_whole(spark):
    f = spark.createDataFrame([("timeout\n", "", "t"), ("timeout", "", "t"), ("xtimeout", "", "t")], "signal string, message string, technique string")
    assert [r["category"] for r in classify.classified(f).collect()] == ["UNMAPPED", "B.5", "UNMAPPED"]


def test_taxonomy_is_valid_and_portable():
    assert all(classify.portable(p) for r in RULES for p in r[1:3] if p) and not classify.portable(r"(?=a)") and not classify.portable(r"a\1")


def test_exact_cohort(spark):
    d = spark.createDataFrame([(f"t{i % 50}",) for i in range(90)], "task_id string")
    ids = sorted({f"t{i}" for i in range(50)})
    assert sampling.exact_cohort(d, "task_id", 10, 3) == sorted(random.Random(3).sample(ids, 10)) == sampling.exact_cohort(d.orderBy(F.desc("task_id")), "task_id", 10, 3)
    assert sampling.exact_cohort(d, "task_id", 99, 3) == ids
    with pytest.raises(ValueError):
        sampling.exact_cohort(d, "task_id", 1, 1, most=20)


LITERALS = st.recursive(st.none() | st.booleans() | st.integers(-99, 99) | st.floats(allow_nan=False) | st.text(max_size=5) | st.binary(max_size=3), lambda x: st.lists(x, max_size=3) | st.tuples(x) | st.dictionaries(st.text(max_size=2), x, max_size=3), max_leaves=8)


@given(LITERALS)
def test_sources_round_trip(x):
    y = values.from_source(values.to_source(x))
    assert y == x and type(y) is type(x)
    assert values.equivalent(x, x) and values.equal_after_normalization(x, x)


def test_value_semantics():
    assert not values.equal_after_normalization(True, 1) and values.equal_after_normalization((1, "2"), [2.0, 1])
    assert not values.equivalent([1], (1,), 0.1) and values.equivalent(1.0, 1.0 + 1e-8) and not values.equivalent(float("nan"), float("nan"))
    assert values.rounding_equal(2.345, 2.35) and not values.rounding_equal(2.3, 2.3) and not values.rounding_equal(True, 1.0)
    assert values.to_source({3, 1}) == "{1, 3}" and values.from_source("frozenset({1})") == frozenset({1})
    with pytest.raises(ValueError):
        values.from_source("__import__('os')")


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(st.lists(st.sampled_from("ABC"), min_size=1, max_size=4).flatmap(lambda s: st.booleans().map(lambda p: s + ["PASS"] if p and len(s) < 4 else s)), min_size=1, max_size=40))
def test_rates_grow_and_matrices_chain(spark, states):
    tall = t.tall(outcomes(spark, [(s, "C.1") for s in states]), 3).cache()
    r = sorted((x["i"], x["num"]) for x in t.rsr(tall).collect())
    assert [n for _, n in r] == sorted(n for _, n in r) and r[-1][1] <= len(states)
    m = by(t.evolution(tall, 3), "i", "from_state")
    for i in (1, 2, 3):
        for s in STATES:
            assert m[(i, s)]["total"] == sum(x[min(i - 1, len(x) - 1)] == s for x in states)
            assert sum(m[(i, f)][f"to_{s.lower()}"] for f in STATES) == sum(x[min(i, len(x) - 1)] == s for x in states)
    tall.unpersist()


def test_scanners():
    text = "hi\n````py\n```\nx\n````\nmid\n```js\nno\n```\n```python\nlast"
    assert scanners.last_python(text) == ("last", "hi\n````py\n```\nx\n````\nmid\n```js\nno\n```", True)
    assert scanners.last_python("plain") == ("plain", "", False)
    assert scanners.line_diff("", "a\nb") == (2, 0, 0) and scanners.line_diff("a\nb\nc", "a\nx\nc") == (1, 1, 2)
    assert scanners.complexity("def f(x):\n  return [y for y in x if y and x or y]") == (4.0, 4, 0, 0) and scanners.complexity("def (") == (0.0, 0, 0, 0)
    assert scanners.closed_json('x {"a": """q"r""", "b": [1') == '{"a": "q\\"r", "b": [1]}' and scanners.closed_json("none") is None
    long = "def f(a):\n    \"\"\"Raises an error.\"\"\"\n" + "    x = 1\n" * 31
    assert {x for x, _ in scanners.function_findings(long)} >= {"Long function", "Claims to raise", "Missing return type", "Untyped parameters"}


def test_adapters_run(spark):
    assert adapters.frame(spark, "/root/testdata/sf0.001", "a_states").count() > 0


def test_long_lists_pair_off_without_recursion():
    from trialframe.functions import values

    numbers = list(range(3000))
    assert values.equal_after_normalization(numbers, [str(n) for n in numbers]) and values.equal_after_normalization([*numbers[1:], 0], numbers[:1] + numbers[1:])
    assert not values.equal_after_normalization(numbers, numbers[:-1] + [-1])
    pairs = {0: {0, 1}, 1: {0}, 2: {1, 2}, 3: {2, 3}}  # augmenting paths are needed here
    assert values.matched([3, 2, 0, 1], [0, 1, 2, 3], lambda x, y: y in pairs[x]) and not values.matched([0, 1, 1], [0, 1, 2], lambda x, y: y in pairs[x])


def test_line_diff_is_the_longest_common_subsequence():
    import random

    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("xyz") for _ in range(rng.randrange(1, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        same = table[-1][-1]
        assert scanners.line_diff("\n".join(a), "\n".join(b)) == (len(b) - same, len(a) - same, same)


def test_envelopes():
    files = '{"files": [{"name": "a.py", "content": """x = "1"\ny"""}, {"path": "p.toml"}, 3]}'
    import json

    want = [("a.py", "a.py", "python", 'x = "1"\ny'), ("file_2.py", "p.toml", "toml", "")]
    for text in ("Groq 400: " + json.dumps({"error": {"failed_generation": files}}) + " end", json.dumps({"choices": [{"message": {"content": "Here: " + files}}]})):
        assert [(f["name"], f["path"], f["language"], f["content"]) for f in scanners.enveloped_files(text)] == want
    assert scanners.enveloped_files("no object") == [] and scanners.enveloped_files('{"error": "x"}') == [] and scanners.enveloped_files('{"files": null}') == []
    assert scanners.enveloped_files("{" * 5000) == [] and scanners.enveloped_files('{"choices": []}') == []


def test_prompts(spark):
    from pyspark.sql import functions as F

    from trialframe.functions import prompts, text

    row = spark.createDataFrame([("{b}", "1 failed\nFAILED a/b.py:3 - assert x", 1)], "a string, out string, code int")
    assert row.select(prompts.filled("{a} {b c} {d}", {"a": F.col("a"), "b c": "{a}"})).first()[0] == "{b} {a} {d}"
    with pytest.raises(ValueError):
        prompts.filled("{a}", {"x": "1"})
    for mode in ("intervenor", "nonsense"):
        with pytest.raises(ValueError):
            prompts.repair_prompt(mode, {}, *(F.lit("") for _ in range(6)), 1)
    status, details, issues = row.select(*text.pytest_report("out", "code", F.lit(None))).first()
    assert (status, details) == ("FAIL", "1 test(s) failed, 0 passed") and [tuple(i) for i in issues] == [("a/b.py", 3, "FAILED a/b.py:3 - assert x")]
    with pytest.raises(Exception, match="no tests"):
        row.select(text.test_preview("a")).collect()


def test_audit(spark):
    from trialframe.functions import audit

    files = spark.createDataFrame([
        (1, "a.py", "import os\nimport re\nre.x(open(p))"), (2, "pkg/__init__.py", "open(p)"), (3, "b.py", None), (4, "c.py", ""), (5, "d.py", 'x = "\\d"\nx = r"\\d"\n# "\\d"\nfrom foo import y'),
    ], "file_id long, path string, content string")
    got = sorted((r["file_id"], r["n"] or 0, r["title"]) for r in audit.static_findings(files).collect())
    assert got == [(1, 0, audit.MAIN_GUARD[0]), (1, 1, "Unused import 'os' (F401)"), (5, 1, audit.ESCAPE[0]), (5, 4, "Unverified import 'foo'")]
    assert [r["passed"] for r in audit.checklist(audit.static_findings(files.filter("file_id = 4"))).orderBy("ord").collect()] == [True] * 15


def test_definition():
    import copy
    import json

    from trialframe import definition as d
    from trialframe.taxonomy import CATEGORIES

    entry = lambda i, p: {"id": i, "primary": i[0], "name": "n", "priority": p, "auto_assignable": i not in d.MANUAL, "repair_hint": "h", "not_assigned_reason": "r"}
    good = {
        "schema": d.SCHEMA, "version": "1.0.0", "primary_types": [entry(p, 1) for p in d.PRIMARY_TYPES], "categories": [entry(c, i + 1) for i, c in enumerate(CATEGORIES)],
        "unmapped": {"id": "U", "name": "n", "priority": 13, "primary_state": "C", "repair_hint": "h"}, "checklist": ["x"] * 10,
        "rules": [{"id": "R", "category": "A.1", "confidence": 1, "match": {"signal": "a", "message": None}}], "prompts": {p: {"variables": ["a b"], "text": "{a b}"} for p in d.PROMPTS},
    }
    assert d.parsed(json.dumps(good)) == good
    for text in ("", "{", "[]"):
        with pytest.raises(d.BadDefinition):
            d.parsed(text)

    def bad(place, change):
        x = copy.deepcopy(good)
        change(x)
        with pytest.raises(d.BadDefinition) as e:
            d.parsed(json.dumps(x))
        assert e.value.place == place

    bad("version", lambda x: x.update(version="2", checklist=[]))  # the first broken rule counts
    bad("$.rules[0].confidence", lambda x: x["rules"][0].update(confidence="1"))
    bad("$.rules[0].match.other", lambda x: x["rules"][0]["match"].update(other=1))
    bad("$.unmapped.name", lambda x: x["unmapped"].pop("name"))
    bad("categories[1].id", lambda x: x["categories"][1].update(id="A.1"))
    bad("categories", lambda x: x["categories"][0].update(priority=2))
    bad("categories", lambda x: (x["categories"][0].update(priority=12), x["categories"][11].update(priority=1)))
    bad("unmapped.priority", lambda x: x["unmapped"].update(priority=3))
    bad("primary_types[3].auto_assignable", lambda x: x["primary_types"][3].update(auto_assignable=True))
    bad("categories[0].not_assigned_reason", lambda x: x["categories"][0].update(auto_assignable=False, not_assigned_reason=" "))
    bad("checklist", lambda x: x["checklist"].pop())
    bad("rules[0].category", lambda x: x["rules"][0].update(category="C.2"))
    bad("rules[0].match.signal", lambda x: x["rules"][0]["match"].update(signal="(?=a)"))
    bad("rules[0].match", lambda x: x["rules"][0].update(match={}))
    bad("prompts.lesson", lambda x: x["prompts"]["lesson"].update(optional=True))
    bad("prompts.tivr_repair.variables[0]", lambda x: x["prompts"]["tivr_repair"].update(text="none"))


def test_guards(tmp_path):
    import os

    from trialframe.operators import catalog
    from trialframe.sources import sinks

    (tmp_path / "root" / "in").mkdir(parents=True)
    root = str(tmp_path / "root")
    os.symlink(tmp_path, tmp_path / "root" / "out")
    assert catalog.guarded(root, "in/../in/a.json") == os.path.join(root, "in", "a.json") and catalog.guarded(root, "in\\b") == os.path.join(root, "in", "b")
    for path in ("", " ", "/etc", "\\x", "C:x", "a\nb", "..", "in/../..", ".", "out/x", "out", "a./b", " a", "in/b "):
        with pytest.raises(ValueError):
            catalog.guarded(root, path)
    seen = []
    f = tmp_path / "x.json"
    f.write_text("1")
    for text in (None, None, "22"):
        if text:
            f.write_text(text)
        assert sinks.described(str(f), lambda p: seen.append(p) or len(seen)) == (2 if text else 1)


def test_report_metrics():
    assert scanners.report_metrics("\n# a\ndef f(x):\n    return g(x) if x else 1\n\n") == (3, 2.0, 1, 33.3)
    assert scanners.report_metrics("") == (0, 1.0, 0, 0.0) and scanners.report_metrics("def (") == (1, 1.0, 0, 0.0)
