"""Readers, sinks and streams on real files."""

from __future__ import annotations

import gzip
import json

import pytest

from trialframe.sources import readers, sinks
from trialframe.streaming import logs


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def test_tasks(spark, tmp_path):
    t = lambda i, **k: {"task_id": i, "prompt": "p", "hidden_tests": "h", **k}
    assert readers.tasks(spark, lines(tmp_path / "a.jsonl", [t("1"), "", t("2")])).count() == 2
    for rows in ([t("1"), t("1")], [t("1", prompt=" ")], []):
        with pytest.raises(readers.BadInput):
            readers.tasks(spark, lines(tmp_path / "b.jsonl", rows))


def test_benchmarks(spark, tmp_path):
    h = lines(tmp_path / "h.jsonl", [{"task_id": "HumanEval/0", "prompt": "def f():\n", "canonical_solution": "  pass", "base_input": [[1]], "plus_input": {}}, "{broken"])
    a = lines(tmp_path / "a.jsonl", [{"problem_id": str(i), "difficulty": d, "prompt": "p"} for i, d in enumerate(("Interview", "competition"))])
    with gzip.open(tmp_path / "m.jsonl.gz", "wt") as f:
        f.write(json.dumps({"task_id": "Mbpp/1", "prompt": "p", "canonical_solution": "s", "entry_point": "g"}))
    assert readers.benchmark(spark, "HumanEval+", h).first()["canonical_solution"] == "def f():\n  pass"
    assert readers.apps(spark, a, ["INTERVIEW"]).count() == 1
    both = readers.problem_list(spark, {"humaneval": h, "mbpp": str(tmp_path / "m.jsonl.gz"), "apps": a})
    assert {(r["id"], r["tier"]) for r in both.collect()} == {("HumanEval/0", None), ("Mbpp/1", None), ("0", "Interview"), ("1", "competition")}
    with pytest.raises(readers.BadInput):
        readers.benchmark(spark, "other", h)
    with pytest.raises(readers.BadInput):
        readers.counted(readers.mbpp(spark, str(tmp_path / "m.jsonl.gz")), 399)
    assert readers.synthetic(spark).count() == 140


def test_caches_and_objects(spark, tmp_path):
    cache = {"schema": "v1", "dataset_sha256": "a" * 64, "model": "m", "llm_mode": "mock", "generation_prompt_style": "s", "entries": [{"task_id": "1", "hidden": {"passed": True, "state": "PASS"}}]}
    (tmp_path / "c").mkdir()
    (tmp_path / "c/ok.json").write_text(json.dumps(cache, indent=1))
    (tmp_path / "c/odd.json").write_text(json.dumps({**cache, "dataset_sha256": "x"}))
    (tmp_path / "c/list.json").write_text("[1]")
    (tmp_path / "c/broken.json").write_text("{")
    assert readers.cache(spark, f"{tmp_path}/c/ok.json").first()["hidden"]["passed"]
    (tmp_path / "d.json").write_text(json.dumps({**cache, "entries": cache["entries"] * 2}))
    for name in ("d.json", "c/broken.json"):
        with pytest.raises(readers.BadInput):
            readers.cache(spark, f"{tmp_path}/{name}")
    assert [r["name"] for r in readers.caches(spark, f"{tmp_path}/c").collect()] == ["ok.json"]
    assert readers.objects(spark, f"{tmp_path}/c/*.json", "model string").count() == 2
    lines(tmp_path / "x/b.jsonl", ["{}", "", "{}"])
    lines(tmp_path / "x/a.jsonl", ["{}"])
    assert [(r["name"], r["tasks"]) for r in readers.datasets(spark, f"{tmp_path}/x").collect()] == [("a.jsonl", 1), ("b.jsonl", 2)]


def test_sources_and_suites(spark, tmp_path):
    import hashlib

    for p in ("pkg/__init__.py", "pkg/a.py", ".hid/b.py", "venv/c.py", "d.txt"):
        lines(tmp_path / "s" / p, ["x"])
    assert [(r["path"], r["module"]) for r in readers.sources(spark, f"{tmp_path}/s").collect()] == [("pkg/__init__.py", "pkg"), ("pkg/a.py", "pkg.a")]
    lines(tmp_path / "q" / f"{hashlib.sha256(b'r1').hexdigest()}.py", ["suite"])
    frame = lambda *x: spark.createDataFrame([(v,) for v in x], "line string")
    assert readers.suites(spark, frame("r1"), f"{tmp_path}/q").first()["suite"] == "suite"
    with pytest.raises(Exception, match="no suite"):
        readers.suites(spark, frame("r2"), f"{tmp_path}/q").collect()


def test_sinks(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "id string, run string, v int, created string")
    path = f"{tmp_path}/t"
    sinks.upsert(rows(("a", "r1", 1, "t0"), ("b", "r2", 1, "t0")), path, ["id"], "run", keep=("created",))
    sinks.upsert(rows(("a", "r1", 2, "t1"), ("c", "r1", 3, "t1")), path, ["id"], "run", keep=("created",))
    assert {(r["id"], r["v"], r["created"]) for r in spark.read.parquet(path).collect()} == {("a", 2, "t0"), ("b", 1, "t0"), ("c", 3, "t1")}
    run = lambda c: spark.createDataFrame([("r", c)], "run_id string, config_json string")
    for _ in range(2):
        sinks.register_run(run("{}"), f"{tmp_path}/runs")
    assert spark.read.parquet(f"{tmp_path}/runs").count() == 1
    with pytest.raises(readers.BadInput):
        sinks.register_run(run("{ }"), f"{tmp_path}/runs")
    sinks.write_document(f"{tmp_path}/d.json", {"a": 1})
    with pytest.raises(ValueError):
        sinks.write_document(f"{tmp_path}/d.json", {"a": float("nan")})
    assert json.loads((tmp_path / "d.json").read_text()) == {"a": 1}
    with pytest.raises(Exception, match="not finite"):
        sinks.write_jsonl(spark.createDataFrame([(float("nan"),)], "x double"), f"{tmp_path}/n")
    sinks.append_jsonl(run("{}"), f"{tmp_path}/j")
    sinks.append_jsonl(run("{}"), f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    sinks.write_csv(run("key=sk-12"), f"{tmp_path}/csv", ["sk-12"])
    assert spark.read.csv(f"{tmp_path}/csv", header=True).first()["config_json"] == "key=[REDACTED]"
    assert sinks.markdown("T", run(None)).splitlines() == ["## T", "", "| run_id | config_json |", "|---|---|", "| r | N/A |"]
    assert json.loads(sinks.exported(run("x")).first()["json"]) == {"run_id": "r", "config_json": "x"}


def entry(task, i, passed):
    return {"schema": "v1", "run_id": "r", "task_id": task, "iteration": i, "hidden": {"passed": passed}}


def test_streams_give_what_batches_give(spark, tmp_path):
    log, out = tmp_path / "log", f"{tmp_path}/out"
    lines(log / "1.jsonl", [entry("a", 0, False), "", entry("b", 0, True)])
    for _ in range(2):
        logs.start(logs.entries(spark, str(log)), out, f"{tmp_path}/cp").awaitTermination(60)
        lines(log / "2.jsonl", [entry("a", 1, True), '{"task_id": "cut'])
    logs.start(logs.entries(spark, str(log)), out, f"{tmp_path}/cp").awaitTermination(60)
    assert spark.read.parquet(out).count() == readers.trajectories(spark, str(log)).count() == 3
    state = f"{tmp_path}/state"
    logs.start_upsert(logs.passed_state(spark, str(log)), state, f"{tmp_path}/cp2", ["run_id", "task_id"], "run_id").awaitTermination(60)
    lines(log / "3.jsonl", [entry("a", 2, False), entry("c", 0, False)])
    logs.start_upsert(logs.passed_state(spark, str(log)), state, f"{tmp_path}/cp2", ["run_id", "task_id"], "run_id").awaitTermination(60)
    assert {(r["task_id"], r["passed_at"], r["last_iteration"]) for r in spark.read.parquet(state).collect()} == {("a", 1, 2), ("b", 0, 0), ("c", None, 0)}
    lines(tmp_path / "p/1.json", [{"run_id": "r", "phase": "x", "completed": 1, "total": 2, "updated_at": "1"}])
    lines(tmp_path / "p/2.json", [{"run_id": "r", "phase": "y", "completed": 2, "total": 2, "updated_at": "2"}])
    logs.start_upsert(logs.progress(spark, f"{tmp_path}/p"), f"{tmp_path}/prog", f"{tmp_path}/cp3", ["run_id"], "run_id").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/prog").first()["phase"] == "y"
    assert logs.output_tail(spark, str(log), 2).count() == 2
