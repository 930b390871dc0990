"""Stateful scans of text, as plain functions and Arrow UDFs: what regular expressions can't say."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PYTHON_TAGS = ("", "python", "py", "python3")
_FENCE = re.compile(r"^\s{0,3}(`{3,})\s*([^\s`]*)[^`]*$")


def blocks(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(first line, line after, tag, content) of fenced blocks: a fence ends at one at least as long; the last may be open."""
    lines, open_at, mark, tag = text.split("\n"), None, "", ""
    for i, line in enumerate(lines):
        m = _FENCE.match(line)
        if open_at is None:
            if m:
                open_at, mark, tag = i, m[1], m[2].lower()
        elif m and len(m[1]) >= len(mark) and not m[2]:
            yield open_at, i + 1, tag, "\n".join(lines[open_at + 1 : i])
            open_at = None
    if open_at is not None:
        yield open_at, len(lines), tag, "\n".join(lines[open_at + 1 :])


def last_python(text: str) -> tuple[str, str, bool]:
    """(code, the rest, whether there was a block) of the last Python block."""
    found = [b for b in blocks(text) if b[2] in PYTHON_TAGS]
    if not found:
        return text, "", False
    first, after, _, code = found[-1]
    lines = text.split("\n")
    return code, "\n".join(lines[:first] + lines[after:]).strip(), True


def named_files(text: str) -> list[tuple[str, str]]:
    """(path, content) of each block, under the last ``### File:`` header before it; solution.py, then file_N.py without one."""
    lines, out = text.split("\n"), []
    for n, (first, _, _, code) in enumerate(blocks(text)):
        names = [m[1].strip().strip("`") for x in lines[:first] if (m := re.match(r"^#{2,4}\s*File:\s*(.+)$", x.strip()))]
        out.append((names[-1] if names else "solution.py" if n == 0 else f"file_{n + 1}.py", code))
    return out


def repaired_files(text: str) -> dict[str, str]:
    """T4: the last block of each file; test files are left out."""
    test = re.compile(r"(?:^|/)(?:test_[^/]*|[^/]*_test|conftest)\.py$")
    return {p.removeprefix("./").replace("\\", "/"): c for p, c in named_files(text) if not test.search(p)}


def examples(prompt: str) -> list[tuple[str, str]]:
    """(input, output): doctests, Input/Output lines, and f(x) == y or -> forms (one for each input of these)."""
    out = [(a.strip(), b.strip()) for a, b in re.findall(r"^\s*>>> (.+)\n\s*(?!>>>)(\S.*)$", prompt, re.M)]
    out += [(a.strip(), b.strip()) for a, b in re.findall(r"Input:\s*(.+?)\s*\n\s*Output:\s*(.+)", prompt)]
    seen = set()
    for a, b in re.findall(r"^\s*(\w+\(.*?\))\s*(?:==|->|=>)\s*(.+)$", prompt, re.M):
        if a not in seen:
            seen.add(a)
            out.append((a.strip(), b.strip()))
    return out


def complexity(code: str) -> tuple[float, int, int, int]:
    """Mean and greatest cyclomatic complexity of functions (1 + decisions + extra operands), calls, top-level imports; zeros for code that does not parse."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return 0.0, 0, 0, 0
    decisions = (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.With, ast.Assert, ast.comprehension, ast.IfExp, ast.AsyncFor, ast.AsyncWith)
    each = [
        1 + sum(isinstance(x, decisions) for x in ast.walk(f)) + sum(len(x.values) - 1 for x in ast.walk(f) if isinstance(x, ast.BoolOp))
        for f in ast.walk(tree) if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef))
    ]
    names = {a.name.split(".")[0] for x in tree.body if isinstance(x, ast.Import) for a in x.names} | {x.module.split(".")[0] for x in tree.body if isinstance(x, ast.ImportFrom) and x.module}
    return (round(sum(each) / len(each), 2) if each else 1.0), max(each, default=1), sum(isinstance(x, ast.Call) for x in ast.walk(tree)), len(names)


def report_metrics(code: str) -> tuple[int, float, int, float]:
    """Lines of the stripped text, mean complexity (1 for code without functions or that does not parse), calls, comment lines in percent to one decimal."""
    lines = code.strip().splitlines()
    n, comments = len(lines), sum(x.strip().startswith("#") for x in lines)
    mean, _, calls, _ = complexity(code)
    return n, mean or 1.0, calls, (2000 * comments + n) // (2 * n) / 10 if n else 0.0


def line_diff(before: str, after: str) -> tuple[int, int, int]:
    """(added, removed, same) lines of a longest common subsequence; an empty text has no lines."""
    a, b = (x.split("\n") if x else [] for x in (before, after))
    # bit-parallel: a zero of ``row`` is a place of ``a`` where the subsequence grows
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every = row = (1 << len(a)) - 1
    for y in b:
        step = row & places.get(y, 0)
        row = ((row + step) | (row - step)) & every
    same = len(a) - row.bit_count()
    return len(b) - same, len(a) - same, same


def functions_of(code: str) -> list[dict]:
    """Functions at indents of 0 to 4 with their last line by indentation, docstring and flags."""
    lines, out = code.split("\n"), []
    indent = lambda t: len(t) - len(t.lstrip(" "))
    for i, line in enumerate(lines):
        m = re.match(r"( {0,4})def\s+(\w+)\s*\(([^)]*)\)\s*(?:->([^:]+))?\s*:", line)
        if not m:
            continue
        end = i
        for j in range(i + 1, len(lines)):
            if lines[j].strip():
                if indent(lines[j]) <= len(m[1]):
                    break
                end = j
        body = lines[i + 1 : end + 1]
        doc = re.match(r"(\"\"\"|''')(.+?)\1", body[0].strip()) if body else None
        text = "\n".join(body)
        has = lambda w: re.search(rf"\b{w}\b", text) is not None
        out.append({"name": m[2], "line": i + 1, "end_line": end + 1, "params": m[3], "typed": m[4] is not None, "docstring": doc[2] if doc else None, "has_return": has("return"), "has_raise": has("raise"), "has_yield": has("yield"), "branches": len(re.findall(r"\b(?:if|elif|for|while|except|with|and|or)\b", text)) + 1, "body": text})
    return out


def function_findings(code: str) -> list[tuple[str, int]]:
    """(title, line) of what is wrong with each function."""
    out = []
    for f in functions_of(code):
        length, doc = f["end_line"] - f["line"] + 1, f["docstring"] or ""
        body = f["body"].strip()
        checks = (
            ("Missing return type", not f["typed"]),
            ("Untyped parameters", any(":" not in p for p in f["params"].split(",") if p.strip() and p.strip() not in ("self", "cls") and not p.strip().startswith("*"))),
            ("Empty test", f["name"].startswith("test_") and (not body or body == "pass")),
            ("Tautological test", f["name"].startswith("test_") and re.search(r"^\s*assert\s+(True|1|yes)\s*$", f["body"], re.M) is not None),
            ("Long function", length > 30),
            ("High complexity", f["branches"] > 10),
            ("Missing docstring", not doc and not f["name"].startswith("_") and length > 5),
            ("Claims to raise", re.search(r"raises|raise|throw|may raise", doc.lower()) is not None and not f["has_raise"]),
            ("Claims to return", re.search(r"returns?\s+(?:a\s+)?(?:list|array|sequence|generator)", doc, re.I) is not None and not f["has_return"] and not f["has_yield"]),
        )
        out += [(title, f["line"]) for title, bad in checks if bad]
    return out


def loop_concatenations(code: str) -> list[int]:
    """Lines that add to a string after a loop header; a finding ends the state."""
    out, inside = [], False
    for n, line in enumerate(code.split("\n"), 1):
        inside = inside or re.match(r"\s*(for|while)\s+", line) is not None
        if inside and re.search(r"\+=\s*[\"']", line):
            out.append(n)
            inside = False
    return out


def closed_json(text: str) -> str | None:
    """The first JSON object in a reply, with triple quotes made strings and open strings and brackets closed; null if it still does not parse."""
    text = re.sub(r'"""(.*?)"""', lambda m: json.dumps(m[1]), text, flags=re.S)
    start = text.find("{")
    if start < 0:
        return None
    stack, quoted, skip, end = [], False, False, None
    for i, c in enumerate(text[start:], start):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
            if not stack:
                end = i + 1
                break
    body = text[start:end] if end else text[start:].rstrip().rstrip(",") + '"' * quoted + "".join(reversed(stack))
    try:
        return json.dumps(json.loads(body), ensure_ascii=False)
    except ValueError:
        return None


def _first_object(text: str) -> dict | None:
    """The object from the first brace to the one that balances it, or to the end; null if that does not parse."""
    start = text.find("{")
    if start < 0:
        return None
    depth, end = 0, len(text)
    for m in re.finditer(r"[{}]", text[start:]):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            end = start + m.end()
            break
    try:
        found = json.loads(text[start:end])
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def _at(value, *path):
    """The part of a JSON value at a path, null where it has none."""
    for key in path:
        if isinstance(value, dict) and isinstance(key, str):
            value = value.get(key)
        elif isinstance(value, list) and isinstance(key, int) and key < len(value):
            value = value[key]
        else:
            return None
    return value


def enveloped_files(text: str) -> list[dict[str, str]]:
    """Files of a reply: its own object, else the one in ``error.failed_generation``, else in ``choices[0].message.content``; the first that has ``files``. Missing fields get their defaults; none for a reply without files."""
    outer = _first_object(re.sub(r"^(Groq|OpenAI|Anthropic|Gemini|DeepSeek)\s+\d+:\s*", "", text))
    unquoted = lambda x: re.sub(r'"content"\s*:\s*"""(.*?)"""', lambda m: '"content": ' + json.dumps(m[1]), x, flags=re.S)
    inner = (_at(outer, "error", "failed_generation"), _at(outer, "choices", 0, "message", "content"))
    for found in (outer, *(_first_object(unquoted(x)) for x in inner if isinstance(x, str))):
        files = _at(found, "files")
        if found is not None and "files" in found:
            break
    else:
        return []
    out = []
    for i, f in enumerate(x for x in files or () if isinstance(x, dict)):
        name = f.get("name") or f"file_{i + 1}.py"
        path = f.get("path") or name
        out.append({"name": name, "path": path, "language": "toml" if name.endswith(".toml") or path.endswith(".toml") else "python", "category": f.get("category") or "other", "description": f.get("description") or "Generated file", "content": f.get("content") or ""})
    return out


def _udf(function, kind: str):
    return F.pandas_udf(lambda s: pd.Series([None if x is None else function(x) for x in s], dtype=object), kind)


def as_column(function, kind: str, text: Column | str) -> Column:
    """A scanner as an Arrow UDF over a column of texts."""
    return _udf(function, kind)(F.col(text) if isinstance(text, str) else text)


def scanned(files: DataFrame, function, schema: str) -> DataFrame:
    """Rows of a scanner that gives several for a text: ``schema`` names its columns after file_id."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, r) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in function(t or "")]
            frame = pd.DataFrame([[i, *(r if isinstance(r, tuple) else (r,))] for i, r in rows], columns=["file_id", *names])
            yield pa.RecordBatch.from_pandas(frame, schema=wanted, preserve_index=False)

    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    wanted = pa.schema([("file_id", pa.int64())] + [(c.strip().split()[0], kinds[c.strip().split()[1]]) for c in schema.split(",")])
    return files.select(F.col("file_id").cast("long"), F.col("content").cast("string")).mapInArrow(run, f"file_id long, {schema}")


def exposures(prompts: DataFrame, tokens: DataFrame, limit: int = 4_000_000) -> DataFrame:
    """(file_id, token_id) where a text holds a token. The tokens are the query set: blocks of at most ``limit`` characters go to the executors, and one automaton finds all of a block's tokens in one pass over each text."""
    import ahocorasick

    held, size, every = [], 0, []
    for r in tokens.select("token_id", "token").filter("length(token) > 0").orderBy("token_id").toLocalIterator():
        if held and size + len(r["token"]) > limit:
            every.append(held)
            held, size = [], 0
        held.append((r["token_id"], r["token"]))
        size += len(r["token"])
    out = prompts.sparkSession.createDataFrame([], "file_id long, token_id long")
    for block in [*every, *([held] if held else [])]:

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            found = ahocorasick.Automaton()
            for i, t in block:
                found.add_word(t, (*(found.get(t, ())), i))
            found.make_automaton()
            for b in batches:
                rows = [(i, k) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k in sorted({x for _, ids in found.iter(t or "") for x in ids})]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["file_id", "token_id"])

        out = out.union(prompts.select(F.col("file_id").cast("long"), F.col("content").cast("string")).mapInArrow(run, "file_id long, token_id long"))
    return out
