"""Expressions over code, prompts and tool output; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_c = lambda x: F.col(x) if isinstance(x, str) else x


def last_block(text: str) -> Column:
    """T5: the last fenced block, or the text."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(_c(text), F.lit(r"(?s)```(?:[A-Za-z0-9]*)\n(.*?)```"), F.lit(1)), F.lit(-1)), _c(text))


def best_block(text: str) -> Column:
    """Of the fenced blocks the longest that has ``def ``, else the longest; the text without any."""
    blocks = F.regexp_extract_all(_c(text), F.lit(r"(?s)```(?:[A-Za-z0-9]*)\n(.*?)```"), F.lit(1))
    ranked = F.array_sort(F.transform(blocks, lambda b: F.struct(F.when(b.contains("def "), 1).otherwise(0).alias("d"), F.length(b).alias("n"), b.alias("b"))))
    return F.coalesce(F.try_element_at(ranked, F.lit(-1))["b"], _c(text))


def interface(text: str) -> tuple[Column, Column, Column]:
    """Name, signature and doc from their lines, the first of each; the name also from ``def``."""
    line = lambda k: F.nullif(F.trim(F.regexp_extract(_c(text), rf"(?im)^{k}:[ \t]*(.*)$", 1)), F.lit(""))
    return F.coalesce(line("NAME"), F.nullif(F.regexp_extract(_c(text), r"def\s+(\w+)", 1), F.lit("")), F.lit("solution")), line("SIGNATURE"), line("DOC")


def test_hash(text: str) -> Column:
    """SHA-256 without a byte order mark, with \\n line ends, without white space at the end."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(_c(text), r"\A\x{FEFF}", ""), r"\r\n?", "\n"), r"\s+\z", "")
    return F.sha2(plain, 256)


def split_hash(text: str) -> Column:
    """SHA-256 of the lines without white space at their ends, stripped as a whole, with one \\n at the end."""
    lines = F.regexp_replace(F.regexp_replace(_c(text), r"[ \t\r\f\x0B]+(\n|\z)", "$1"), r"\A\s+|\s+\z", "")
    return F.sha2(F.concat(lines, F.lit("\n")), 256)


def test_count(text: str) -> Column:
    """Number of test functions."""
    return F.regexp_count(_c(text), F.lit(r"def\s+test_\w+\s*\(")).cast("long")


def test_preview(text: str, tests: int = 5, width: int = 500) -> Column:
    """The lines before the test after the first ``tests``, long ones cut, with a note if more tests follow; a suite without tests is an error."""
    lines = F.split(_c(text), r"\r\n|\r|\n")
    starts = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.ltrim(F.get(lines, i - 1)).startswith("def test_"))
    end = F.coalesce(F.get(starts, F.lit(tests)) - 1, F.size(lines))
    cut = F.transform(F.slice(lines, F.lit(1), end), lambda x: F.when(F.length(x) <= width, x).otherwise(F.concat(F.substring(x, 1, width), F.lit(" # ... preview truncated"))))
    note = F.when(F.size(starts) > tests, F.lit(f"# ... [Remaining tests omitted from preview. {tests}+ tests verified in sandbox]"))
    shown = F.rtrim(F.array_join(F.array_compact(F.concat(cut, F.array(note))), "\n"))
    return F.when(test_count(text) > 0, F.regexp_replace(shown, r"\s+\z", "")).otherwise(F.raise_error(F.lit("the suite has no tests")).cast("string"))


def line_metrics(text: str) -> tuple[Column, Column, Column]:
    """Non-blank lines, comment lines, and comments in percent of lines to one decimal."""
    lines = F.filter(F.split(_c(text), "\n"), lambda x: x.rlike(r"\S"))
    comments = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*#")))
    n = F.size(lines)
    return n.cast("long"), comments.cast("long"), F.when(n > 0, F.floor((2000 * comments + n) / (2 * n)) / 10.0).otherwise(0.0)


def line_table(files: DataFrame) -> DataFrame:
    """A row per line: file_id, path, n from 1, line. Lines of one file are dealt as rows, so a long file costs no single expression."""
    return files.select("file_id", "path", F.posexplode(F.split("content", "\n")).alias("n", "line")).withColumn("n", (F.col("n") + 1).cast("long"))


#: Secrets in source, (title, pattern, CWE).
SECRETS = (
    ("Hardcoded password", r"""(?i)(?:password|passwd|pwd)\s*=\s*["'][^"']{3,}["']""", "CWE-798"),
    ("Hardcoded API key", r"""(?i)(?:api[_-]?key|apikey|api[_-]?secret)\s*=\s*["'][^"']{8,}["']""", "CWE-798"),
    ("Hardcoded secret/token", r"""(?i)(?:secret|token)\s*=\s*["'][A-Za-z0-9_\-./+=]{16,}["']""", "CWE-798"),
    ("Hardcoded bearer token", r"""(?i)["']Bearer\s+[A-Za-z0-9_\-./+=]{16,}["']""", "CWE-798"),
    ("Embedded private key", r"-----BEGIN\s+(RSA|EC|DSA|OPENSSH)?\s*PRIVATE\s+KEY-----", "CWE-321"),
    ("Connection string with embedded credentials", r"""(?i)postgresql://[^"'\s]*:[^"'\s]*@""", "CWE-798"),
    ("MySQL connection string with credentials", r"""(?i)mysql://[^"'\s]*:[^"'\s]*@""", "CWE-798"),
    ("MongoDB connection string with credentials", r"""(?i)mongodb\+srv://[^"'\s]*:[^"'\s]*@""", "CWE-798"),
)
#: Rules on single lines: title, severity, rule id, patterns that a line must have, patterns that it must not have, pattern of the file's path.
#: In titles, {length} is the line's length and {word} the marker found.
LINE_RULES = (
    ("Bare except clause (E722)", "MEDIUM", "pylint W0702 / Ruff E722", (r"\bexcept\s*:",), (), None),
    ("Line exceeds 120 chars ({length}) (E501)", "LOW", "Ruff E501", (r"^.{121}",), (r"^#",), None),
    ("SQL injection via string interpolation", "CRITICAL", "Bandit B608 / Ruff S608", (r"\b(text|execute|executemany|raw|cursor\.execute)\s*\(", r"""f"|f'|%s|\.format\("""), (), None),
    ("Subprocess with shell=True", "HIGH", "Bandit B602 / B604", (r"subprocess\.(run|call|Popen|check_output)\s*\(", r"shell\s*=\s*True"), (), None),
    ("Use of eval() / exec()", "CRITICAL", "Bandit B102", (r"\beval\s*\(|^\s*exec\s*\(",), (), None),
    ("Use of pickle for deserialization", "HIGH", "Bandit B301", (r"\bpickle\.(loads?|Unpickler)\b",), (), None),
    ("yaml.load without SafeLoader", "HIGH", "Bandit B506", (r"yaml\.load\s*\(",), (r"Loader\s*=\s*(yaml\.)?SafeLoader", r"yaml\.safe_load"), None),
    ("Weak hash algorithm (md5/sha1)", "HIGH", "Bandit B303", (r"hashlib\.(md5|sha1)\s*\(",), (), None),
    ("Insecure PRNG for security-sensitive value", "HIGH", "Bandit B311", (r"\brandom\.(randint|choice|random|randrange)\s*\(",), (), None),
    ("debug=True enabled", "HIGH", "Bandit / Flask lint", (r"debug\s*=\s*True",), (), r"main|app|config\.py$"),
    ("Blocking await via .result() / .wait()", "HIGH", "asyncio lint", (r"\.result\s*\(\)|\.wait\s*\(\)|\.get_result\s*\(\)",), (), None),
    ("File opened without context manager", "MEDIUM", "Ruff SIM115", (r"=\s*open\s*\(",), (r"with\s+",), None),
    ("Mutable default argument", "HIGH", "Ruff B006", (r"def\s+\w+\s*\([^)]*=\s*\[\s*\]|def\s+\w+\s*\([^)]*=\s*\{\s*\}",), (), None),
    ("{word} marker in source", "LOW", "manual review", (r"#\s*(TODO|FIXME|HACK|XXX|WARN)\b",), (), None),
    ("print() left in production code", "LOW", "logging best practice", (r"\bprint\s*\(",), (r"def\s+print",), r"\.py$"),
    ("Lint/type error suppressed", "LOW", "manual review", (r"#\s*noqa\b|#\s*type:\s*ignore",), (), None),
)
#: What all findings of ``SECRETS`` have.
SECRET_FINDING = ("CRITICAL", "detect-secrets / gitleaks / Bandit B105")
SECRET_RULES = tuple((title, *SECRET_FINDING, (pattern,), (), None) for title, pattern, _ in SECRETS)


def line_findings(lines: DataFrame, rules: tuple, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each line and rule that it breaks, with the columns to ``keep``; the rules are one array of conditions, so lines are read once."""
    hits = []
    for name, severity, rule_id, needs, excludes, path in rules:
        hit = reduce(lambda a, b: a & b, [*(F.col("line").rlike(p) for p in needs), *(~F.col("line").rlike(p) for p in excludes), *([F.col("path").rlike(path)] if path else [])])
        title = F.lit(name)
        if "{length}" in name:
            title = F.replace(title, F.lit("{length}"), F.length("line").cast("string"))
        if "{word}" in name:
            title = F.replace(title, F.lit("{word}"), F.regexp_extract("line", needs[0], 1))
        hits.append(F.when(hit, F.struct(title.alias("title"), F.lit(severity).alias("severity"), F.lit(rule_id).alias("rule_id"), F.lit(name).alias("rule"))))
    return lines.select("file_id", "n", *keep, F.explode(F.array_compact(F.array(*hits))).alias("f")).select("file_id", "n", "f.*", *keep)


def floating_dependencies(lines: DataFrame) -> DataFrame:
    """In dependency files, lower bounds without an upper one, and ``*`` pins."""
    files = lines.filter(F.col("path").rlike(r"pyproject\.toml|requirements.*\.txt|setup\.py"))
    name = F.regexp_extract("line", r"([a-zA-Z0-9_-]+)\s*(==|>=|<=|~=|\^|>|<)?\s*([0-9.*]+)?", 1)
    op = F.regexp_extract("line", r"([a-zA-Z0-9_-]+)\s*(==|>=|<=|~=|\^|>|<)?\s*([0-9.*]+)?", 2)
    version = F.regexp_extract("line", r"([a-zA-Z0-9_-]+)\s*(==|>=|<=|~=|\^|>|<)?\s*([0-9.*]+)?", 3)
    kind = F.when((op == ">=") & ~F.col("line").contains("<"), "floating").when(version.contains("*"), "wildcard")
    return files.select("file_id", "n", name.alias("name"), kind.alias("kind")).filter("kind is not null and name <> ''")


def loop_queries(lines: DataFrame) -> DataFrame:
    """Loop headers with a database call within the next eight lines."""
    call = F.col("line").rlike(r"\b(db|session|cursor)\.(query|execute|scalars|fetchall)\b")
    w = Window.partitionBy("file_id").orderBy("n").rowsBetween(1, 8)
    return lines.withColumn("near", F.max(call).over(w)).filter(F.col("near") & F.col("line").rlike(r"^\s*(for|while)\s+")).select("file_id", "n")


def technique_matrix(findings: DataFrame, techniques: tuple[str, ...]) -> DataFrame:
    """Each technique with its number of findings, and PASS or FINDINGS."""
    every = findings.sparkSession.createDataFrame([(t,) for t in techniques], "title string")
    n = findings.groupBy("title").agg(F.count("*").alias("n"))
    return every.join(n, "title", "left").select("title", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "PASS").otherwise("FINDINGS").alias("status"))


def feedback(timed_out: Column, errors: Column) -> Column:
    """A timeout's sentence, else up to three reports, else the functional sentence."""
    return F.when(timed_out, "The execution of the code has exceeded the time limit").when(F.size(errors) > 0, F.array_join(F.slice(errors, 1, 3), "\n\n")).otherwise("The functionality of code is incorrect")


def redacted(text: str | Column, secrets: list[str], mark: str = "[REDACTED]") -> Column:
    """Secrets replaced, the longest first."""
    out = _c(text)
    for s in sorted({x for x in secrets if x}, key=lambda x: (-len(x), x)):
        out = F.replace(out, F.lit(s), F.lit(mark))
    return out


def trimmed(text: str, most: int = 40, head: int = 3) -> Column:
    """Of more than ``most`` lines the first ``head``, a mark and the last ones."""
    lines = F.split(_c(text), "\n")
    short = F.concat(F.slice(lines, 1, head), F.array(F.lit("...")), F.slice(lines, F.lit(head + 1) - most, F.lit(most - head - 1)))
    return F.when(F.size(lines) <= most, _c(text)).otherwise(F.array_join(F.when(F.size(lines) > most, short).otherwise(lines), "\n"))


def snippet(text: str, line: str | Column, around: int = 3) -> Column:
    """The lines around one, numbered in four places, it marked."""
    lines, at = F.split(_c(text), "\n"), _c(line).cast("int")
    first, last = F.greatest(F.lit(1), at - around), F.least(F.size(lines), at + around)
    row = lambda i: F.concat(F.when(i == at, "> ").otherwise("  "), F.lpad(i.cast("string"), 4, " "), F.lit(" | "), F.get(lines, i - 1))
    return F.when((at >= 1) & (at <= F.size(lines)), F.array_join(F.transform(F.sequence(first, F.greatest(first, last)), row), "\n"))


def pytest_counts(text: str) -> tuple[Column, Column, Column]:
    """Passed and failed tests, and their rate to one decimal, null for none."""
    n = lambda word: F.coalesce(F.expr("1") * F.nullif(F.regexp_extract(_c(text), rf"(\d+) {word}", 1), F.lit("")).cast("long"), F.lit(0).cast("long"))
    from .rates import rate

    p, f = n("passed"), n("failed")
    return p, f, rate(p, p + f)


def pytest_report(text: str, exit_code: str, errors: str, most: int = 10) -> tuple[Column, Column, Column]:
    """Status, details and issues (file, line, message) of a test run. No tests (5) and skipped ones are SKIP; only a failed run has issues, ``most`` at most."""
    out, code, late = _c(text), _c(exit_code), F.lower(F.coalesce(_c(errors), F.lit(""))).contains("timed out")
    n = lambda word, other: F.coalesce(F.nullif(F.regexp_extract(out, rf"(\d+)\s+{word}", 1), F.lit("")), F.lit(other))
    skipped = out.rlike(r"\d+\s+(?:skipped|xfailed)")
    status = F.when((code < 0) & ~late, "ERROR").when(code == 0, F.when(skipped, "SKIP").otherwise("PASS")).when(code == 5, "SKIP").otherwise("FAIL")
    passed = F.when(out.rlike(r"\d+\s+passed"), F.concat(n("passed", ""), F.lit(" test(s) passed")))
    failed = F.when(late, F.lit("The execution of the code has exceeded the time limit (timeout)")).otherwise(F.concat(n("failed", "?"), F.lit(" test(s) failed, "), n("passed", "0"), F.lit(" passed")))
    details = F.when(status == "FAIL", failed).when(code == 5, F.lit("No test functions found in generated code")).when(status == "PASS", passed)
    place = lambda x, k: F.nullif(F.regexp_extract(x, r"([\w/\\][\w./\\]+\.py)(?::(\d+))?", k), F.lit(""))
    lines = F.slice(F.filter(F.split(out, "\n"), lambda x: x.rlike("FAILED|ERROR|assert")), 1, most)
    issues = F.transform(lines, lambda x: F.struct(F.coalesce(place(x, 1), F.lit("")).alias("file"), place(x, 2).cast("long").alias("line"), F.trim(x).alias("message")))
    return status, details, F.when(status == "FAIL", issues)


def mypy_findings(text: str, most: int = 5) -> Column:
    """(file, line, signal, message) of the first ``most`` error lines of a report."""
    pattern = r"^([^:\n]+\.py):(\d+):(?:\d+:)?\s*error:\s*(.*?)(?:\s+\[([\w-]+)\])?\s*$"
    lines = F.filter(F.transform(F.split(_c(text), "\n"), F.trim), lambda x: x.rlike(pattern))
    part = lambda x, k: F.regexp_extract(x, pattern, k)
    code = lambda x: F.coalesce(F.nullif(part(x, 4), F.lit("")), F.lit("error"))
    return F.transform(F.slice(lines, 1, most), lambda x: F.struct(F.replace(part(x, 1), F.lit("\\"), F.lit("/")).alias("file"), part(x, 2).cast("long").alias("line"), F.concat(F.lit("mypy:"), code(x)).alias("signal"), part(x, 3).alias("message")))


def collected(text: str) -> Column:
    """Number of collected tests: as stated, else, if that is none, by test ids, else by definitions."""
    stated = lambda k: F.nullif(F.regexp_extract(_c(text), r"(?i)(?:collected\s+(\d+)\s+(?:tests?|items?)|(\d+)\s+(?:tests?|items?)\s+collected)", k), F.lit(""))
    count = lambda p: F.nullif(F.regexp_count(_c(text), F.lit(p)), F.lit(0)).cast("long")
    return F.coalesce(F.nullif(F.coalesce(stated(1), stated(2)).cast("long"), F.lit(0)), count(r"::test_[a-zA-Z0-9_]+"), count(r"(?m)^\s*def\s+test_[a-zA-Z0-9_]+"), F.lit(0).cast("long"))


def passed_on_stub(text: str) -> Column:
    """Names of the tests that a run against a stub reports as passed."""
    lines = F.filter(F.split(_c(text), r"[\r\n]+"), lambda x: F.upper(x).contains("PASSED") & x.contains("test_"))
    name = lambda x, p: F.nullif(F.regexp_extract(x, p, 1), F.lit(""))
    return F.transform(lines, lambda x: F.coalesce(name(x, r"::(test_[a-zA-Z0-9_]+)"), name(x, r"\b(test_[a-zA-Z0-9_]+)\b(?!\.py)"), F.trim(x)))


def whole_json(text: str) -> Column:
    """Non-finite numbers outside quotes as null, so that the text parses."""
    return F.regexp_replace(_c(text), r"([:\[,]\s*)(?:-?Infinity|NaN)(?=\s*[,\]}])", "$1null")
