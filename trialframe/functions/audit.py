"""Rules that look at a whole file or at the rest of it, and the checklist over all findings (T17, T21). Everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LINE_RULES, SECRET_RULES, line_findings, line_table

#: Modules that an import may name without a finding.
KNOWN_MODULES = (
    "os sys json re math random secrets datetime collections itertools functools typing pathlib hashlib hmac base64 logging subprocess shutil io csv uuid "
    "http urllib socket threading asyncio concurrent contextlib dataclasses enum abc warnings traceback pickle yaml sqlite3 copy time textwrap string struct "
    "fastapi starlette pydantic uvicorn sqlalchemy httpx requests aiohttp httpcore pytest hypothesis moto faker numpy pandas scipy sklearn torch tensorflow "
    "jose jwt bcrypt cryptography passlib celery redis boto3 botocore slack_sdk stripe openai anthropic langchain litellm tiktoken"
).split()
#: Title, severity, rule id of the rules below.
UNUSED_IMPORT = ("Unused import '{name}' (F401)", "LOW", "Ruff F401 / pyflakes")
ESCAPE = ("Invalid escape sequence in string (W605)", "LOW", "Ruff W605")
UNKNOWN_IMPORT = ("Unverified import '{name}'", "MEDIUM", "importlib / pip-audit")
LOOSE_ANY = ("Loose use of typing.Any", "LOW", "mypy strict")
CORS = ("Wildcard CORS with credentials enabled", "HIGH", "OWASP A05")
MAIN_GUARD = ("Script runs at import time (missing __main__ guard)", "LOW", "Ruff / convention")
#: Patterns of the rules above.
IMPORTED = r"^import\s+(\w+)\z"
ANY_IMPORT = r"from\s+typing\s+import.*\bAny\b"
STAR_ORIGIN = r"""allow_origins\s*=\s*\[\s*["']\*["']\s*\]"""
SIDE_EFFECT = r"open\(|engine\.create|subprocess|httpx\.get|requests\.get"
GUARD = r"""if\s+__name__\s*==\s*["']__main__["']"""
QUOTED = r"""("[^"']*"|'[^"']*')"""
BAD_ESCAPE = r"""\\[^\\nrt'"0abfvxNuU]"""
RAW_STRING = r"""r["']"""


def _finding(rule: tuple[str, str, str], name=None):
    title = F.lit(rule[0]) if name is None else F.replace(F.lit(rule[0]), F.lit("{name}"), name)
    return title.alias("title"), F.lit(rule[1]).alias("severity"), F.lit(rule[2]).alias("rule_id"), F.lit(rule[0]).alias("rule")


def unused_imports(files: DataFrame) -> DataFrame:
    """Modules of ``import x`` lines that no other line of the file names. Only words that the file imports are dealt to the group-by, so it is as small as the imports."""
    names = F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?m)^import[^\S\n]+(\w+)"), F.lit(1)))
    lines = files.select("file_id", F.posexplode(F.split("content", "\n")).alias("n", "line"), names.alias("names")).filter(F.size("names") > 0)
    words = F.array_intersect(F.array_distinct(F.regexp_extract_all("line", F.lit(r"\w+"), F.lit(0))), F.col("names"))
    used = lines.select("file_id", (F.col("n") + 1).cast("long").alias("n"), F.explode(words).alias("name"), F.regexp_extract("line", IMPORTED, 1).alias("imported"), "line")
    own = F.col("imported") == F.col("name")
    found = used.groupBy("file_id", "name").agg(F.count("*").alias("lines"), F.max(F.when(own, F.col("n"))).alias("n"), F.max(F.when(own, F.col("line"))).alias("line"))
    return found.filter("lines = 1 and n is not null").select("file_id", "n", *_finding(UNUSED_IMPORT, F.col("name")), "line")


def line_audit(lines: DataFrame) -> DataFrame:
    """Invalid escapes in the first string of a line, and imports of unknown modules."""
    quoted = F.regexp_extract("line", QUOTED, 1)
    escape = quoted.rlike(BAD_ESCAPE) & ~F.col("line").startswith("#") & ~F.col("line").rlike(RAW_STRING)
    name = F.regexp_extract("line", r"^(?:import|from)\s+([a-zA-Z0-9_]+)", 1)
    unknown = (name != "") & ~name.isin(KNOWN_MODULES) & ~name.startswith("_")
    hits = F.array(F.when(escape, F.struct(*_finding(ESCAPE))), F.when(unknown, F.struct(*_finding(UNKNOWN_IMPORT, name))))
    return lines.select("file_id", "n", "line", F.explode(F.array_compact(hits)).alias("f")).select("file_id", "n", "f.*", "line")


def file_audit(files: DataFrame) -> DataFrame:
    """One finding a file at most for each: ``Any`` where it is imported, any origin with credentials, side effects without a guard (at no line)."""
    lines = F.split("content", "\n")
    first = lambda p: F.array_position(F.transform(lines, lambda x: x.rlike(p)), True)
    any_at, star_at = first(r"\bAny\b"), first(STAR_ORIGIN)
    c = F.col("content")
    hits = F.array(
        F.when(first(ANY_IMPORT) > 0, F.struct(any_at.cast("long").alias("n"), *_finding(LOOSE_ANY))),
        F.when(c.contains("allow_origins") & c.contains("allow_credentials=True") & (star_at > 0), F.struct(star_at.cast("long").alias("n"), *_finding(CORS))),
        F.when(c.rlike(SIDE_EFFECT) & ~c.rlike(GUARD) & F.col("path").endswith(".py") & ~F.col("path").contains("__init__"), F.struct(F.lit(None).cast("long").alias("n"), *_finding(MAIN_GUARD))),
    )
    found = files.select("file_id", lines.alias("lines"), F.explode(F.array_compact(hits)).alias("f"))
    return found.select("file_id", "f.*", F.coalesce(F.get("lines", (F.col("f.n") - 1).cast("int")), F.lit("")).alias("line"))


def static_findings(files: DataFrame) -> DataFrame:
    """All findings of all rules with the line that each is on."""
    lines = line_table(files)
    return line_findings(lines, (*LINE_RULES, *SECRET_RULES), keep=("line",)).unionByName(line_audit(lines)).unionByName(unused_imports(files)).unionByName(file_audit(files))


#: The checklist: label, column that a finding fails it by, pattern.
CHECKLIST = (
    ("Every SQL query parameterized (zero f-string/concat into SQL)", "title", r"^SQL injection"),
    ("No os.system / subprocess with shell=True on user input", "title", r"^Subprocess with shell=True"),
    ("No eval/exec on untrusted data", "title", r"^Use of eval"),
    ("No pickle.loads on untrusted data", "title", r"^Use of pickle"),
    ("No hardcoded credentials, keys, or connection strings", "title", r"^Hardcoded|onnection string with"),
    ("No yaml.load without SafeLoader", "title", r"yaml\.load"),
    ("No weak crypto (MD5/SHA1 for secrets)", "title", r"^Weak hash"),
    ("No insecure PRNG for tokens/codes", "title", r"^Insecure PRNG"),
    ("No wildcard CORS with credentials", "title", r"^Wildcard CORS"),
    ("No debug=True in production config", "line", r"debug\s*=\s*True"),
    ("No embedded private keys", "title", r"^Embedded private key"),
    ("No mutable default arguments", "title", r"(?i)mutable default"),
    ("No blocking .result() / .wait() in async code", "line", r"(?i)\.result\(\)"),
    ("No leftover print() statements", "title", r"print\(\) left"),
    ("All TODO/FIXME markers tracked", "title", r"TODO|FIXME"),
)


def checklist(findings: DataFrame) -> DataFrame:
    """Label and whether no finding fails it, in order; one aggregation over all findings to a single row."""
    failed = findings.agg(*(F.coalesce(F.bool_or(F.col(where).rlike(p)), F.lit(False)).alias(f"x{i}") for i, (_, where, p) in enumerate(CHECKLIST)))
    rows = F.array(*(F.struct(F.lit(i + 1).cast("long").alias("ord"), F.lit(label).alias("label"), (~F.col(f"x{i}")).alias("passed")) for i, (label, _, _) in enumerate(CHECKLIST)))
    return failed.select(F.explode(rows).alias("r")).select("r.*")
