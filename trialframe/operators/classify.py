"""Ordered rules to categories. Each classifier is one CASE, so the first match decides and rows never multiply. Three classifiers that disagree are kept apart: rules, batch and web."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..taxonomy import CATEGORIES, LIBRARIES, PRIMARIES, RULES, UNMAPPED, WEB_LIBRARIES


def portable(pattern: str) -> bool:
    """Whether Java and RE2 read a rule's pattern alike: ASCII, no groups with ``?``, backreferences, possessive quantifiers or unusual escapes."""
    body = pattern.removeprefix("(?i)")
    return body.isascii() and not re.search(r"\(\?|\\[1-9]|[*+?}]\+|\\[^dDwWsSbB.()\[\]{}*+?|^$\\/'\"-]", body)


def by_rules(signal: str = "signal", message: str = "message", technique: str = "technique", rules: tuple = RULES) -> tuple[Column, Column, Column]:
    """Category, rule and confidence of the first rule whose signal pattern matches the whole signal and whose message pattern is found; UNMAPPED without one; null for advisory findings."""
    category = rule = confidence = None
    blocking = F.col(technique) != "advisory"
    for name, pattern, text, target, sure in rules:
        hit = F.col(signal).rlike(rf"\A(?:{pattern})\z")
        hit = blocking & (hit & F.coalesce(F.col(message), F.lit("")).rlike(text) if text else hit)
        category = F.when(hit, target) if category is None else category.when(hit, target)
        rule = F.when(hit, name) if rule is None else rule.when(hit, name)
        confidence = F.when(hit, F.lit(sure)) if confidence is None else confidence.when(hit, F.lit(sure))
    return category.when(blocking, UNMAPPED), rule, confidence


def classified(findings: DataFrame) -> DataFrame:
    category, rule, confidence = by_rules()
    return findings.select("*", category.alias("category"), rule.alias("rule_id"), confidence.alias("confidence"))


def rank(category: Column | str) -> Column:
    c = F.col(category) if isinstance(category, str) else category
    at = F.array_position(F.array(*(F.lit(x) for x in CATEGORIES)), c)
    return F.when(at > 0, at).otherwise(len(CATEGORIES) + 1).cast("long")


def diagnoses(found: DataFrame, key: str = "report_id") -> DataFrame:
    """Per report and category: priority, highest confidence, distinct signals and rules in order of first sight, message of the first finding."""
    g = found.filter("category is not null").groupBy(key, "category").agg(
        F.max("confidence").alias("confidence"), F.min_by("message", "ord").alias("summary"), F.array_sort(F.collect_list(F.struct("ord", "signal", "rule_id"))).alias("seen")
    )
    distinct = lambda c: F.array_distinct(F.filter(F.transform("seen", lambda s: s[c]), lambda x: x.isNotNull()))
    return g.select(key, "category", rank("category").alias("priority"), "confidence", "summary", distinct("signal").alias("signals"), distinct("rule_id").alias("rules"))


def batch(text: str = "message", timed_out: Column | None = None) -> Column:
    """C4: category of a program's output."""
    t = F.coalesce(F.col(text), F.lit(""))
    has = lambda *words: t.rlike("|".join(map(re.escape, words)))
    name = F.regexp_extract(t, r"NameError:\s+name\s+'([^']+)'\s+is not defined", 1)
    timeout = has("TimeoutExpired", "time limit")
    return (
        F.when(timeout | timed_out if timed_out is not None else timeout, "B.5")
        .when(has("IndentationError", "TabError"), "A.2")
        .when(has("SyntaxError"), "A.1")
        .when(name.isin(*LIBRARIES), "A.3")
        .when(name != "", "B.2")
        .when(t.rlike(r"TypeError:\s+.*(?:takes\s+\d+\s+positional argument|missing\s+\d+\s+required positional argument)"), "B.4")
        .when(has("IndexError", "KeyError", "ZeroDivisionError", "RecursionError", "OverflowError"), "B.3")
        .when(has("AttributeError", "TypeError", "ValueError", "ModuleNotFoundError", "ImportError"), "B.1")
        .when(has("AssertionError", "assert ", "FAILED"), "C.1")
        .when(has("Traceback (most recent call last):"), "B.1")
        .otherwise("C.1")
    )


#: Category by technique number, where the text decides nothing.
WEB_FALLBACK = {1: "A.1", 2: "A.3", 3: "C.1", 4: "B.1", 5: "B.4", 6: "C.4", 7: "C.4"}


def web(text: str = "message", name: str = "technique_name", number: str = "technique_id") -> Column:
    """Category of a verification issue."""
    t, n = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(name), F.lit(""))
    has = lambda *words: t.rlike("|".join(map(re.escape, words)))
    out = (
        F.when(has("IndentationError", "TabError"), "A.2")
        .when(has("ModuleNotFoundError", "ImportError") | n.contains("Import"), "A.3")
        .when(has("SyntaxError", "unexpected EOF", "invalid syntax") | n.contains("AST"), "A.1")
        .when(has("NameError", "UnboundLocalError") & t.rlike(f"name '({'|'.join(WEB_LIBRARIES)})' is not defined"), "A.3")
        .when(has("NameError", "UnboundLocalError"), "B.2")
        .when(has("IndexError", "KeyError", "ZeroDivisionError", "ValueError", "OverflowError"), "B.3")
        .when(has("TypeError") & has("takes", "positional", "argument", "missing required"), "B.4")
        .when(has("AttributeError", "TypeError"), "B.1")
        .when(has("Timeout", "RecursionError", "RuntimeError"), "B.5")
        .when(has("assert", "AssertionError") | n.contains("Pytest"), "C.1")
        .when(has("format") | (has("expected") & has("tuple", "list", "dict", "str")), "C.3")
        .when(n.contains("Radon") | n.contains("Semgrep"), "C.4")
    )
    for k, c in WEB_FALLBACK.items():
        out = out.when(F.col(number) == k, c)
    return out.otherwise("C.1")


def interpreter_report(text: str = "message") -> Column:
    """Distinct lines from the first traceback or syntax error on, pytest's error lines also without their mark; else the first 500 characters."""
    lines = F.transform(F.split(F.col(text), "\n"), lambda x: F.rtrim(x, F.lit("\r")))
    start = F.array_position(F.transform(lines, lambda x: x.contains("Traceback (most recent call last):") | x.contains("SyntaxError:") | x.contains("IndentationError:")), True).cast("int")
    marked = lambda x: F.when(x.startswith("E   ") & ~x.startswith("E   assert"), F.array(x, F.substring(x, 5, 1 << 30))).otherwise(F.array(x))
    found = F.array_distinct(F.flatten(F.transform(F.slice(lines, F.greatest(start, F.lit(1)), F.size(lines)), marked)))
    return F.when(start > 0, F.regexp_replace(F.array_join(found, "\n"), r"^\s+|\s+$", "")).otherwise(F.substring(F.col(text), 1, 500))


def enriched_signal(stage: str, exc_type: str, module: str, name: str, stdlib: Column) -> Column:
    """``stage:Class`` with a qualifier: defined by the candidate, a standard name that is not bound, or where an import came from."""
    qualifier = (
        F.when(F.col(module) == "candidate", "llm_defined")
        .when((F.col(exc_type) == "NameError") & stdlib, "stdlib_unbound")
        .when((F.col(exc_type) == "ImportError") & (F.col(name) == "candidate"), "candidate")
        .when(F.col(exc_type) == "ImportError", "external")
    )
    return F.concat_ws(":", F.col(stage), F.col(exc_type), qualifier)


def last_error(text: str = "message") -> Column:
    """Signal of the last ``E   Class: message`` line; ``collection:unknown`` without one."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"(?m)^E   ([A-Za-z_][A-Za-z0-9_.]*): "), F.lit(1))
    return F.concat(F.lit("collection:"), F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("unknown")))


def grouped(findings: DataFrame, key: str = "report_id", cap: int = 5) -> DataFrame:
    """Findings of one signal and message are one, at the first place, with the occurrences added; then the first ``cap`` of a report."""
    g = findings.groupBy(key, "signal", "message").agg(F.min("ord").alias("ord"), F.sum("occurrences").alias("occurrences"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("ord")).cast("long")).filter(F.col("place") <= cap)


def report_findings(findings: DataFrame, key: str = "report_id") -> DataFrame:
    """Collection and runtime findings grouped and capped, then one functional aggregate of a report."""
    functional = F.col("signal").startswith("functional:")
    one = findings.filter(functional).groupBy(key).agg(F.min_by("signal", "ord").alias("signal"), F.min_by("message", "ord").alias("message"), F.min("ord").alias("ord"), F.sum("occurrences").alias("occurrences"))
    stages = F.col("signal").startswith("collection:") | F.col("signal").startswith("runtime:")
    return grouped(findings.filter(stages), key).drop("place").unionByName(one)


def test_counts(tests: DataFrame, key: str = "report_id") -> DataFrame:
    """C11: passed, and failed including collection errors."""
    return tests.groupBy(key).agg(F.count_if(F.col("outcome") == "passed").alias("passed"), F.count_if(F.col("outcome").isin("failed", "collection_error")).alias("failed"))


def bug_report(bugs: DataFrame, key: str = "report_id") -> DataFrame:
    """Distinct bugs by category, file, line and message (the first stays), counts by primary type and a histogram by category."""
    first = distinct_first(bugs, ["category", "file", "line", "message"], key)
    by = first.groupBy(key, "category").agg(F.count("*").alias("n"))
    return by.groupBy(key).agg(
        F.sum("n").alias("total"), *(F.sum(F.when(F.col("category").startswith(p), F.col("n")).otherwise(0)).alias(f"type_{p.lower()}") for p in PRIMARIES), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("by_category")
    )


def distinct_first(rows: DataFrame, columns: list[str], key: str, order: str = "ord") -> DataFrame:
    """Of rows equal in ``columns`` the first in order."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(key, *columns).orderBy(order))).filter("rn = 1").drop("rn")


def optimization(before: DataFrame, after: DataFrame, key: str = "report_id") -> DataFrame:
    """C14: bugs before and after, fixed = max(0, difference) in total and by primary type with their rates (null for none), and 100, 0 or null for the program."""
    from ..functions.rates import rate

    marked = before.select(key, "category", F.lit(True).alias("old")).unionByName(after.select(key, "category", F.lit(False).alias("old")))
    parts = {"": F.lit(True), **{f"_{p.lower()}": F.col("category").startswith(p) for p in PRIMARIES}}
    n = marked.groupBy(key).agg(*(F.count_if(part & (F.col("old") == old)).alias(f"n_{side}{x}") for x, part in parts.items() for side, old in (("before", True), ("after", False))))
    fixed = lambda x: F.greatest(F.lit(0), F.col(f"n_before{x}") - F.col(f"n_after{x}"))
    return n.select(
        key, "n_before", "n_after", *(c for x in parts for c in (fixed(x).alias(f"fixed{x}"), rate(fixed(x), f"n_before{x}").alias(f"pct_fixed{x}"))), F.when(F.col("n_before") > 0, F.when(F.col("n_after") == 0, 100.0).otherwise(0.0)).alias("rsr")
    )


def decreases(bugs: DataFrame, key: str = "report_id") -> DataFrame:
    """C14: categories whose bugs became fewer from an iteration to the next, with by how many; the last iteration of a program is its final state."""
    n = bugs.groupBy(key, "iteration", "category").agg(F.count("*").alias("n"))
    last = bugs.groupBy(key).agg(F.max("iteration").alias("last"))
    later = n.select(key, (F.col("iteration") - 1).alias("iteration"), "category", F.col("n").alias("left"))
    j = n.join(last, key).filter("iteration < last").join(later, [key, "iteration", "category"], "left")
    return j.select(key, "iteration", "category", (F.col("n") - F.coalesce("left", F.lit(0))).alias("fewer")).filter("fewer > 0")


def winner(a: str, b: str, a_tokens: str, b_tokens: str) -> Column:
    """By the round that passed (0: not failing, -1: never); where both passed in one round, by fewer tokens; two that never pass are a tie."""
    x, y = F.col(a), F.col(b)
    late = lambda c: F.when(c < 0, 99).otherwise(c)
    none = (x == 0) | (y == 0) | ((x < 0) & (y < 0))
    return F.when(none, "tie").when(late(x) < late(y), "a").when(late(y) < late(x), "b").when(F.col(a_tokens) < F.col(b_tokens), "a").when(F.col(b_tokens) < F.col(a_tokens), "b").otherwise("tie")


def token_estimate(*texts: str) -> Column:
    """(length of all texts + 3) / 4, whole; lengths are code points."""
    total = sum((F.length(F.coalesce(F.col(t), F.lit(""))) for t in texts), F.lit(0))
    return F.floor((total + 3) / 4)
