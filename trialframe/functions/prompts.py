"""Repair prompts (T22, T24, T34): templates filled as one concatenation, so no text is looked at twice and nothing leaves the JVM.

Templates are a parameter: name to text with ``{variables}``, as the taxonomy file holds them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most pieces of evidence and lessons, and the texts that stand for missing or withheld parts.
MOST_EVIDENCE = 3
MOST_LESSONS = 2
SEE_EVIDENCE = "* (see evidence below)"
WITHHELD = "(withheld in this configuration)"
NO_DIAGNOSIS = "* No diagnosis produced."
NO_EVIDENCE = "* No evidence captured."
#: Modes with the template that each fills.
MODE_TEMPLATES = {"dou": "dou_critique", "dou_no_bt": "dou_critique", "generic": "generic_repair", "evidence_only": "tivr_repair", "taxonomy_only": "tivr_repair", "full": "tivr_repair"}
OPTIONAL_MODES = ("intervenor", "dou_intervenor")

_text = lambda v: v if isinstance(v, Column) else F.lit(str(v))


def filled(template: str, values: dict[str, Column | str]) -> Column:
    """The template with its variables; others in braces stay, and what a value brings in is not looked at again."""
    parts = re.split(r"\{([^{}\r\n]+)\}", template)
    missing = [v for v in values if v not in parts[1::2]]
    if missing:
        raise ValueError(f"{missing[0]!r} is not in the template")
    out = [F.lit(p) if i % 2 == 0 else _text(values[p]) if p in values else F.lit("{" + p + "}") for i, p in enumerate(parts)]
    return F.concat(*out)


def _or(text: Column, other: str) -> Column:
    return F.when(text == "", F.lit(other)).otherwise(text)


def diagnosis_block(diagnoses: Column, templates: dict[str, str]) -> Column:
    """A line with category and confidence (n/a for none) and one with guidance for each of ``diagnoses``: array<struct<primary, secondary, confidence, repair_hint>>."""

    def one(d: Column) -> Column:
        sure = F.when(d["confidence"].isNull(), F.lit("n/a")).otherwise(F.format_string("%.2f", d["confidence"]))
        return F.concat(filled(templates["diagnosis_line"], {"primary": d["primary"], "secondary": d["secondary"], "confidence": sure}), F.lit("\n"), filled(templates["guidance_line"], {"repair_hint": d["repair_hint"]}))

    return _or(F.array_join(F.transform(diagnoses, one), "\n"), NO_DIAGNOSIS)


def evidence_block(findings: Column, templates: dict[str, str]) -> Column:
    """The first findings with place and message, their evidence fenced: array<struct<signal, file, line, message, evidence>>."""

    def one(f: Column) -> Column:
        place = F.when(f["file"].isNull(), F.lit("")).when(f["line"].isNull(), F.concat(F.lit(" ["), f["file"], F.lit("]"))).otherwise(F.concat(F.lit(" ["), f["file"], F.lit(":"), f["line"].cast("string"), F.lit("]")))
        fenced = F.when(F.coalesce(f["evidence"], F.lit("")).rlike(r"\S"), F.concat(F.lit("\n```\n"), F.regexp_replace(f["evidence"], r"\n+\z", ""), F.lit("\n```"))).otherwise(F.lit(""))
        return F.concat(filled(templates["evidence_line"], {"signal": f["signal"], "location": place, "message": f["message"]}), fenced)

    return _or(F.array_join(F.transform(F.slice(findings, 1, MOST_EVIDENCE), one), "\n"), NO_EVIDENCE)


def plain_evidence(findings: Column) -> Column:
    """What the first findings show: their evidence, else their message."""
    one = lambda f: F.when(F.coalesce(f["evidence"], F.lit("")).rlike(r"\S"), f["evidence"]).otherwise(f["message"])
    return _or(F.array_join(F.transform(F.slice(findings, 1, MOST_EVIDENCE), one), "\n\n"), NO_EVIDENCE)


def _last(items: Column, most: int) -> Column:
    return F.slice(items, F.greatest(F.size(items) - most + 1, F.lit(1)), most)


def repair_prompt(mode: str, templates: dict[str, str], prompt: Column, code: Column, findings: Column, diagnoses: Column, lessons: Column, iteration: Column | int, budget: int, feedback: Column | str = "", checklist: str = "") -> Column:
    """The prompt of a mode. Optional modes are made of a teacher's and a student's prompt by the caller with ``filled``."""
    if mode not in MODE_TEMPLATES:
        raise ValueError(f"mode {mode!r} is optional and not built here" if mode in OPTIONAL_MODES else f"unknown mode {mode!r}")
    template = templates[MODE_TEMPLATES[mode]]
    if mode.startswith("dou"):
        return filled(template, {"prompt": prompt, "solution": code, "error log": feedback, "checklist": checklist if mode == "dou" else ""})
    strip = lambda c: F.regexp_replace(c, r"\A\s+|\s+\z", "")
    if mode == "generic":
        return filled(template, {"spec": strip(prompt), "code": strip(code), "evidence_block": plain_evidence(findings)})
    at = F.lit(iteration) if isinstance(iteration, int) else iteration
    learnt = F.when((at >= 2) & (F.size(lessons) > 0), F.concat(F.lit("\n" + templates["lessons_header"]), F.array_join(_last(lessons, MOST_LESSONS), "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return filled(template, {
        "spec": strip(prompt), "code": strip(code), "iteration": at.cast("string"), "budget": str(budget),
        "diagnosis_block": F.lit(SEE_EVIDENCE) if mode == "evidence_only" else diagnosis_block(diagnoses, templates),
        "evidence_block": F.lit(WITHHELD) if mode == "taxonomy_only" else evidence_block(findings, templates),
        "lessons_block": learnt if mode == "full" else "",
    })


#: Headings and sentences of the tagged sections.
SECTIONS = {
    "prompt_only": "## [prompt-only] Problem Specification & Interface Contract",
    "interface": "### Confirmed Function Interface:",
    "detail": "## [visible-test-detail] Test Failure Execution Details",
    "summary": "## [visible-test-detail] Test Verification Summary",
    "failed": "- {n} test assertion(s) failed against the locked test suite.\n  (Detailed test traceback and assertion inputs withheld to prevent test fitting).",
    "crashed": "- Program failed pre-test correctness checks (syntax, imports, or runtime crash).",
    "passed": "- All test assertions passed.",
    "history": "## [history] Previous Repair Round Critique & Unresolved Issues",
    "unresolved": "- Round {round} attempt left {n} unresolved issue(s). Do not repeat the same logic error.",
}


def specification(prompt: Column, interface: Column) -> Column:
    """The task, and the interface if one is confirmed."""
    known = F.coalesce(interface, F.lit("")).rlike(r"\S")
    shown = F.concat(F.lit(f"\n\n{SECTIONS['interface']}\n```python\n"), F.trim(interface), F.lit("\n```"))
    return F.concat(F.lit(SECTIONS["prompt_only"] + "\n"), F.trim(prompt), F.when(known, shown).otherwise(F.lit("")))


def visible_tests(findings: Column, detail: bool, templates: dict[str, str]) -> Column:
    """Failed tests with their evidence, or without ``detail`` only how many failed. ``findings``: array<struct<technique, signal, file, line, message, evidence>>."""
    tests = F.filter(findings, lambda f: (f["technique"] == "tests") | f["signal"].startswith("tests:"))
    if not detail:
        some = filled(SECTIONS["failed"], {"n": F.size(tests).cast("string")})
        return F.concat(F.lit(SECTIONS["summary"] + "\n"), F.when(F.size(tests) > 0, some).when(F.size(findings) > 0, F.lit(SECTIONS["crashed"])).otherwise(F.lit(SECTIONS["passed"])))

    def one(f: Column) -> Column:
        fenced = F.when(F.coalesce(f["evidence"], F.lit("")).rlike(r"\S"), F.concat(F.lit("\n```\n"), F.regexp_replace(f["evidence"], r"\n+\z", ""), F.lit("\n```"))).otherwise(F.lit(""))
        return F.concat(F.lit("- Test Failure in `"), F.coalesce(f["file"], F.lit("test_suite")), F.lit("`: "), f["message"], fenced)

    listed = F.array_join(F.transform(F.slice(tests, 1, MOST_EVIDENCE), one), "\n")
    return F.concat(F.lit(SECTIONS["detail"] + "\n"), F.when(F.size(tests) > 0, listed).otherwise(evidence_block(findings, templates)))


def history(lessons: Column, iteration: Column, unresolved: Column) -> Column:
    """The last lessons, or how much the round before left; null before the second iteration."""
    listed = F.array_join(F.transform(_last(lessons, MOST_LESSONS), lambda x: F.concat(F.lit("- "), x)), "\n")
    left = filled(SECTIONS["unresolved"], {"round": (iteration - 1).cast("string"), "n": unresolved.cast("string")})
    return F.when(iteration >= 2, F.concat(F.lit(SECTIONS["history"] + "\n"), F.when(F.size(lessons) > 0, listed).otherwise(left)))


def tagged(*sections: Column) -> Column:
    """The sections that a prompt has, an empty line between them; null ones are switched off."""
    return F.array_join(F.array_compact(F.array(*sections)), "\n\n")
