"""The taxonomy file (C17): read on the driver, checked rule by rule; the first broken one is reported with its place."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

from .operators.classify import portable
from .taxonomy import CATEGORIES

#: What a definition must state.
SCHEMA, VERSIONS = "maci.taxonomy", ("1.0.0",)
PRIMARY_TYPES, STATES = ("A", "B", "C", "D"), ("A", "B", "C")
MANUAL = ("D", "C.2", "C.4")
CHECKLIST_ITEMS = 10
PROMPTS = ("dou_generation", "tivr_generation", "dou_critique", "tivr_repair", "generic_repair", "diagnosis_line", "guidance_line", "evidence_line", "lessons_header", "lesson", "web_repair_system")
CONDITIONS = ("technique", "signal", "message", "ignore_case")
#: Types of the parts: a name with ? may be missing.
SHAPE = {
    "primary_types": [{"id": str, "name": str, "auto_assignable": bool}], "categories": [{"id": str, "primary": str, "name": str, "priority": int, "auto_assignable": bool, "repair_hint": str}],
    "unmapped": {"id": str, "name": str, "priority": int, "primary_state": str, "repair_hint": str}, "checklist": [str],
    "rules": [{"id": str, "category": str, "confidence": float, "match": {"technique?": list, "signal?": str, "message?": str, "ignore_case?": bool}}], "prompts": {"*": {"variables": [str], "text": str}},
}

Problem = tuple[str, str]


class BadDefinition(ValueError):
    """A definition breaks a rule: ``place`` and ``rule``."""

    def __init__(self, place: str, rule: str) -> None:
        super().__init__(f"{place}: {rule}")
        self.place, self.rule = place, rule


def _shape(value, wanted, place: str) -> Iterator[Problem]:
    kind = wanted if isinstance(wanted, type) else type(wanted)
    fits = isinstance(value, (int, float)) if kind is float else isinstance(value, kind)
    if not fits or isinstance(value, bool) and kind is not bool:
        yield place, f"not of type {kind.__name__}"
    elif isinstance(wanted, list):
        for i, x in enumerate(value):
            yield from _shape(x, wanted[0], f"{place}[{i}]")
    elif isinstance(wanted, dict):
        for name, part in ({k: wanted["*"] for k in value} if "*" in wanted else wanted).items():
            key = name.removesuffix("?")
            if key in value and (value[key] is not None or key == name):
                yield from _shape(value[key], part, f"{place}.{key}")
            elif key == name:
                yield f"{place}.{key}", "missing"
        if "signal?" in wanted:
            yield from ((f"{place}.{k}", "unknown condition") for k in value if k not in CONDITIONS)


def _ids(entries: list[dict], place: str, known: tuple[str, ...]) -> Iterator[Problem]:
    seen = set()
    for i, e in enumerate(entries):
        if e["id"] in seen or e["id"] not in known:
            yield f"{place}[{i}].id", "repeated" if e["id"] in seen else "unknown"
        seen.add(e["id"])
    if missing := [k for k in known if k not in seen]:
        yield place, f"without {', '.join(missing)}"


def _categories(d: dict) -> Iterator[Problem]:
    yield from _ids(d["categories"], "categories", CATEGORIES)
    by_place = sorted(d["categories"], key=lambda c: c["priority"])
    if [c["priority"] for c in by_place] != list(range(1, len(CATEGORIES) + 1)):
        yield "categories", "priorities are not 1 to 12, each once"
    if [c["id"][0] for c in by_place] != sorted(c["id"][0] for c in by_place):
        yield "categories", "priorities do not rank A before B before C"
    u = d["unmapped"]
    for bad, key, rule in ((u["id"] in CATEGORIES, "id", "a category's"), (u["priority"] <= len(CATEGORIES), "priority", "not below every category"), (u["primary_state"] not in STATES, "primary_state", "not A, B or C")):
        if bad:
            yield f"unmapped.{key}", rule


def _names(d: dict) -> Iterator[Problem]:
    def one(e: dict, place: str, *texts: str) -> Iterator[Problem]:
        yield from ((f"{place}.{k}", "blank") for k in texts if not e[k].strip())
        if e["id"] in MANUAL and e.get("auto_assignable"):
            yield f"{place}.auto_assignable", "must not be"
        if not e.get("auto_assignable", True) and not str(e.get("not_assigned_reason") or "").strip():
            yield f"{place}.not_assigned_reason", "missing or blank"

    yield from _ids(d["primary_types"], "primary_types", PRIMARY_TYPES)
    for i, e in enumerate(d["primary_types"]):
        yield from one(e, f"primary_types[{i}]", "name")
    for i, e in enumerate(d["categories"]):
        if e["primary"] != e["id"][0]:
            yield f"categories[{i}].primary", "not its id's"
        yield from one(e, f"categories[{i}]", "name", "repair_hint")
    yield from one(d["unmapped"], "unmapped", "repair_hint")


def _rules(d: dict) -> Iterator[Problem]:
    automatic, seen = {c["id"]: c["auto_assignable"] for c in d["categories"]}, set()
    for i, r in enumerate(d["rules"]):
        place, m = f"rules[{i}]", {k: v for k, v in r["match"].items() if v is not None}
        if not r["id"].strip() or r["id"] in seen:
            yield f"{place}.id", "blank or repeated"
        seen.add(r["id"])
        if not automatic.get(r["category"]):
            yield f"{place}.category", "not a category" if r["category"] not in automatic else "not assigned by rules"
        if not (math.isfinite(r["confidence"]) and 0 <= r["confidence"] <= 1):
            yield f"{place}.confidence", "not from 0 to 1"
        if not any(k in m for k in ("technique", "signal", "message")) or m.get("technique") == []:
            yield f"{place}.match", "no condition"
        for k in ("signal", "message"):
            if k in m and not (m[k] and portable(m[k])):
                yield f"{place}.match.{k}", "empty or not portable"
            elif k in m:
                try:
                    re.compile(m[k])
                except re.error:
                    yield f"{place}.match.{k}", "does not compile"


def _prompts(d: dict) -> Iterator[Problem]:
    for name in PROMPTS:
        if name not in d["prompts"] or d["prompts"][name].get("optional"):
            yield f"prompts.{name}", "missing" if name not in d["prompts"] else "must not be optional"
    for name, p in d["prompts"].items():
        present = re.findall(r"\{([^{}\r\n]+)\}", p["text"])
        for j, v in enumerate(p["variables"]):
            if v in p["variables"][:j] or v not in present:
                yield f"prompts.{name}.variables[{j}]", "repeated" if v in p["variables"][:j] else "not in the text"


def _header(d: dict) -> Iterator[Problem]:
    if d.get("schema") != SCHEMA:
        yield "schema", f"not {SCHEMA}"
    if d.get("version") not in VERSIONS:
        yield "version", "not supported"


#: The checks after reading, in order.
CHECKS = (
    ("header", _header), ("types", lambda d: _shape(d, SHAPE, "$")), ("categories", _categories), ("names", _names),
    ("checklist", lambda d: iter([("checklist", f"not {CHECKLIST_ITEMS} items")] if len(d["checklist"]) != CHECKLIST_ITEMS else [])), ("rules", _rules), ("prompts", _prompts),
)


def parsed(text: str) -> dict:
    """The definition in ``text``, or an error for the first rule that it breaks."""
    try:
        d = json.loads(text)
    except ValueError as x:
        raise BadDefinition("$", f"not JSON: {x}") from None
    if not isinstance(d, dict):
        raise BadDefinition("$", "not an object")
    for _, check in CHECKS:
        for place, rule in check(d):
            raise BadDefinition(place, rule)
    return d
