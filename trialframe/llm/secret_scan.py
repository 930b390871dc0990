"""Secret scan: patterns, and windows of high entropy.

The patterns are ``assign``, ``access`` and ``hex``. The entropy scan looks at candidate
strings, maximal runs of ``[A-Za-z0-9+/_=-]`` of ``WINDOW`` characters or more that have a
digit and a letter. Their class, by the characters they use, sets the entropy that a window
must reach. A window's entropy is kept as the sum S of c*log2(c) over its characters'
counts c: a step takes out the one term that the leaving character changes and puts in the
one that the entering character changes. Overlapping windows above the limit are one span.
Candidates that match the allow-list are suppressed; base spans are not.

DataFrame expressions only, no shuffle. Defined cases: null text counts as "", which has no
spans; a text of any length is scanned whole, in time in proportion (patterns neither recurse
nor rescan); spans that start together are ordered by kind; repeated rows return a row each;
empty table: empty result; other columns are not read, and pass through ``redact`` untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_rows
from .spans import by_start, let, number_of, placed, replaced, written_as

KINDS = ("assign", "access", "hex", "entropy")
WINDOW, BLOCK = 20, 256
#: Class: characters, and bits per character that a window of 20 must reach. The most that 20 characters can have is 4.32.
CLASSES = (("hex", "[0-9a-fA-F]*", 3.0), ("lower", "[0-9a-z]*", 3.6), ("upper", "[0-9A-Z]*", 3.6), ("mixed", ".*", 3.8))
#: Runs that are not secrets though they look random: UUIDs, alphabets and digit runs, placeholders, paths of words.
ALLOW = (
    r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    r"(?i).*(?:abcdefghij|klmnopqrst|0123456789|1234567890|qwertyuiop|example|placeholder|changeme).*",
    r"[A-Za-z]++(?:[/_-][A-Za-z]++)*+(?:[/_=-]?[0-9]{1,4})?",
)
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9+/_.=-]++"
ASSIGN_VALUE = r"^(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{WINDOW},}}+"


def base_spans(text: Column) -> Column:
    yes = lambda m: F.lit(True)
    assign = placed(text, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN_VALUE, 1)) >= 6, text.contains("=") | text.contains(":"))
    return F.concat(assign, placed(text, ACCESS, 1, yes, text.contains("AKIA")), placed(text, HEX, 2, yes))


def _limit(value: Column) -> Column:
    out = F.lit(CLASSES[-1][2])
    for _, characters, bits in reversed(CLASSES[:-1]):
        out = F.when(value.rlike(rf"\A{characters}\z"), F.lit(bits)).otherwise(out)
    return out


def merged(spans: Column) -> Column:
    """Ascending spans with those that touch or overlap made one."""
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")

    def step(out, s):
        last = F.try_element_at(out, F.lit(-1))
        joined = F.struct(s["kind"].alias("kind"), last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(out) > 0) & (last["end"] >= s["start"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(joined))).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(spans, none, step)


def in_blocks(value: Column, at: Column) -> Column:
    """Spans of a candidate of any length: blocks of ``BLOCK`` windows keep the cost of finding a character by its place low."""
    # each block's text and limit are made once, as fields: an expression in the lambda below would be evaluated at every step
    cut = F.regexp_extract_all(value, F.lit(f".{{1,{BLOCK}}}"), F.lit(0))
    whole = lambda c, i: F.concat(F.get(c, i), F.coalesce(F.left(F.get(c, i + 1), F.lit(WINDOW - 1)), F.lit("")))
    blocks = let(F.struct(cut.alias("c"), _limit(value).alias("limit")), lambda x: F.transform(x["c"], lambda v, i: F.struct(whole(x["c"], i).alias("v"), (at + i * BLOCK).alias("at"), x["limit"].alias("limit"))))
    return merged(F.flatten(F.transform(F.filter(blocks, lambda x: F.length(x["v"]) >= WINDOW), lambda x: high_windows(x["v"], x["at"], limit=x["limit"]))))


def high_windows(value: Column, at: Column, window: int = WINDOW, limit: Column | None = None) -> Column:
    """Spans of kind 3 over the windows of ``value`` (that starts at ``at`` in its text) whose entropy reaches ``limit``, by default that of its class."""
    clogc = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)))
    term = lambda count: F.element_at(clogc, count + 1)
    occurs = lambda where, c: F.length(where) - F.length(F.replace(where, c, F.lit("")))
    # the highest S at which entropy log2(window) - S / window reaches the limit
    most = (math.log2(window) - (_limit(value) if limit is None else limit)) * window + 1e-9
    none = F.array().cast("array<struct<start:int,end:int>>")
    begin = F.struct(F.lit(0.0).alias("s"), none.alias("out"))

    def step(state, i):
        into, rest = value.substr(i + F.lit(1), F.lit(1)), F.when(i >= window, value.substr(i - window + 2, F.lit(window - 1))).otherwise(value.substr(F.lit(1), i))
        leaving = value.substr(i - window + 1, F.lit(1))
        old = occurs(rest, leaving)
        less = F.when(i >= window, term(old + 1) - term(old)).otherwise(F.lit(0.0))
        new = occurs(rest, into)
        s = state["s"] - less + term(new + 1) - term(new)
        last = F.element_at(state["out"], -1)
        lo, hi = (at + i - window + 1).cast("int"), (at + i + 1).cast("int")
        grown = F.when((F.size(state["out"]) > 0) & (F.try_element_at(state["out"], F.lit(-1))["end"] >= lo), F.concat(F.slice(state["out"], 1, F.size(state["out"]) - 1), F.array(F.struct(F.try_element_at(state["out"], F.lit(-1))["start"].alias("start"), hi.alias("end"))))).otherwise(
            F.concat(state["out"], F.array(F.struct(lo.alias("start"), hi.alias("end"))))
        )
        return F.struct(s.alias("s"), F.when((i >= window - 1) & (s <= most), grown).otherwise(state["out"]).alias("out"))

    runs = F.aggregate(F.sequence(F.lit(0), F.length(value) - 1), begin, step, lambda s: s["out"])
    return F.transform(runs, lambda r: F.struct(F.lit(3).alias("kind"), r["start"].alias("start"), r["end"].alias("end")))


def suspicious(value: Column) -> Column:
    """A digit, a letter, and no match of the allow-list."""
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | value.rlike(rf"\A(?:{pattern})\z")
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~allowed


def _found(text: Column) -> Column:
    """struct(base, every) of a text that isn't null: the patterns' spans, and theirs and the entropy scan's."""
    plain = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    method = let(placed(text, CANDIDATE, 3, suspicious), lambda c: F.when(F.size(c) == 0, none).otherwise(F.flatten(F.transform(c, lambda x: in_blocks(x["value"], x["start"])))))
    return let(F.transform(base_spans(text), plain), lambda base: F.struct(base.alias("base"), F.concat(base, method).alias("every")))


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base spans and all spans (kind, start, end) of each row."""
    rows = text_rows(docs).withColumn("f", _found(F.col("text")))
    base, every = by_start(F.col("f.base")), F.col("f.every")
    return rows.select("doc_id", *(number_of(every, k).alias(f"n_{n}") for k, n in enumerate(KINDS)), F.sha2(written_as(base, KINDS), 256).alias("base_sha256"), written_as(by_start(every), KINDS).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of its texts replaced by ``[SECRET]``, and n_chars to match where that column exists; other columns as they are, whatever their names."""
    own, row = docs.columns, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("row", "text", _found(F.col("text"))["every"].alias("every"))
    rows = rows.select("row", (F.size("every") > 0).alias("hit"), replaced(F.col("text"), F.col("every"), lambda s, t: F.lit("[SECRET]")).alias("clean"))
    new = {"text": F.when(F.col("hit"), F.col("clean")).otherwise(F.col("row")["text"])}
    if "n_chars" in own:
        new["n_chars"] = F.when(F.col("hit"), F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    return rows.select(*(new.get(c, F.col("row")[c]).alias(c) for c in own))
