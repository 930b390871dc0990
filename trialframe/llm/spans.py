"""Regular-expression spans in code points, as DataFrame expressions.

``split`` gives the gaps between the matches of a pattern and ``regexp_extract_all`` the
matches, so a running sum of both lengths places every match. Patterns are written with
possessive quantifiers and lookbehinds where these give the same leftmost non-overlapping
matches, so the regex engine neither recurses nor rescans on very long runs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Code points in a block of text, and elements in a block of a running value: what a place costs to find has this bound.
BLOCK, RUN = 1024, 256


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where body uses it in further lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def before(values: Column, op, first: int = 0, block: int = RUN) -> Column:
    """Of an array of int, what ``op`` makes of ``first`` and all values before each element; by blocks, so the work is in proportion."""
    add = lambda s, n: F.struct(op(s["at"], n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
    run = lambda numbers, begin: F.aggregate(numbers, F.struct(begin.alias("at"), F.array().cast("array<int>").alias("out")), add, lambda s: s["out"])
    total = lambda part: F.aggregate(part, F.lit(first), op)
    cut = lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / block).cast("int")), lambda b: F.slice(n, b * block + 1, F.lit(block)))
    blocks = lambda n: let(cut(n), lambda p: F.flatten(F.zip_with(p, run(F.transform(p, total), F.lit(first)), run)))
    return let(values, lambda n: F.when(F.size(n) == 0, F.array().cast("array<int>")).when(F.size(n) <= block, run(n, F.lit(first))).otherwise(blocks(n)))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def placed(text: Column, pattern: str, kind: int, keep, bound=None) -> Column:
    """Array of struct(kind, start, end, value) of the matches for which ``keep(value)`` holds; ``bound``: only texts for which it holds have any."""
    none = F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")
    # a match at position 0 has an empty gap before it; regexes here never match the empty string
    pairs = lambda found: F.filter(F.zip_with(found, F.split(text, pattern, -1), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g"), F.length(m).alias("n"))), lambda p: p["m"].isNotNull())
    at = lambda found: let(pairs(found), lambda p: F.zip_with(p, before(F.transform(p, lambda x: x["g"] + x["n"]), _sum), lambda x, a: F.struct(F.lit(kind).alias("kind"), (a + x["g"]).alias("start"), (a + x["g"] + x["n"]).alias("end"), x["m"].alias("value"))))
    spans = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(F.filter(at(found), lambda s: keep(s["value"]))))
    return spans if bound is None else F.when(bound, spans).otherwise(none)


def starts(words: Column) -> Column:
    """Start of each of ``words``, one character apart."""
    return before(F.transform(words, lambda w: F.length(w) + 1), _sum)


def text_blocks(text: Column) -> Column:
    """``text`` in blocks of ``BLOCK`` code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def between(blocks: Column, start: Column, end: Column) -> Column:
    """Code points from ``start`` up to ``end`` of a text in blocks; "" if that is none."""
    first = F.floor(start / BLOCK).cast("int")
    count = F.greatest(F.lit(0), F.floor((end - 1) / BLOCK).cast("int") - first + 1)
    return F.when(end <= start, F.lit("")).otherwise(F.array_join(F.slice(blocks, first + 1, count), "").substr(start - first * BLOCK + 1, end - start))


def written_as(spans: Column, names: tuple[str, ...]) -> Column:
    """``kind:start:end``, comma-joined, in the order given."""
    kinds = F.array(*(F.lit(n) for n in names))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def number_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def by_start(spans: Column) -> Column:
    """Sorted by start, then kind."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def by_kind(spans: Column) -> Column:
    """Sorted by kind, then start."""
    return F.sort_array(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))


def rewritten(text: Column, spans: Column, write) -> Column:
    """``text`` with ``write(span, blocks, from, to)`` in place of each span's characters that no span before it has; an empty result where there are none is up to ``write``."""

    def of(s: Column, blocks: Column, p: Column) -> Column:
        begin, end = F.greatest(s["start"], p), F.greatest(s["end"], p)
        return F.concat(between(blocks, p, begin), write(s, blocks, begin, end))

    def whole(spans: Column) -> Column:
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        reach = before(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        body = lambda blocks: F.concat(F.array_join(F.zip_with(spans, reach, lambda s, p: of(s, blocks, p)), ""), between(blocks, last, F.length(text)))
        return let(text_blocks(text), body)

    return F.when(F.size(spans) == 0, text).otherwise(let(by_start(spans), whole))


def replaced(text: Column, spans: Column, label) -> Column:
    """``text`` with each span, overlapping ones together, replaced by ``label(first span, its text)``; spans that touch stay apart."""
    return rewritten(text, spans, lambda s, blocks, begin, end: F.when(begin == s["start"], label(s, between(blocks, s["start"], s["end"]))).otherwise(F.lit("")))


def masked(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with ``mark`` in place of each character of its spans that is not a separator."""
    return rewritten(text, spans, lambda s, blocks, begin, end: F.regexp_replace(between(blocks, begin, end), r"[^\x20\x09-\x0D]", mark))
