"""Quality rules with host verdicts.

Each document is measured over its whole text. Rule failures are summed by host (the
``source`` column unless another is named), each host's failure rate of each rule is
shrunk with a beta prior fitted to all hosts, and a host whose shrunk rate passes
``HOST_LIMIT`` for a rule is rejected with all its documents.

Defined cases: null text counts as no words (fails); a text of any length is measured whole;
a null host is a host of its own; repeated rows count and return once each; a rate that equals the
limit is not above it; an empty table gives an empty result; other
columns, whatever their names, pass through ``filter_documents`` untouched and are not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, plain, slices, starts_within, text_rows, windows, mixed, written

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: A host is rejected if its shrunk failure rate of some rule is above this.
HOST_LIMIT = 0.75
#: Hosts up to this number are broadcast; beyond it they are joined by a shuffle.
BROADCAST_HOSTS = 20_000
RULES = ("few_words", "repeats", "symbols", "dup_lines", "word_length")
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _per_document(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def measure(text: pa.Array) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    words = Words(text)
    codes, n = words.codes, len(words.codes)
    chars = pc.utf8_length(words.vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
    word_chars = _per_document(chars[codes] if n else np.zeros(0, np.int64), words.offsets)
    symbols = sum(pc.count_substring(text, s).to_numpy(zero_copy_only=False).astype(np.int64) for s in "#*$%&|<>")

    lists = pc.split_pattern(text, "\n")
    bounds = lists.offsets.to_numpy().astype(np.int64)
    lines = lists.flatten().dictionary_encode()
    worded = (pc.binary_length(pc.ascii_trim_whitespace(lines.dictionary)).to_numpy(zero_copy_only=False) > 0)[lines.indices.to_numpy(zero_copy_only=False)]
    doc = np.repeat(np.arange(len(text)), np.diff(bounds))[worded]
    key = doc * max(1, len(lines.dictionary)) + lines.indices.to_numpy(zero_copy_only=False)[worded]
    distinct = np.bincount(np.unique(key) // max(1, len(lines.dictionary)), minlength=len(text))
    dup_lines = np.bincount(doc, minlength=len(text)) - distinct

    repeat = np.zeros(len(text), np.int64)
    starts = starts_within(words.offsets, n, WINDOW)
    if len(starts):
        doc = words.document_of()[starts]
        hashed = windows(mixed(codes), WINDOW)[starts] ^ mixed(doc + 1)
        _, back, count = np.unique(hashed, return_inverse=True, return_counts=True)
        again = np.flatnonzero(count[back] > 1)
        if len(again):  # equal hashes are confirmed word by word
            rows = np.column_stack([doc[again], *(codes[starts[again] + j] for j in range(WINDOW))])
            _, back, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
            at = starts[again[count[back.ravel()] > 1]]
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            repeat = _per_document(np.cumsum(edge[:-1]) > 0, words.offsets)
    return [words.counts, word_chars, symbols, dup_lines, repeat]


def measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the measures of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [pa.array(x.astype(np.int64)) for x in measure(plain(b.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *found], ["doc_id", "host", *(x.split()[0] for x in MEASURES.split(", "))])

    return text_rows(docs, F.col(host).cast("string").alias("host")).mapInArrow(run, f"doc_id long, host string, {MEASURES}")


def rule_failures() -> dict[str, F.Column]:
    """The rules over the measures; the first two are those of ``base_failed``."""
    n = F.col("n_words")
    return {
        "few_words": n < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n,
        "symbols": 10 * F.col("n_symbols") > 5 * F.col("word_chars"),
        "dup_lines": 2 * F.col("n_dup_lines") > n,
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n),
    }


def base_failed() -> F.Column:
    rules = rule_failures()
    return rules["few_words"] | rules["repeats"]


def host_verdicts(measured: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: documents, and by rule the failures, the shrunk rate; ``rejected``.

    The prior is fitted by moments over hosts, weighted by their documents, so a host with
    few documents stays near the mean of all. Only the sums over all hosts, one row, reach the driver.
    """
    hosts = measured.groupBy("host").agg(F.count("*").alias("n_docs"), *(F.sum(v.cast("long")).alias(f"f_{k}") for k, v in rule_failures().items()))
    rate = lambda k: F.col(f"f_{k}") / F.col("n_docs")
    sums = hosts.agg(
        F.sum("n_docs").alias("n"), F.count("*").alias("h"), *(F.sum(f"f_{k}").alias(f"f_{k}") for k in RULES), *(F.sum(rate(k) * F.col(f"f_{k}")).alias(f"q_{k}") for k in RULES)
    ).first()
    total, count = sums["n"] or 1, sums["h"] or 1
    out, bad = hosts, F.lit(False)
    for k in RULES:
        mean = min(max((sums[f"f_{k}"] or 0) / total, 1e-6), 1 - 1e-6)
        spread = max((sums[f"q_{k}"] or 0) / total - mean * mean, 0) - mean * (1 - mean) * count / total
        weight = min(max(mean * (1 - mean) / max(spread, 1e-9) - 1, 2.0), 1e4)
        shrunk = (F.col(f"f_{k}") + mean * weight) / (F.col("n_docs") + weight)
        out = out.withColumn(f"rate_{k}", shrunk)
        bad = bad | (F.col(f"rate_{k}") > limit)
    return out.withColumn("rejected", bad)


def _sized(hosts: DataFrame) -> DataFrame:
    """The rejected hosts, broadcast only if they are few; they are counted first."""
    bad = hosts.filter("rejected").select(F.col("host").alias("bad_host"))
    return F.broadcast(bad) if bad.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS else bad


def quality_rules(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The measures of each row with ``base_failed``, ``host_rejected`` and ``kept``."""
    m = written(measures(docs, host), "measures")
    bad = _sized(host_verdicts(m, limit)).withColumn("is_bad", F.lit(True))
    j = m.join(bad, F.col("host").eqNullSafe(F.col("bad_host")), "left").drop("bad_host")
    j = j.withColumn("host_rejected", F.coalesce("is_bad", F.lit(False))).drop("is_bad").withColumn("base_failed", base_failed())
    return j.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def filter_documents(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``docs``, with their own columns, that pass the rules and whose host is not rejected. Each text is measured once."""
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(own, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col(host).cast("string").alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [pa.array(x.astype(np.int64)) for x in measure(plain(b.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *found], ["row", "host", *(x.split()[0] for x in MEASURES.split(", "))])

    schema = rows.select("row", "host").schema
    for x in MEASURES.split(", "):
        schema = schema.add(x.split()[0], "long")
    m = written(rows.mapInArrow(run, schema), "measured")
    bad = _sized(host_verdicts(m, limit))
    kept = m.filter(~base_failed()).join(bad, F.col("host").eqNullSafe(F.col("bad_host")), "left_anti")
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))
