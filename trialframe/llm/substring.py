"""Substring deduplication with FM-indexes.

1. Every run of ``WIDTH`` words has an anchor: the smallest hash among its ``GRAM``-word
   runs. Equal windows have equal anchors, so anchors deal the text into shards: only
   stretches whose anchor occurs in two or more documents are looked at further, each in
   the shard of its anchor. Documents with equal word sequences are one document here, and
   windows that repeat within a document are looked at once, at their first place.
2. A shard's stretches make one FM-index: suffix order, the Burrows-Wheeler text in a
   wavelet matrix of packed bits with counted ranks, a bit for each row whose common prefix
   with the row before is shorter than the window, and the smallest doc_id of each such
   group of rows.
3. Each stretch is streamed through it from its last word to its first: backward search
   extends the interval, and when a match is longer than the window the interval widens to
   the group of its first ``WIDTH`` words. Matching statistics are thus capped at the
   threshold; where they reach it and the group has a smaller doc_id, the window is
   reported.
4. A shard has at most about ``SHARD_WORDS`` words. An anchor with more is dealt over several, and
   what its shards leave (of equal windows, the smallest document's) goes through
   another round, under its anchor and its next smallest hash. So equal windows shrink by the shard's
   size in each round, different ones are told apart, and no task grows with a passage's copies.

Defined cases: null or empty text has no words, nothing removed, and the hash of "". Equal
windows within one document, or in rows with the same doc_id, remove nothing. A null doc_id
neither removes nor loses words. A text of any length is handled whole, in stretches of at most
``LONGEST`` windows. Repeated rows return a row each. Empty table: empty result. Columns other than
doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Ids, Words, first_alike, mixed, partitions, plain, slices, starts_within, text_rows, windows, written

WIDTH, GRAM = 50, 8
SHARD_WORDS, LONGEST = 200_000, 256


# ------------------------------------------------------------------- the index


class WaveletMatrix:
    """Rank of any symbol in a sequence; each level's bits are packed, with a count for each 64."""

    def __init__(self, codes: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        now = codes
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level) & 1
            packed = np.packbits(np.pad(bit.astype(np.uint8), (0, -len(bit) % 64 + 64)), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))[:-1]]))
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before position ``at``."""
        lo, hi = np.zeros_like(at), at
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            words, counts, one = self.words[k], self.counts[k], ((symbol >> level) & 1).astype(bool)
            both = np.concatenate([lo, hi])
            block = both >> 6
            ones = counts[block] + np.bitwise_count(words[block] & ((np.uint64(1) << (both & 63).astype(np.uint64)) - np.uint64(1)))
            of_lo, of_hi = ones[: len(lo)], ones[len(lo) :]
            lo = np.where(one, self.zeros[k] + of_lo, lo - of_lo)
            hi = np.where(one, self.zeros[k] + of_hi, hi - of_hi)
        return hi - lo


class FMIndex:
    """Of stretches of words, each with its document; ``codes`` < 0 never occur."""

    def __init__(self, codes: np.ndarray, offsets: np.ndarray, docs: np.ndarray, width: int):
        count, lengths = len(docs), np.diff(offsets)
        # every stretch ends in a separator of its own, smaller than all words
        text = np.zeros(len(codes) + count, np.int64)
        ends = offsets[1:] + np.arange(count)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = codes + count
        text[ends] = np.arange(count)
        n = len(text)
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        step, prefix = 1, None
        self.symbols = int(text.max()) + 1
        half = 1 << (width.bit_length() - 1)  # the largest power of two within the window
        while True:
            if step == half:
                prefix = rank
            if step >= half and int(rank.max()) == n - 1:
                break
            after = np.full(n, -1, np.int64)
            after[: n - step] = rank[step:] if step < n else 0
            order = np.argsort(rank * (n + 1) + after + 1, kind="stable")
            key = (rank * (n + 1) + after + 1)[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            step *= 2
        rows = np.empty(n, np.int64)
        rows[rank] = np.arange(n)
        behind = np.minimum(rows + width - half, n - 1)
        first, second = prefix[rows], prefix[behind]
        start = np.ones(n, bool)
        start[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        heads = np.flatnonzero(start)
        self.group = np.cumsum(start) - 1
        self.heads = np.append(heads, n)
        owner = np.repeat(docs, lengths + 1)
        self.smallest = np.minimum.reduceat(owner[rows], heads)
        self.width, self.rows = width, n
        self.wavelet = WaveletMatrix(text[rows - 1], self.symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))])
        self.shift = count

    def extended(self, word: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of ``word`` followed by what the intervals match: one step of backward search."""
        code = word + self.shift
        at = self.wavelet.rank(np.concatenate([code, code]), np.concatenate([lo, hi])) + np.tile(self.before[code], 2)
        return at[: len(lo)], at[len(lo) :]

    def matched(self, codes: np.ndarray, offsets: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(stretch, start) of each window that also starts in a document smaller than the stretch's own."""
        lanes = np.flatnonzero(np.diff(offsets) >= self.width)
        at = offsets[1:][lanes].copy()
        lo, hi, length = np.zeros(len(lanes), np.int64), np.full(len(lanes), self.rows, np.int64), np.zeros(len(lanes), np.int64)
        found = []
        while len(lanes):
            at -= 1
            lo, hi = self.extended(codes[at], lo, hi)
            length += 1
            some = hi > lo
            length[~some] = 0  # nothing in the index continues here; start anew
            lo, hi = np.where(some, lo, 0), np.where(some, hi, self.rows)
            full = np.flatnonzero(length >= self.width)
            if len(full):
                group = self.group[lo[full]]
                lo[full], hi[full], length[full] = self.heads[group], self.heads[group + 1], self.width
                hit = full[self.smallest[group] < docs[lanes[full]]]
                found.append((lanes[hit], at[hit] - offsets[lanes[hit]]))
            more = at > offsets[lanes]
            lanes, at, lo, hi, length = lanes[more], at[more], lo[more], hi[more], length[more]
        return (np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


# --------------------------------------------------------------------- anchors


def anchors(hashes: np.ndarray, offsets: np.ndarray, width: int, gram: int, alike: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of windows with one anchor: its document, the anchor's hash, the first and the last window's start; windows that have been there, by ``alike``, are left out."""
    grams = windows(hashes, gram)
    starts = starts_within(offsets, len(hashes), width)
    if alike is not None:
        starts = starts[alike[starts] == starts]
    if not len(starts):
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    span = width - gram + 1
    low, size = grams.copy(), 1  # low[i]: smallest of the next ``size`` grams
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    n = len(grams) - span + 1
    low = np.minimum(low[:n], low[span - size : span - size + n])
    low = low[starts]
    doc = np.searchsorted(offsets, starts, "right") - 1
    first, last = _runs(low, doc, starts)
    return doc[first], low[first], starts[first], starts[last]


def _runs(key: np.ndarray, owner: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of neighbouring windows with one key and one owner, ``LONGEST`` of them at most."""
    new = np.ones(len(starts), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.arange(len(starts))
    new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % LONGEST == 0
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(starts)) - 1


def refined(hashes: np.ndarray, keys: np.ndarray, level: int, width: int, gram: int) -> np.ndarray:
    """For each window of ``hashes`` that begins at one of ``keys``' places, the key with the window's ``level``-th smallest hash (from 0) in it."""
    grams = windows(hashes, gram)
    span = width - gram + 1
    if level >= span or not len(keys):
        return keys
    view = np.lib.stride_tricks.sliding_window_view(grams, span)
    return mixed(keys.view(np.uint64) ^ mixed(np.partition(view, level, axis=1)[:, level])).view(np.int64)


def _joined(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _scanned(docs: DataFrame, width: int) -> DataFrame:
    """Of each row: words, a key of its word sequence, the hash of all words, and its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = Words(plain(b.column(1)))
            texts = [x.encode().split() for x in b.column(1).to_pylist()]
            doc, low, lo, hi = anchors(w.hashes(), w.offsets, width, GRAM, first_alike(w, width))
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))]).astype(np.int32)
            base = w.offsets[doc]
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (low.view(np.int64), (lo - base).astype(np.int32), (hi - base).astype(np.int32))]
            joined = [b" ".join(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(w.counts), pa.array([xxhash.xxh3_128_digest(x) for x in joined], pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in joined]), *lists],
                ["doc_id", "n_words", "key", "sha", "anchor", "first", "last"],
            )

    return text_rows(docs).mapInArrow(run, "doc_id long, n_words long, key binary, sha string, anchor array<long>, first array<int>, last array<int>")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, key and text of the documents in ``ids`` (and a few others, which a join drops)."""
    bitmap = docs.sparkSession.sparkContext.broadcast(Ids(ids, "doc_id"))  # 16 MiB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(b.filter(pa.array(bitmap.value.may_have(b.column(2).to_numpy(zero_copy_only=False)))) for b in batches):
            keys = [xxhash.xxh3_128_digest(b" ".join(x.encode().split())) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), b.column(1)], ["id", "id_key", "text"])

    return text_rows(docs, F.xxhash64(F.col("doc_id").cast("long")).alias("hash")).filter("doc_id is not null").mapInArrow(run, "id long, id_key binary, text string")


def _stretches(rows: DataFrame, width: int) -> DataFrame:
    """anchor, document, first window and words of each listed stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = {k: [] for k in ("anchor", "doc_id", "key", "first", "words")}
            for d, k, text, runs in zip(*(b.column(i).to_pylist() for i in range(4))):
                words = text.encode().split()
                for r in runs:
                    for name, v in zip(out, (r["anchor"], d, k, r["first"], b" ".join(words[r["first"] : r["last"] + width]).decode())):
                        out[name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["anchor"], pa.int64()), pa.array(out["doc_id"], pa.int64()), pa.array(out["key"], pa.binary()), pa.array(out["first"], pa.int32()), pa.array(out["words"], pa.string())], list(out))

    return rows.mapInArrow(run, "anchor long, doc_id long, key binary, first int, words string")


FOUND = "anchor long, doc_id long, key binary, first int, stop int, words string"


def searched(anchor: np.ndarray, docs: np.ndarray, keys: list[bytes], first: np.ndarray, words: pa.Array, parts: np.ndarray, level: int, width: int) -> pa.RecordBatch:
    """Rows of ``FOUND``, from stretches that make one index: reported intervals (no anchor), and what is left of anchors in several parts, under their next keys."""
    w = Words(words)
    lane, start = FMIndex(w.codes, w.offsets, docs, width).matched(w.codes, w.offsets, docs)
    out: dict[str, list] = {name: [] for name in ("anchor", "doc_id", "key", "first", "stop", "words")}

    def row(*cells) -> None:
        for column, cell in zip(out.values(), cells):
            column.append(cell)

    order = np.lexsort((start, lane))
    lane, start = lane[order], start[order]
    new = np.ones(len(lane), bool)
    new[1:] = (lane[1:] != lane[:-1]) | (start[1:] > start[:-1] + width)
    heads = np.flatnonzero(new)
    tails = np.append(heads, len(lane))[1:] - 1
    for i, x, y in zip(lane[heads].tolist(), start[heads].tolist(), (start[tails] + width).tolist()):
        row(None, int(docs[i]), keys[i], int(first[i]) + x, int(first[i]) + y, None)
    bounds, hashes = np.searchsorted(lane, np.arange(len(docs) + 1)), None
    for i in np.flatnonzero(parts > 1).tolist():
        hashes = w.hashes() if hashes is None else hashes
        own = hashes[w.offsets[i] : w.offsets[i + 1]]
        left = np.ones(len(own) - width + 1, bool)
        left[start[bounds[i] : bounds[i + 1]]] = False
        left = np.flatnonzero(left)
        if len(left):
            key = refined(own, np.full(len(own) - width + 1, anchor[i]), level, width, GRAM)[left]
            text = words[i].as_py().split(" ")
            for a, b in zip(*_runs(key, np.zeros(len(left)), left)):
                row(int(key[a]), int(docs[i]), keys[i], int(first[i] + left[a]), None, " ".join(text[left[a] : left[b] + width]))
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.string()))], list(out))


def _round(stretches: DataFrame, level: int, width: int) -> DataFrame:
    """``FOUND`` of the stretches, each anchor's dealt over as many shards as its words need."""
    size = F.sum(F.size(F.split("words", " ")))
    of = stretches.groupBy("anchor").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"), F.ceil(size / SHARD_WORDS).cast("int").alias("parts")).filter("x < y")
    dealt = stretches.join(of.select("anchor", "parts"), "anchor").withColumn("part", F.pmod(F.xxhash64("doc_id", "key", "first", F.lit(level)), F.col("parts")).cast("int"))
    dealt = dealt.select("anchor", "part", "parts", "doc_id", "key", "first", "words").repartition(partitions(stretches.sparkSession), "anchor", "part").sortWithinPartitions("anchor", "part")

    def index(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        words = t["words"].combine_chunks() if isinstance(t["words"], pa.ChunkedArray) else t["words"]
        return searched(t["anchor"].to_numpy(), t["doc_id"].to_numpy(), t["key"].to_pylist(), t["first"].to_numpy(), words, t["parts"].to_numpy(), level, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None  # whole shards; the last one of held may go on
        for b in slices(batches, "words", 1 << 20):
            shard = np.column_stack([b.column(0).to_numpy(), b.column(1).to_numpy()])
            if held and size >= SHARD_WORDS * 6:
                other = (shard != last).any(1)
                cut = int(np.argmax(other)) if other.any() else len(other)
                if cut < len(other):
                    yield index(held + ([b.slice(0, cut)] if cut else []))
                    held, size, b, shard = [], 0, b.slice(cut), shard[cut:]
            held.append(b)
            size, last = size + pc.sum(pc.binary_length(b.column(6))).as_py(), shard[-1]
        if held:
            yield index(held)

    return dealt.mapInArrow(run, FOUND)


def _applied(rows: DataFrame, width: int) -> DataFrame:
    """doc_id, key, n_removed, sha and kept text, from the texts and the intervals found; windows go wherever the document has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w, out = Words(plain(b.column(2))), []
            hit = np.zeros(len(w.codes) + 1, np.int64)
            for base, cuts in zip(w.offsets.tolist(), b.column(3).to_pylist()):
                for c in cuts:
                    hit[base + c["first"] : base + c["stop"] - width + 1] = 1
            hit = hit[:-1][first_alike(w, width)] if len(w.codes) else hit[:-1]
            at = np.flatnonzero(hit)
            edge = np.zeros(len(w.codes) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + width, -1)
            kept = np.cumsum(edge[:-1]) == 0
            for i, (d, k, text) in enumerate(zip(*(b.column(i).to_pylist() for i in range(3)))):
                words, keep = text.encode().split(), kept[w.offsets[i] : w.offsets[i + 1]]
                words = [words[j] for j in np.flatnonzero(keep)]
                out.append((d, k, len(keep) - len(words), _joined(words), b" ".join(words).decode()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string()))], ["id", "id_key", "removed", "cut_sha", "kept_text"])

    return rows.mapInArrow(run, "id long, id_key binary, removed long, cut_sha string, kept_text string")


def removed_intervals(docs: DataFrame, scanned: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, key and the word intervals (first, stop) to remove, for the first of the documents with equal words."""
    some = scanned.filter(f"n_words >= {width} and doc_id is not null")
    firsts = some.groupBy("key").agg(F.min("doc_id").alias("least"))
    own = some.join(firsts, "key").filter("doc_id = least").dropDuplicates(["key"]).select("doc_id", "key", F.explode(F.arrays_zip("anchor", "first", "last")).alias("r")).select("doc_id", "key", "r.*")
    own = written(own, "anchors")
    shared = own.groupBy("anchor").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).filter("x < y").select("anchor")
    runs = written(own.join(shared, "anchor", "left_semi"), "runs")
    by_doc = runs.groupBy("doc_id", "key").agg(F.collect_list(F.struct("anchor", "first", "last")).alias("runs"))
    texts = _texts(docs, runs)
    listed = by_doc.join(texts, (by_doc.doc_id == texts.id) & (by_doc.key == texts.id_key)).dropDuplicates(["doc_id", "key"]).select("doc_id", "key", "text", "runs")
    stretches, level, rounds = written(_stretches(listed, width), "stretches"), 1, []
    while True:
        rounds.append(written(_round(stretches, level, width), "round"))
        stretches = rounds[-1].filter("anchor is not null").select("anchor", "doc_id", "key", "first", "words")
        if not stretches.limit(1).count():
            return reduce(DataFrame.unionByName, rounds).filter("anchor is null").select("doc_id", "key", "first", "stop")
        level += 1


def dedup_substrings(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and removed intervals' effect for each row of ``docs``."""
    scanned = written(_scanned(docs, width), "scanned")
    intervals = written(removed_intervals(docs, scanned, width), "intervals")
    cuts = intervals.groupBy("doc_id", "key").agg(F.collect_list(F.struct("first", "stop")).alias("cuts"))
    texts = _texts(docs, intervals)
    rows = cuts.join(texts, (cuts.doc_id == texts.id) & (cuts.key == texts.id_key)).dropDuplicates(["doc_id", "key"]).select("doc_id", "key", "text", "cuts")
    applied = _applied(rows, width).select("id", "id_key", "removed", "cut_sha")
    least = scanned.filter(f"n_words >= {width} and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("least")).withColumnRenamed("key", "k")
    out = scanned.select("doc_id", "n_words", "key", "sha").join(least, F.col("key") == F.col("k"), "left").join(applied, (F.col("doc_id") == F.col("id")) & (F.col("key") == F.col("id_key")), "left")
    copy = F.col("least") < F.col("doc_id")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"), F.when(copy, F.lit(empty)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256")
    )
