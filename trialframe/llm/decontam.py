"""Benchmark decontamination by spaced seeds.

``MASKS`` select some of the tokens of a span and ignore the others, so a substituted word
at an ignored place leaves the hash as it is. Hashes of the benchmark and of the documents
are joined; around every hit the item is laid over the document along the hit's diagonal
(and up to ``BAND`` neighbours, for dropped or added words) and compared word by word.
What the masks don't find is looked for by ``PAIRS``: of ``m`` matches among ``n`` words in
place, at least (3 (m - 1) - (n - 1)) / 2 follow the one before at a distance of one or two,
so diagonals with fewer pairs needn't be compared, and substituted words lose no item of
three words or more at 50 % and above. Two-word items need both words.
Words are lower-cased without punctuation at their ends.

The benchmark is the query set: it goes to the executors in blocks of at most
``BLOCK_WORDS`` words, one scan of the documents for each block, so what is broadcast has a
fixed bound.

An item is found where at least ``PERCENT`` of its words match. Items shorter than a mask
use a contiguous seed of their own length. Defined cases: null or empty texts, on either
side, match nothing; a text of any length, and one that repeats itself, is compared whole, in time in proportion
to its length and its items' (each diagonal is compared once, with a sliding band) and in bounded memory;
repeated rows return a row each; a null item_id is no item; ties between diagonals go to the
first place in the text; empty tables give an empty result; ``filter_documents`` keeps
other columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mixed, plain, slices, text_rows

#: Spans of 12 tokens, 8 of them compared.
MASKS = ("110110011101", "111010110011", "101111001101")
#: Two words side by side or with one between; of items of four words also the first and the last.
PAIRS = ("11", "101", "1001")
PERCENT = 50
BAND = 3
BLOCK_WORDS = 1_000_000
TABLE_BITS = 21
#: Hits, or cells of a comparison, that are held at once.
STEP = 2_000_000
#: Punctuation that is dropped at a word's ends.
ENDS = ".,;:!?\"'()[]{}<>«»¿¡…#*$%&|-"


def folded(word: str) -> str:
    return word.lower().strip(ENDS)


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the tokens that ``mask`` selects, from each position on."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(mask), np.uint64)
    with np.errstate(over="ignore"):
        for j, c in enumerate(mask):
            if c == "1":
                out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
        return mixed(out)


class Block:
    """Items with their words' hashes and, for each mask, the sorted seed hashes and their places."""

    def __init__(self, items: list[tuple[int, str]], masks: tuple[str, ...] = MASKS):
        w = Words(pa.array([t for _, t in items], pa.string()))
        h = w.hashes(folded)
        self.ids = [i for i, _ in items]
        self.words = [h[a:b] for a, b in zip(w.offsets[:-1], w.offsets[1:])]
        self.longest = max(map(len, self.words), default=0)
        span = max(map(len, masks))
        places: dict[str, list] = {}
        for k, words in enumerate(self.words):
            for mask in masks if len(words) >= span else ("1" * len(words),) * bool(len(words)):
                places.setdefault(mask, []).append((seeds(words, mask), k))
        self.tables = self._tables(places)
        self.pairs = self._tables({p: [(seeds(x, p), k) for k, x in enumerate(self.words) if len(x) >= len(p) and (p != PAIRS[2] or len(x) == 4)] for p in PAIRS})

    @staticmethod
    def _tables(places: dict[str, list]) -> dict[str, tuple]:
        tables = {}
        for mask, found in places.items():
            if not found:
                continue
            value = np.concatenate([s for s, _ in found])
            item = np.concatenate([np.full(len(s), k) for s, k in found])
            at = np.concatenate([np.arange(len(s)) for s, _ in found])
            order = np.argsort(value, kind="stable")
            near = np.zeros(1 << TABLE_BITS, bool)
            near[value & np.uint64((1 << TABLE_BITS) - 1)] = True
            tables[mask] = (value[order], item[order], at[order], near)
        return tables

    def _hits(self, tables: dict[str, tuple], h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Diagonals that the tables' seeds hit, as ascending numbers (see ``_number``), and how often; at most ``STEP`` hits are held at once."""
        keys, votes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for mask, (value, item, at, near) in tables.items():
            s = seeds(h, mask)
            where = np.flatnonzero(near[s & np.uint64((1 << TABLE_BITS) - 1)])
            lo, hi = np.searchsorted(value, s[where], "left"), np.searchsorted(value, s[where], "right")
            doc = np.searchsorted(offsets, where, "right") - 1
            fits = (hi > lo) & (where + len(mask) <= offsets[doc + 1])
            where, lo, count, doc = where[fits], lo[fits], (hi - lo)[fits], doc[fits]
            ends = np.cumsum(count)
            begin = 0
            while begin < len(where):
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + STEP, "right")))
                c = count[begin:end]
                each = np.repeat(np.arange(begin, end), c)
                entry = np.arange(len(each)) - np.repeat(np.cumsum(c) - c, c) + lo[each]
                k, n = np.unique(self._number(doc[each], item[entry], where[each] - at[entry] - offsets[doc[each]], offsets), return_counts=True)
                keys.append(k)
                votes.append(n)
                begin = end
                if sum(map(len, keys)) > STEP:
                    keys, votes = ([x] for x in _added(keys, votes))
        return _added(keys, votes)

    def _range(self, offsets: np.ndarray) -> int:
        return int(np.diff(offsets).max(initial=0)) + self.longest + 4 * BAND + 4

    def _number(self, doc, item, diagonal, offsets: np.ndarray) -> np.ndarray:
        """Text, item and diagonal as one number; diagonals of one text and item are far from those of another."""
        return (doc * len(self.words) + item) * self._range(offsets) + diagonal + self.longest + 2 * BAND + 2

    def found(self, text: pa.Array, percent: int = PERCENT) -> list[tuple[int, int, int, int, int, int]]:
        """(row, item_id, words of the item, words matched, first word, word after the last) of each item in each text."""
        w = Words(text)
        h = w.hashes(folded)
        if not self.words or not len(h):
            return []
        out = self._compared(h, w.offsets, self._hits(self.tables, h, w.offsets)[0], percent, set())
        keys, votes = self._hits(self.pairs, h, w.offsets)
        # diagonals with pairs enough in their band, and their neighbours
        item = keys // self._range(w.offsets) % len(self.words)
        size = np.array([len(x) for x in self.words])
        least = np.maximum(1, -((size - 1 - 3 * (-(-percent * size // 100) - 1)) // 2))
        sums = np.concatenate([[0], np.cumsum(votes)])
        lo, hi = np.searchsorted(keys, keys - BAND, "left"), np.searchsorted(keys, keys + BAND, "right")
        likely = np.flatnonzero(sums[hi] - sums[lo] >= least[item])
        edge = np.zeros(len(keys) + 1, np.int64)
        np.add.at(edge, lo[likely], 1)
        np.add.at(edge, hi[likely], -1)
        out += self._compared(h, w.offsets, keys[np.cumsum(edge[:-1]) > 0], percent, {(r[0], r[1]) for r in out})
        return [(d, self.ids[k], *rest) for d, k, *rest in sorted(out)]

    def _compared(self, h: np.ndarray, offsets: np.ndarray, keys: np.ndarray, percent: int, done: set) -> list[tuple[int, int, int, int, int, int]]:
        """As ``found``, with the item's number, of the items laid over the texts along the diagonals of ``keys``, but for pairs in ``done``."""
        out, reach = [], self._range(offsets)
        pair, diagonal = keys // reach, keys % reach - self.longest - 2 * BAND - 2
        heads = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(keys) else np.zeros(0, np.int64)
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(keys)]):
            d, k = divmod(int(pair[a]), len(self.words))
            if (d, k) in done:
                continue
            own, words = h[offsets[d] : offsets[d + 1]], self.words[k]
            n, best = len(words), (0, 0, 0)
            rows = max(2 * BAND + 1, STEP // n)  # as many diagonals at once, with their neighbours to either side
            for x in range(a, b, rows):
                lo, hi = max(a, x - BAND), min(b, x + rows + BAND)
                match = _matches(words, own, diagonal[lo:hi])
                count = match.sum(axis=1)
                i = int(np.argmax(count[x - lo : min(b, x + rows) - lo])) + x - lo
                if count[i] > best[0]:
                    on = np.flatnonzero(match[i])
                    best = (int(count[i]), max(0, int(on[0] + diagonal[lo + i])), min(len(own), int(on[-1] + diagonal[lo + i]) + 1))
            if 100 * best[0] >= percent * n:
                out.append((d, k, n, *best))
        return out


def _added(keys: list[np.ndarray], votes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their votes."""
    k, back = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(back, np.concatenate(votes), len(k)).astype(np.int64)


def _matches(words: np.ndarray, own: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """For each of the ascending diagonals which words match on it or on one of the others up to ``BAND`` away."""
    at = diagonals[:, None] + np.arange(len(words))
    inside = (at >= 0) & (at < len(own))
    on = inside & (own[np.where(inside, at, 0)] == words)
    out = on.copy()
    for step in range(1, min(BAND, len(diagonals) - 1) + 1):
        close = (diagonals[step:] - diagonals[:-step] <= BAND)[:, None]
        out[step:] |= on[:-step] & close
        out[:-step] |= on[step:] & close
    return out


def blocks(benchmark: DataFrame, limit: int = BLOCK_WORDS) -> Iterator[list[tuple[int, str]]]:
    """The items in ascending order, in blocks of at most ``limit`` words (or one item), read as a stream."""
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("i"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).filter("i is not null").orderBy("i", "t").toLocalIterator():
        n = len(r["t"].split())
        if held and size + n > limit:
            yield held
            held, size = [], 0
        held.append((r["i"], r["t"]))
        size += n
    if held:
        yield held


OVERLAPS = "doc_id long, item_id long, n_item_words long, n_matched long, start_word long, end_word long"


def overlaps(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row for each benchmark item found in a row of ``docs``: the words matched and where."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], OVERLAPS)
    for items in blocks(benchmark):
        block = spark.sparkContext.broadcast(Block(items))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                rows = block.value.found(plain(b.column(1)), percent)
                cells = [b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 6))]
                yield pa.RecordBatch.from_arrays(cells, [x.split()[0] for x in OVERLAPS.split(", ")])

        out = out.union(text_rows(docs).mapInArrow(run, OVERLAPS))
    return out


def filter_documents(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with their own columns, in which no benchmark item is found."""
    for items in blocks(benchmark):
        block = docs.sparkSession.sparkContext.broadcast(Block(items))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                clean = np.ones(b.num_rows, bool)
                clean[[r[0] for r in block.value.found(plain(b.column(b.schema.get_field_index("text"))), percent)]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
