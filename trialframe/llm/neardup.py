"""Near-duplicate documents by HyperMinHash sketches.

Each of ``REGISTERS`` buckets is fed by a hash function of its own over all shingles, so
short documents fill every bucket too; of a bucket's minimum, its leading zeros (6 bits)
and the ``MANTISSA`` bits after the first one are stored, 16 bits in all. ``ROWS``
neighbouring registers are a band. Documents whose bands are equal are compared by sketch
(the share of equal registers, corrected for registers that agree by chance), and what
passes is confirmed on the full shingle sets.

Equal sets are one class from the start. The classes that share a band are a group. First each
group's members are compared with its smallest, so most groups become one component at the cost of
their size. Where a group is left with several components, pairs across them are compared, in
blocks of ``BLOCK`` members (or ``BLOCK_SHINGLES`` shingles): first by sketches, each pair in the first band that it
shares; then members that have a candidate are confirmed on full sets, and each pair of blocks
reports only links that join components. So no link with a shared band is lost, no group is gathered
in one task, whatever its size, and what moves is the members of a block, not their pairs.
A pair at the threshold shares no band with probability (1 - t^ROWS)^BANDS: 2e-8 at 0.85, 4e-6 at 0.8.

Defined cases: null or empty text, or one without words: no shingles, no links. Fewer
words than a shingle: the whole sequence is one shingle. Rows that share a doc_id are one
document, linked if any of its texts is, and return a row each. A null doc_id is linked
with nothing, has a null component and is kept. A text of any length is one set, of all its
shingles. Of equally similar documents the smallest doc_id names the group. Empty table: empty result.
Columns other than doc_id and text are not read, and pass through ``keep_one``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Ids, Words, mixed, partitions, plain, slices, starts_within, text_rows, whole_groups, windows, written
from .components import components

BANDS, ROWS, MANTISSA = 24, 4, 10
REGISTERS = BANDS * ROWS
BLOCK, BLOCK_SHINGLES = 384, 4_000_000
#: Pairs of one document that go to one task.
STAR = 512
#: Sketches pass if the estimate is at most this many standard errors below the threshold.
ERRORS = 4.5
_FEED = mixed(np.arange(1, 2 * REGISTERS + 1))


def shingle_sets(text: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all texts, one after the other, and their bounds."""
    words = Words(text, fold=True)
    h, n = words.hashes(), len(words.codes)
    starts = starts_within(words.offsets, n, size)
    values, doc = windows(h, size)[starts] if len(starts) else np.zeros(0, np.uint64), words.document_of()[starts] if len(starts) else np.zeros(0, np.int64)
    for d in np.flatnonzero((words.counts > 0) & (words.counts < size)):
        whole = np.uint64(xxhash.xxh3_64_intdigest(h[words.offsets[d] : words.offsets[d + 1]].tobytes(), int(words.counts[d])))
        values, doc = np.append(values, whole), np.append(doc, d)
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    return values[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(text)))]).astype(np.int64)


def compressed(minima: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of 64-bit minima as one 16-bit register."""
    y = minima >> np.uint64(11)  # 53 bits, exact in a double
    length = np.frexp(y.astype(np.float64))[1].astype(np.uint64)
    rest = (y << (np.uint64(53) - length)) & np.uint64((1 << 52) - 1)
    return (((np.uint64(53) - length) << np.uint64(MANTISSA)) | (rest >> np.uint64(52 - MANTISSA))).astype(np.uint16)


def sketches(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of registers for each set; zeros for an empty set."""
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), REGISTERS), np.uint16)
    if len(full):
        at = bounds[:-1][full]
        with np.errstate(over="ignore"):
            for j in range(REGISTERS):
                out[full, j] = compressed(np.minimum.reduceat((values ^ _FEED[2 * j]) * (_FEED[2 * j + 1] | np.uint64(1)), at))
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from rows of registers. Different minima agree in a register with probability of about 2^-MANTISSA / 1.5; that share is taken out."""
    chance = 2.0**-MANTISSA / 1.5
    return np.maximum(0, ((a == b).mean(axis=1) - chance) / (1 - chance))


def _sketched(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            values, bounds = shingle_sets(plain(b.column(1)), size)
            regs = sketches(values, bounds)
            keys = [xxhash.xxh3_128_digest(values[x:y].tobytes()) if y > x else None for x, y in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(bounds)), pa.array(keys, pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary())], ["doc_id", "n_shingles", "set_key", "registers"])

    return text_rows(docs).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, registers binary")


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """doc_id and shingle set of the documents in ``ids`` (and a few others, which a join drops)."""
    bitmap = docs.sparkSession.sparkContext.broadcast(Ids(ids, "id"))  # 16 MiB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(b.filter(pa.array(bitmap.value.may_have(b.column(2).to_numpy(zero_copy_only=False)))) for b in batches):
            values, bounds = shingle_sets(plain(b.column(1)), size)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([values[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:])], pa.binary())], ["id", "shingles"])

    return text_rows(docs, F.xxhash64(F.col("doc_id").cast("long")).alias("hash")).filter("doc_id is not null").mapInArrow(run, "id long, shingles binary")


def _cut(percent: int) -> float:
    return percent / 100 - ERRORS * (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of hashes have 100 * intersection >= percent * union."""
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _similar(pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs with their registers, those that may be similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
                yield b.select(["a", "b"]).filter(pa.array(estimate(x, y) >= _cut(percent)))

    return pairs.mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs with their full sets, those that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(b.column(2), b.column(3))]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def _with(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """``pairs`` (a, b) with the ``column`` of both; ``a`` may have very many pairs, its value is repeated for every ``STAR`` of them."""
    many = pairs.groupBy(F.col("a").alias("h")).agg(F.ceil(F.count("*") / STAR).cast("int").alias("copies"))
    of_a = values.join(many, F.col("id") == F.col("h")).select("h", "copies", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col(column).alias("va"))
    dealt = pairs.join(many, F.col("a") == F.col("h")).select("a", "b", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("at"))
    both = dealt.join(values.select(F.col("id").alias("b"), F.col(column).alias("vb")), "b").join(of_a, (F.col("a") == F.col("h")) & (F.col("at") == F.col("copy")))
    return both.select("a", "b", "va", "vb")


def across(band: int, registers: np.ndarray, labels: np.ndarray, rows: np.ndarray, columns: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ``rows`` and ``columns`` (indices, ascending ones if they are the same) with different labels that may be similar enough and share no band before ``band``."""
    out = []
    for i in rows.tolist():
        others = columns[labels[columns] != labels[i]]
        if len(rows) == len(columns) and rows[0] == columns[0]:
            others = others[others > i]
        others = others[estimate(registers[others], registers[i][None]) >= _cut(percent)]
        if len(others):
            shared = (registers[others] == registers[i]).reshape(-1, BANDS, ROWS).all(axis=2)
            others = others[np.argmax(shared, axis=1) == band]
            out.append(np.column_stack([np.full(len(others), i), others]))
    pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


TASK = ["band", "key", "i", "j"]


def _tasks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Each pair of blocks as a table, and its candidate pairs as places in it. Rows: ``TASK``, right, v, label, registers, ..."""
    for t in whole_groups(batches, len(TASK)):
        band, j = t["band"][0].as_py(), t["j"][0].as_py()
        registers = np.frombuffer(b"".join(t["registers"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
        right, labels, every = t["right"].to_numpy().astype(bool), t["label"].to_numpy(), np.arange(t.num_rows)
        alone = j is not None and t["i"][0].as_py() == j
        a, b = across(band, registers, labels, every, every, percent) if alone else across(band, registers, labels, every[~right], every[right], percent)
        if len(a):
            yield t, a, b


def _dealt(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of groups with several components, in pairs of blocks: those outside the group's largest component with one another and with it."""
    known = members.join(labels, F.col("id") == F.col("v"), "left").select("band", "key", "id", "n_shingles", F.coalesce("component", "id").alias("label"))
    counts = known.groupBy("band", "key", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    need = lambda n, s: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    groups = counts.groupBy("band", "key").agg(F.max_by(F.struct("label", "n", "s"), F.struct("n", "label")).alias("core"), F.count("*").alias("labels"), F.sum("n").alias("n"), F.sum("s").alias("s")).filter("labels > 1")
    groups = groups.select("band", "key", F.col("core.label").alias("core"), need(F.col("n") - F.col("core.n"), F.col("s") - F.col("core.s")).alias("us"), need(F.col("core.n"), F.col("core.s")).alias("cs"))
    j = known.join(groups, ["band", "key"]).withColumn("is_core", F.col("label") == F.col("core"))
    block = F.pmod(F.xxhash64("id"), F.when(F.col("is_core"), F.col("cs")).otherwise(F.col("us"))).cast("int")
    j = j.withColumn("block", block)
    # blocks outside the core are numbered from 0, those of the core from -1 down; i is never of the core
    place = lambda i, j, right: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), right.alias("right"))
    numbers = lambda n: F.sequence(F.lit(0), n - 1)
    own = F.transform(numbers(F.col("us")), lambda k: place(F.least(F.col("block"), k), F.greatest(F.col("block"), k), F.col("block") > k))
    to_core = F.transform(numbers(F.col("cs")), lambda k: place(F.col("block"), -1 - k, F.lit(False)))
    from_core = F.transform(numbers(F.col("us")), lambda k: place(k, -1 - F.col("block"), F.lit(True)))
    return j.select("band", "key", F.explode(F.when(F.col("is_core"), from_core).otherwise(F.concat(own, to_core))).alias("p"), F.col("id").alias("v"), "label").select("band", "key", "p.i", "p.j", "p.right", "v", "label")


def _sorted(tasks: DataFrame, n: int) -> DataFrame:
    return tasks.repartition(n, *TASK).sortWithinPartitions(*TASK)


def _links_across(members: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between the components (``labels``: v, component) that share a group of ``members``."""
    n = partitions(docs.sparkSession)
    registers = classes.select(F.col("id").alias("v"), "registers")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, a, b in _tasks(batches, percent):
            yield from t.take(np.unique(np.concatenate([a, b]))).to_batches()

    tasks = _sorted(_dealt(members, labels).join(registers, "v").select(*TASK, "right", "v", "label", "registers"), n)
    found = written(tasks.mapInArrow(look, tasks.schema), "candidates")
    sets = _sets(docs, found.select(F.col("v").alias("id")).distinct(), size)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, a, b in _tasks(batches, percent):
            ids, labels, parent, links = t["v"].to_pylist(), t["label"].to_pylist(), {}, []
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["shingles"]]

            def root(x: int) -> int:
                while parent.setdefault(x, x) != x:
                    parent[x] = x = parent[parent[x]]
                return x

            for x, y in zip(a.tolist(), b.tolist()):
                if root(labels[x]) != root(labels[y]) and alike(sets[x], sets[y], percent):
                    parent[root(labels[x])] = root(labels[y])
                    links.append((ids[x], ids[y]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    with_sets = found.join(sets.dropDuplicates(["id"]), F.col("v") == F.col("id")).drop("id")
    return _sorted(with_sets, n).mapInArrow(confirm, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``."""
    sketched = written(_sketched(docs, shingle), "sketches")
    some = sketched.filter("doc_id is not null and n_shingles > 0")
    classes = written(some.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.min_by("registers", "doc_id").alias("registers"), F.min_by("n_shingles", "doc_id").alias("n_shingles")), "classes")
    bands = classes.select("id", "n_shingles", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"), "registers").select("id", "n_shingles", "band", F.expr(f"substring(registers, band * {2 * ROWS} + 1, {2 * ROWS})").alias("key"))
    shared = bands.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("id").alias("hub")).filter("n > 1")
    members = written(bands.join(shared, ["band", "key"]), "members")
    pairs = members.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    pairs = written(_similar(_with(written(pairs, "stars"), classes, "registers"), percent), "pairs")
    sets = written(_sets(docs, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), shingle), "sets").dropDuplicates(["id"])
    links = written(_confirmed(_with(pairs, sets, "shingles"), percent), "stars")
    first = components(links)
    links = links.union(_links_across(members.filter("n > 2"), first, classes, docs, shingle, percent))
    found = components(links)
    by_class = classes.select("set_key", "id").join(found, F.col("id") == F.col("v"), "left").select("set_key", F.coalesce("component", "id").alias("component"))
    own = found.select(F.col("v").alias("w"), F.col("component").alias("own"))
    out = sketched.join(by_class, "set_key", "left").join(own, F.col("doc_id") == F.col("w"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.least("component", "own"), "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with their own columns, whose document is the smallest doc_id of its group."""
    gone = near_duplicates(docs, shingle, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(gone, F.col("id") == F.col("gone"), "left_anti").select(*(F.col("row")[c].alias(c) for c in docs.columns))
