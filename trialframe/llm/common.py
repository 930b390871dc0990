"""Shared pieces of the training-data operators.

Driver side: the shared folder, tables that cut lineage, a bitmap of ids with a bounded size.
Executor side: Arrow record batches cut to a bounded number of text bytes, words and
their 64-bit hashes, hashes of word windows. Words are ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that one step on an executor handles at once; a longer single text is a step of its own.
SLICE_BYTES = 6 << 20
#: Bits of an id bitmap: 128 KiB to 16 MiB.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
_tables: list[tuple[SparkSession, str]] = []


# ---------------------------------------------------------------- driver side


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session gets one of its own where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="trialframe-")
        spark.conf.set("spark.checkpoint.dir", path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # with the scheme of the default file system if it has none
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other job uses; removed when the driver ends."""
    path = f"{shared_dir(spark)}/trialframe/{uuid.uuid4().hex}/{name}"
    _tables.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def release() -> None:
    """Deletes the tables that ``written`` made. Results that still read them can't be used afterwards."""
    while _tables:
        spark, path = _tables.pop()
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path.rpartition("/")[0])
        except Exception:  # the session has ended; the folder's owner cleans it
            pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Ids:
    """A bitmap in which each id of a table sets the bit of its hash: eight bits for each id, from ``LEAST_BITS`` to ``MOST_BITS``.

    It lets a scan skip most rows whose id is not in the table; a join afterwards is exact,
    so a crowded bitmap (beyond some 17 million ids) costs time and changes no result.
    """

    def __init__(self, ids: DataFrame, column: str):
        wanted = 8 * ids.select(column).count()
        self.bits = min(max(1 << (wanted - 1).bit_length() if wanted else 0, LEAST_BITS), MOST_BITS)
        bit = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(self.bits))
        rows = ids.select(bit.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m")).toLocalIterator()
        self.map = np.zeros((self.bits // 32768 + 2, 4096), np.uint8)
        for r in rows:
            self.map[r["k"]] = np.frombuffer(r["m"], np.uint8)

    def may_have(self, hashed: np.ndarray) -> np.ndarray:
        """Which of the hashes (``xxhash64`` of the id, a column that Spark computed) may be in the table."""
        b = np.mod(hashed.astype(np.int64), self.bits)
        # bitmap_bucket_number counts from 1 for positions 1.., and position 0 shares bucket 0 with none
        k = np.where(b > 0, 1 + (b - 1) // 32768, b // 32768)
        p = np.where(b > 0, (b - 1) % 32768, (-b) % 32768)
        return (self.map[k, p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1


def text_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """``doc_id`` as long, ``text`` as string with "" for null, and the columns named; nothing else, so further columns can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *columns)


# -------------------------------------------------------------- executor side


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def whole_groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.Table]:
    """Of rows that are sorted by their first ``columns`` columns: a table for each distinct value of these."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, bool)
        for k in range(columns):
            new[1:] |= pc.not_equal(b.column(k)[1:], b.column(k)[:-1]).to_numpy(zero_copy_only=False)
        new[0] = not held or any(held[-1].column(k)[-1] != b.column(k)[0] for k in range(columns))
        at = np.flatnonzero(new)
        if held and len(at):
            yield pa.Table.from_batches([*held, b.slice(0, at[0])])
            held = []
        for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
            yield pa.Table.from_batches([b.slice(x, y - x)])
        held.append(b.slice(at[-1]) if len(at) else b)
    if held:
        yield pa.Table.from_batches(held)


def plain(column: pa.Array) -> pa.Array:
    """A string column without nulls."""
    return pc.fill_null(column.cast(pa.string()), "")


class Words:
    """The words of a batch: ``codes`` into ``vocabulary`` in reading order, ``offsets`` by document."""

    def __init__(self, text: pa.Array, fold: bool = False):
        text = pc.ascii_lower(text) if fold else text
        lists = pc.ascii_split_whitespace(text)
        flat = lists.flatten()
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
        if not full.all():
            bounds = np.concatenate([[0], np.cumsum(full)])[bounds]
            flat = flat.filter(pa.array(full))
        coded = flat.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.vocabulary = coded.dictionary
        self.offsets = bounds
        self.counts = np.diff(bounds)

    def hashes(self, of=None) -> np.ndarray:
        """64-bit hash of each word, or of ``of(word)``, in reading order."""
        words = self.vocabulary.to_pylist()
        h = xxhash.xxh3_64_intdigest
        table = np.fromiter((h(w) for w in words) if of is None else (h(of(w)) for w in words), np.uint64, len(words))
        return table[self.codes] if len(words) else np.zeros(0, np.uint64)

    def document_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each position on; the last ``width - 1`` positions are left out."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
        return mixed(out)


def first_alike(words: "Words", width: int) -> np.ndarray:
    """For each position the first from which its document has the same ``width`` words; where these don't fit, the position itself."""
    n = len(words.codes)
    out, starts = np.arange(n), starts_within(words.offsets, n, width)
    if len(starts):
        doc = words.document_of()[starts]
        _, first, back = np.unique(windows(mixed(words.codes), width)[starts] ^ mixed(doc + 1), return_index=True, return_inverse=True)
        again = np.flatnonzero(first[back] != np.arange(len(starts)))
        if len(again):  # equal hashes are confirmed word by word
            at, to = starts[again], starts[first[back[again]]]
            same = doc[again] == doc[first[back[again]]]
            for j in range(width):
                same &= words.codes[at + j] == words.codes[to + j]
            out[at[same]] = to[same]
    return out


def starts_within(offsets: np.ndarray, total: int, width: int) -> np.ndarray:
    """Positions from which ``width`` words belong to one document, ascending."""
    n = total - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ok = np.ones(n, bool)
    for b in range(1, width):  # the positions less than ``width`` before a document's end
        at = offsets[1:] - b
        ok[at[(at >= 0) & (at < n) & (at >= offsets[:-1])]] = False
    return np.flatnonzero(ok)
