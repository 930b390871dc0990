"""Conflict-constrained best-fit packing.

Documents are cut into pieces of at most ``capacity`` tokens (a token: a word), and pieces
are put into bins of that capacity. A bin never holds two pieces of one source, nor two of
one duplicate cluster. A bin carries both as bitmaps, over numbers that its shard gives to
sources and clusters. Open bins are kept by residual; the search starts at the smallest
residual that fits a piece and goes on to the successor until it meets the tightest bin whose
bitmaps are compatible. A level whose bins all hold the piece's source, or cluster, is
passed over by its counts, without looking at its bins.

Pieces are dealt by a hash into shards of about ``SHARD`` pieces, largest first in each, so
no task grows with the input and a hot source or cluster is spread over all shards; each
shard leaves at most a few bins less full than one long list would. A piece that fills a
bin closes it.

Defined cases: null or empty text: a piece of no tokens, in no bin (bin null). A null
source is a source of its own. A null doc_id, or one that many rows share, is dealt over all shards
by row. Ties go to the smaller doc_id. A text of any length is cut whole. Repeated rows are pieces of
their own, and of one cluster. Empty table: empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, partitions, text_rows

CAPACITY = 2048
SHARD = 20_000
PACKED = "doc_id long, piece int, first_token long, n_tokens long, bin string, place int"


class Bins:
    """Open bins by residual, with their bitmaps."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.levels: list[list[tuple[int, int, int, int]]] = [[] for _ in range(capacity + 1)]  # (bin, sources, clusters, pieces)
        self.with_source: list[dict[int, int]] = [{} for _ in range(capacity + 1)]
        self.with_cluster: list[dict[int, int]] = [{} for _ in range(capacity + 1)]
        self.open = 0  # a bit for each residual that has bins
        self.made = 0

    def _count(self, residual: int, sources: int, clusters: int, by: int) -> None:
        for table, bits in ((self.with_source[residual], sources), (self.with_cluster[residual], clusters)):
            while bits:
                low = bits & -bits
                k = low.bit_length()
                bits ^= low
                if left := table.get(k, 0) + by:
                    table[k] = left
                else:
                    table.pop(k, None)

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """The bin of a piece and its place there; ``source`` and ``cluster`` are numbers."""
        s, c = 1 << source, 1 << cluster
        rest = self.open >> size << size
        while rest:
            residual = (rest & -rest).bit_length() - 1
            rest &= rest - 1
            level = self.levels[residual]
            if self.with_source[residual].get(source + 1, 0) == len(level) or self.with_cluster[residual].get(cluster + 1, 0) == len(level):
                continue
            for i, (name, sources, clusters, n) in enumerate(level):
                if not sources & s and not clusters & c:
                    level[i] = level[-1]
                    level.pop()
                    self._count(residual, sources, clusters, -1)
                    if not level:
                        self.open &= ~(1 << residual)
                    self._keep(residual - size, (name, sources | s, clusters | c, n + 1))
                    return name, n
        self.made += 1
        self._keep(self.capacity - size, (self.made - 1, s, c, 1))
        return self.made - 1, 0

    def _keep(self, residual: int, entry: tuple[int, int, int, int]) -> None:
        if residual:
            self.levels[residual].append(entry)
            self._count(residual, entry[1], entry[2], 1)
            self.open |= 1 << residual


def pieces(docs: DataFrame, capacity: int = CAPACITY, source: str = "source", cluster: str | None = None) -> DataFrame:
    """doc_id, piece, first_token, n_tokens, source, cluster, number of the row. Without a cluster column, equal texts are a cluster."""
    rows = text_rows(docs, F.xxhash64(F.col(source).cast("string"), F.col(source).isNull()).alias("s"), (F.xxhash64(F.col(cluster).cast("string")) if cluster else F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("c"))
    sized = rows.select("doc_id", "s", "c", F.monotonically_increasing_id().alias("row"), F.regexp_count("text", F.lit(WORD.replace("+", "++"))).cast("long").alias("n"))
    every = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / capacity).cast("int") - 1)))
    cut = sized.select("doc_id", "s", "c", "row", "n", every.alias("piece"))
    first = (F.col("piece") * F.lit(capacity)).cast("long")
    return cut.select("doc_id", "piece", first.alias("first_token"), F.least(F.lit(capacity), F.col("n") - first).cast("long").alias("n_tokens"), "s", "c", "row")


def pack(docs: DataFrame, capacity: int = CAPACITY, source: str = "source", cluster: str | None = None) -> DataFrame:
    """Each piece with its bin (shard-number) and its place in the bin."""
    cut = pieces(docs, capacity, source, cluster)
    # a row has one piece at least: the number of shards follows the number of rows, which is one count
    shards = max(1, -(-docs.count() // SHARD))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "s", "c", "row"), F.lit(shards)).cast("int"))
    # a task takes several shards, one after the other, where there are more shards than partitions
    dealt = dealt.repartition(min(shards, max(partitions(docs.sparkSession), 2)), "shard").sortWithinPartitions("shard", F.desc("n_tokens"), "doc_id", "piece", "s", "c", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bins, sources, clusters = None, None, {}, {}
        for b in batches:
            names, places = [], []
            for size, s, c, shard in zip(*(b.column(i).to_pylist() for i in (3, 4, 5, 7))):
                if shard != now:
                    now, bins, sources, clusters = shard, Bins(capacity), {}, {}
                if size:
                    name, place = bins.put(size, sources.setdefault(s, len(sources)), clusters.setdefault(c, len(clusters)))
                    names.append(f"{shard}-{name}")
                    places.append(place)
                else:
                    names.append(None)
                    places.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(names, pa.string()), pa.array(places, pa.int32())], [x.split()[0] for x in PACKED.split(", ")])

    return dealt.mapInArrow(run, PACKED)
