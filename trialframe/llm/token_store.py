"""Token ids in a content-addressed store.

Documents are encoded, an end id is appended, and each id stream is cut where a rolling
hash of the last ``ROLL`` ids has ``CUT_BITS`` zero bits. Chunks are addressed by a
128-bit BLAKE2 digest; each is stored once, as a zstd frame in a pack file. Packs follow
ascending doc_id (of a chunk's first document), so reading documents in order reads packs
in order. A recipe per document lists its chunks; recipes are in ascending doc_id order, in
parts, and a Merkle root over the recipes of each part, and one over all parts, make the
manifest. Reading fetches coalesced byte ranges and checks every chunk, recipe and root.

``Encoder`` gives what the library's ``encode`` gives, with a cache: the byte-level
pre-tokeniser never joins text across a single space between two other characters, so a
text is cut there (and between a piece's letters and what follows them), and each
distinct part is encoded once. Texts where a space touches
another white space, or that hold a special token, are encoded whole.

Defined cases: null or empty text: the end id alone. Repeated doc_ids are in an order of
their own and all returned; null doc_ids come first. Empty table: an empty store and
result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_dir, partitions, plain, slices, text_rows, windows, mixed
from .files import create, fetched, swept

ROLL, CUT_BITS, LEAST, MOST = 16, 9, 64, 4096
#: Pieces that a worker remembers, and that it encodes as one text.
CACHE, JOINED = 1_000_000, 500
#: A piece without apostrophes is cut after its letters, where the next character is ASCII and not a letter: the pre-tokeniser always ends a token there.
CUT = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-ɏ]+)(?P<tail>[^A-Za-z'\x{80}-\x{10FFFF}][^']*)$"


class Encoder:
    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.opens = np.array([t.startswith("\u0120") for t, _ in sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])])  # ids of tokens that begin with a space
        self.kind = np.uint16 if max(self.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else np.uint32
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known.update(zip(keys, range(len(self.known), len(self.known) + len(keys))))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, ids])

    def _places(self, stems: list[str], tails: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each stem, after a space, and of each tail are in ``flat``. Tails are kept under a leading NUL."""
        if len(self.known) > CACHE:
            self._forget()
        known = self.known
        new = [p for p in stems if p not in known]
        if new:
            # many stems are encoded as one text; a stem has one space, its first character, so its first id tells where it begins
            ids = np.fromiter(chain.from_iterable(self.whole([" " + " ".join(new[i : i + JOINED]) for i in range(0, len(new), JOINED)])), self.kind)
            first = np.flatnonzero(self.opens[ids])
            if len(first) != len(new):
                raise ValueError("the vocabulary joins text across a space")
            self._learn(new, ids, np.diff(np.append(first, len(ids))))
        marked = ["\0" + t for t in tails]
        new = [t for t in marked if t not in known]
        if new:
            ids = self.whole([t[1:] for t in new])
            self._learn(new, np.fromiter(chain.from_iterable(ids), self.kind), np.fromiter(map(len, ids), np.int64, len(ids)))
        return np.fromiter(map(known.__getitem__, stems), np.int64, len(stems)), np.fromiter(map(known.__getitem__, marked), np.int64, len(marked))

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, one after the other, and their bounds."""
        lists = pc.split_pattern(text, " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        codes, pieces = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        odd = pc.or_(pc.equal(pc.binary_length(pieces), 0), pc.not_equal(pc.utf8_trim_whitespace(pieces), pieces))
        for s in (*self.special, "\0"):
            odd = pc.or_(odd, pc.match_substring(pieces, s))
        slow = np.logical_or.reduceat(odd.to_numpy(zero_copy_only=False)[codes], bounds[:-1]) if len(text) else np.zeros(0, bool)
        doc = np.repeat(np.arange(len(text)), np.diff(bounds))
        head = np.zeros(len(codes), bool)
        head[bounds[:-1]] = True
        use = ~head & ~slow[doc]
        needed = np.zeros(len(pieces), bool)
        needed[codes[use]] = True
        chosen = np.flatnonzero(needed)
        place = (np.cumsum(needed) - 1)[codes[use]]
        used = pieces.take(pa.array(chosen))
        cut = pc.extract_regex(used, CUT)
        stems = pc.coalesce(pc.struct_field(cut, [0]), used).dictionary_encode()
        tails = pc.struct_field(cut, [1]).dictionary_encode()
        stem_at, tail_at = self._places(stems.dictionary.to_pylist(), tails.dictionary.to_pylist())
        stem_of = stem_at[stems.indices.to_numpy(zero_copy_only=False)] if len(chosen) else np.zeros(0, np.int64)
        has_tail = tails.indices.is_valid().to_numpy(zero_copy_only=False)
        tail_of = np.zeros(len(chosen), np.int64)
        tail_of[has_tail] = tail_at[tails.indices.drop_null().to_numpy()] if has_tail.any() else 0
        # the first piece has no space before it; slow texts are their own first piece
        texts = text.to_pylist()
        heads = pieces.take(pa.array(codes[bounds[:-1]])).to_pylist()
        first = self.whole([t if s else h for t, s, h in zip(texts, slow, heads)])
        lone_sizes = np.fromiter(map(len, first), np.int64, len(first))
        lone = np.fromiter(chain.from_iterable(first), self.kind, int(lone_sizes.sum()))
        pool = np.concatenate([self.flat, lone, np.array([self.end], self.kind)])
        # slots: of each piece the stem and the tail, and after each document the end id
        sizes, source = np.zeros(2 * len(codes) + len(text), np.int32), np.zeros(2 * len(codes) + len(text), np.int64)
        slot = 2 * np.arange(len(codes)) + doc
        sizes[slot[use]], source[slot[use]] = self.sizes[stem_of][place], self.starts[stem_of][place]
        sizes[slot[use] + 1], source[slot[use] + 1] = np.where(has_tail, self.sizes[tail_of], 0)[place] if len(chosen) else 0, self.starts[tail_of][place] if len(chosen) else 0
        sizes[slot[head]], source[slot[head]] = lone_sizes, len(self.flat) + np.cumsum(lone_sizes) - lone_sizes
        ends = 2 * bounds[1:] + np.arange(len(text))
        sizes[ends], source[ends] = 1, len(pool) - 1
        total = np.cumsum(sizes, dtype=np.int64)
        every = int(total[-1]) if len(total) else 0
        narrow = np.int32 if max(every, len(pool)) < 1 << 31 else np.int64  # half the memory to move
        at = np.repeat((source - (total - sizes)).astype(narrow), sizes)
        at += np.arange(every, dtype=narrow)
        ids = pool[at]
        return ids, np.concatenate([[0], total[ends]]).astype(np.int64)


def cuts(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each document."""
    low = windows(mixed(ids), ROLL) & np.uint64((1 << CUT_BITS) - 1)
    marks = np.flatnonzero(low == 0) + ROLL  # ends after the window
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        ends, at = [], lo
        for m in marks[np.searchsorted(marks, lo + LEAST) : np.searchsorted(marks, hi)].tolist():
            while m - at > MOST:
                at += MOST
                ends.append(at)
            if m - at >= LEAST:
                at = m
                ends.append(at)
        while hi - at > MOST:
            at += MOST
            ends.append(at)
        out.append([*ends, hi])
    return out


def address(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; a last node without a partner moves up."""
    level = leaves or [address(b"")]
    while len(level) > 1:
        level = [address(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def leaf(doc_id, digests: list[bytes]) -> bytes:
    return address(b"\0" + str(doc_id).encode() + b"".join(digests))


_ENCODERS: dict = {}


def encoder(path: str, end: int) -> Encoder:
    """One for each Python worker."""
    return _ENCODERS.setdefault((path, end), None) or _ENCODERS.__setitem__((path, end), Encoder(path, end)) or _ENCODERS[path, end]


_STAGE = "doc_id long, row long, n_tokens long, leaf binary, chunks array<binary>, own array<struct<digest:binary,no:int,pack:string,at:long,size:long>>"
_INDEX = "digest binary, pack string, at long, size long"


class Store:
    """Paths and tables of a store in the shared folder."""

    def __init__(self, spark, folder: str, width: int, parts: int):
        self.spark, self.folder, self.width, self.parts = spark, folder, width, parts

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")


def write_store(docs: DataFrame, tokenizer: str, end: int) -> Store:
    spark = docs.sparkSession
    folder = new_dir(spark, "tokens")
    width = np.dtype(encoder(tokenizer, end).kind).itemsize
    n = partitions(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pack = encoder(tokenizer, end), zstandard.ZstdCompressor(level=1)
        name, out, at, seen, row = uuid.uuid4().hex, None, 0, set(), TaskContext.get().partitionId() << 33
        for b in slices(batches, limit=8 << 20):
            out = out or create(f"{folder}/first/{name}")
            ids, bounds = enc(plain(b.column(1)))
            cells: list[list] = [[], [], [], [], []]
            for doc, lo, ends in zip(b.column(0).to_pylist(), bounds[:-1].tolist(), cuts(ids, bounds)):
                digests, own, x = [], [], lo
                for no, y in enumerate(ends):
                    data = ids[x:y].tobytes()
                    digests.append(d := address(data))
                    if d not in seen:  # a later copy in another task is found when packs are joined
                        seen.add(d)
                        out.write(frame := pack.compress(data))
                        own.append({"digest": d, "no": no, "pack": name, "at": at, "size": len(frame)})
                        at += len(frame)
                    x = y
                for cell, v in zip(cells, (row, ends[-1] - lo, leaf(doc, digests), digests, own)):
                    cell.append(v)
                row += 1
            types = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.struct({"digest": pa.binary(), "no": pa.int32(), "pack": pa.string(), "at": pa.int64(), "size": pa.int64()})))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cells, types))], ["doc_id", "row", "n_tokens", "leaf", "chunks", "own"])
            if len(seen) > 4_000_000:
                seen.clear()
        if out:
            out.close()

    text_rows(docs).mapInArrow(encode, _STAGE).write.parquet(f"{folder}/stage")
    stage = spark.read.schema(_STAGE).parquet(f"{folder}/stage")
    stage.select("doc_id", "row", "n_tokens", "leaf", "chunks").repartitionByRange(n, "doc_id", "row").sortWithinPartitions("doc_id", "row").withColumn("part", F.spark_partition_id()).write.parquet(f"{folder}/recipes")
    every = stage.select("doc_id", "row", F.explode("own").alias("o")).select("o.digest", F.struct("doc_id", "row", "o.no", "o.pack", "o.at", "o.size").alias("place"))
    owners = every.groupBy("digest").agg(F.min("place").alias("place")).select("digest", "place.*")

    def join_packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, at = uuid.uuid4().hex, None, 0
        for b in batches:
            out = out or create(f"{folder}/packs/{name}")
            digests, packs, ats, sizes = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("digest", "pack", "at", "size"))
            places = [(f"{folder}/first/{p}", x, s) for p, x, s in zip(packs, ats, sizes)]
            starts = []
            for lo in range(0, len(places), 4000):
                data = fetched(places[lo : lo + 4000])
                for p in places[lo : lo + 4000]:
                    out.write(data[p])
                    starts.append(at)
                    at += p[2]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([name] * len(digests)), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], ["digest", "pack", "at", "size"])
        if out:
            out.close()

    owners.repartitionByRange(n, "doc_id", "row").sortWithinPartitions("doc_id", "row", "no").mapInArrow(join_packs, _INDEX).write.parquet(f"{folder}/index")
    store = Store(spark, folder, width, n)
    swept(f"{folder}/packs", {r["pack"] for r in store.table("index").select("pack").distinct().toLocalIterator()})
    swept(f"{folder}/first", set())
    roots(store).write.parquet(f"{folder}/manifest")
    return store


def roots(store: Store) -> DataFrame:
    """part, documents, ids and Merkle root of the recipes of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves: dict[int, list[bytes]] = {}
        sums: dict[int, int] = {}
        for b in batches:  # a task has few parts, and of each 16 bytes a document
            for part, n, x in zip(*(b.column(i).to_pylist() for i in range(3))):
                leaves.setdefault(part, []).append(x)
                sums[part] = sums.get(part, 0) + n
        if leaves:
            yield pa.RecordBatch.from_arrays([pa.array(list(leaves), pa.int32()), pa.array([len(x) for x in leaves.values()], pa.int64()), pa.array(list(sums.values()), pa.int64()), pa.array([merkle(x) for x in leaves.values()], pa.binary())], ["part", "n_docs", "n_ids", "root"])

    return store.table("recipes").select("part", "n_tokens", "leaf", "doc_id", "row").repartition(store.parts, "part").sortWithinPartitions("part", "doc_id", "row").mapInArrow(run, "part int, n_docs long, n_ids long, root binary")


def root_of(store: Store) -> str:
    """Checks the recipes against the manifest; the root over all parts, of which there are as many as partitions."""
    told, now = ({r["part"]: bytes(r["root"]) for r in t.collect()} for t in (store.table("manifest"), roots(store)))
    if told != now:
        raise ValueError("the recipes do not have the manifest's roots")
    return merkle([told[k] for k in sorted(told)]).hex()


_READ = "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long"


def read_store(store: Store, with_ids: bool = False) -> DataFrame:
    """Every document from the files: its place in the stream of all ids, number of ids and their checksum (and the ids)."""
    folder, kind = store.folder, np.uint16 if store.width == 2 else np.uint32
    chunks = store.table("recipes").select("part", "doc_id", "row", "leaf", F.posexplode("chunks").alias("no", "digest"))
    where = chunks.join(store.table("index"), "digest").select("part", "doc_id", "row", "no", "leaf", "digest", "pack", "at", "size")
    dealt = where.repartition(store.parts, "part").sortWithinPartitions("part", "doc_id", "row", "no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        now, held, digests, start, part_now = None, [], [], 0, None
        done: list[tuple] = []

        def close() -> None:
            nonlocal start, part_now
            if now is None:
                return
            part, doc, _, told = now
            if leaf(doc, digests) != told:
                raise ValueError(f"document {doc} does not match its recipe")
            ids = np.frombuffer(b"".join(held), kind).astype("<u4")
            start = start if part == part_now else 0
            part_now = part
            done.append((doc, part, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes() if with_ids else None))
            start += len(ids)

        def out() -> pa.RecordBatch:
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())[: 5 + with_ids]
            batch = pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], [x.split()[0] for x in _READ.split(", ")] + ["ids"] * with_ids)
            done.clear()
            return batch

        for b in batches:
            rows = list(zip(*(b.column(i).to_pylist() for i in range(9))))
            for lo in range(0, len(rows), 2000):
                data = fetched([(f"{folder}/packs/{r[6]}", r[7], r[8]) for r in rows[lo : lo + 2000]])
                for part, doc, row, _, told, digest, pack, at, size in rows[lo : lo + 2000]:
                    if now is None or now[2] != row:
                        close()
                        now, held, digests = (part, doc, row, told), [], []
                    ids = unpack.decompress(data[f"{folder}/packs/{pack}", at, size])
                    if address(ids) != digest:
                        raise ValueError(f"a chunk of document {doc} does not have its digest")
                    held.append(ids)
                    digests.append(digest)
                yield out()
        close()
        yield out()

    dealt.mapInArrow(run, _READ + ", ids binary" * with_ids).write.parquet(target := new_dir(store.spark, "read"))
    read = store.spark.read.parquet(target)
    # one row for each part, as many as partitions: their sums are added up here
    sums, before, total = read.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect(), [], 0
    for r in sorted(sums, key=lambda r: r["part"]):
        before.append((r["part"], total))
        total += r["n"]
    offsets = F.broadcast(store.spark.createDataFrame(before, "part int, before long"))
    return read.join(offsets, "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
