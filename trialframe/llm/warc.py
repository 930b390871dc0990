"""WARC archives with an index that is written first and read first.

Writing makes one archive for each task, of records that are gzip members of their own, and
the index: file, offset, length, URL and digest of each record. Of pages with equal
payloads the smallest page_id has the response, the others are revisits without a payload.
Reading selects records in the index, sorts their byte ranges, joins near ones to one read
and parses the records; payloads are checked against their digests.

An archive counts only if its task committed its index rows; files of lost attempts are
swept. Defined cases: a null html is an empty payload, a null url an empty URI; a null
page_id is a revisit if its payload has another page, else a response; rows that repeat a
page_id and its payload are each a response where the first is; an empty table gives an
empty archive and index; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_dir, slices
from .files import create, fetched, swept

INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
END = b"\r\n"


def record(page_id, url: str, payload: bytes, refers_to) -> tuple[bytes, str]:
    """A record as a gzip member, and its payload's digest."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    name = "" if page_id is None else page_id
    block = payload if refers_to is None else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + END + END + block + END + END) + pack.flush(), digest


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, lower-cased, and block of a record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(END + END)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, rest[: int(fields["content-length"])]


def write_archives(pages: DataFrame, least_bytes: int = 0) -> tuple[str, DataFrame]:
    """Writes ``pages`` (page_id, url, html); the archive folder and the index. Payloads under ``least_bytes`` bytes are never revisits."""
    spark = pages.sparkSession
    folder = new_dir(spark, "archive")
    clean = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "[\r\n]", "%0A")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), clean("url").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("html", 256)))
    # only digests and ids are grouped and joined by payload; the html moves once, by page
    small = rows.filter(F.octet_length("html") >= least_bytes).select("page_id", "sha")
    groups = small.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select(F.col("sha").alias("s"), "first")
    again = small.join(groups, F.col("sha") == F.col("s")).filter("page_id is null or page_id <> first").select(F.col("page_id").alias("p"), "s", F.col("first").alias("refers_to")).distinct()
    dealt = rows.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s")), "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for b in slices(batches, "html"):
            if out is None:
                out = create(f"{folder}/{name}")
            cells = []
            for page, url, html, refers in zip(*(b.column(i).to_pylist() for i in range(4))):
                member, digest = record(page, url, html.encode(), refers)
                out.write(member)
                cells.append((name, at, len(member), page, url, digest, "response" if refers is None else "revisit"))
                at += len(member)
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in cells], t) for i, t in enumerate(types)], [x.split()[0] for x in INDEX.split(", ")])
        if out is not None:
            out.close()

    index = f"{folder}.index"
    dealt.mapInArrow(run, INDEX).write.parquet(index)
    found = spark.read.schema(INDEX).parquet(index)
    swept(folder, {r["file"] for r in found.select("file").distinct().toLocalIterator()})
    return folder, found


def read_records(spark: SparkSession, folder: str, index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records that ``index`` (all or some of its rows) selects, from the archives in ``folder``."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a file's records may be more than a task should read: ranges of 64 MB are dealt
    dealt = index.select("file", "offset", "length").withColumn("part", F.floor(F.col("offset") / (64 << 20))).repartition(n, "file", "part").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = list(zip(*(b.column(i).to_pylist() for i in range(3))))
            at = 0
            while at < len(places):
                to, size = at, 0
                while to < len(places) and (to == at or size + places[to][2] <= 16 << 20):
                    size += places[to][2]
                    to += 1
                data = fetched([(f"{folder}/{f}", o, m) for f, o, m in places[at:to]])
                cells = []
                for f, o, m in places[at:to]:
                    head, payload = parsed(data[f"{folder}/{f}", o, m])
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    if head["warc-type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{f} at {o}: the payload does not have the digest {digest}")
                    number = lambda k: int(v) if (v := head.get(k, "")[10:-1]) else None
                    cells.append((number("warc-record-id"), int(head["x-payload-length"]) if head["warc-type"] == "revisit" else len(payload), digest, head["warc-type"], number("warc-refers-to"), head.get("warc-target-uri", ""), payload if with_payload else None))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())[: 6 + with_payload]
                yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in cells], t) for i, t in enumerate(types)], [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * with_payload)
                at = to

    return dealt.mapInArrow(run, RECORDS + ", payload binary" * with_payload)
