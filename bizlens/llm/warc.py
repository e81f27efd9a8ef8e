"""WARC archives with a two-level capture index (operator 4).

Writing: every task writes WARC files of its own (one gzip member a record)
into the shared folder and returns where each record lies. Records with equal
payloads of at least ``min_dedup`` bytes are stored once: the smallest page id
is the response, the others are revisits that refer to it.

Index: captures are sorted by their reversed-host URL key over the whole table
and written as compressed blocks of ``block_lines`` lines; each index file ends
in its sparse directory (first key and place of every block). The top level
lists the first and last key of each index file: one row a file, so it is
broadcast. A lookup searches the top level, then the directory, reads one block
by its range, and searches it; records are read by their range.

A file name holds the task attempt, and an index row names the file of the
attempt that returned it, so a repeated task never mixes with a lost one.

Defined results: null html is an empty payload; a null url has the key ``-``.
Rows with equal page ids are separate records; all with the smallest page id
of their payload are responses. A null page id is a revisit where its payload
has a response with an id, else a response. Empty tables give no row. Only
the named columns are read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.llm.shared import read, shared_path, stored

MIN_DEDUP = 100
BLOCK_LINES = 3000
FILE_BYTES = 1 << 30
DATE = "1970-01-01T00:00:00Z"  # the table has no capture time
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _printable(text: str) -> str:
    """Percent-encode blanks and control characters, which would break lines."""
    return re.sub(r"[\x00-\x20\x7f\x85  ]", lambda m: "".join(f"%{x:02X}" for x in m[0].encode()), text)


def surt_key(url: str | None) -> str:
    """``https://User@www.Example.org:8080/A?b#c`` -> ``org,example,www:8080)/a?b``."""
    if url is None:
        return "-"
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url.strip()).partition("#")[0]
    m = re.match(r"[^/?]*", rest)
    host, path = m[0].rpartition("@")[2].lower(), rest[m.end():]
    name, colon, port = host.partition(":")
    if port in ("80", "443"):
        colon = port = ""
    if not path.startswith("/"):
        path = "/" + path
    return _printable(",".join(reversed(name.rstrip(".").split("."))) + colon + port + ")" + path.lower())


def key_of(url: Column) -> Column:
    @F.arrow_udf("string")
    def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            yield pa.array([surt_key(x) for x in col.to_pylist()], pa.string())

    return keys(url)


def record(kind: str, url: str | None, page_id: int | None, payload: bytes, digest: str,
           refers_to: int | None) -> bytes:
    """One WARC record, not compressed. A revisit has the HTTP head but no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}", f"WARC-Record-ID: {record_id(page_id)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_printable(url)}")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, payload) of one record; checks the stated length."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record of {fields.get('WARC-Record-ID')} is cut short")
    return fields, rest[:size].partition(b"\r\n\r\n")[2]


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Output:
    """A file of this task attempt."""

    def __init__(self, folder: str, suffix: str) -> None:
        ctx = TaskContext.get()
        self.system, base = _filesystem(folder)
        self.system.create_dir(base, recursive=True)
        self.stem = f"part-{ctx.partitionId():05d}-{ctx.taskAttemptId()}"
        self.base, self.suffix, self.serial, self.stream, self.at, self.name = base, suffix, 0, None, 0, ""

    def next_file(self) -> None:
        self.close()
        self.name = f"{self.stem}-{self.serial:03d}{self.suffix}"
        self.stream = self.system.open_output_stream(f"{self.base}/{self.name}", compression=None)
        self.at, self.serial = 0, self.serial + 1

    def write(self, data: bytes) -> int:
        at = self.at
        self.stream.write(data)
        self.at += len(data)
        return at

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


@dataclass
class Archive:
    """Where the archives and the index files are, and the top level of the index."""

    folder: str
    index: str
    top: DataFrame  # file, first_key, last_key, at, length


def write_archives(pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", html: str = "html",
                   min_dedup: int = MIN_DEDUP) -> DataFrame:
    """Write one record a page; (key, page_id, file, at, length) of each."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    again = (rows.where(F.octet_length("payload") >= min_dedup).groupBy("digest")
             .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"))
    # AQE splits a payload that many pages share
    marked = rows.join(again, "digest", "left").withColumn(
        "refers_to", F.expr("case when first is not null and not (page_id <=> first) then first end"))
    schema = "url string, page_id long, file string, at long, length long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Output(folder, ".warc.gz")
        for b in batches:
            name, at, length = [], [], []
            urls, ids, payload, digest, refers = (b.column(k) for k in range(5))
            for k in range(b.num_rows):
                if out.stream is None or out.at > FILE_BYTES:
                    out.next_file()
                    info = b"software: bizlens\r\nformat: WARC File Format 1.1\r\n"
                    out.write(_member(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: "
                                      f"{record_id(None)}\r\nContent-Type: application/warc-fields\r\nContent-Length: "
                                      f"{len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n"))
                to = refers[k].as_py()
                data = _member(record("response" if to is None else "revisit", urls[k].as_py(), ids[k].as_py(),
                                      payload[k].as_py(), digest[k].as_py(), to))
                name.append(out.name)
                at.append(out.write(data))
                length.append(len(data))
            yield pa.RecordBatch.from_arrays([urls, ids, pa.array(name, pa.string()), pa.array(at, pa.int64()),
                                              pa.array(length, pa.int64())], ["url", "page_id", "file", "at", "length"])
        out.close()

    done = stored(marked.select("url", "page_id", "payload", "digest", "refers_to").mapInArrow(write, schema), "captures")
    return done.select(key_of(F.col("url")).alias("key"), "page_id", "file", "at", "length")


def write_index(captures: DataFrame, folder: str, *, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the sorted index of (key, page_id, file, at, length); its top level."""
    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "page_id", "file", "at"]
    ranged = captures.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, lines, directory, span = _Output(folder, ".cdx.gz"), [], [], [None, None]

        def flush() -> None:
            if lines:
                data = _member("".join(f"{k} {json.dumps(v)}\n" for k, v in lines).encode())
                directory.append([lines[0][0], out.write(data), len(data)])
                lines.clear()

        for b in batches:
            for key, page_id, file, at, length in zip(*(c.to_pylist() for c in b.columns)):
                if out.stream is None:
                    out.next_file()
                    span[0] = key
                span[1] = key
                lines.append((key, [page_id, file, at, length]))
                if len(lines) == block_lines:
                    flush()
        if out.stream is not None:
            flush()
            data = _member(json.dumps(directory).encode())
            at = out.write(data)
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": out.name, "first_key": span[0], "last_key": span[1], "at": at,
                                               "length": len(data)}])

    top = ranged.select("key", "page_id", "file", "at", "length") \
        .mapInArrow(write, "file string, first_key string, last_key string, at long, length long")
    return stored(top, "top-level")


def write_warc(pages: DataFrame, **options) -> Archive:
    """Archives and index of ``pages`` in the shared folder."""
    spark = pages.sparkSession
    folder, index = shared_path(spark, "warc"), shared_path(spark, "cdx")
    return Archive(folder, index, write_index(write_archives(pages, folder, **options), index))


def lookup(archive: Archive, keys: DataFrame) -> DataFrame:
    """(key, page_id, file, at, length): the captures of each distinct ``key``."""
    spark = keys.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one row an index file, and there are at most as many as shuffle partitions
    top = spark.sparkContext.broadcast([tuple(r) for r in archive.top.orderBy("first_key", "last_key").collect()])
    folder = archive.index

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = top.value
        firsts, lasts = [f[1] for f in files], [f[2] for f in files]
        for b in batches:
            name, key = [], []
            for k in b.column(0).to_pylist():
                for f in range(bisect_left(lasts, k), bisect_right(firsts, k)):
                    name.append(f)
                    key.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.int32()), pa.array(key, pa.string())], ["n", "key"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, stream, directory, firsts, block_at, block = None, None, [], [], None, []
        system, base = _filesystem(folder)
        for b in batches:
            out = []
            for f, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                name, _, _, at, length = top.value[f]
                if name != current:
                    stream = system.open_input_file(f"{base}/{name}")
                    directory = json.loads(gzip.decompress(stream.read_at(length, at)))
                    firsts, current, block_at = [d[0] for d in directory], name, None
                for d in range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key)):
                    if d != block_at:
                        lines = gzip.decompress(stream.read_at(directory[d][2], directory[d][1])).decode().splitlines()
                        block, block_at = [x.partition(" ")[::2] for x in lines], d
                    for k in range(bisect_left(block, key, key=lambda x: x[0]),
                                   bisect_right(block, key, key=lambda x: x[0])):
                        out.append([key, *json.loads(block[k][1])])
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (
                pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["key", "page_id", "file", "at", "length"])

    routed = keys.select("key").distinct().mapInArrow(route, "n int, key string")
    ordered = routed.repartitionByRange(n, "n", "key").sortWithinPartitions("n", "key")
    return ordered.mapInArrow(search, "key string, page_id long, file string, at long, length long")


def fetch(archive: Archive, captures: DataFrame, *, with_payload: bool = False) -> DataFrame:
    """Read records by their range: (page_id, record_type, payload_bytes, payload_digest, refers_to[, payload]).
    A response is measured from its payload, which must fit its stated digest;
    a revisit has the figures it states."""
    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folder = archive.folder

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _filesystem(folder)
        current, stream = None, None
        for b in batches:
            rows = []
            for name, at, length in zip(*(c.to_pylist() for c in b.columns)):
                if name != current:
                    stream, current = system.open_input_file(f"{base}/{name}"), name
                fields, payload = parse(gzip.decompress(stream.read_at(length, at)))
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if fields["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} does not fit its digest")
                page, to = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page")
                rows.append((page and int(page), fields["WARC-Type"], len(payload), digest, to and int(to), payload))
            cols = list(zip(*rows)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in list(zip(cols, kinds))[:5 + with_payload]],
                                             ["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to",
                                              "payload"][:5 + with_payload])

    ordered = captures.select("file", "at", "length").repartitionByRange(n, "file", "at").sortWithinPartitions("file", "at")
    return ordered.mapInArrow(load, "page_id long, record_type string, payload_bytes long, payload_digest string, "
                                    "refers_to long" + ", payload binary" * with_payload)


def resolve(records: DataFrame) -> DataFrame:
    """Give each revisit the payload figures of the response it refers to."""
    done = stored(records, "records")
    source = done.where("record_type = 'response'").groupBy("page_id", "payload_digest") \
        .agg(F.max("payload_bytes").alias("full")) \
        .select(F.col("page_id").alias("refers_to"), F.col("payload_digest"), "full")
    # AQE splits a response that many revisits refer to
    return done.join(source, ["refers_to", "payload_digest"], "left").select(
        "page_id", F.expr("case when record_type = 'revisit' then full else payload_bytes end").alias("payload_bytes"),
        "payload_digest", "record_type", "refers_to")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages, look all their URLs up in the index, and read all records back."""
    pages = read(spark, sf_dir, "pages")
    archive = write_warc(pages)
    captures = lookup(archive, pages.select(key_of(F.col("url")).alias("key")))
    return resolve(fetch(archive, captures))


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
