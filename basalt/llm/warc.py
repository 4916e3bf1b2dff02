"""WARC archives with a two-level capture index.

Archives are written by Spark's own text writer, so that its commit protocol covers lost executors and
any file system that Spark reaches: a line is the gzip member of one record, and what ends a line is an
empty gzip member. Any WARC reader takes the files.

The capture index is sorted by reversed-host URL keys and cut into compressed blocks. A sparse directory
holds the first key of each block. A lookup searches the directory by bisection, opens the blocks that
may hold the key, bisects again inside, and reads the records' ranges out of the archives. Ranges are read
where a file system library reaches the store; elsewhere archives are shuffled whole to the captures they serve.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import islice
from typing import BinaryIO
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.common import materialise, scratch

#: Records of an archive file and captures of an index block, at most.
FILE_RECORDS, BLOCK_CAPTURES = 10_000, 512
#: Blocks up to which the directory is broadcast; a larger one is met by a join instead.
DIRECTORY_BLOCKS, DIRECTORY_BYTES = 500_000, 64 << 20
DATE = "1970-01-01T00:00:00Z"
#: Bytes of an archive read at a time, and captures told at a time.
SPAN, INDEXED = 1 << 14, 4096


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


#: An empty gzip member with plain header fields.
EMPTY = bytes((31, 139, 8, 0, 0, 0, 0, 0, 0, 255, 3, 0)) + bytes(8)


def url_key(url: str | None) -> str:
    """The sort key of a URL: host parts in reverse order, port, path and query; no scheme, user or fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url if "://" in url else f"//{url}")
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return f"){url}"
    port = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{sha1}')}>"


def build(page_id: int | None, url: str | None, payload: bytes, first: int | None, date: str = DATE) -> bytes:
    """A record: a response, or with `first` (another page's id) a revisit of that page's payload, which isn't stored again."""
    sha1 = digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, sha1)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{sha1}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='!#$&%()*+,/:;=?@[]~-._' + chr(39))}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(first, sha1)}", f"X-Refers-To-Page: {first}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> dict:
    """Fields of a record: headers by lower-case name, payload (None for a revisit) and payload_bytes."""
    head, found, rest = record.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = headers["warc-type"] == "revisit"
    size = int(re.search(rb"\r\ncontent-length: *(\d+)", http, re.I)[1])
    if not revisit and (len(payload) != size or f"sha1:{digest(payload)}" != headers["warc-payload-digest"]):
        raise ValueError("the payload doesn't have its digest")
    return {"headers": headers, "payload": None if revisit else payload, "payload_bytes": size}


def members(file: BinaryIO, span: int = SPAN) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member that isn't empty. Of the file only `span` bytes and a record are held."""
    at, data = 0, file.read(span)
    while data:
        z, end, out = zlib.decompressobj(31), at, []
        while not z.eof:
            if not data:
                raise ValueError("an archive ends within a record")
            out.append(z.decompress(data))
            end += len(data) - len(z.unused_data)
            data = z.unused_data if z.eof else file.read(span)
        if any(out):
            yield at, end - at, b"".join(out)
        at, data = end, data or file.read(span)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record for every page. Of equal payloads of at least min_bytes, the smallest page_id's is the response.

    Null html: an empty payload. Null ids: never the smallest; if all ids of a group are null, all are
    responses. Repeated rows: each is written; all with the smallest id are responses. Empty table: no
    records. Only digests are grouped, so a hot payload doesn't gather.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    shared = rows.where(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([gzip_member(build(r["page_id"], r["url"], r["payload"], r["first"])) for r in part], pa.binary())], names=["record"])

    first = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first")
    records = rows.join(shared, ["sha", "size"], "left").select("page_id", "url", "payload", first).mapInArrow(run, "record binary")
    writer = records.select(F.col("record").cast("string").alias("value")).write.option("maxRecordsPerFile", FILE_RECORDS)
    writer.option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1")).text(path)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """path, content: whole files, of 2 GB at most."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system library's view of a path as Spark writes it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if ":" in path.split("/")[0] else f"file://{path}")


def reachable(path: str) -> bool:
    """Does the library know the store? A fault while reading is no reason to read in another way."""
    try:
        found, root = store(path)
        return found.get_file_info(root).type == fs.FileType.Directory
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def inside(root: str, path: str) -> str:
    """The place in the store of a file of the folder `root`, by the path that Spark gives it."""
    return f"{root}/{unquote(path.rsplit('/', 1)[-1])}"


def write_index(spark: SparkSession, archive_path: str, index_path: str) -> None:
    """Scan the archives and write the index: block (in key order), first_key, last_key, captures, data (compressed lines).

    A task reads an archive of any size as a stream and holds a record at a time. Where the store isn't reachable but for
    Spark, files come whole, of 2 GB at most. Equal captures are as many rows. No records: an empty index.
    """
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
    streamed = reachable(archive_path)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(archive_path) if streamed else (None, None)
        for batch in batches:
            for k, path in enumerate(batch.column(0).to_pylist()):
                with files.open_input_stream(inside(root, path), buffer_size=1 << 20) if streamed else pa.BufferReader(batch.column(1)[k].as_buffer()) as file:
                    records = members(file)
                    while rows := [(url_key((h := parse(x)["headers"]).get("warc-target-uri")), h["warc-record-id"], path, at, n) for at, n, x in islice(records, INDEXED)]:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "record_id", "path", "start", "length"])

    found = archives(spark, archive_path)
    if streamed:  # paths alone, of which the reader deals out as many to a task as it would files
        found = found.select("path")
    captures = materialise(found.mapInArrow(scan, "key string, record_id string, path string, start bigint, length bigint"), "captures")

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []

        def out(rows: list) -> pa.RecordBatch:
            nonlocal number
            number += 1
            data = zlib.compress("\n".join(json.dumps(r) for r in rows).encode())
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([rows[0][0]]), pa.array([rows[-1][0]]), pa.array([len(rows)]), pa.array([data], pa.binary())], names=["block", "first_key", "last_key", "captures", "data"])

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(held) >= BLOCK_CAPTURES:
                yield out(held[:BLOCK_CAPTURES])
                held = held[BLOCK_CAPTURES:]
        if held:
            yield out(held)

    order = ["key", "path", "start"]
    ordered = captures.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(block, "block bigint, first_key string, last_key string, captures bigint, data binary").write.parquet(index_path)


def lookup(keys: DataFrame, index_path: str, directory_blocks: int = DIRECTORY_BLOCKS) -> DataFrame:
    """key, record_id, path, start, length of every capture of the keys (key).

    Null keys find nothing; the empty key finds records without a URL. Repeated keys count once. Captures of equal
    keys all come. No keys, or an empty index: no rows. Other columns are dropped. The directory is broadcast up to
    `directory_blocks` blocks and DIRECTORY_BYTES of keys; beyond, keys meet the keys of all blocks by a join.
    """
    spark = keys.sparkSession
    index = spark.read.parquet(index_path)
    keys = keys.select("key").where("key is not null").distinct()
    blocks, size = index.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("first_key") + F.octet_length("last_key")), F.lit(0))).first()
    if blocks <= directory_blocks and size <= DIRECTORY_BYTES:
        directory = sorted((r[0], r[1], r[2]) for r in index.select("first_key", "last_key", "block").collect())
        shared = spark.sparkContext.broadcast(directory)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            firsts, lasts = [x[0] for x in shared.value], [x[1] for x in shared.value]
            for batch in batches:
                out = [(key, shared.value[b][2]) for key in batch.column(0).to_pylist() for b in range(bisect_left(lasts, key), bisect_right(firsts, key))]
                k, b = zip(*out, strict=True) if out else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(b, pa.int64())], names=["key", "block"])

        asked = keys.mapInArrow(search, "key string, block bigint")
    else:  # every block tells the keys it holds, and keys meet them by a join
        def holds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    own = sorted({json.loads(x)[0] for x in zlib.decompress(data).decode().split("\n")})
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([number] * len(own), pa.int64())], names=["key", "block"])

        asked = keys.join(index.select("block", "data").mapInArrow(holds, "key string, block bigint"), "key")

    def open_block(table: pa.Table, blocks: pa.Table) -> pa.Table:
        lines = [json.loads(x) for x in zlib.decompress(blocks.column("data")[0].as_py()).decode().split("\n")] if len(blocks) else []
        own = [x[0] for x in lines]
        found = [lines[k] for key in table.column("key").to_pylist() for k in range(bisect_left(own, key), bisect_right(own, key))]
        columns = list(zip(*found, strict=True)) or [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "record_id", "path", "start", "length"])

    return asked.groupBy("block").cogroup(index.select("block", "data").groupBy("block")).applyInArrow(open_block, "key string, record_id string, path string, start bigint, length bigint")


#: Records read at a time.
READ_RECORDS = 256


RECORD_SCHEMA = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_records(captures: DataFrame, archive_path: str, payloads: bool = True) -> DataFrame:
    """The records at captures (path, start, length): see RECORD_SCHEMA; payload is null for revisits.

    A capture given twice is read twice. Null ids and URLs of records come back null. No captures: no rows. Other
    columns are dropped. Captures are dealt out by place, so that a task reads neighbouring ranges of few files.
    """

    def table_of(records: list[bytes]) -> pa.RecordBatch:
        out = []
        for record in records:
            r = parse(record)
            h = r["headers"]
            number = lambda name: int(h[name]) if name in h else None  # noqa: E731, B023
            out.append((number("x-page-id"), h.get("warc-target-uri"), r["payload"] if payloads else None, r["payload_bytes"], h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], number("x-refers-to-page")))
        kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
        columns = list(zip(*out, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in RECORD_SCHEMA.split(", ")])

    if reachable(archive_path):

        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = store(archive_path)
            name, file = None, None
            for batch in batches:
                for k in range(0, batch.num_rows, READ_RECORDS):
                    part, records = batch.slice(k, READ_RECORDS), []
                    for path, at, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
                        if path != name:
                            if file:
                                file.close()
                            name, file = path, fs.open_input_file(inside(root, path))
                        records.append(zlib.decompress(file.read_at(n, at), 31))
                    yield table_of(records)
            if file:
                file.close()

        place = ["path", "start", "length"]
        return captures.select(*place).repartitionByRange("path", "start").sortWithinPartitions("path", "start").mapInArrow(ranges, RECORD_SCHEMA)

    def read(table: pa.Table, files: pa.Table) -> pa.Table:
        view = memoryview(files.column("content")[0].as_buffer()) if len(files) else b""
        places = zip(table.column("start").to_pylist(), table.column("length").to_pylist(), strict=True) if len(files) else ()
        return pa.Table.from_batches([table_of([zlib.decompress(view[at : at + n], 31) for at, n in places])])

    return captures.groupBy("path").cogroup(archives(captures.sparkSession, archive_path).groupBy("path")).applyInArrow(read, RECORD_SCHEMA)


def keys_of(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """key: the index key of each page's URL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = (x if x is None else quote(x, safe="!#$&%()*+,/:;=?@[]~-._" + chr(39)) for x in batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([url_key(x) for x in urls], pa.string())], names=["key"])

    return pages.select(F.col(url_col).alias("url")).mapInArrow(run, "key string")


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """Write, index, look every page's key up, and read the records found."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archive_path, index_path = scratch(spark, "warc"), scratch(spark, "captures")
    write_archives(pages, archive_path)
    write_index(spark, archive_path, index_path)
    found = lookup(keys_of(pages), index_path)
    return read_records(found, archive_path, payloads=False).drop("payload", "url")


OP1_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), f AS (
  SELECT body, min(page_id) AS first FROM p GROUP BY body HAVING count(*) > 1
), d AS (
  SELECT p.page_id, CAST(octet_length(encode(p.body)) AS BIGINT) AS payload_bytes, sha1(p.body) AS h,
    CASE WHEN f.first IS NOT NULL AND p.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
  FROM p LEFT JOIN f ON p.body = f.body
), g AS (
  SELECT *, lower(substr(h, CAST(10 * i + 1 AS INT), 10)) AS part, i FROM d, range(4) r(i)
), v AS (
  SELECT *, CAST('0x' || part AS BIGINT) AS n FROM g
), b AS (
  SELECT page_id, payload_bytes, refers_to, h, i,
    list_aggregate(list_transform(range(8), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((n >> (35 - 5 * k)) & 31 AS INT) + 1, 1)), 'string_agg', '') AS s
  FROM v
)
SELECT page_id, payload_bytes, string_agg(s, '' ORDER BY i) AS payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM b GROUP BY page_id, payload_bytes, refers_to, h
"""
