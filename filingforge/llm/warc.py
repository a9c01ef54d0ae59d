"""WARC archives with revisit resolution.

Headers (key, payload digest and size) are shuffled by digest, pre-aggregated to one row a digest; the revisits found
there are joined back to their rows by key and digest, so that payloads move once, by an even key. Each task then
writes gzipped archives of bounded size with fresh headers into the shared folder, and a manifest names the files of
the tasks that succeeded; what a lost task left behind is in no manifest and is never read. Archives are read back by as
many tasks as there are archives, one each. The folder is one that pyarrow's file systems open: a local or mounted path,
file, hdfs, s3 (s3a is taken for it), gs or abfs; others are an error.

A record's id is made of its key and payload digest, so that a revisit can name its response; where rows repeat both, or
have no key, the writing task and a count are added, and each id stays unique (a revisit of a payload whose largest key
repeats names key and digest alone). All records carry the time of the write.

Defined results: a null payload is empty; a very long payload is one record, in an archive of its own if need be; rows
that repeat the largest key of their payload are all responses; a row of null key revisits the largest key, and is a
response where its payload has no key at all; a null URL is written as about:blank; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingforge.operators.validation import ranked

from .common import arrow_schema, scratch, staged

#: Uncompressed bytes after which the next record starts a new archive.
ARCHIVE_BYTES = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONTROL = re.compile(r"[\x00-\x20\x7f]")


def filesystem(address: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address, and the path there."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", address))


def sha1_base32(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1, without a prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int | None, digest: str, place: str = "") -> str:
    """Of key and payload; place tells records apart that share both."""
    return f"<urn:x-page:{'null' if key is None else key}:{digest}{place and ':' + place}>"


def key_of(name: str) -> int | None:
    value = name.removeprefix("<urn:x-page:").partition(":")[0]
    return None if value == "null" else int(value)


def response_record(key: int | None, url: str | None, payload: bytes, date: str, refers_to: int | None, place: str = "") -> bytes:
    """A response record, or a revisit of refers_to with the HTTP header alone."""
    digest = sha1_base32(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    uri = CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(key, digest, place)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed archive."""
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not the start of a record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) != b"\r\n":
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        yield headers, block


def find_revisits(pages: DataFrame, key: str, min_bytes: int) -> DataFrame:
    """(key, digest, refers_to, repeats) of the rows that revisit another, or that share key and digest; pages: key, digest, size."""
    distinct = pages.groupBy("digest", key).agg(F.count("*").alias("n"), F.max("size").alias("size"))
    large = distinct.where(F.col("size") >= min_bytes)
    originals = large.groupBy("digest").agg(F.max(key).alias("refers_to"), F.count("*").alias("keys"))
    originals = staged(pages.sparkSession, originals.where((F.col("keys") > 1) & F.col("refers_to").isNotNull()), "warc-originals").drop("keys")
    found = distinct.join(originals, "digest", "left").withColumn("refers_to", F.when((F.col("size") >= min_bytes) & (F.col(key).isNull() | (F.col(key) < F.col("refers_to"))), F.col("refers_to")))
    return found.where(F.col("refers_to").isNotNull() | (F.col("n") > 1)).select(key, "digest", "refers_to", (F.col("n") > 1).alias("repeats"))


def write_archives(pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, date: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the rows as archives into folder; returns the manifest (file, records, bytes), already staged. date: now, if none."""
    spark = pages.sparkSession
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    revisits = find_revisits(rows.select("key", "digest", "size"), "key", min_bytes).withColumnsRenamed({"key": "rkey", "digest": "rdigest"})
    decided = rows.join(revisits, F.col("key").eqNullSafe(F.col("rkey")) & (F.col("digest") == F.col("rdigest")), "left").select("key", "url", "payload", "refers_to", F.coalesce("repeats", F.col("key").isNull()).alias("repeats"))
    schema = "file string, records long, bytes long"
    shape = arrow_schema(schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        task, total = context.partitionId() if context else 0, 0
        stem = f"part-{task:06d}-{uuid.uuid4().hex[:12]}"
        system, root = filesystem(folder)
        system.create_dir(root, recursive=True)
        sink = name = None
        number = records = size = 0

        def finish() -> pa.RecordBatch:
            sink.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records]), pa.array([size])], schema=shape)

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("key", "url", "payload", "refers_to", "repeats")), strict=True):
                total += 1
                record = response_record(row[0].as_py(), row[1].as_py(), row[2].as_py(), date, row[3].as_py(), f"{task}-{total}" if row[4].as_py() else "")
                if sink is not None and size + len(record) > archive_bytes:
                    yield finish()
                    sink = None
                if sink is None:
                    name, number, records, size = f"{folder}/{stem}-{number:05d}.warc.gz", number + 1, 0, 0
                    sink = system.open_output_stream(f"{root}/{name.rpartition('/')[2]}", compression=None)
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)  # a gzip member for each record
                sink.write(packer.compress(record) + packer.flush())
                records, size = records + 1, size + len(record)
        if sink is not None:
            yield finish()

    return staged(spark, decided.mapInArrow(write, schema), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row for each record of the manifest's archives; payloads of responses are checked against their digests."""
    schema = "key long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    shape = arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                system, path = filesystem(name)
                rows = []
                with system.open_input_stream(path, compression=None) as raw, gzip.open(raw) as stream:
                    for headers, block in read_records(stream):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        length = int(re.search(rb"(?i)content-length: *(\d+)", head)[1])
                        if headers["warc-type"] == "response" and (sha1_base32(payload) != digest or len(payload) != length):
                            raise ValueError(f"{name}: {headers['warc-record-id']} has another payload than its digest says")
                        refers = headers.get("warc-refers-to")
                        rows.append((key_of(headers["warc-record-id"]), length, digest, headers["warc-type"], refers and key_of(refers)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), shape.types, strict=True)], schema=shape)

    # File names are few bytes, archives are not: they are numbered, and each number has a task of its own.
    names = ranked(manifest.select("file"), "file")
    return names.repartitionById(max(1, manifest.count()), F.col("rank0").cast("int")).select("file").mapInArrow(read, schema)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back."""
    folder = scratch(spark, "warc")
    if "://" not in folder and not folder.startswith("/"):
        folder = re.sub(r"^file:/*", "/", folder)
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(manifest).withColumnRenamed("key", "page_id")


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x FROM p),
g AS (SELECT x, max(page_id) AS m FROM h GROUP BY x),
bits AS (SELECT x, list_transform(range(0, 40), lambda i: strpos('0123456789abcdef', substr(x, i + 1, 1)) - 1) AS d FROM g),
b32 AS (
  SELECT x, list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * ((d[(5 * k) // 4 + 1] >> (3 - (5 * k) % 4)) & 1) + 8 * ((d[(5 * k + 1) // 4 + 1] >> (3 - (5 * k + 1) % 4)) & 1)
      + 4 * ((d[(5 * k + 2) // 4 + 1] >> (3 - (5 * k + 2) % 4)) & 1) + 2 * ((d[(5 * k + 3) // 4 + 1] >> (3 - (5 * k + 3) % 4)) & 1)
      + ((d[(5 * k + 4) // 4 + 1] >> (3 - (5 * k + 4) % 4)) & 1), 1)), 'string_agg', '') AS digest
  FROM bits
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < m THEN m END AS refers_to
FROM h JOIN g USING (x) JOIN b32 USING (x)
"""
