import base64
import gzip
import hashlib
import io
import uuid

import pyarrow.fs as pafs

from filingforge.llm import warc
from filingforge.llm.common import shared_dir

ROWS = [(1, "http://a/1", "same"), (2, None, "same"), (3, "http://a/3\nx", "same"), (4, "http://b", None), (5, "http://b", ""), (6, "u", "é" * 50_000), (7, "u", "tiny"), (8, "u", "tiny"), (3, "http://a/3", "same"), (None, "u", "same"), (None, "u", "alone")]


def brute(rows, min_bytes):
    out = []
    for key, _, html in rows:
        data = (html or "").encode()
        keys = [k for k, _, h in rows if (h or "").encode() == data and k is not None]
        top = max(keys, default=None)
        revisit = len(data) >= min_bytes and top is not None and (key is None or key < top)
        out.append((key, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    frame = spark.createDataFrame([(*r, "z", "z") for r in ROWS], "page_id long, url string, html string, digest string, size string").repartition(3)
    for min_bytes, limit in ((0, 64 << 20), (5, 300)):
        folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
        manifest = warc.write_archives(frame, folder, min_bytes=min_bytes, archive_bytes=limit)
        got = [tuple(r) for r in warc.read_archives(manifest).collect()]
        assert sorted(got, key=str) == brute(ROWS, min_bytes)
        system, path = pafs.FileSystem.from_uri(manifest.first().file)
        with system.open_input_stream(path, compression=None) as raw:
            assert gzip.decompress(raw.read()).startswith(b"WARC/1.1\r\nWARC-Type: ")
    assert warc.read_archives(warc.write_archives(frame.limit(0), folder + "-none")).count() == 0


def test_records():
    record = warc.response_record(9, "http://x", b"payload", "2020-01-01T00:00:00Z", None) + warc.response_record(8, "http://y", b"payload", "2020-01-01T00:00:00Z", 9)
    (a, block), (b, short) = warc.read_records(io.BytesIO(record))
    assert block.endswith(b"\r\n\r\npayload") and short.endswith(b"\r\n\r\n") and a["warc-payload-digest"] == b["warc-payload-digest"]
    assert b["warc-refers-to"] == a["warc-record-id"] and b["warc-profile"].endswith("identical-payload-digest")


def test_each_archive_has_a_task_of_its_own(spark):
    frame = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(120)], "page_id long, url string, html string").repartition(4)
    manifest = warc.write_archives(frame, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}", archive_bytes=2000)
    found = warc.read_archives(manifest)
    archives, sizes = manifest.count(), [len(x) for x in found.rdd.glom().collect()]
    assert archives > 20 and len(sizes) == archives and min(sizes) > 0 and sum(sizes) == 120
    assert warc.filesystem("file:///tmp")[1] == "/tmp"
