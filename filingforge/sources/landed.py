"""Responses that a crawler has landed, as a table and as a stream; and one file a filing, as a sink.

A landing folder holds a folder a day (YYYY-MM-DD) with one file a response: its status line, headers and body, as HTTP/1.1
writes them. Names within a day rise as responses land, so a day and a name say how far a reader has come. Batch and stream
read files by the same code, so their rows are equal, also where a stream starts again from its checkpoint.

spark.dataSource.register(LandedSource); spark.read.format("landed").load(folder). Options: prefix_bytes (as much of each body
and no more is read; default all), partition_bytes (files are dealt to tasks by their bytes), first_day, last_day (days
outside are not listed), push_filters (true: filters on day reach the listing by themselves; for sessions in which
spark.sql.python.filterPushdown.enabled is true). Files are read by ranges, each tried again
where reading fails, from the byte that was reached.

FilingSource writes a row's content to a file named by its key: spark.dataSource.register(FilingSource);
df.write.format("filings").option("path", folder).mode("append").save(), with columns name and content. Tasks write to folders
of their own; the driver renames those of tasks that ended well, one rename a task, and drops all others, so a task that failed,
was killed or ran twice leaves no file.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "day string, name string, url string, status int, fetched_at timestamp, content_type string, body_bytes long, body string"
#: Bytes of a range and tries of each; bytes of headers at most.
RANGE, TRIES, HEAD = 1 << 20, 3, 1 << 16
DAY = re.compile(r"\d{4}-\d{2}-\d{2}")


@dataclass
class Files(InputPartition):
    """Files of one task: (day, name, size)."""

    files: tuple[tuple[str, str, int], ...]


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address."""
    if "://" not in path and not path.startswith("/"):
        path = re.sub(r"^file:/*", "/", path)
    return pafs.FileSystem.from_uri(path)


def listed(path: str, wanted: Callable[[str], bool], after: tuple[str, str] = ("", ""), until: tuple[str, str] | None = None) -> list[tuple[str, str, int]]:
    """Landed files in order, of wanted days alone: behind `after`, up to `until`. Files that begin with . or _ aren't landed yet."""
    system, root = filesystem(path)
    days = sorted(x.base_name for x in system.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if x.type == pafs.FileType.Directory and DAY.fullmatch(x.base_name))
    out = []
    for day in days:
        if wanted(day) and day >= after[0] and (until is None or day <= until[0]):
            for x in system.get_file_info(pafs.FileSelector(f"{root}/{day}")):
                if x.type == pafs.FileType.File and x.base_name[0] not in "._" and (day, x.base_name) > after and (until is None or (day, x.base_name) <= until):
                    out.append((day, x.base_name, x.size))
    return sorted(out)


def dealt(files: Sequence[tuple[str, str, int]], most: int) -> list[Files]:
    """Files in order, by tasks of about `most` bytes."""
    out, part, size = [], [], 0
    for f in files:
        if part and size + f[2] > most:
            out.append(Files(tuple(part)))
            part, size = [], 0
        part.append(f)
        size += f[2]
    return [*out, Files(tuple(part))] if part else out


def read_ranges(read: Callable[[int, int], bytes], most: int, *, step: int = RANGE, tries: int = TRIES) -> bytes:
    """Up to `most` bytes by ranges; a range that fails is tried again from the byte that was reached."""
    out = bytearray()
    failed = 0
    while len(out) < most:
        try:
            got = read(len(out), min(step, most - len(out)))
        except OSError:
            failed += 1
            if failed >= tries:
                raise
            continue
        failed = 0
        if not got:
            break
        out += got
    return bytes(out)


def response(day: str, name: str, raw: bytes, size: int, prefix: int | None) -> tuple:
    """The row of a file's bytes; a file that is no response has no status."""
    head, found, body = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("latin-1").split("\r\n")
    status = re.fullmatch(r"HTTP/1\.[01] (\d{3})(?: .*)?", first)
    if not found or not status:
        return day, name, None, None, None, None, size, None
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    total = size - len(head) - 4
    body = body if prefix is None else body[:prefix]
    text = body.decode("utf-8", errors="ignore")
    try:
        at = datetime.fromisoformat(headers["date"]) if "date" in headers else None
    except ValueError:
        at = None
    return day, name, headers.get("content-location"), int(status[1]), at, headers.get("content-type"), total, text


class Landed:
    """What batch and stream readers share."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.prefix = int(options["prefix_bytes"]) if "prefix_bytes" in options else None
        self.most = int(options.get("partition_bytes", 64 << 20))
        self.first, self.last = options.get("first_day", ""), options.get("last_day", "9999-99-99")
        self.tests: list[tuple[str, str]] = []

    def wanted(self, day: str) -> bool:
        compare = {"=": day.__eq__, ">": day.__gt__, ">=": day.__ge__, "<": day.__lt__, "<=": day.__le__}
        return self.first <= day <= self.last and all(compare[op](value) for op, value in self.tests)

    def rows(self, partition: Files) -> Iterator[tuple]:
        system, root = filesystem(self.path)
        for day, name, size in partition.files:
            most = size if self.prefix is None else min(size, HEAD + self.prefix)

            def read(at: int, n: int, file: str = f"{root}/{day}/{name}") -> bytes:
                with system.open_input_file(file) as source:
                    return source.read_at(n, at)

            yield response(day, name, read_ranges(read, most), size, self.prefix)


class LandedReader(Landed, DataSourceReader):
    """All files of the wanted days."""

    def partitions(self) -> list[Files]:
        return dealt(listed(self.path, self.wanted), self.most) or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.rows(partition)


class PushedReader(LandedReader):
    """The same, where the session lets filters reach Python sources."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        kinds = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in kinds and f.attribute == ("day",):
                self.tests.append((kinds[type(f)], f.value))
            yield f  # Spark checks the rows as well


class LandedStream(Landed, DataSourceStreamReader):
    """Files as they land; an offset is the last file's day and name."""

    def initialOffset(self) -> dict:
        return {"day": "", "name": ""}

    def latestOffset(self) -> dict:
        last = listed(self.path, self.wanted)[-1:]
        return {"day": last[0][0], "name": last[0][1]} if last else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return dealt(listed(self.path, self.wanted, (start["day"], start["name"]), (end["day"], end["name"])), self.most)

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing is held: files stay where they landed."""


class LandedSource(DataSource):
    """Landed responses."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> LandedReader:
        return PushedReader(self.options) if self.options.get("push_filters", "") == "true" else LandedReader(self.options)

    def streamReader(self, schema: object) -> LandedStream:
        return LandedStream(self.options)


@dataclass
class Written(WriterCommitMessage):
    """A task's folder and its files."""

    folder: str
    files: int


class FilingWriter(DataSourceWriter):
    """One file a row below a folder of the task; see the module."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.suffix = options.get("suffix", ".html")
        self.run = uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        system, root = filesystem(self.path)
        number = TaskContext.get().partitionId()
        folder = f"_writing-{self.run}/{number:06d}-{uuid.uuid4().hex[:8]}"
        system.create_dir(f"{root}/{folder}", recursive=True)
        count = 0
        try:
            for row in rows:
                with system.open_output_stream(f"{root}/{folder}/{file_name(row['name'])}{self.suffix}", compression=None) as sink:
                    sink.write((row["content"] or "").encode())
                count += 1
        except BaseException:
            system.delete_dir(f"{root}/{folder}")
            raise
        return Written(folder, count)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = filesystem(self.path)
        for m in messages:
            if m is not None and m.files:
                system.move(f"{root}/{m.folder}", f"{root}/part-{self.run[:8]}-{m.folder.rpartition('/')[2][:6]}")
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        system, root = filesystem(self.path)
        if system.get_file_info(f"{root}/_writing-{self.run}").type != pafs.FileType.NotFound:
            system.delete_dir(f"{root}/_writing-{self.run}")


class FilingSource(DataSource):
    """One file a filing."""

    @classmethod
    def name(cls) -> str:
        return "filings"

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema: object, overwrite: bool) -> FilingWriter:
        if overwrite:
            raise ValueError("filings are added; they can't be overwritten")
        return FilingWriter(self.options)


def file_name(name: str | None) -> str:
    """A name that any file system takes, different for different names."""
    return re.sub(r"[^A-Za-z0-9-]", lambda m: "_" + m[0].encode().hex() + "_", name) if name else "_"


def escaped(text: Column) -> Column:
    """Text as content of a page; null is empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def score_page(title: Column, rows: Column) -> Column:
    """A filing's page: a heading, and a table of rows (array<struct<label, value, band>>)."""
    line = lambda r: F.concat(F.lit("<tr><th>"), escaped(r["label"]), F.lit("</th><td>"), escaped(r["value"]), F.lit('</td><td class="'), escaped(r["band"]), F.lit('">'), escaped(r["band"]), F.lit("</td></tr>"))
    return F.concat(F.lit("<!DOCTYPE html><html><head><title>"), escaped(title), F.lit("</title></head><body><h1>"), escaped(title), F.lit("</h1><table>"), F.array_join(F.transform(rows, line), ""), F.lit("</table></body></html>"))


def write_pages(pages: DataFrame, path: str, *, name: str, content: Column, suffix: str = ".html") -> None:
    """One file a filing; of rows that share a name the one whose content comes first is written."""
    spark = pages.sparkSession
    spark.dataSource.register(FilingSource)
    rows = pages.select(F.col(name).cast("string").alias("name"), content.alias("content")).groupBy("name").agg(F.min("content").alias("content"))
    rows.write.format("filings").option("path", path).option("suffix", suffix).mode("append").save()
