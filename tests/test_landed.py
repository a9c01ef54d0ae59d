"""Landed responses by batch and stream, and one file a filing."""

import os
import random

import pytest
from pyspark.sql import functions as F

from filingforge.sources import landed


def land(folder, day, name, body, status="200 OK", head="Content-Location: http://x/a?b=1\r\nContent-Type: application/json\r\nDate: 2025-01-02T03:04:05+00:00"):
    os.makedirs(f"{folder}/{day}", exist_ok=True)
    with open(f"{folder}/{day}/{name}", "wb") as file:
        file.write(f"HTTP/1.1 {status}\r\n{head}\r\n\r\n".encode() + body.encode())


@pytest.fixture
def folder(tmp_path, spark):
    spark.dataSource.register(landed.LandedSource)
    path = str(tmp_path / "landed")
    r = random.Random(1)
    for d in range(1, 5):
        for i in range(7):
            land(path, f"2025-01-0{d}", f"{i:04d}", '{"n": %d, "é": "%s"}' % (d * 100 + i, "x" * r.randrange(3000)), "404 Not Found" if i == 3 else "200 OK")
    return path


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def read(spark, path, **options):
    reader = spark.read.format("landed")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


def test_batch(spark, folder):
    land(folder, "2025-01-05", "0000", "", head="X: y")
    os.makedirs(f"{folder}/other")
    with open(f"{folder}/2025-01-05/0001", "w") as file:
        file.write("no response")
    land(folder, "2025-01-05", "_half", "not yet")
    got = read(spark, folder, partition_bytes=2000)
    assert got.rdd.getNumPartitions() > 5
    rows = {(r.day, r.name): r for r in got.collect()}
    assert len(rows) == 30 and sum(r.status == 404 for r in rows.values()) == 4
    one = rows["2025-01-02", "0005"]
    assert one.url == "http://x/a?b=1" and one.content_type == "application/json" and one.body_bytes == len(one.body.encode()) and one.fetched_at.year == 2025
    assert spark.createDataFrame([one]).select(F.from_json("body", "n int").n).first()[0] == 205
    assert rows["2025-01-05", "0000"].body == "" and rows["2025-01-05", "0001"].status is None
    cut = read(spark, folder, prefix_bytes=9).where("status = 200").collect()
    assert all(len(r.body.encode()) <= 9 and (r.body_bytes == 0 or r.body.startswith('{"n": ')) for r in cut)
    assert read(spark, folder + "-none").count() == 0


def test_days_are_pruned(spark, folder, monkeypatch):
    for day in ("2025-01-01", "2025-01-04"):  # a read of these would find no responses
        for name in os.listdir(f"{folder}/{day}"):
            with open(f"{folder}/{day}/{name}", "w") as file:
                file.write("spoiled")
    reader = landed.PushedReader({"path": folder})
    filters = [landed.GreaterThan(("day",), "2025-01-01"), landed.LessThanOrEqual(("day",), "2025-01-03"), landed.EqualTo(("status",), 200)]
    assert list(reader.pushFilters(filters)) == filters
    assert {f[0] for part in reader.partitions() for f in part.files} == {"2025-01-02", "2025-01-03"}
    assert read(spark, folder, first_day="2025-01-02", last_day="2025-01-03").where("status IS NOT NULL").count() == 14
    name = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(name, "true")
    try:
        pushed = read(spark, folder, push_filters="true").where("day > '2025-01-01' AND day < '2025-01-04'")
        assert pushed.count() == 14 and pushed.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset(name)


def test_ranges_are_tried_again():
    data, fails = bytes(range(256)) * 10, [0]

    def read(at, n):
        fails[0] += 1
        if fails[0] % 3:
            raise OSError("reset")
        return data[at : at + n]

    assert landed.read_ranges(read, len(data), step=100) == data
    assert landed.read_ranges(read, 55, step=100) == data[:55]

    def never(at, n):
        raise OSError("down")

    with pytest.raises(OSError, match="down"):
        landed.read_ranges(never, 10)


def test_stream_and_batch_read_the_same_rows_after_a_restart(spark, folder, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        stream = spark.readStream.format("landed").option("partition_bytes", 2000).load(folder)
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(once=True).start(out).awaitTermination(120)
        return rows_of(spark.read.parquet(out))

    assert run() == rows_of(read(spark, folder))
    land(folder, "2025-01-04", "0099", "late")
    land(folder, "2025-01-06", "0000", "next")
    assert run() == rows_of(read(spark, folder)) and len(run()) == 30


def pages(spark, n):
    rows = [(f"f{i}", "x") for i in range(n)] + [("a/b é", "<b>&\"'"), (None, "none"), ("f0", "x")]
    return spark.createDataFrame(rows, "id string, text string").repartition(4)


def files(path):
    out = {}
    for top, _, names in os.walk(path):
        for name in names:
            if not name.endswith(".crc"):
                out.setdefault(name, []).append(os.path.join(top, name))
    return out


def test_one_file_a_filing(spark, tmp_path):
    path = str(tmp_path / "pages")
    content = landed.score_page(F.col("id"), F.array(F.struct(F.lit("Score <1>").alias("label"), F.col("text").alias("value"), F.lit("high").alias("band"))))
    landed.write_pages(pages(spark, 50), path, name="id", content=content)
    got = files(path)
    assert len(got) == 52 and all(len(x) == 1 for x in got.values()) and not any("_writing" in x[0] for x in got.values())
    with open(got[landed.file_name("a/b é") + ".html"][0]) as file:
        text = file.read()
    assert "<h1>a/b é</h1>" in text and "<th>Score &lt;1&gt;</th><td>&lt;b&gt;&amp;&quot;&#39;</td>" in text and "<b>" not in text


def test_a_task_that_dies_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "pages")
    poison = F.when(F.col("id") == "f7", F.raise_error(F.lit("dies"))).otherwise(F.col("text"))
    with pytest.raises(Exception, match="dies"):
        landed.write_pages(pages(spark, 50), path, name="id", content=poison)
    assert files(path) == {}
    landed.write_pages(pages(spark, 50), path, name="id", content=F.to_json(F.struct("id", "text")), suffix=".json")
    assert len(files(path)) == 52 and all(len(x) == 1 for x in files(path).values())


def test_names():
    names = ["a", "a_", "a/b", "a_2f_b", "é", "..", None, ""]
    assert len({landed.file_name(n) for n in names[:6]}) == 6 and landed.file_name("..") == "_2e__2e_"
