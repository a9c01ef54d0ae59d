"""SimHash near-duplicates with pigeonring filtering.

A fingerprint's bit is 1 if it is 1 in more than half of the hashes of the text's word shingles, repeats counted. Two
fingerprints are linked where at most `distance` bits differ.

The 64 bits are a ring of eight segments. If two fingerprints differ in at most 3 bits, some segment starts a chain of
which each prefix of l segments differs in at most 3 * l / 8 bits, that is 0, 0, 1, 1, 1, 2, 2 and 3. Such a chain's
first two segments agree, and of the next three, at least two. So each distinct fingerprint is filed, for each of the
eight starts, under its first two segments with each two of the next three: 24 keys of 32 bits. In a key's bucket the
chain's prefixes prune pairs step by step before the full Hamming check.

Buckets don't emit pairs: a search from fingerprint to fingerprint over those not reached yet emits a link when it
first reaches one, so a bucket of n fingerprints emits fewer than n links and a dense one is searched in few steps.
A bucket that many fingerprints share is dealt out in blocks, each two of which meet in one task; fingerprints in
fewer bits than a block holds are one block anyway. Components of the links are found by star rounds.

Defined results: null texts and texts without words have fingerprint 0 and are linked like any other; a text with
fewer words than a shingle is one shingle; a very long text is hashed whole, its bits summed in parts; rows that repeat an
id are rows of their own; a row of null id has its fingerprint and component like any other, and a component in which no
row has an id is null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingforge.session import spread

from .common import arrow_schema, slices, staged
from .components import connected_components

UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
FOLD = bytes.maketrans(UPPER, LOWER)
SEGMENTS, BITS = 8, 8
#: Fingerprints of one block of a bucket.
BLOCK = 2_000
#: Rows of buckets that one task searches, about.
TASK_ROWS = 8_000


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64, seed 42, of each shingle of the folded text."""
    import xxhash

    words = text.translate(FOLD).split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(flat, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, count=len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(flat[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64, count=len(starts))


def simhash(text: bytes, width: int = 3) -> int:
    """The fingerprint of a text."""
    return fingerprint(shingle_hashes(text, width))


def fingerprint(hashes: np.ndarray) -> int:
    """The fingerprint of a text's shingle hashes, repeats counted."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """key and fp, the fingerprint as a signed long."""
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    schema = f"key {source.schema['key'].dataType.simpleString()}, fp long"
    shape = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values = [simhash(t or b"", width) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(np.array(values, np.uint64).view(np.int64))], schema=shape)

    return source.mapInArrow(run, schema).withColumnRenamed("key", key)


def chain_budgets(distance: int) -> list[int]:
    """Most differing bits of a chain's first 1, 2, ... segments."""
    return [distance * length // SEGMENTS for length in range(1, SEGMENTS + 1)]


def keys_of(fps: np.ndarray) -> np.ndarray:
    """The 24 keys of each fingerprint: 3 * start + left-out segment in the high bits, four segments in the low 32."""
    fps = fps.astype(np.uint64)
    out = np.empty((len(fps), 3 * SEGMENTS), np.int64)
    for start in range(SEGMENTS):
        ring = rotated(fps, start)
        head = ring & np.uint64(0xFFFF)
        for skip in range(3):
            kept = [2 + j for j in range(3) if j != skip]
            low = head.copy()
            for place, j in enumerate(kept):
                low |= ((ring >> np.uint64(BITS * j)) & np.uint64(0xFF)) << np.uint64(16 + BITS * place)
            out[:, 3 * start + skip] = (np.uint64((3 * start + skip) << 32) | low).astype(np.int64)
    return out


def rotated(fps: np.ndarray, start: int) -> np.ndarray:
    """The ring with segment `start` first (lowest)."""
    shift = np.uint64(BITS * start)
    return fps if not start else (fps >> shift) | (fps << (np.uint64(64) - shift))


def bucket_links(fps: np.ndarray, start: int, distance: int) -> list[tuple[int, int]]:
    """Links that connect the distinct fingerprints of a bucket wherever chains from `start` stay within budget."""
    ring = rotated(fps, start)
    budgets = chain_budgets(distance)
    left = np.arange(len(fps))
    links = []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            differ = ring[left] ^ ring[at]
            near = np.arange(len(left))
            for length in (5, 7, SEGMENTS):  # the last prefix of each budget; shorter ones follow from the key or from these
                mask = np.uint64((1 << (BITS * length)) - 1)
                near = near[np.bitwise_count(differ[near] & mask) <= budgets[length - 1]]
            if len(near):
                found = left[near]
                links += [(int(fps[at]), int(fps[x])) for x in found]
                front += found.tolist()
                left = np.delete(left, near)
    return links


def near_links(fps: DataFrame, *, distance: int = 3, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints (column fp) wherever at most `distance` bits differ."""
    if not 0 <= distance <= 3:
        raise ValueError("the keys hold for distances up to 3")
    spark = fps.sparkSession
    key_shape = arrow_schema("bucket long, fp long")

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array(batch.column("fp"), dtype=np.int64)
            for i in range(0, len(own), 1 << 14):
                keys = keys_of(own[i : i + (1 << 14)].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(own[i : i + (1 << 14)], keys.shape[1]))], schema=key_shape)

    filed = fps.select("fp").mapInArrow(file, "bucket long, fp long")
    # Buckets of one fingerprint end here: counts are pre-aggregated, and the counts of buckets of two and more are
    # joined back, a join whose skewed sides Spark can split.
    counts = staged(spark, filed.groupBy("bucket").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / block).cast("int")).withColumn("rows", F.col("count") * F.col("blocks")).drop("count"), "simhash-buckets")
    # Rows that meet are few bytes and much work: the number of tasks follows their count, which isn't merged afterwards.
    total = counts.agg(F.sum("rows")).first()[0] or 0
    tasks = max(1, -(-total // TASK_ROWS))
    shared = filed.join(counts.drop("rows"), "bucket")
    # Blocks i and j of a bucket meet under (i, j); a row goes to as many of these as there are blocks.
    own = F.pmod(F.xxhash64("fp"), F.col("blocks").cast("long")).cast("int")
    met = shared.select("bucket", "fp", "blocks", own.alias("own")).select(
        "bucket", "fp", F.explode(F.expr("CASE WHEN blocks = 1 THEN array(0) ELSE transform(sequence(0, blocks - 1), j -> least(own, j) * blocks + greatest(own, j)) END")).alias("pair")
    )
    link_shape = arrow_schema("a long, b long")

    def link(key: tuple, table: pa.Table) -> pa.Table:
        own = np.unique(np.array(table.column("fp"), dtype=np.int64))
        pairs = bucket_links(own.view(np.uint64), (key[0].as_py() >> 32) // 3, distance)
        columns = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table([pa.array(columns[:, 0]), pa.array(columns[:, 1])], schema=link_shape)

    return met.repartition(tasks, "bucket", "pair").groupBy("bucket", "pair").applyInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 3, distance: int = 3) -> DataFrame:
    """A row for each row of docs: key, fp (signed long), component: the least key reachable over links."""
    spark = docs.sparkSession
    rows = staged(spark, fingerprints(docs, key=key, text=text, width=width), "simhash-rows")
    classes = staged(spark, rows.groupBy("fp").agg(F.min(key).alias("least")), "simhash-classes")
    parts = connected_components(near_links(classes, distance=distance))
    named = staged(spark, classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "simhash-named")
    least = named.groupBy("component").agg(F.min("least").alias("first"))
    by_fp = staged(spark, named.join(staged(spark, least, "simhash-least"), "component").select(F.col("fp"), F.col("first").alias("component")), "simhash-components")
    return rows.join(by_fp, "fp").select(key, "fp", "component")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the least doc_id of its component."""
    found = near_duplicates(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
