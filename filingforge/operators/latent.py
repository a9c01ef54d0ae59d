"""Semantic similarity by latent vectors: a truncated singular value decomposition of a whole corpus's term weights.

Terms are hashed to a fixed number of slots. Rows of the matrix are chunks of texts, their smoothed term weights scaled to
length one; it is never built: each round of randomised subspace iteration multiplies its Gram matrix by a thin block of
vectors, chunk by chunk, in the tasks that hold the chunks. A task adds up one partial block, and partial blocks are added
by ranges of slots, so what reaches the driver has the size of the model, slots x directions, whatever the corpus. The model
is a table (slot, idf, vector) and can be stored and read as one.

A text's vector is the mean of its chunks' vectors; the similarity of two texts is the cosine of theirs, from 0 to 1, and 0
where one of them is blank or holds no term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from filingforge.operators.shaping import chunks
from filingforge.staging import staged

#: Slots of hashed terms, directions that are kept, directions carried beside them, and rounds.
SLOTS, DIRECTIONS, SPARE, ROUNDS = 1 << 14, 64, 16, 6
#: Characters of a chunk.
CHUNK = 2000
#: Slots that are added up in one task.
RANGE = 256
MODEL = "slot int, idf double, vector array<double>"


def chunk_slots(text: Column, slots: int = SLOTS, size: int = CHUNK) -> Column:
    """array<array<int>>: the slots of each chunk's terms, runs of two word characters and more."""
    terms = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.transform(chunks(F.coalesce(text, F.lit("")), size), lambda c: F.transform(terms(c), lambda t: F.pmod(F.xxhash64(t), F.lit(slots)).cast("int")))


def weighted(lists: list[list[int]] | pa.ListArray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of unit length as (slot, weight, row) entries, in the order of rows; rows without a term have none."""
    lists = lists if isinstance(lists, pa.ListArray) else pa.array(lists, pa.list_(pa.int32()))
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    cells, counts = np.unique(row * len(idf) + flat, return_counts=True)
    row, slot = cells // len(idf), cells % len(idf)
    weight = counts * idf[slot]
    norm = np.sqrt(np.bincount(row, weights=weight * weight, minlength=len(lists)))
    return slot, weight / np.where(norm > 0, norm, 1)[row], row


def times(entries: tuple[np.ndarray, np.ndarray, np.ndarray], rows: int, block: np.ndarray) -> np.ndarray:
    """The rows times a block of vectors by slot."""
    slot, weight, row = entries
    out = np.zeros((rows, block.shape[1]))
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    if len(starts):
        out[row[starts]] = np.add.reduceat(block[slot] * weight[:, None], starts, axis=0)
    return out


def gram_times(rows: DataFrame, idf: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The matrix's Gram matrix times a block; rows: slots (array<int>)."""
    spark, (slots, width) = rows.sparkSession, block.shape
    shared = spark.sparkContext.broadcast((idf, block))
    shape = pa.schema([("range", pa.int32()), ("part", pa.binary())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, block = shared.value
        total, seen = np.zeros((slots, width)), False
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                lists = batch.column("slots").slice(at, 512)
                slot, weight, row = entries = weighted(lists, idf)
                ahead = times(entries, len(lists), block)
                order = np.argsort(slot, kind="stable")
                starts = np.flatnonzero(np.diff(slot[order], prepend=-1))
                if len(starts):
                    seen = True
                    total[slot[order][starts]] += np.add.reduceat((ahead[row] * weight[:, None])[order], starts, axis=0)
        if seen:
            parts = [total[i : i + RANGE].tobytes() for i in range(0, slots, RANGE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], schema=shape)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.frombuffer(part)
                sums[i] = sums[i] + found if i in sums else found
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], schema=shape)

    # A task a core at most, so that partial blocks don't outnumber them; then each range of slots in one place.
    parts = rows.coalesce(spark.sparkContext.defaultParallelism).mapInArrow(partial, "range int, part binary")
    found = parts.repartition(-(-slots // RANGE), "range").mapInArrow(added, "range int, part binary").collect()
    out = np.zeros((slots, width))
    for r in found:
        out[RANGE * r["range"] : RANGE * (r["range"] + 1)] = np.frombuffer(r["part"]).reshape(-1, width)
    shared.unpersist()
    return out


def fit(texts: DataFrame, text: str = "text", *, slots: int = SLOTS, directions: int = DIRECTIONS, spare: int = SPARE, rounds: int = ROUNDS, size: int = CHUNK, seed: int = 1) -> DataFrame:
    """The model of a corpus: a row (slot, idf, vector) for each slot that holds a term."""
    spark = texts.sparkSession
    rows = staged(spark, texts.select(F.explode(chunk_slots(F.col(text), slots, size)).alias("slots")).where(F.size("slots") > 0), "latent-rows")
    counts = rows.select(F.explode(F.array_distinct("slots")).alias("slot")).groupBy("slot").count().collect()  # a row a slot
    if not counts:
        return spark.createDataFrame([], MODEL)
    frequency, n = np.zeros(slots), rows.count()
    frequency[[r["slot"] for r in counts]] = [r["count"] for r in counts]
    idf = np.log((1 + n) / (1 + frequency)) + 1
    used = frequency > 0
    width = min(directions + spare, int(used.sum()))
    block = np.random.default_rng(seed).normal(size=(slots, width)) * used[:, None]
    for _ in range(rounds):
        block, _ = np.linalg.qr(gram_times(rows, idf, block))
    values, turn = np.linalg.eigh(block.T @ gram_times(rows, idf, block))
    top = np.argsort(values)[::-1][: min(directions, int((values > 1e-10 * values.max()).sum()))]
    vectors = block @ turn[:, top]
    return spark.createDataFrame([(int(i), float(idf[i]), vectors[i].tolist()) for i in np.flatnonzero(used)], MODEL)


def with_vectors(texts: DataFrame, model: DataFrame, columns: dict[str, str], *, slots: int = SLOTS, size: int = CHUNK) -> DataFrame:
    """Adds a vector for each named text column; null where a text holds no term of the model. columns: vector by text."""
    spark = texts.sparkSession
    found = model.collect()  # at most a row a slot
    idf, vectors = np.zeros(slots), np.zeros((slots, len(found[0]["vector"]) if found else 1))
    for r in found:
        idf[r["slot"]], vectors[r["slot"]] = r["idf"], r["vector"]
    shared = spark.sparkContext.broadcast((idf, vectors))
    names = list(columns.values())
    source = texts.select(F.struct("*").alias("row"), *[chunk_slots(F.col(t), slots, size).alias(f"s{i}") for i, t in enumerate(columns)])
    schema = source.select("row", *[F.lit(None).cast("array<double>").alias(f"v{i}") for i in range(len(names))]).schema
    shape = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, vectors = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for i in range(len(names)):
                    lists = part.column(f"s{i}")
                    flat = lists.flatten()
                    latent = times(weighted(flat, idf), len(flat), vectors)
                    edges = np.cumsum([0, *lists.value_lengths().to_pylist()])
                    means = [latent[a:b].mean(axis=0) if b > a and latent[a:b].any() else None for a, b in zip(edges, edges[1:])]
                    out.append(pa.array([None if m is None else m.tolist() for m in means], pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays([part.column("row"), *out], schema=shape)

    return source.mapInArrow(run, schema).select("row.*", *[F.col(f"v{i}").alias(n) for i, n in enumerate(names)])


def similarity(a: Column, b: Column) -> Column:
    """The cosine of two vectors from 0 to 1; 0 where one is null or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.coalesce(F.when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / size))), F.lit(0.0))


def with_similarity(pairs: DataFrame, model: DataFrame, *, text: str = "text", prior: str = "prior_text", name: str = "latent_similarity", slots: int = SLOTS, size: int = CHUNK) -> DataFrame:
    """Pairs of texts with their similarity."""
    found = with_vectors(pairs, model, {text: "_vector", prior: "_prior_vector"}, slots=slots, size=size)
    return found.withColumn(name, similarity(F.col("_vector"), F.col("_prior_vector"))).drop("_vector", "_prior_vector")


def save_model(model: DataFrame, path: str) -> None:
    """The model as an artifact."""
    model.coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    """A stored model."""
    return spark.read.schema(str(_parse_datatype_string(MODEL).toDDL())).parquet(path)
