"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows of equal text are one group and stay in one shard, unless the group alone weighs more than a quarter of a
shard; such a group is cut into pieces. There are fewer than 4 * shards such groups at any size of the
input, because each holds more than 1 / (4 * shards) of some total. All other groups fall by the hash of their text
into a fixed number of bundles. The driver packs bundles and pieces, a table whose size does not depend on the
input: in order of falling weight, each goes to the shard where the dot product of its vector with the residual
capacity is highest, among the shards that hold it in every dimension, or else in bytes.

Rows are numbered once, as they are written to the shared folder without their texts; that number, not doc_id, deals
the rows of a heavy group to pieces and those of a shard to parts, so rows that share an id or have none are no hot key.
Slots are numbered in parts of bounded size: parts are counted, and a row's slot is its part's offset plus its rank in
the part.

Defined results: a null text is an empty one, with no bytes, no tokens and CRC 0; a very long text is a unit like any
other, and no shard can be smaller than the largest; repeated rows are rows of their own, in one shard unless their group
is cut, with slots of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged

#: A token: a run of other characters than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bundles a shard; the heaviest unit that greedy placement has left at its end is about this part of a shard.
BUNDLES_PER_SHARD = 256
#: A group of equal texts above this part of a shard is cut.
HEAVY = 0.25
#: Rows whose slots one task numbers at once, about.
SLOT_ROWS = 50_000
#: Parts of a shard that a table of a few thousand rows and more has at least, so that tasks stay even.
MANY_PARTS = 64
#: How much the byte dimension counts in the dot product, beside tokens and rows.
WEIGHTS = np.array([2.0, 1.0, 1.0])


def pack_vectors(vectors: np.ndarray, shards: int, weights: np.ndarray = WEIGHTS) -> np.ndarray:
    """The shard of each row of vectors (units by bytes, tokens, rows).

    Each dimension is scaled so that a shard's fair share is 1. Units go by falling size; of the shards whose residual
    holds the unit in all dimensions (if none: in bytes) the one with the highest dot product takes it, ties to the lowest
    number; where none has the bytes, the one with the most bytes left takes it.
    """
    share = vectors.sum(axis=0) / shards
    scaled = vectors / np.where(share > 0, share, 1)
    residual = np.ones((shards, vectors.shape[1]))
    placed = np.zeros(len(vectors), dtype=np.int64)
    for i in np.argsort(-(scaled * weights).sum(axis=1), kind="stable"):
        unit = scaled[i]
        fits = (residual >= unit).all(axis=1)
        if not fits.any():
            fits = residual[:, 0] >= unit[0]
        score = residual @ (unit * weights)
        placed[i] = best = int(np.argmax(np.where(fits, score, -np.inf) if fits.any() else residual[:, 0]))
        residual[best] -= unit
    return placed


def shard_documents(docs: DataFrame, shards: int = 24, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, tokens, law, shard, slot, grown_shard; shard sizes in bytes are near equal (law `bytes`)."""
    spark = docs.sparkSession
    narrow = staged(
        spark,
        docs.select(
            F.col(key),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
            F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
            F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h1"),
            F.monotonically_increasing_id().alias("__row"),
        ),
        "shard-rows",
    )
    group = ["h1", "text_crc32", "size"]
    measures = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = narrow.agg(*measures).first()
    totals = [total["bytes"] or 0, total["tokens"] or 0, total["rows"]]
    limit = [max(x * HEAVY / shards, 1) for x in totals]
    heavy_groups = (
        narrow.groupBy(*group).agg(*measures).where((F.col("rows") > 1) & ((F.col("bytes") > limit[0]) | (F.col("tokens") > limit[1]) | (F.col("rows") > limit[2])))
    ).collect()
    # Fewer than 3 * shards / HEAVY rows by the limits themselves.
    pieces = {tuple(r[c] for c in group): math.ceil(max(r[m] / x for m, x in zip(("bytes", "tokens", "rows"), limit, strict=True))) for r in heavy_groups}
    bundles = shards * BUNDLES_PER_SHARD
    cut_schema = "h1 long, text_crc32 long, size long, piece_of int, pieces int"
    cut = spark.createDataFrame([(*k, i, n) for i, (k, n) in enumerate(sorted(pieces.items()))], cut_schema)
    units = (
        narrow.join(F.broadcast(cut), group, "left")
        .withColumn("spread", F.xxhash64("__row", F.lit(7)))
        .withColumn("unit_piece", F.when(F.col("piece_of").isNotNull(), F.pmod("spread", F.col("pieces").cast("long")).cast("int")).otherwise(F.lit(-1)))
        .withColumn("unit", F.when(F.col("piece_of").isNotNull(), F.col("piece_of")).otherwise(F.pmod(F.xxhash64("h1"), F.lit(bundles)).cast("int")))
    )
    counted = units.groupBy("unit", "unit_piece").agg(*measures).orderBy("unit_piece", "unit").collect()
    placed = pack_vectors(np.array([[r["bytes"], r["tokens"], r["rows"]] for r in counted], dtype=float).reshape(-1, 3), shards)
    plan = spark.createDataFrame([(r["unit"], r["unit_piece"], int(s)) for r, s in zip(counted, placed, strict=True)], "unit int, unit_piece int, shard int")
    parts = max(math.ceil(totals[2] / shards / SLOT_ROWS), min(MANY_PARTS, math.ceil(totals[2] / shards / 16)), 1)
    rows = units.join(F.broadcast(plan), ["unit", "unit_piece"]).withColumn("part", F.pmod("spread", F.lit(parts)).cast("int"))
    offsets = rows.groupBy("shard", "part").count().withColumn("before", F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("__row"))
    return (
        rows.withColumn("rank", rank)
        .join(offsets.select("shard", "part", "before"), ["shard", "part"])
        .select(
            key, "size", "text_crc32", "tokens", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
        )
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards whose sizes in bytes are near equal."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24).drop("tokens")
