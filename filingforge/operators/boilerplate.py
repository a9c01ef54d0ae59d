"""Corpus n-grams that many filers share, and how much of a text they cover."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from filingforge.staging import staged

GRAM = 4
#: Grams that are broadcast; more meet the texts' grams by shuffling.
BROADCAST_GRAMS = 1_000_000


def gram_array(tokens: str | Column = "tokens", n: int = GRAM) -> Column:
    """Every n tokens in a row, joined by spaces, in order; empty for shorter arrays."""
    arr = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.when(F.size(arr) >= n, F.transform(F.sequence(F.lit(1), F.size(arr) - n + 1), lambda i: F.array_join(F.slice(arr, i, n), " "))).otherwise(F.array().cast("array<string>"))


def gram_hashes(tokens: str | Column = "tokens", n: int = GRAM) -> Column:
    """A 64-bit hash of every n tokens in a row, in the order of gram_array(), without the grams."""
    arr = F.col(tokens) if isinstance(tokens, str) else tokens
    last = F.size(arr) - n + 1
    return F.when(last > 0, F.transform(F.slice(arr, F.lit(1), last), lambda t, i: F.xxhash64(t, *[F.get(arr, i + k) for k in range(1, n)]))).otherwise(F.array().cast("array<long>"))


def hash_of(gram: str = "gram", n: int = GRAM) -> Column:
    """The hash that gram_hashes() has for a gram."""
    return F.get(gram_hashes(F.split(gram, " "), n), F.lit(0))


def hits(texts: DataFrame, key: str, wanted: DataFrame, *, n: int, tokens: str) -> DataFrame:
    """key, n_tokens, pos and grams of each text: its grams whose hash is wanted, in order. wanted: h, and the gram if it has to agree too.

    What is wanted is of a counted size; it is sent to where the texts are, and only hits are made texts.
    """
    spark = texts.sparkSession
    rows = wanted.toArrow()  # at most BROADCAST_GRAMS
    shared = spark.sparkContext.broadcast((np.unique(rows.column("h").to_numpy()), frozenset(rows.column("gram").to_pylist()) if "gram" in wanted.columns else None))
    source = texts.select(F.col(key).alias("key"), F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens")).withColumn("h", gram_hashes("tokens", n))
    schema = f"key {source.schema['key'].dataType.simpleString()}, n_tokens int, pos array<int>, grams array<string>"
    shape = to_arrow_schema(_parse_datatype_string(schema))

    def found(part: pa.RecordBatch) -> pa.RecordBatch:
        hashes, known = shared.value
        flat, sizes = part.column("h").flatten().to_numpy(zero_copy_only=False), part.column("tokens").value_lengths().to_numpy(zero_copy_only=False)
        ends = np.cumsum(part.column("h").value_lengths().to_numpy(zero_copy_only=False))
        place = np.searchsorted(hashes, flat)
        hit = np.flatnonzero((place < len(hashes)) & (hashes[np.minimum(place, len(hashes) - 1)] == flat)) if len(hashes) else np.zeros(0, np.int64)
        row = np.searchsorted(ends, hit, "right")
        pos = hit - np.concatenate([[0], ends])[row]
        first, words = (np.cumsum(sizes) - sizes)[row] + pos, part.column("tokens").flatten()
        grams = list(map(" ".join, zip(*(words.take(pa.array(first + k)).to_pylist() for k in range(n)))))
        if known is not None:
            same = np.fromiter((g in known for g in grams), bool, len(grams))
            row, pos, grams = row[same], pos[same], [g for g, kept in zip(grams, same, strict=True) if kept]
        at = np.searchsorted(row, np.arange(part.num_rows + 1)).tolist()
        lists = ([values[i:j] for i, j in zip(at, at[1:])] for values in (pos.tolist(), grams))
        columns = [part.column("key").cast(shape.field("key").type), pa.array(sizes, pa.int32()), *(pa.array(x, shape.field(c).type) for x, c in zip(lists, ("pos", "grams")))]
        return pa.RecordBatch.from_arrays(columns, schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield found(batch.slice(at, 256))

    return source.mapInArrow(run, schema).withColumnRenamed("key", key)


def gram_baseline(sections: DataFrame, *, min_doc_freq: int = 2, min_doc_frac: float = 0.05, tokens: str = "tokens", n: int = GRAM) -> DataFrame:
    """gram, doc_freq, n_docs of the grams in at least max(min_doc_freq, ceil(min_doc_frac * documents)) documents.

    A gram counts once a document; counts are combined before the shuffle. Grams are shuffled as 64-bit hashes; only those
    whose hash is frequent enough are then made texts and counted by themselves, so that hashes that collide change nothing.
    Tokens hold no spaces.
    """
    sections = sections.select(F.lit(0).alias("_key"), tokens)
    documents = F.broadcast(sections.where(F.size(tokens) > 0).agg(F.count("*").alias("n_docs")))  # one row
    limit = F.greatest(F.lit(min_doc_freq), F.ceil(F.col("n_docs") * min_doc_frac))
    hashed = sections.select(F.explode(F.array_distinct(gram_hashes(tokens, n))).alias("h")).groupBy("h").agg(F.count("*").alias("doc_freq"))
    hashes = staged(sections.sparkSession, hashed.join(documents).where(F.col("doc_freq") >= limit).select("h"), "gram-hashes")
    if hashes.count() <= BROADCAST_GRAMS:
        grams = hits(sections, "_key", hashes, n=n, tokens=tokens).select(F.explode(F.array_distinct("grams")).alias("gram"))
    else:
        every = sections.select(F.explode(F.array_distinct(gram_array(tokens, n))).alias("gram")).withColumn("h", hash_of(n=n))
        grams = every.join(hashes, "h", "left_semi")
    return grams.groupBy("gram").agg(F.count("*").alias("doc_freq")).join(documents).where(F.col("doc_freq") >= limit)


def cross_firm_ratio(sections: DataFrame, baseline: DataFrame, *, key: str = "doc_id", tokens: str = "tokens", n: int = GRAM) -> DataFrame:
    """key, covered_words, boilerplate_cross_firm_ratio: the share of tokens in any baseline gram.

    A gram at i covers i to i + n - 1: overlaps are resolved by counting the steps between hits in order, so a text
    costs one row a hit, not n.
    """
    spark = sections.sparkSession
    grams = staged(spark, baseline.select("gram"), "grams")
    if grams.count() <= BROADCAST_GRAMS:
        found = hits(sections, key, grams.withColumn("h", hash_of(n=n)), n=n, tokens=tokens)
    else:
        base = sections.select(key, F.size(tokens).alias("n_tokens"))
        at = sections.select(key, F.posexplode(gram_array(tokens, n)).alias("pos", "gram"))
        found = base.join(at.join(grams, "gram", "left_semi").groupBy(key).agg(F.sort_array(F.collect_list("pos")).alias("pos")), key, "left")
    # From each hit on, n words or those up to the next hit are covered.
    gaps = F.zip_with(F.slice("pos", F.lit(2), F.size("pos") - 1), F.slice("pos", F.lit(1), F.size("pos") - 1), lambda a, b: F.least(a - b, F.lit(n)))
    covered = F.when(F.size("pos") > 0, F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x) + n)
    out = found.withColumn("covered_words", F.coalesce(covered, F.lit(0)))
    return out.select(key, "covered_words", F.round(F.when(F.col("n_tokens") > 0, F.col("covered_words") / F.col("n_tokens")).otherwise(0.0), 6).alias("boilerplate_cross_firm_ratio"))


def artifact(baseline: DataFrame, *, fiscal_year: int, section: str, min_doc_freq: int, min_doc_frac: float) -> DataFrame:
    """The baseline with the facts it was built from, ready for a sink."""
    return baseline.select(F.lit(fiscal_year).alias("fiscal_year"), F.lit(section).alias("section"), F.lit(min_doc_freq).alias("min_doc_freq"), F.lit(min_doc_frac).alias("min_doc_frac"), "n_docs", F.split("gram", " ").alias("gram"), "doc_freq")


def latest_artifact(artifacts: DataFrame, fiscal_year: int, section: str) -> DataFrame:
    """The artifact of the requested year if there is one, else of the latest year."""
    own = artifacts.where(F.col("section") == section)
    year = own.agg(F.coalesce(F.max(F.when(F.col("fiscal_year") == fiscal_year, F.col("fiscal_year"))), F.max("fiscal_year")).alias("fiscal_year"))
    return own.join(F.broadcast(year), "fiscal_year")  # one row is broadcast
