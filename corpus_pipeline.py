"""The corpus pipeline: language ID, near-dedup, decontamination, secret scans, packing.

Each stage reads what its predecessor kept, written as Parquet, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filingforge.llm import decontaminate, language, packing, secrets, similar
from filingforge.llm.common import scratch, staged

#: A text is rejected where no language has this share of its expected words.
LEAST_SCORE = 0.4
#: Near-duplicates: words of a shingle; two texts are linked where their shingle sets have a Jaccard similarity of 0.8.
SHINGLE = 5


def _nested(docs: DataFrame) -> DataFrame:
    """The text beside the whole row as one column, so that no name of the row can clash with a stage's own."""
    return docs.select(F.struct("*").alias("document"), F.col("text"))


def _rows(found: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The rows again, in the columns of docs, some with new values."""
    return found.select(*[changed[c].alias(c) if c in changed else F.col(f"document.`{c}`") for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a language (null, no letter) and those in which none stands out; sets lang to the one found."""
    found = language.predict(_nested(docs), language.train_on(docs), carry=["document"])
    return _rows(found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)), docs, lang=F.col("lang_pred"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component: that of the least doc_id (null behind all others), then of the least text hash.

    Rows that share an id are told apart by their texts. Of rows that repeat id and text, the one whose other columns come
    first as JSON stays.
    """
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))
    named = docs.select(place.alias("place"), F.struct("*").alias("document"), F.col("text"))
    found = similar.near_duplicates(named, key="place", width=SHINGLE)
    kept = staged(spark, found.where(F.col("place") == F.col("component")).select("place").distinct(), "kept-rows")
    others = [F.col(f"document.`{c}`").alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*others)) if others else F.lit("")
    first = named.join(kept, "place").groupBy("place").agg(F.min_by("document", order).alias("document"))
    return _rows(first, docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which at least one word in twenty lies in a benchmark item's window."""
    found = decontaminate.contamination(_nested(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=["document"])
    return _rows(found.where(~decontaminate.is_contaminated()), docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; n_chars follows."""
    found = secrets.scan_secrets(_nested(docs), secrets.train_markov(secrets.labelled_samples(docs)), carry=["document"])
    found = found.withColumn("clean", F.when(F.col("document.text").isNotNull(), secrets.redacted("text", "spans")))
    return _rows(found, docs, text=F.col("clean"), n_chars=F.length("clean").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    pieces = packing.pack_documents(docs, packing.default_vocabulary())
    return packing.with_digests(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("secret_scans", redact_secrets),
    ("packing", pack_sequences),
]

#: Language scores and near-duplicate components aren't expressible in SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
