"""Streaming ingestion of landed filings (an addition: batch results don't depend on it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from filingforge.operators.metrics import section_metrics, with_text_parts

LANDED = "filing_id string, section string, section_ord int, text string, landed_at timestamp"


def read_landed(spark: SparkSession, path: str, *, files_per_trigger: int = 100) -> DataFrame:
    """Sections as they land, as JSON lines."""
    return spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files_per_trigger).json(path)


def metrics_stream(sections: DataFrame, *, late: str = "1 day") -> DataFrame:
    """Each section's metrics once: a section that lands again within the watermark is dropped."""
    once = sections.withWatermark("landed_at", late).dropDuplicatesWithinWatermark(["filing_id", "section"])
    return section_metrics(with_text_parts(once)).drop("tokens", "sentences", "lower")


def tone_by_window(metrics: DataFrame, *, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Mean negative ratio and number of sections by landing window."""
    return metrics.withWatermark("landed_at", late).groupBy(F.window("landed_at", window)).agg(F.avg("negative_word_ratio").alias("negative_word_ratio"), F.count("*").alias("n"))


def start(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream as Parquet; offsets and files are committed together."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
