"""Helpers that several operators use; staging in the shared folder is the library's."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from filingforge.staging import drop_staged, scratch, shared_dir, staged

__all__ = ["arrow_schema", "ascii_lower", "drop_staged", "scratch", "shared_dir", "slices", "small_batches", "staged"]

#: Rows of an Arrow batch where the session doesn't name a number: texts are long, and Spark's own default is 10,000.
BATCH_ROWS = 2_000


def arrow_schema(df_schema: str | object) -> pa.Schema:
    """The Arrow schema of a Spark schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    return to_arrow_schema(df_schema if isinstance(df_schema, StructType) else _parse_datatype_string(df_schema))


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows of Arrow batches, from now on and for all of the session, unless it has a bound of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_ROWS)


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batch that hold about `limit` bytes of the column each, one row at least: this bounds working memory."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first = total = 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += size
    yield batch.slice(first)


def ascii_lower(column: object) -> object:
    """A-Z to a-z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
