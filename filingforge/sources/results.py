"""Results kept by their content: what was computed once isn't computed again.

A row's key is a digest of the columns that its result depends on and of the versions of the steps that make it. Results lie
below a folder in runs, each written aside and renamed when it is whole, so readers see all of a run or nothing of it. A
request takes the keys that no run holds, computes a row for each of them alone, commits these as a new run, and answers from
the runs. Rows of equal content share one result. Runs that hold the same keys (two writers at once) are harmless: a key has
one result whoever computed it, and the first run by name answers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Named results of a run that hold its rows; others are leftovers of runs that never ended.
RUN = "run-"


def content_key(columns: Sequence[str], versions: Mapping[str, str]) -> Column:
    """The digest of columns (nulls apart from empty strings) and of named versions, whatever the order of either's names."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.concat(F.octet_length(F.col(f"`{c}`").cast("string")).cast("string"), F.lit(":"), F.col(f"`{c}`").cast("string")), F.lit("-"))) for c in sorted(columns)]
    return F.sha2(F.concat_ws("\n", *[F.lit(f"{k}@{v}") for k, v in sorted(versions.items())], *parts).cast("binary"), 256)


def _files(spark: SparkSession, path: str) -> tuple[object, object]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def runs(spark: SparkSession, path: str) -> list[str]:
    """The whole runs below a path, by name."""
    system, at = _files(spark, path)
    if not system.exists(at):
        return []
    return sorted(str(s.getPath().toString()) for s in system.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith(RUN))


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every result of the runs: cache_key, cache_run and the columns of schema."""
    found = runs(spark, path)
    columns = f"cache_key string, {schema}"
    if not found:
        return spark.createDataFrame([], columns).withColumn("cache_run", F.lit(""))
    return spark.read.schema(columns).parquet(*found).withColumn("cache_run", F.regexp_extract(F.input_file_name(), f"/({RUN}[^/]+)/", 1))


def commit(spark: SparkSession, rows: DataFrame, path: str) -> str | None:
    """Writes rows aside and makes them a run by one rename; None, and no run, where there are no rows."""
    name = uuid.uuid4().hex
    aside, final = f"{path}/_{name}", f"{path}/{RUN}{name}"
    rows.write.parquet(aside)
    system, at = _files(spark, aside)
    if spark.read.schema(rows.schema).parquet(aside).isEmpty():
        system.delete(at, True)
        return None
    if not system.rename(at, _files(spark, final)[1]):
        raise OSError(f"{aside} can't be renamed to {final}")
    return final


def cached(rows: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, *, columns: Sequence[str], versions: Mapping[str, str], schema: str) -> DataFrame:
    """rows with the columns of schema, computed where no run has them, and cache_new: computed by this call.

    compute takes rows (cache_key and columns, each key once) and returns cache_key and the columns of schema. Rows for which it
    returns none keep nulls and are tried again next time.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("cache_key", content_key(columns, versions))
    missing = keyed.select("cache_key", *columns).join(stored(spark, path, schema).select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    new = commit(spark, compute(missing).select("cache_key", *names), path)
    first = stored(spark, path, schema).groupBy("cache_key").agg(F.min_by(F.struct(*names), "cache_run").alias("_result"), F.min("cache_run").alias("_run"))
    out = keyed.join(first, "cache_key", "left")
    fresh = F.lit(False) if new is None else F.coalesce(F.col("_run") == new.rpartition("/")[2], F.lit(False))
    return out.select(*rows.columns, *[F.col("_result").getField(n).alias(n) for n in names], fresh.alias("cache_new"))


def stale_versions(spark: SparkSession, path: str, schema: str, current: Sequence[str]) -> DataFrame:
    """cache_key, n of results whose key isn't among the current ones: what a change of text or version has left behind."""
    keys = spark.createDataFrame([(k,) for k in current], "cache_key string")
    return stored(spark, path, schema).join(keys, "cache_key", "left_anti").groupBy("cache_key").agg(F.count("*").alias("n"))
