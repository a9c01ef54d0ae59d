"""The distribution of scores as an artifact that new filings extend: a percentile needs no new global sort.

The artifact is a histogram on a grid: a row (cohort, cell, n) for each cell of `step` that holds scores. Histograms add up, so
parts of a corpus can be counted on their own, in any order, and the sum is that of the whole. A score's rank is known up to
the scores that share its cell, and exactly where scores are published to the grid's own places; a quantile is known to half
a step. Batches are stored apart and replaced whole, so a batch that is sent twice counts once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Cells of all cohorts that are broadcast.
BROADCAST_CELLS = 500_000
#: The grid of published scores: two places.
STEP = 0.01


def cell(score: Column, step: float = STEP) -> Column:
    """The grid's cell of a score; cells are numbered by their middles, so a score of the grid is the middle of its own."""
    return F.round(score / step, 0).try_cast("long")


def histogram(scores: DataFrame, score: str, cohort: Sequence[str], *, step: float = STEP) -> DataFrame:
    """cohort, cell, n of finite scores."""
    x = F.col(score)
    good = scores.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return good.groupBy(*cohort, cell(x, step).alias("cell")).agg(F.count("*").alias("n"))


def merged(*parts: DataFrame, cohort: Sequence[str]) -> DataFrame:
    """The histogram of all parts together."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(*cohort, "cell").agg(F.sum("n").alias("n"))


def extend(spark: SparkSession, part: DataFrame, path: str, batch: str) -> None:
    """Adds a batch to the artifact at path, or replaces the batch of that name."""
    part.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def load(spark: SparkSession, path: str, cohort: Sequence[str]) -> DataFrame:
    """The artifact's histogram over all batches."""
    return merged(spark.read.parquet(path), cohort=cohort)


def compact(spark: SparkSession, path: str, into: str, cohort: Sequence[str]) -> None:
    """All batches as one, in another place."""
    extend(spark, load(spark, path, cohort), into, "all")


def cumulated(counts: DataFrame, cohort: Sequence[str]) -> DataFrame:
    """cohort, cell, n, below (scores in lower cells), total. A cohort has as many rows as the grid has cells in use."""
    by = Window.partitionBy(*cohort).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumns({"below": F.sum("n").over(by) - F.col("n"), "total": F.sum("n").over(Window.partitionBy(*cohort))})


def quantiles(counts: DataFrame, cohort: Sequence[str], shares: Sequence[float], *, step: float = STEP) -> DataFrame:
    """cohort, share, value: the middle of the cell that holds the rank ceil(share * n), 1 at least."""
    rows = cumulated(counts, cohort).withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    rank = F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("total")))
    return rows.where((F.col("below") < rank) & (rank <= F.col("below") + F.col("n"))).select(*cohort, "share", (F.col("cell") * step).alias("value"))


def medians(counts: DataFrame, cohort: Sequence[str], *, step: float = STEP) -> DataFrame:
    """cohort, median, total: the mean of the two middle scores' cells, to one place."""
    rows = cumulated(counts, cohort)
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    holds = lambda r: ((F.col("below") <= r) & (r < F.col("below") + F.col("n"))).cast("int")
    hits = rows.withColumn("_hits", holds(low) + holds(high)).where("_hits > 0")
    return hits.groupBy(*cohort).agg(F.round(F.sum(F.col("cell") * F.col("_hits")) * step / 2, 1).alias("median"), F.max("total").alias("total"))


def with_context(scores: DataFrame, counts: DataFrame, score: str, cohort: Sequence[str], *, step: float = STEP) -> DataFrame:
    """Adds cohort_n, cohort_median and percentile (share of lower scores, half-even) from a histogram; null without a cohort.

    A score that the histogram doesn't hold itself is ranked behind all cells below its own. Only the distinct cells asked for
    are sorted, among those of the histogram; scores themselves aren't.
    """
    marks = cumulated(counts, cohort)
    at = cell(F.col(score), step)
    asked = scores.where(at.isNotNull()).select(*cohort, at.alias("cell")).distinct()
    both = asked.withColumn("_asked", F.lit(True)).unionByName(marks.select(*cohort, "cell", "n"), allowMissingColumns=True)
    lower = F.coalesce(F.sum("n").over(Window.partitionBy(*cohort).orderBy("cell").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = both.withColumn("_below", lower).where("_asked").select(*[F.col(c).alias(f"_{c}") for c in cohort], F.col("cell").alias("_cell"), "_below")
    middle = medians(counts, cohort, step=step).select(*[F.col(c).alias(f"_{c}") for c in cohort], F.col("median").alias("cohort_median"), F.col("total").alias("cohort_n"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cohort]
    drop = [f"_{c}" for c in cohort]
    # A grid's cells are few; where cohorts are many, scores meet them by shuffling.
    ranks = F.broadcast(ranks) if counts.count() <= BROADCAST_CELLS else ranks
    out = scores.withColumn("_at", at).join(ranks, [*same, F.col("_at") == F.col("_cell")], "left").drop(*drop, "_cell", "_at")
    out = out.join(F.broadcast(middle), same, "left").drop(*drop)
    share = F.bround(F.col("_below") * 100 / F.col("cohort_n"), 0).cast("int")
    return out.withColumn("percentile", F.when(F.col(score).isNotNull(), share)).drop("_below")
