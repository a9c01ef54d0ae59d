"""Rank-based validation: quintiles, rank correlation, outcomes, and pass or fail gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingforge.staging import staged

#: Row numbers within a partition take the low bits of monotonically_increasing_id().
ROW_BITS = 33


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def ranked(rows: DataFrame, value: str | Sequence[str], tie: str | None = None, name: str = "rank0") -> DataFrame:
    """Adds the global rank from 0 by the value or values, then tie (nulls first).

    Rows are dealt by ranges of all these columns and sorted; each row's place, a partition and a number in it, is written
    with the row to the shared folder, so that counts and rows can't disagree however partitions are merged. A rank is
    that number behind the rows of all partitions before it: no task sees more than its range, and one row a partition
    is broadcast.
    """
    order = [*([value] if isinstance(value, str) else value), *([tie] if tie else [])]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    kept = staged(rows.sparkSession, placed, "ranked").withColumn("_part", F.shiftright("_place", ROW_BITS))
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")).alias("_before"))
    return kept.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))).drop("_part", "_place", "_before")


def ranked_in_group(rows: DataFrame, group: Sequence[str], value: str, tie: str | None = None) -> DataFrame:
    """Adds _rank, the rank from 0 in the row's group, and _n, the group's size, from one global rank; null groups are left out."""
    r = ranked(rows, [*group, value], tie, "_rank0")
    stats = r.groupBy(*group).agg(F.min("_rank0").alias("_first"), F.count("*").alias("_n"))
    return r.join(stats, list(group)).withColumn("_rank", F.col("_rank0") - F.col("_first")).drop("_rank0", "_first")


def with_quintiles(rows: DataFrame, value: str, tie: str) -> DataFrame:
    """Adds quintile 1 to 5: min(5, floor(5 * rank / n) + 1) over finite values."""
    good = rows.where(finite(value))
    total = good.agg(F.count("*").alias("_n"))
    return ranked(good, value, tie).join(F.broadcast(total)).withColumn("quintile", F.least(F.lit(5), F.floor(F.col("rank0") * 5 / F.col("_n")) + 1).cast("int")).drop("_n", "rank0")


def quintile_monotonicity(rows: DataFrame, score: str, outcome: str, tie: str, *, min_n: int = 50, min_group: int = 5) -> DataFrame:
    """One row: n, means of the outcome in the first and last quintile, their ratio, and the verdict."""
    q = with_quintiles(rows.where(finite(score) & finite(outcome)), score, tie)
    mean = lambda k: F.avg(F.when(F.col("quintile") == k, F.col(outcome)))
    count = lambda k: F.count_if(F.col("quintile") == k)
    out = q.agg(F.count("*").alias("n"), mean(1).alias("q1_mean"), mean(5).alias("q5_mean"), count(1).alias("q1_n"), count(5).alias("q5_n"))
    enough = (F.col("n") >= min_n) & (F.col("q1_n") >= min_group) & (F.col("q5_n") >= min_group)
    return out.withColumn("q5_q1_ratio", F.when(F.col("q1_mean") != 0, F.col("q5_mean") / F.col("q1_mean"))).withColumn(
        "status", F.when(~enough, F.lit("insufficient")).when(F.col("q5_mean") > F.col("q1_mean"), F.lit("pass")).otherwise(F.lit("fail"))
    )


def spearman(rows: DataFrame, x: str, y: str, tie: str) -> DataFrame:
    """One row: n and the correlation of ordinal ranks; what the values come from is computed once, though ranges are sampled first."""
    good = staged(rows.sparkSession, rows.where(finite(x) & finite(y)).select(*dict.fromkeys((x, y, tie))), "correlated")
    return ranked(ranked(good, x, tie, "rx"), y, tie, "ry").agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho"))


def rank_gaps(rows: DataFrame, x: str, y: str, tie: str, top: int = 20) -> DataFrame:
    """The rows whose two ranks differ most (ties by the key, falling)."""
    good = rows.where(finite(x) & finite(y))
    both = ranked(ranked(good, x, tie, "rx"), y, tie, "ry").withColumn("gap", F.abs(F.col("rx") - F.col("ry")))
    return both.orderBy(F.desc("gap"), F.desc(tie)).limit(top)


def log_returns(bars: DataFrame, *, key: str = "ticker", date: str = "date", close: str = "close") -> DataFrame:
    """Adds log_return: ln(close / previous close), null without a positive previous close."""
    before = F.lag(close).over(Window.partitionBy(key).orderBy(date))
    return bars.withColumn("log_return", F.when((before > 0) & (F.col(close) > 0), F.ln(F.col(close) / before)))


def annualised_volatility(value: str = "log_return", least: int = 20, days: int = 252) -> Column:
    """Sample standard deviation times sqrt(days), null under `least` finite returns."""
    good = F.when(finite(value), F.col(value))
    return F.when(F.count(good) >= least, F.coalesce(F.stddev_samp(good), F.lit(0.0)) * F.sqrt(F.lit(float(days))))


def realised_volatility(filings: DataFrame, bars: DataFrame, *, key: str = "ticker", days: int = 90, least: int = 20) -> DataFrame:
    """key, filing_date, trading_days, realized_vol over bars from the day after filing to `days` days after it.

    A filing stands for each day of its window and meets bars by ticker and day, so it meets none outside of it, and a
    ticker with many bars is no single key. Returns start inside the window.
    """
    f = filings.select(key, "filing_date").distinct()
    window = f.select(key, "filing_date", F.explode(F.sequence(F.date_add("filing_date", 1), F.date_add("filing_date", days))).alias("date"))
    inside = window.join(bars, [key, "date"])
    before = F.lag("close").over(Window.partitionBy(key, "filing_date").orderBy("date"))
    returns = inside.withColumn("log_return", F.when((before > 0) & (F.col("close") > 0), F.ln(F.col("close") / before)))
    return returns.groupBy(key, "filing_date").agg(F.count("*").alias("trading_days"), annualised_volatility(least=least).alias("realized_vol"))


def first_after(filings: DataFrame, events: DataFrame, *, key: str = "ticker", date: str = "filing_date", event_date: str = "event_date", value: str = "value") -> DataFrame:
    """Forward as-of join: the first event strictly after each filing, null where there is none.

    Both sides go through one sort by key and time; the next event is carried backwards, so nothing multiplies.
    """
    a = filings.select(key, F.col(date).alias("_at"), F.lit(0).alias("_kind"), F.struct(*[F.col(c) for c in filings.columns]).alias("_row"), F.lit(None).cast(events.schema[event_date].dataType).alias("_date"), F.lit(None).cast(events.schema[value].dataType).alias("_value"))
    b = events.select(key, F.col(event_date).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(event_date).alias("_date"), F.col(value).alias("_value"))
    # Later rows first; on one day filings stand before events, which are not strictly after them.
    ordered = Window.partitionBy(key).orderBy(F.desc("_at"), F.asc("_kind"), F.desc("_value")).rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("_next", F.last(F.when(F.col("_kind") == 1, F.struct("_date", "_value")), ignorenulls=True).over(ordered))
    return found.where("_kind = 0").select("_row.*", F.col("_next._date").alias("next_event_date"), F.col("_next._value").alias("next_event_value"))


def medians(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """group, n, median (the mean of the two middle values) and upper_median (the value at n div 2), by global ranks."""
    r = ranked_in_group(rows.where(F.col(value).isNotNull()), group, value)
    low, high, upper = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2), F.floor(F.col("_n") / 2)
    middle = r.where((F.col("_rank") == low) | (F.col("_rank") == high))
    return middle.groupBy(*group).agg(F.max("_n").alias("n"), F.avg(value).alias("median"), F.max(F.when(F.col("_rank") == upper, F.col(value))).alias("upper_median"))


def gate(name: str, value: Column, threshold: float, n: Column, *, at_least: bool = True) -> Column:
    """A struct name, value, threshold, n, status; null values are skipped."""
    ok = value >= threshold if at_least else value <= threshold
    return F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"), F.lit(float(threshold)).alias("threshold"), n.cast("long").alias("n"), F.when(value.isNull(), F.lit("skip")).when(ok, F.lit("pass")).otherwise(F.lit("fail")).alias("status"))


def overall(gates: DataFrame, need: int | None = None) -> DataFrame:
    """One row: passed, total and whether all (or at least `need`) gates that weren't skipped pass."""
    out = gates.agg(F.count_if(F.col("status") == "pass").alias("passed"), F.count_if(F.col("status") != "skip").alias("total"))
    return out.withColumn("overall_pass", (F.col("passed") >= F.lit(need)) if need is not None else (F.col("passed") == F.col("total")) & (F.col("total") > 0))


def filter_reasons(rows: DataFrame, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """Adds reason, the first check that holds, or null for a row that passes."""
    reason = F.lit(None).cast("string")
    for name, holds in reversed(checks):
        reason = F.when(F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(reason)
    return rows.withColumn("reason", reason)


def best_weights(rows: DataFrame, a: str, b: str, target: str, tie: str, weights: Sequence[float] = (0.5, 0.6, 0.7)) -> DataFrame:
    """weight, n, rho of w * a + (1 - w) * b against the target, best first.

    The target is ranked once, the mixes of all weights in one global order by weight; what that adds to a weight's ranks
    is taken off.
    """
    good = ranked(rows.where(finite(a) & finite(b) & finite(target)).select(tie, a, b, target), target, tie, "ry")
    mixes = F.array(*[F.struct(F.lit(float(w)).alias("weight"), (F.col(a) * w + F.col(b) * (1 - w)).alias("mix")) for w in weights])
    grid = good.select(tie, "ry", F.inline(mixes))
    both = ranked_in_group(grid, ["weight"], "mix", tie)
    return both.groupBy("weight").agg(F.count("*").alias("n"), F.corr("_rank", "ry").alias("rho")).orderBy(F.desc("rho"), "weight")
