"""Rows for readers: active flags, change rows, score cards, bands, panels and corpus context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingforge.functions.term_packs import FLAG_PATTERNS
from filingforge.operators.validation import ranked_in_group

# Tiers of flags.
SERIOUS = ("material_weakness_flag", "restatement_flag", "non_reliance_flag", "going_concern_flag", "covenant_breach_flag", "cybersecurity_incident_flag")
TIERS = {"lite": ("overall_disclosure_risk_score", "score_coverage_ratio"), "standard": ("overall_disclosure_risk_score", "score_coverage_ratio", "disclosure_quality_score", "disclosure_change_risk_score"), "analyst": None}


def label(name: Column) -> Column:
    """material_weakness_flag -> Material Weakness."""
    return F.initcap(F.replace(F.regexp_replace(name, "_flag$", ""), F.lit("_"), F.lit(" ")))


def tier_of(flag: Column) -> Column:
    return F.when(flag.isin(list(SERIOUS)), F.lit("serious")).otherwise(F.lit("notable"))


def active_flags(flags: DataFrame, keys: list[str]) -> DataFrame:
    """Long rows: keys, flag, label, tier of the flags that are true."""
    names = F.array(*[F.when(F.col(f), F.lit(f)) for f in FLAG_PATTERNS])
    return flags.select(*keys, F.explode(F.array_compact(names)).alias("flag")).withColumns({"label": label(F.col("flag")), "tier": tier_of(F.col("flag"))})


def flag_summary(active: DataFrame, key: str) -> DataFrame:
    """A row a flag and filing: how many sections carry it, and which."""
    return active.groupBy(key, "flag", "label", "tier").agg(F.count_distinct("section").alias("n_sections"), F.array_join(F.array_sort(F.collect_set("section")), ",").alias("sections"))


def flag_groups(active: DataFrame, key: str) -> DataFrame:
    """A row a section and filing: its flags in order."""
    return active.groupBy(key, "section").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.count_distinct("flag").alias("n_flags"))


def change_rows(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, change score (the second where there is one), missing_reason, and the delta of the largest size."""
    deltas = F.array(*[F.struct(F.lit(-i).alias("i"), F.lit(d).alias("name"), F.col(d).alias("value")) for i, d in enumerate(("negative_language_delta", "uncertainty_language_delta", "legal_language_delta", "constraining_language_delta"))])
    top = F.array_max(F.transform(F.filter(deltas, lambda d: d["value"].isNotNull()), lambda d: F.struct(F.abs(d["value"]).alias("size"), d["i"].alias("i"), d["name"].alias("name"), d["value"].alias("value"))))
    return diffs.select(*keys, F.coalesce("change_v2", "change_v1").alias("change_score"), F.when(F.col("change_v1").isNull(), F.lit("no_prior")).alias("missing_reason"), top["name"].alias("top_delta"), top["value"].alias("top_delta_value"))


def risk_band(score: Column, *, inverted: bool = False) -> Column:
    """low, moderate, elevated or high by quarters; missing for null."""
    s = 100 - score if inverted else score
    return F.when(score.isNull(), F.lit("missing")).when(s <= 25, F.lit("low")).when(s <= 50, F.lit("moderate")).when(s <= 75, F.lit("elevated")).otherwise(F.lit("high"))


def score_card(scores: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """Long rows: key, component, label, weight_pct, score, band."""
    rows = F.array(*[F.struct(F.lit(c).alias("component"), F.lit(round(w * 100, 4)).alias("weight_pct"), F.col(c).cast("double").alias("score")) for c, w in weights.items()])
    return scores.select(key, F.inline(rows)).withColumns({"label": label(F.regexp_replace("component", "_score$", "")), "band": risk_band(F.col("score")), "score": F.round("score", 6)})


def panel_summary(panel: DataFrame) -> DataFrame:
    """status, n: how many requests were answered and how many failed."""
    return panel.groupBy("status").agg(F.count("*").alias("n"))


def panel(requests: DataFrame, scores: DataFrame, *, key: str = "filing_id") -> DataFrame:
    """Requests in their order with score, status and error; a request that can't be answered is a row, not a failure."""
    out = requests.join(scores.withColumn("_found", F.lit(True)), key, "left")
    return out.withColumns({"status": F.when(F.col("_found"), F.lit("ok")).otherwise(F.lit("error")), "error": F.when(F.col("_found").isNull(), F.lit("not found"))}).drop("_found").orderBy("ordinal")


def corpus_context(scores: DataFrame, score: str, group: list[str]) -> DataFrame:
    """Adds n, median and strict percentile (half-even) of each score in its cohort, by global ranks."""
    good = ranked_in_group(scores.where(F.col(score).isNotNull()), group, score)
    below = good.groupBy(*group, score).agg(F.min("_rank").alias("_below"))
    n = F.col("_n")
    middle = good.where((F.col("_rank") == F.floor((n - 1) / 2)) | (F.col("_rank") == F.floor(n / 2)))
    median = middle.groupBy(*group).agg(F.round(F.avg(score), 1).alias("cohort_median"))
    out = good.join(below, [*group, score]).join(median, group).withColumn("percentile", F.bround(F.col("_below") * 100 / n, 0).cast("int"))
    return out.withColumnRenamed("_n", "cohort_n").drop("_below", "_rank")


def preset(scores: DataFrame, keys: list[str], tier: str) -> DataFrame:
    """The columns of a tier; analyst has all."""
    columns = TIERS[tier]
    return scores if columns is None else scores.select(*keys, *columns)
