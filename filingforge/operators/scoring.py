"""Component and headline scores of filings from section rows.

Sections are pivoted to one row a filing in a single shuffle. A component is a list of weighted signals over that row;
its score is their weighted mean over the signals that are not null, and null where all are. The same lists, unpivoted,
are the evidence table, so provenance is what was scored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingforge.functions.term_packs import DENSITIES, FLAG_PATTERNS
from filingforge.functions.text import clamp

# Weights of the headline, points and cohorts of calibration.
WEIGHTS = {
    "risk_factor_intensity_score": 0.20,
    "disclosure_change_score": 0.15,
    "mdna_uncertainty_score": 0.15,
    "legal_regulatory_risk_score": 0.10,
    "liquidity_stress_score": 0.10,
    "boilerplate_risk_score": 0.10,
    "internal_controls_risk_score": 0.05,
    "event_severity_score": 0.05,
    "tone_negativity_score": 0.05,
}
DECILES = {
    ("", "10-K", "negative_word_ratio"): (0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08, 0.10, 0.12, 0.15),
    ("", "10-K", "uncertainty_word_ratio"): (0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.09, 0.11, 0.14),
    ("", "10-K", "boilerplate_phrase_ratio"): (0.02, 0.04, 0.06, 0.08, 0.10, 0.12, 0.14, 0.16, 0.18, 0.22),
    ("", "10-K", "boilerplate_combined_ratio"): (0.03, 0.06, 0.09, 0.12, 0.15, 0.18, 0.21, 0.24, 0.27, 0.32),
    ("", "10-K", "readability_score"): (20.0, 30.0, 35.0, 40.0, 45.0, 50.0, 55.0, 60.0, 65.0, 75.0),
    ("", "10-Q", "negative_word_ratio"): (0.008, 0.015, 0.025, 0.035, 0.045, 0.055, 0.07, 0.09, 0.11, 0.13),
    ("", "10-Q", "uncertainty_word_ratio"): (0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08, 0.10, 0.12, 0.15),
    ("financials", "10-K", "negative_word_ratio"): (0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.09, 0.11, 0.13, 0.16),
    ("healthcare", "10-K", "uncertainty_word_ratio"): (0.02, 0.03, 0.04, 0.05, 0.06, 0.08, 0.10, 0.12, 0.14, 0.18),
}
WARNING_PENALTIES = {"short_section": 0.08, "sec_parser_unavailable": 0.10, "extraction_suspect": 0.12, "last_resort_extraction": 0.12}

RISKS, LEGAL_10K, LEGAL_10Q = "item_1a_risk_factors", "item_3_legal_proceedings", "item_1_legal_proceedings"
MDNA_10K, MDNA_10Q, CONTROLS_10K, CONTROLS_10Q = "item_7_mdna", "item_2_mdna", "item_9a_controls", "item_4_controls"
EVENTS = ("item_1_01", "item_1_05", "item_2_02", "item_5_02", "item_8_01")
SECTIONS = (RISKS, LEGAL_10K, LEGAL_10Q, MDNA_10K, MDNA_10Q, CONTROLS_10K, CONTROLS_10Q, *EVENTS)
LEGAL = (RISKS, LEGAL_10K, LEGAL_10Q)
CYBER = ("item_1_05", "item_8_01", RISKS)
IC_FLAGS = ("material_weakness_flag", "restatement_flag", "ineffective_controls_flag")
LEGAL_FLAGS = ("investigation_flag", "material_legal_proceeding_flag")
LIQUIDITY_FLAGS = ("going_concern_flag", "covenant_breach_flag")
EVENT_FLAGS = (*LEGAL_FLAGS, "going_concern_flag", "guidance_withdrawal_flag", "cybersecurity_incident_flag")
STATIC_RISK = ("tone_negativity_score", "boilerplate_risk_score", "mdna_uncertainty_score", "legal_regulatory_risk_score", "liquidity_stress_score", "internal_controls_risk_score")

_METRICS = {
    RISKS: ("negative_word_ratio", "uncertainty_word_ratio", "litigious_word_ratio", "constraining_word_ratio", "boilerplate_combined_ratio", "numeric_specificity_score", "company_specificity_score"),
    **dict.fromkeys((MDNA_10K, MDNA_10Q), ("uncertainty_word_ratio", "modal_word_ratio", "constraining_word_ratio", "readability_score", *DENSITIES)),
    **dict.fromkeys((LEGAL_10K, LEGAL_10Q), ("litigious_word_ratio",)),
    **dict.fromkeys(EVENTS, ("uncertainty_word_ratio",)),
}
_DELTAS = {"uncertainty_language_delta": (RISKS, MDNA_10K, MDNA_10Q), "legal_language_delta": LEGAL}


@dataclass(frozen=True)
class ScoringConfig:
    """Weights, the points a flag adds in model 1, what a flag counts as evidence in model 2, and the cohort."""

    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    flag_points: float = 15.0
    flag_evidence: float = 65.0
    form_type: str = "10-K"
    sector: str = ""

    def __post_init__(self):
        if set(self.weights) != set(WEIGHTS) or any(w <= 0 for w in self.weights.values()):
            raise ValueError("a positive weight is needed for each component, and for no other")
        if not (0 <= self.flag_points <= 100 and 0 <= self.flag_evidence <= 100):
            raise ValueError("points lie between 0 and 100")


@dataclass(frozen=True)
class Signal:
    """A named value from 0 to 100 (or null) with its weight and the section it comes from."""

    name: str
    value: Column
    weight: float
    section: str | Column | None = None


def weighted_mean(values: Sequence[tuple[Column, float]]) -> Column:
    """Over the values that are not null; null where all are."""
    total = sum((F.when(v.isNotNull(), F.lit(float(w))).otherwise(F.lit(0.0)) for v, w in values), F.lit(0.0))
    part = sum((F.coalesce(v.cast("double") * F.lit(float(w)), F.lit(0.0)) for v, w in values), F.lit(0.0))
    return F.when(total > 0, part / total)


def filing_rows(sections: DataFrame, diffs: DataFrame | None = None, *, key: str = "filing_id", with_diffs: bool = False) -> DataFrame:
    """One row a filing: metrics by section, merged flags, the first section of each flag, diffs and deltas.

    sections: key, section, section_ord, metrics, flags and densities. diffs: key, section, change_v1, change_v2,
    uncertainty_language_delta, legal_language_delta; sections without a prior have none. with_diffs: they stand in sections.
    """
    with_diffs = with_diffs or diffs is not None
    joined = sections if diffs is None else sections.join(diffs, [key, "section"], "left")
    at = lambda s, c: F.max(F.when(F.col("section") == s, F.col(c)))
    out = [F.max((F.col("section") == s).cast("int")).alias(f"has.{s}") for s in SECTIONS]
    out += [at(s, m).cast("double").alias(f"{m}@{s}") for s, names in _METRICS.items() for m in names]
    out += [F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in FLAG_PATTERNS]
    out += [F.min_by(F.when(F.col(f), F.col("section")), F.when(F.col(f), F.col("section_ord"))).alias(f"first.{f}") for f in FLAG_PATTERNS]
    for version in ("change_v1", "change_v2"):
        out += [(at(s, version) if with_diffs else F.lit(None)).cast("double").alias(f"{version}@{s}") for s in SECTIONS]
    for delta, names in _DELTAS.items():
        part = F.avg(F.when(F.col("section").isin(list(names)) & F.col(delta).isNotNull(), F.greatest(F.lit(0.0), F.col(delta)))) if with_diffs else F.lit(None)
        out.append(part.cast("double").alias(delta))
    return joined.groupBy(key).agg(*out)


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _mdna(metric: str) -> Column:
    return F.when(_c(f"has.{MDNA_10K}") == 1, _c(f"{metric}@{MDNA_10K}")).when(_c(f"has.{MDNA_10Q}") == 1, _c(f"{metric}@{MDNA_10Q}"))


def _any(flags: Sequence[str]) -> Column:
    out = F.lit(False)
    for flag in flags:
        out = out | F.col(flag)
    return out


def percentile_rank(value: Column, references: Sequence[float]) -> Column:
    """Mid-rank percentile among the references."""
    refs = F.lit(list(map(float, references)))
    below, equal = F.size(F.filter(refs, lambda r: r < value)), F.size(F.filter(refs, lambda r: r == value))
    return F.when(value.isNotNull(), (below + equal * 0.5) * 100 / len(references))


def lookup_baseline(rows: DataFrame, baselines: DataFrame, *, metric: str = "metric") -> DataFrame:
    """rows (metric, form_type, sector, fiscal_year) left-joined with the closest cohort: references, cohort, mean, std, n.

    baselines: metric, form_type, sector and fiscal_year (null: any), references (array). A cohort of sector, form and
    year comes before sector and form, then form and year, then the form; the table is a row a cohort and metric.
    """
    levels = (("sector", "fiscal_year"), ("sector",), ("fiscal_year",), ())
    out = rows.withColumn("_sector", F.lower(F.trim("sector")))
    for i, used in enumerate(levels):
        own = baselines.where(F.col("sector").isNotNull() if "sector" in used else F.col("sector").isNull()).where(F.col("fiscal_year").isNotNull() if "fiscal_year" in used else F.col("fiscal_year").isNull())
        own = own.select(F.col("metric").alias("_m"), F.col("form_type").alias("_f"), F.lower("sector").alias("_s"), F.col("fiscal_year").alias("_y"), F.col("references").alias(f"_refs{i}"))
        on = (F.col(metric) == F.col("_m")) & (F.coalesce("form_type", F.lit("10-K")) == F.col("_f"))
        if "sector" in used:
            on = on & (F.col("_sector") == F.col("_s"))
        if "fiscal_year" in used:
            on = on & (F.col("fiscal_year") == F.col("_y"))
        out = out.join(own, on, "left").drop("_m", "_f", "_s", "_y")
    form = F.coalesce("form_type", F.lit("10-K"))
    year = F.col("fiscal_year").cast("string")
    names = (F.concat_ws(":", "_sector", form, year), F.concat_ws(":", "_sector", form), F.concat_ws(":", form, year), form)
    cohort = F.coalesce(*[F.when(F.col(f"_refs{i}").isNotNull(), names[i]) for i in range(4)])
    out = out.withColumns({"references": F.coalesce(*[F.col(f"_refs{i}") for i in range(4)]), "cohort": cohort}).drop("_sector", *[f"_refs{i}" for i in range(4)])
    return out.withColumns(reference_stats(F.col("references")))


def reference_stats(references: Column) -> dict[str, Column]:
    """n, mean and sample deviation of an array of references; null where there are too few."""
    n = F.size(references)
    mean = F.aggregate(references, F.lit(0.0), lambda acc, x: acc + x) / n
    squares = F.aggregate(F.transform(references, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda acc, x: acc + x)
    return {"n": F.when(references.isNotNull(), n), "mean": F.when(n > 0, mean), "std": F.when(n > 1, F.sqrt(squares / (n - 1)))}


def calibrated(metric: str, value: Column, config: ScoringConfig) -> Column:
    """The percentile in the cohort: sector and form, else form; without one, ratios count in hundredths."""
    references = DECILES.get((config.sector.lower(), config.form_type, metric)) or DECILES.get(("", config.form_type, metric))
    if references:
        return percentile_rank(value, references)
    return clamp(value * 100) if metric.endswith("_ratio") else clamp(value)


def _change(version: str) -> tuple[Column, Column, Column]:
    mdna = F.coalesce(_c(f"{version}@{MDNA_10K}"), _c(f"{version}@{MDNA_10Q}"))
    controls = F.coalesce(_c(f"{version}@{CONTROLS_10K}"), _c(f"{version}@{CONTROLS_10Q}"))
    return _c(f"{version}@{RISKS}"), mdna, controls


def signals_v1() -> dict[str, list[Signal]]:
    """Signals of the first model."""
    d_risks, d_mdna, d_controls = _change("change_v1")
    risk = lambda m: _c(f"{m}@{RISKS}")
    return {
        "risk_factor_intensity_score": [
            Signal("negative_word_ratio", risk("negative_word_ratio") * 100, 0.375, RISKS), Signal("uncertainty_word_ratio", risk("uncertainty_word_ratio") * 100, 0.375, RISKS), Signal("diff_1a", d_risks, 0.25, RISKS),
        ],
        "disclosure_change_score": [Signal("diff_1a", d_risks, 0.6, RISKS), Signal("diff_mdna", d_mdna, 0.4)],
        "mdna_uncertainty_score": [
            Signal("uncertainty_word_ratio", _mdna("uncertainty_word_ratio") * 100, 0.40), Signal("modal_word_ratio", _mdna("modal_word_ratio") * 100, 0.35), Signal("readability_score", _mdna("readability_score"), 0.25),
            Signal("uncertainty_term_density", _mdna("uncertainty_term_density"), 0.10), Signal("demand_softness_density", _mdna("demand_softness_density"), 0.05), Signal("margin_pressure_density", _mdna("margin_pressure_density"), 0.05),
        ],
        "legal_regulatory_risk_score": [Signal("litigious_word_ratio", risk("litigious_word_ratio") * 100, 0.70, RISKS), Signal("legal_language_delta", F.col("legal_language_delta"), 0.30)],
        "liquidity_stress_score": [Signal("constraining_word_ratio", _mdna("constraining_word_ratio") * 100, 0.50), Signal("liquidity_constraint_density", _mdna("liquidity_constraint_density"), 0.35)],
        "boilerplate_risk_score": [
            Signal("boilerplate_combined_ratio", risk("boilerplate_combined_ratio") * 100, 1 / 3, RISKS), Signal("numeric_specificity_score", 100 - risk("numeric_specificity_score"), 1 / 3, RISKS),
            Signal("company_specificity_score", 100 - risk("company_specificity_score"), 1 / 3, RISKS),
        ],
        "internal_controls_risk_score": [Signal("diff_controls", d_controls, 0.6), Signal("constraining_word_ratio", risk("constraining_word_ratio") * 100, 0.4, RISKS)],
        "event_severity_score": [Signal("diff_1a", d_risks, 1.0, RISKS)],
        "specificity_quality_score": [Signal("numeric_specificity_score", risk("numeric_specificity_score"), 0.5, RISKS), Signal("company_specificity_score", risk("company_specificity_score"), 0.5, RISKS)],
        "tone_negativity_score": [Signal("negative_word_ratio", risk("negative_word_ratio") * 100, 0.5, RISKS), Signal("uncertainty_word_ratio", _mdna("uncertainty_word_ratio") * 100, 0.5)],
    }


#: Components that are null without risk factors, and flags that add points to a component.
NEED_RISKS = ("risk_factor_intensity_score", "legal_regulatory_risk_score", "boilerplate_risk_score")
BOOSTS = {"mdna_uncertainty_score": ("guidance_withdrawal_flag",), "legal_regulatory_risk_score": LEGAL_FLAGS, "liquidity_stress_score": LIQUIDITY_FLAGS, "internal_controls_risk_score": IC_FLAGS}


def signals_v2(config: ScoringConfig) -> dict[str, list[Signal]]:
    """Signals of the second model where they differ from the first's."""
    # A filing with any second-version diff uses these throughout.
    has_v2 = F.coalesce(*[_c(f"change_v2@{s}") for s in SECTIONS]).isNotNull()
    pick = lambda a, b: F.when(has_v2, a).otherwise(b)
    d_risks, d_mdna, d_controls = (pick(a, b) for a, b in zip(_change("change_v2"), _change("change_v1"), strict=True))
    flag = lambda f, w: Signal(f, F.when(F.col(f), F.lit(config.flag_evidence)), w, _c(f"first.{f}"))
    placed = lambda f, w, where: Signal(f, F.when(F.col(f) & _c(f"first.{f}").isin(list(where)), F.lit(config.flag_evidence)), w, _c(f"first.{f}"))
    events = [placed(f, 0.45, EVENTS) for f in EVENT_FLAGS]
    for s in EVENTS:
        events += [Signal(f"uncertainty_{s}", _c(f"uncertainty_word_ratio@{s}") * 100, 0.25, s), Signal(f"diff_{s}", pick(_c(f"change_v2@{s}"), _c(f"change_v1@{s}")), 0.20, s)]
    return {
        "risk_factor_intensity_score": [
            Signal("negative_word_ratio", calibrated("negative_word_ratio", _c(f"negative_word_ratio@{RISKS}"), config), 0.375, RISKS),
            Signal("uncertainty_word_ratio", calibrated("uncertainty_word_ratio", _c(f"uncertainty_word_ratio@{RISKS}"), config), 0.375, RISKS),
            Signal("diff_1a", d_risks, 0.25, RISKS),
        ],
        "disclosure_change_score": [Signal("diff_1a", d_risks, 0.6, RISKS), Signal("diff_mdna", d_mdna, 0.4)],
        "legal_regulatory_risk_score": [
            *[Signal(f"litigious_word_ratio_{s}", _c(f"litigious_word_ratio@{s}") * 100, 0.5 if s == RISKS else 0.35, s) for s in LEGAL],
            Signal("legal_language_delta", F.col("legal_language_delta"), 0.30), *[flag(f, 0.5) for f in LEGAL_FLAGS],
        ],
        "liquidity_stress_score": [
            Signal("constraining_word_ratio_mdna", _mdna("constraining_word_ratio") * 100, 0.50), Signal("liquidity_constraint_density", _mdna("liquidity_constraint_density"), 0.35),
            Signal("constraining_word_ratio_1a", _c(f"constraining_word_ratio@{RISKS}") * 100, 0.25, RISKS), *[flag(f, 0.5) for f in LIQUIDITY_FLAGS],
        ],
        "internal_controls_risk_score": [Signal("diff_controls", d_controls, 0.6), Signal("constraining_word_ratio", _c(f"constraining_word_ratio@{RISKS}") * 100, 0.4, RISKS), *[flag(f, 0.5) for f in IC_FLAGS]],
        "event_severity_score": [],
        "cybersecurity_incident_risk_score": [placed("cybersecurity_incident_flag", 0.7, CYBER)],
        "event_materiality_score": events,
    }


def component_scores(filings: DataFrame, config: ScoringConfig | None = None, *, model: int = 2) -> DataFrame:
    """Adds component scores, the headline, coverage, missing components and split aggregates to filing_rows()."""
    config = config or ScoringConfig()
    signals = signals_v1() | (signals_v2(config) if model == 2 else {"cybersecurity_incident_risk_score": [], "event_materiality_score": []})
    second = set(signals_v2(config)) if model == 2 else set()
    scores = {}
    for name, parts in signals.items():
        value = weighted_mean([(s.value, s.weight) for s in parts]) if parts else F.lit(None).cast("double")
        if name in NEED_RISKS and (name not in second or name == "risk_factor_intensity_score"):
            value = F.when(_c(f"has.{RISKS}") == 1, value)
        if name in BOOSTS and name not in second:
            value = F.when(value.isNotNull(), F.least(F.lit(100.0), value + F.when(_any(BOOSTS[name]), F.lit(float(config.flag_points))).otherwise(F.lit(0.0))))
        if name == "disclosure_change_score":
            value = F.when(value.isNotNull(), F.least(F.lit(100.0), value + F.coalesce(F.col("uncertainty_language_delta") * 0.1, F.lit(0.0))))
        scores[name] = clamp(value)
    df = filings.withColumns(scores)
    present = F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in config.weights])
    quality = F.coalesce(F.col("specificity_quality_score"), clamp(100 - F.col("boilerplate_risk_score")))
    return df.withColumns({
        "overall_disclosure_risk_score": clamp(weighted_mean([(F.col(c), w) for c, w in config.weights.items()])),
        "score_coverage_ratio": F.size(F.filter(present, lambda x: x.isNotNull())) / F.lit(float(len(config.weights))),
        "missing_components": F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in config.weights])),
        "disclosure_quality_score": quality,
        "static_disclosure_quality_score": quality,
        "disclosure_deterioration_score": F.col("disclosure_change_score"),
        "static_disclosure_risk_score": clamp(weighted_mean([(F.col(c), 1.0) for c in STATIC_RISK])),
        "disclosure_change_risk_score": clamp(weighted_mean([(F.col("disclosure_change_score"), 1.0), (F.col("event_severity_score"), 1.0)])),
    })


COMPONENTS = (*WEIGHTS, "specificity_quality_score", "cybersecurity_incident_risk_score", "event_materiality_score")
AGGREGATES = ("overall_disclosure_risk_score", "score_coverage_ratio", "disclosure_quality_score", "disclosure_deterioration_score", "static_disclosure_risk_score", "disclosure_change_risk_score")


def evidence(filings: DataFrame, config: ScoringConfig | None = None, *, model: int = 2, key: str = "filing_id") -> DataFrame:
    """Long provenance: key, component, name, value, weight, section of every signal that is not null."""
    config = config or ScoringConfig()
    signals = signals_v1() | (signals_v2(config) if model == 2 else {})
    rows = []
    for component, parts in signals.items():
        for s in parts:
            section = s.section if isinstance(s.section, Column) else F.lit(s.section).cast("string")
            rows.append(F.struct(F.lit(component).alias("component"), F.lit(s.name).alias("name"), s.value.cast("double").alias("value"), F.lit(float(s.weight)).alias("weight"), section.alias("section")))
    return filings.select(key, F.inline(F.array(*rows))).where(F.col("value").isNotNull())


def _equals(value: str):
    return lambda x: x == value


def confidence(scores: DataFrame, *, extraction: Column, diff: Column, warnings: Column, required_present: Column, has_prior: Column) -> DataFrame:
    """Adds confidence_base, confidence_penalty and confidence_score.

    extraction, diff: mean confidences (null: none); warnings: an array of names, each counted.
    """
    coverage = F.col("score_coverage_ratio")
    penalty = F.when(~required_present, F.lit(0.25)).otherwise(F.lit(0.0)) + F.when(~has_prior, F.lit(0.10)).otherwise(F.lit(0.0))
    for name, points in WARNING_PENALTIES.items():
        penalty = penalty + F.size(F.filter(warnings, _equals(name))) * F.lit(points)
    penalty = penalty + F.when(coverage < 0.75, F.least(F.lit(0.20), (0.75 - coverage) * 0.4)).otherwise(F.lit(0.0))
    base = weighted_mean([(extraction, 1.0), (coverage, 1.0), (diff, 1.0)])
    return scores.withColumn("confidence_base", F.coalesce(base, F.lit(0.3))).withColumn("confidence_penalty", penalty).withColumn(
        "confidence_score", F.round(clamp(F.col("confidence_base") - F.col("confidence_penalty"), 0, 1), 6)
    )


def robust_z(value: Column, refs: Column) -> Column:
    """Against the upper median and its absolute deviations."""
    median = F.element_at(F.sort_array(refs), (F.size(refs) / 2).cast("int") + 1)
    spread = F.sort_array(F.transform(refs, lambda r: F.abs(r - median)))
    mad = F.element_at(spread, (F.size(refs) / 2).cast("int") + 1)
    return F.when(F.size(refs) < 2, F.lit(0.0)).otherwise((value - median) / (1.4826 * F.when(mad == 0, F.lit(1e-9)).otherwise(mad)))


def winsorized(value: Column, refs: Column, low: float = 0.05, high: float = 0.95) -> Column:
    """0 to 100 between two quantiles by index; 50 where they coincide."""
    ordered, last = F.sort_array(refs), F.size(refs) - 1
    a, b = F.element_at(ordered, (last * low).cast("int") + 1), F.element_at(ordered, (last * high).cast("int") + 1)
    return F.when(F.size(refs) < 2, value).when(b <= a, F.lit(50.0)).otherwise((F.greatest(a, F.least(b, value)) - a) * 100 / (b - a))
