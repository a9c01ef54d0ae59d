"""Validation reports: gates over corpora, score against outcomes, agreement with references, coverage of a universe."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingforge.functions.term_packs import FLAG_PATTERNS, FORM_PATTERNS, TOPICS, form_base
from filingforge.operators import metrics, scoring, validation

#: Thresholds of the gates.
MATRIX = {"extraction_rate": 0.5, "median_confidence": 0.6, "component_coverage": 0.4}
EDGAR = {"E1_fetch_rate": 0.90, "E2_analysis_rate": 0.85, "E3_filter_retention": 0.85, "E4_median_confidence": 0.75, "E5_min_analysis_n": 80}
#: Words and confidence of a section that is good for analysis, and tickers that a report lists.
ANALYSIS_WORDS, ANALYSIS_CONFIDENCE, LISTED = 200, 0.75, 50


def _gates(facts: DataFrame, rules: Mapping[str, tuple[Column, float | None]]) -> DataFrame:
    """One row of facts as a row a gate: a value that is missing fails; without a threshold a value passes."""
    rows = [
        F.struct(F.lit(name).alias("name"), validation_round(value).alias("value"), F.lit(limit).cast("double").alias("threshold"), F.when(value.isNotNull() & (F.lit(True) if limit is None else value >= limit), F.lit("pass")).otherwise(F.lit("fail")).alias("status"))
        for name, (value, limit) in rules.items()
    ]
    return facts.select(F.inline(F.array(*rows)))


def validation_round(value: Column) -> Column:
    return F.round(value.cast("double"), 4)


def matrix_gates(sections: DataFrame, scores: DataFrame, *, key: str = "filing_id", components: tuple[str, ...] = scoring.COMPONENTS, limits: dict[str, float] | None = None) -> DataFrame:
    """Gates of a corpus of filings: it isn't empty, required sections are there, their median confidence, scored components.

    sections: key, form_type, section, text, extraction_confidence; scores: a row a filing. The median is the value at n
    div 2 of the sorted confidences.
    """
    limits = MATRIX | (limits or {})
    # All sections that a form has count.
    wanted = F.create_map(*[x for form, names in FORM_PATTERNS.items() for x in (F.lit(form), F.array(*map(F.lit, names)))])
    base = F.coalesce(F.try_element_at(wanted, F.upper(F.regexp_replace("form_type", "[/-]A$", ""))), F.try_element_at(wanted, F.lit("10-K")))
    hit = F.array_contains(base, F.col("section")) & (F.trim(F.coalesce("text", F.lit(""))) != "")
    by_filing = sections.withColumn("_hit", hit).groupBy(key).agg(F.count_if("_hit").alias("hits"), F.max(F.size(base)).alias("need"))
    rate = by_filing.agg(F.count("*").alias("n"), (F.sum("hits") / F.sum("need")).alias("rate"))
    middle = validation.medians(sections.withColumn("_hit", hit).where("_hit").select(F.lit(1).alias("one"), F.col("extraction_confidence").cast("double").alias("c")), ["one"], "c").select(F.col("upper_median").alias("median"))
    share = scores.agg(sum((F.avg(F.col(c).isNotNull().cast("double")) for c in components), F.lit(0.0)).alias("total"), F.count("*").alias("scored"))
    facts = rate.join(middle, how="left", on=F.lit(True)).join(share, how="left", on=F.lit(True))  # one row each
    return _gates(facts, {
        "non_empty_corpus": (F.when(F.col("n") > 0, F.col("n")), None),
        "required_section_extraction_rate": (F.coalesce("rate", F.lit(0.0)), limits["extraction_rate"]),
        "median_extraction_confidence": (F.coalesce("median", F.lit(0.0)), limits["median_confidence"]),
        "component_coverage": (F.when(F.col("scored") > 0, F.col("total") / len(components)), limits["component_coverage"]),
    })


def edgar_gates(rows: DataFrame, *, universe_expected: int, n_input: int, limits: dict[str, float] | None = None, confidence: str = "extraction_confidence") -> DataFrame:
    """E1 to E5 over the rows that are left for analysis: fetched, analysed and retained shares, median confidence, rows."""
    limits = EDGAR | (limits or {})
    middle = validation.medians(rows.select(F.lit(1).alias("one"), F.col(confidence).cast("double").alias("c")), ["one"], "c").select("median")
    facts = rows.agg(F.count("*").alias("n")).join(middle, how="left", on=F.lit(True))
    share = lambda part, whole: (part / F.lit(float(whole))) if whole else F.lit(None).cast("double")
    values = (share(F.lit(float(n_input)), universe_expected), share(F.col("n"), universe_expected), share(F.col("n"), n_input), F.col("median"), F.col("n").cast("double"))
    return _gates(facts, {name: (v, limits[name]) for name, v in zip(EDGAR, values, strict=True)})


def coverage(rows: DataFrame, universe: DataFrame, *, key: str = "ticker", listed: int = LISTED) -> DataFrame:
    """One row: expected, present and missing tickers counted, and the first missing ones by name."""
    have, want = (x.select(F.upper(key).alias("t")).where("t IS NOT NULL").distinct() for x in (rows, universe))
    marked = want.join(have.withColumn("here", F.lit(True)), "t", "left")
    counts = marked.agg(F.count("*").alias("expected"), F.count("here").alias("present"))
    names = marked.where("here IS NULL").select("t").orderBy("t").limit(listed).agg(F.sort_array(F.collect_list("t")).alias("missing"))
    return counts.join(names, how="left", on=F.lit(True)).withColumn("n_missing", F.col("expected") - F.col("present"))


def with_outcomes(outcomes: DataFrame, scores: DataFrame, *, key: str = "ticker") -> DataFrame:
    """Outcomes with the scores of their tickers, by upper-cased name, null where there are none."""
    own = scores.withColumn("_t", F.upper(key)).drop(key)
    return outcomes.withColumn("_t", F.upper(key)).join(own, "_t", "left").drop("_t")


def outcomes_report(joined: DataFrame, *, tie: str = "ticker", min_n: int = 50, min_group: int = 5) -> DataFrame:
    """Two monotonicity rows: volatility by overall score, and earnings surprise by change score (skipped where none is scored)."""
    out = None
    for name, score, outcome in (("volatility_vs_overall", "overall_disclosure_risk_score", "realized_vol_90d"), ("earnings_surprise_vs_change", "disclosure_change_score", "earnings_surprise_abs")):
        part = validation.quintile_monotonicity(joined, score, outcome, tie, min_n=min_n, min_group=min_group).withColumn("name", F.lit(name))
        if score == "disclosure_change_score":
            part = part.withColumn("status", F.when(F.col("n") == 0, F.lit("skipped")).otherwise(F.col("status")))
        out = part if out is None else out.unionByName(part)
    return out


def construct_report(rows: DataFrame, pairs: dict[str, tuple[str, str]], *, tie: str = "ticker") -> DataFrame:
    """A row a pair of columns: name, n and rank correlation of our metric with a reference."""
    out = None
    for name, (ours, theirs) in pairs.items():
        part = validation.spearman(rows, ours, theirs, tie).withColumn("name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def corpus_rows(sections: DataFrame, *, section: str = "item_1a_risk_factors", min_words: int = ANALYSIS_WORDS, min_confidence: float = ANALYSIS_CONFIDENCE) -> DataFrame:
    """Rows of a one-section corpus with their quality tier: analysis, or extracted alone."""
    good = (F.col("word_count") >= min_words) & (F.col("extraction_confidence") >= min_confidence)
    own = sections.where(F.col("section") == section).withColumn("quality_tier", F.when(good, F.lit("analysis")).otherwise(F.lit("extracted")))
    return own.withColumnsRenamed({"section": "section_name", "text": "cleaned_text"})


def missing_reasons(requests: DataFrame, filings: DataFrame, rows: DataFrame, *, key: str = "ticker") -> DataFrame:
    """Requests without a corpus row and why: no filing was found, or it has no such section."""
    found, built = filings.select(key, F.lit(True).alias("_f")).distinct(), rows.select(key, F.lit(True).alias("_r")).distinct()
    left = requests.join(found, key, "left").join(built, key, "left").where("_r IS NULL")
    return left.withColumn("reason", F.when(F.col("_f").isNull(), F.lit("filing_not_found")).otherwise(F.lit("no_section"))).drop("_f", "_r")


def score_corpus(rows: DataFrame, *, key: str = "ticker", form_type: str = "10-K", model: int = 2) -> DataFrame:
    """Scores of corpus rows (key, section, section_ord, text), a row a filing: the whole model over the sections there are."""
    parts = metrics.with_text_parts(rows.select(key, "section", "section_ord", "text"))
    filings = scoring.filing_rows(metrics.section_densities(metrics.section_flags(metrics.section_metrics(parts))), key=key)
    return scoring.component_scores(filings, scoring.ScoringConfig(form_type=form_base(form_type)), model=model)


#: Versions that may differ without a report being stale.
LENIENT = ("metrics_engine_version", "dictionary_version")


def stale_versions(reports: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, key, reported, expected, problem): reports: path, versions (map); expected: path, versions (map)."""
    want = expected.select("path", F.explode("versions").alias("key", "expected"))
    have = reports.select("path", F.col("versions").alias("_v"))
    both = want.join(have, "path", "left").withColumn("reported", F.try_element_at("_v", "key"))
    problem = F.when(F.col("_v").isNull(), F.lit("missing report")).when(F.col("reported").isNull(), F.lit("missing version")).when((F.col("reported") != F.col("expected")) & ~F.col("key").isin(*LENIENT), F.lit("stale version"))
    return both.withColumn("problem", problem).where("problem IS NOT NULL").drop("_v")


def taxonomy(spark) -> DataFrame:
    """(kind, name, scope): sections by form, components, flags and topics that results can name."""
    rows = [("section", s, f) for f, names in FORM_PATTERNS.items() for s in names]
    rows += [("component", c, None) for c in scoring.COMPONENTS] + [("flag", f, None) for f in FLAG_PATTERNS] + [("topic", t, None) for t in TOPICS]
    return spark.createDataFrame(rows, "kind string, name string, scope string")
