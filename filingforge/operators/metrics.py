"""Metrics, flags and densities of sections: narrow transformations, no shuffle."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingforge.functions import text as T
from filingforge.functions.term_packs import MDNA_SECTIONS, TermPacks

#: Token packs behind each ratio.
RATIO_PACKS = {
    "negative_word_ratio": "negative",
    "uncertainty_word_ratio": "uncertainty",
    "litigious_word_ratio": "litigious",
    "constraining_word_ratio": "constraining",
    "modal_word_ratio": "modal",
    "weak_modal_word_ratio": "weak_modal",
    "moderate_modal_word_ratio": "moderate_modal",
    "strong_modal_word_ratio": "strong_modal",
}
#: Weights of the phrase ratio and the cross-firm ratio in the combined boilerplate ratio.
BOILERPLATE_BLEND = (0.4, 0.6)


def with_text_parts(sections: DataFrame, text: str = "text", parts: tuple[str, ...] = ("tokens", "sentences")) -> DataFrame:
    """Adds lower and the parts, which everything else reads; each text is taken apart once.

    Parts are computed whether they are read or not: flags need no tokens, densities no sentences.
    """
    safe = F.coalesce(F.col(text), F.lit(""))
    lowered = T.once(sections, {text: safe, "lower": F.lower(safe)})
    makers = {"tokens": lambda: T.tokens_of("lower"), "sentences": lambda: T.sentences(text)}
    df = T.once(lowered, {p: makers[p]() for p in parts}) if parts else lowered
    return df.select(*[c for c in sections.columns if c != text], text, *parts, "lower")


def with_phrase_runs(sections: DataFrame, packs: TermPacks | None = None) -> DataFrame:
    """Adds phrase_runs: text.runs_of() of all phrases of the packs.

    Metrics, flags and densities that are all wanted then share one search; where it is missing, each makes its own.
    """
    packs = packs or TermPacks()
    named = (*packs.flag_patterns.values(), *packs.densities.values())
    return T.once(sections, {"phrase_runs": T.runs_of("lower", [*_metric_phrases(packs), *(p for phrases in named for p in phrases)])})


def _metric_phrases(packs: TermPacks) -> tuple[str, ...]:
    return (*packs.geography, *packs.segment, *packs.boilerplate, *packs.legal)


def _runs(sections: DataFrame, phrases: Iterable[str]) -> Column:
    return F.col("phrase_runs") if "phrase_runs" in sections.columns else T.runs_of("lower", phrases)


def section_metrics(sections: DataFrame, packs: TermPacks | None = None, *, text: str = "text") -> DataFrame:
    """Adds the metrics of each section to its row; sections come from with_text_parts().

    A column boilerplate_cross_firm_ratio is used if there is one and counts as 0 where it is missing or null;
    phrase_runs (with_phrase_runs() of the same packs) is used if there is one, here, by flags and by densities.
    """
    packs = packs or TermPacks()
    listed = {name: getattr(packs, pack) for name, pack in RATIO_PACKS.items()}
    # The few tokens that are in any pack, and then the packs of each.
    df = T.once(sections, {
        "_listed": F.filter("tokens", lambda t: t.isin(sorted({w for words in listed.values() for w in words}))),
        "_runs": _runs(sections, _metric_phrases(packs)),
    })
    df = T.once(df, {
        "word_count": F.size("tokens"),
        "sentence_count": F.size("sentences"),
        "_numbers": F.regexp_count(F.col(text), F.lit(r"\d(?<![\p{L}\p{N}_]\d)\d*(?:[.,]\d+)?(?![\p{L}\p{N}_])")),
        "_capitals": T.capitalised(text),
        "_named": T.phrases_present("lower", packs.geography, "_runs") + T.phrases_present("lower", packs.segment, "_runs"),
        "_long": F.size(F.filter("tokens", lambda w: F.length(w) > 6)),
        "_boilerplate": F.when(T.holds_any("lower", packs.boilerplate, "_runs"), T.sentence_phrase_hits("sentences", packs.boilerplate, "_runs")).otherwise(F.lit(0)),
        "_legal": T.phrase_hits("lower", packs.legal, "_runs"),
        **{f"_{name}": T.tokens_in("_listed", words) for name, words in listed.items()},
    })
    words, n_sentences = F.col("word_count"), F.col("sentence_count")
    cross = F.coalesce(F.col("boilerplate_cross_firm_ratio"), F.lit(0.0)) if "boilerplate_cross_firm_ratio" in sections.columns else F.lit(0.0)
    average = T.ratio(words, n_sentences)
    df = df.withColumns({
        "average_sentence_length": average,
        "readability_score": F.least(F.lit(100.0), average * 2 + T.ratio(F.col("_long"), words, 100)),
        **{name: F.round(T.ratio(F.col(f"_{name}"), words), 6) for name in RATIO_PACKS},
        "legal_regulatory_phrase_ratio": F.round(T.ratio(F.col("_legal"), words), 6),
        "numeric_specificity_score": F.least(F.lit(100.0), T.ratio(F.col("_numbers"), words, 1000)),
        "company_specificity_score": F.least(F.lit(100.0), T.ratio(F.col("_capitals") + F.col("_numbers") + F.col("_named"), words, 100)),
        "boilerplate_phrase_ratio": F.least(F.lit(1.0), F.col("_boilerplate") / F.greatest(n_sentences, F.lit(1))),
        "boilerplate_cross_firm_ratio": cross,
    })
    a, b = BOILERPLATE_BLEND
    df = df.withColumn("boilerplate_combined_ratio", T.clamp(F.col("boilerplate_phrase_ratio") * a + F.col("boilerplate_cross_firm_ratio") * b, 0, 1))
    rounded = {c: F.round(c, 6) for c in ("average_sentence_length", "readability_score", "numeric_specificity_score", "company_specificity_score", "boilerplate_phrase_ratio", "boilerplate_cross_firm_ratio", "boilerplate_combined_ratio")}
    return df.withColumns(rounded).drop(*[c for c in df.columns if c.startswith("_")])


METRICS = (
    "word_count", "sentence_count", "average_sentence_length", "readability_score", *RATIO_PACKS, "legal_regulatory_phrase_ratio",
    "numeric_specificity_score", "company_specificity_score", "boilerplate_phrase_ratio", "boilerplate_cross_firm_ratio", "boilerplate_combined_ratio",
)

#: (family, metric, factor of its normalised value)
FAMILIES = (
    ("tone", "negative_word_ratio", 100), ("tone", "uncertainty_word_ratio", 100), ("specificity", "numeric_specificity_score", 1), ("specificity", "company_specificity_score", 1),
    ("boilerplate", "boilerplate_phrase_ratio", 100), ("boilerplate", "boilerplate_cross_firm_ratio", 100), ("boilerplate", "boilerplate_combined_ratio", 100),
    ("liquidity", "constraining_word_ratio", 100), ("internal_controls", "modal_word_ratio", 100),
)


def metric_families(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Long rows: keys, metric_family, metric_name, raw_value, normalized_value."""
    rows = F.array(*[F.struct(F.lit(f).alias("metric_family"), F.lit(m).alias("metric_name"), F.col(m).cast("double").alias("raw_value"), F.round(F.col(m) * k, 6).cast("double").alias("normalized_value")) for f, m, k in FAMILIES])
    return metrics.select(*keys, F.inline(rows))


def flag_column(flag: str, packs: TermPacks, section: Column | str = "section", runs: Column | str | None = None, near: Column | str | None = None) -> Column:
    """Whether a sentence of a section in scope holds a pattern of the flag and nothing that suppresses it.

    runs: text.runs_of() of the flag's patterns, else the text is searched for each. near: text.sentences_near() of the
    flag's patterns, else all sentences are searched.
    """
    scope = packs.flag_scopes.get(flag, ())
    patterns, muted = packs.flag_patterns[flag], packs.flag_suppressions.get(flag, ())
    fires = lambda low: T.holds_any(low, patterns) & ~T.holds_any(low, muted) if muted else T.holds_any(low, patterns)
    section = F.col(section) if isinstance(section, str) else section
    found = T.holds_any("lower", patterns, runs)
    lowered = F.transform("sentences", F.lower) if near is None else near
    return F.when(section.isin(list(scope)) & found, F.exists(lowered, fires)).otherwise(F.lit(False))


def section_flags(sections: DataFrame, packs: TermPacks | None = None) -> DataFrame:
    """Adds a boolean column for each flag; sections come from with_text_parts()."""
    packs = packs or TermPacks()
    every = [p for patterns in packs.flag_patterns.values() for p in patterns]
    df = T.once(sections, {"_runs": _runs(sections, every)})
    # The few sentences that can hold a pattern, whichever flags look for one.
    df = T.once(df, {"_near": T.sentences_near("sentences", every, "_runs")})
    return T.once(df, {flag: flag_column(flag, packs, runs="_runs", near="_near") for flag in packs.flag_patterns}).drop("_runs", "_near")


def section_densities(sections: DataFrame, packs: TermPacks | None = None, mdna: tuple[str, ...] = MDNA_SECTIONS) -> DataFrame:
    """Adds term hits for each thousand words, at most 100; 0 outside of management's discussion."""
    packs = packs or TermPacks()
    words, own = F.greatest(F.size("tokens"), F.lit(1)), F.col("section").isin(list(mdna))
    df = T.once(sections, {"_runs": F.when(own, _runs(sections, [t for terms in packs.densities.values() for t in terms]))})
    return T.once(df, {
        name: F.when(own, F.round(F.least(F.lit(100.0), T.phrase_hits("lower", terms, "_runs") / words * 1000), 6)).otherwise(F.lit(0.0))
        for name, terms in packs.densities.items()
    }).drop("_runs")
