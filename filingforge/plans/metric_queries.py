"""Metrics, flags, densities, boilerplate grams and headline scores, with independent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingforge.functions import term_packs as P
from filingforge.functions import text as T
from filingforge.operators import boilerplate, entities, metrics, products, scoring, validation
from filingforge.session import table
from filingforge.staging import staged

from .corpus import FILINGS_SQL, SECTIONS_SQL, frame


def quoted(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_pattern(phrase: str) -> str:
    """The phrase in text whose other characters are doubled, so that neighbours can share none."""
    import re

    parts = [re.escape(p).replace("'", "''") for p in re.split(r"[\s-]+", phrase.lower()) if p]
    return "(?:^|[^a-z0-9])" + r"[\s-]+".join(parts) + "(?:$|[^a-z0-9])"


TOKENS = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z]+'))"
SENTENCES = r"list_filter(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[.!?]+\s+'), lambda s: regexp_matches(s, '\S'))"
DOUBLED = r"regexp_replace(lower(text), '([^a-z0-9])', '\1\1', 'g')"


def doubled(expression: str) -> str:
    return rf"regexp_replace(lower({expression}), '([^a-z0-9])', '\1\1', 'g')"


def hits(phrases, column: str = "dbl") -> str:
    return " + ".join(f"len(regexp_extract_all({column}, '{sql_pattern(p)}'))" for p in phrases)


def present(phrases, column: str = "dbl") -> str:
    return " + ".join(f"CAST(regexp_matches({column}, '{sql_pattern(p)}') AS INT)" for p in phrases)


def any_of(phrases, column: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{sql_pattern(p)}')" for p in phrases) + ")"


def share(words) -> str:
    return f"CASE WHEN len(tokens) = 0 THEN 0.0 ELSE round(len(list_filter(tokens, lambda w: list_contains({quoted(words)}, w))) / len(tokens), 6) END"


PARTS = f"SELECT *, {TOKENS} AS tokens, {SENTENCES} AS sentences, {DOUBLED} AS dbl FROM base"
PACKS = P.TermPacks()
RATIOS = ", ".join(f"{share(getattr(PACKS, pack))} AS {name}" for name, pack in metrics.RATIO_PACKS.items())
NUMBERS = r"len(regexp_extract_all(regexp_replace(text, '([\p{L}\p{N}_])([^\p{L}\p{N}_.,]|[.,](?:[^0-9]|$))', '\1 \2', 'g'), '(?:^|[^\p{L}\p{N}_])[0-9]+(?:[.,][0-9]+)?(?:$|[^\p{L}\p{N}_])'))"
METRICS_SELECT = f"""
  len(tokens) AS word_count, len(sentences) AS sentence_count,
  {RATIOS},
  CASE WHEN len(tokens) = 0 THEN 0.0 ELSE round(({hits(P.LEGAL_REGULATORY)}) / len(tokens), 6) END AS legal_regulatory_phrase_ratio,
  round(CASE WHEN len(sentences) = 0 THEN 0.0 ELSE len(tokens) / len(sentences) END, 6) AS average_sentence_length,
  round(least(100.0, CASE WHEN len(sentences) = 0 THEN 0.0 ELSE len(tokens) / len(sentences) END * 2 + CASE WHEN len(tokens) = 0 THEN 0.0 ELSE len(list_filter(tokens, lambda w: length(w) > 6)) / len(tokens) * 100 END), 6) AS readability_score,
  round(least(1.0, list_sum(list_transform(sentences, lambda s: {present(P.BOILERPLATE, doubled('s'))})) / greatest(len(sentences), 1)), 6) AS boilerplate_phrase_ratio
"""


def _sections(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    return metrics.with_text_parts(frame(spark, sf_dir, SECTIONS_SQL, "documents"), parts=parts or ("tokens", "sentences"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the sections alone, written, as grams go through them several times."""
    return staged(spark, frame(spark, sf_dir, SECTIONS_SQL, "documents").select("doc_id", T.tokens(F.coalesce("text", F.lit(""))).alias("tokens")), "tokens")


def section_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tone ratios, readability and phrase ratios of each section."""
    out = metrics.section_metrics(_sections(spark, sf_dir))
    return out.select("doc_id", "section", F.col("word_count").cast("long"), F.col("sentence_count").cast("long"), *metrics.RATIO_PACKS, "legal_regulatory_phrase_ratio", "average_sentence_length", "readability_score", "boilerplate_phrase_ratio")


def specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words, places and segments, and numbers."""
    s = _sections(spark, sf_dir)
    out = metrics.section_metrics(s)
    return out.select(
        "doc_id", T.capitalised("text").cast("long").alias("capitalised"),
        (T.phrases_present("lower", P.GEOGRAPHY) + T.phrases_present("lower", P.SEGMENT)).cast("long").alias("named"), F.size(T.numeric_tokens("text")).cast("long").alias("numbers"), F.col("numeric_specificity_score").isNotNull().alias("scored"),
    )


def metric_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long form of the metrics, summed by family and metric."""
    long = metrics.metric_families(metrics.section_metrics(_sections(spark, sf_dir)), ["doc_id"]).where("metric_name IN ('negative_word_ratio', 'uncertainty_word_ratio', 'constraining_word_ratio', 'modal_word_ratio', 'boilerplate_phrase_ratio')")
    return long.groupBy("metric_family", "metric_name").agg(F.count("*").alias("n"), F.round(F.avg("raw_value"), 6).alias("mean_raw"), F.round(F.max("normalized_value"), 6).alias("max_normalized"))


def section_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All event flags of each section."""
    return metrics.section_flags(_sections(spark, sf_dir, "sentences")).select("doc_id", "section", *P.FLAG_PATTERNS)


def densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term densities of management's discussions, 0 elsewhere."""
    return metrics.section_densities(_sections(spark, sf_dir, "tokens")).select("doc_id", *P.DENSITIES)


def gram_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-grams in at least 2 % of the sections."""
    return boilerplate.gram_baseline(_tokens(spark, sf_dir), min_doc_freq=2, min_doc_frac=0.02).select("gram", "doc_freq", "n_docs")


def cross_firm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each section shared 4-grams cover."""
    s = _tokens(spark, sf_dir)
    return boilerplate.cross_firm_ratio(s, boilerplate.gram_baseline(s, min_doc_freq=2, min_doc_frac=0.02)).select("doc_id", F.col("covered_words").cast("long"), "boilerplate_cross_firm_ratio")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filing rows of the seeded corpus, without priors."""
    s = metrics.with_phrase_runs(metrics.with_text_parts(frame(spark, sf_dir, FILINGS_SQL, "documents")))
    return scoring.filing_rows(metrics.section_densities(metrics.section_flags(metrics.section_metrics(s))))


def headline_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tone, risk factors, legal, liquidity and controls components of each filing, and their weighted mean, model 1."""
    out = scoring.component_scores(scored(spark, sf_dir), model=1)
    named = ("risk_factor_intensity_score", "legal_regulatory_risk_score", "liquidity_stress_score", "internal_controls_risk_score", "tone_negativity_score")
    partial = scoring.weighted_mean([(F.col(c), scoring.WEIGHTS[c]) for c in named])
    return out.select("filing_id", *[F.round(c, 6).alias(c) for c in named], F.round(partial, 6).alias("weighted"), F.size(F.array_compact(F.array(*[F.col(c) for c in named]))).cast("long").alias("n_present"))


def scores_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components, the headline, coverage and aggregates of the second model."""
    out = scoring.component_scores(scored(spark, sf_dir), model=2)
    return out.select("filing_id", *[F.round(c, 6).alias(c) for c in (*scoring.COMPONENTS, *scoring.AGGREGATES)], F.array_join("missing_components", ",").alias("missing"))


def score_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence behind the second model, counted and averaged by component and signal."""
    out = scoring.evidence(scored(spark, sf_dir), model=2)
    return out.groupBy("component", "name").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.max("weight"), 6).alias("weight"))


def score_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of filings without priors."""
    out = scoring.component_scores(scored(spark, sf_dir), model=2)
    out = scoring.confidence(out, extraction=F.lit(0.8), diff=F.lit(None).cast("double"), warnings=F.array(F.lit("short_section")), required_present=F.col("`has.item_7_mdna`") == 1, has_prior=F.lit(False))
    return out.select("filing_id", F.round("score_coverage_ratio", 6).alias("coverage"), F.round("confidence_base", 6).alias("base"), F.round("confidence_penalty", 6).alias("penalty"), "confidence_score")


def active_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags that are set, by section, with label and tier."""
    flags = metrics.section_flags(_sections(spark, sf_dir, "sentences"))
    return products.active_flags(flags, ["doc_id", "section"])


def flag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of filings with the sections that carry them."""
    s = metrics.section_flags(metrics.with_text_parts(frame(spark, sf_dir, FILINGS_SQL, "documents"), parts=("sentences",)))
    return products.flag_summary(products.active_flags(s, ["filing_id", "section"]), "filing_id")


def score_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card rows by band."""
    out = products.score_card(scoring.component_scores(scored(spark, sf_dir), model=1), "filing_id", scoring.WEIGHTS)
    return out.where("component IN ('tone_negativity_score', 'legal_regulatory_risk_score')").groupBy("component", "label", "band").agg(F.count("*").alias("n"), F.max("weight_pct").alias("weight_pct"))


#: label, name: nations and regions by their names, and an office.
GAZETTEER_SQL = "SELECT 'GPE' AS label, initcap(n_name) AS name FROM {nation} UNION ALL SELECT 'GPE', initcap(r_name) FROM {region} UNION ALL SELECT 'ORG', 'Department of Justice'"


def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_entities, density and specificity of each section."""
    names = spark.sql(GAZETTEER_SQL, nation=table(spark, sf_dir, "nation"), region=table(spark, sf_dir, "region"))
    # Counts of a text stay in its row while it is scanned, so texts meet nothing.
    texts = T.once(frame(spark, sf_dir, SECTIONS_SQL, "documents"), {"n_tokens": F.size(T.tokens("text")), "n_words": F.size(T.word_runs("text")), "capitals": T.capitalised("text")})
    found = entities.with_entities(texts, names, key="doc_id", kept=("n_tokens", "n_words", "capitals"))
    return found.select("doc_id", F.size("entities").cast("long").alias("n_entities"), F.round(entities.density_of(F.col("entities"), F.col("n_tokens")), 6).alias("density"), T.ratio(F.col("capitals").cast("double"), F.col("n_words")).alias("specificity"))


def entity_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a gazetteer in each section."""
    return entity_counts(spark, sf_dir).drop("specificity")


def entity_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of entity density and the share of capitalised words."""
    return validation.spearman(entity_counts(spark, sf_dir), "density", "specificity", "doc_id").select("n", F.round("rho", 6).alias("rho"))


QUERIES = {f.__name__: f for f in (entity_density, entity_correlation, section_metrics, specificity, metric_families, section_flags, densities, gram_baseline, cross_firm, headline_scores, scores_v2, score_evidence, score_confidence, active_flags, flag_summary, score_cards)}


def flag_sql(flag: str) -> str:
    scope = ", ".join(f"'{s}'" for s in P.FLAG_SCOPES[flag])
    muted = P.FLAG_SUPPRESSIONS.get(flag)
    test = any_of(P.FLAG_PATTERNS[flag], "d") + (f" AND NOT {any_of(muted, 'd')}" if muted else "")
    return f"section IN ({scope}) AND len(list_filter(ds, lambda d: {test})) > 0 AS {flag}"


FLAGS_CTE = f"sent AS (SELECT * EXCLUDE (tokens), list_transform(sentences, lambda s: {doubled('s')}) AS ds FROM parts), flags AS (SELECT * EXCLUDE (sentences, ds), {', '.join(flag_sql(f) for f in P.FLAG_PATTERNS)} FROM sent)"
DENSITY_SELECT = ", ".join(f"CASE WHEN section IN ('item_7_mdna', 'item_2_mdna') THEN round(least(100.0, ({hits(t)}) / greatest(len(tokens), 1) * 1000), 6) ELSE 0.0 END AS {n}" for n, t in P.DENSITIES.items())
GRAMS_CTE = "grams AS (SELECT doc_id, i - 1 AS pos, array_to_string(list_slice(tokens, i, i + 3), ' ') AS gram FROM (SELECT doc_id, tokens, unnest(range(1, len(tokens) - 2)) AS i FROM parts WHERE len(tokens) >= 4)), nd AS (SELECT count(*) AS n_docs FROM parts WHERE len(tokens) > 0), baseline AS (SELECT gram, count(DISTINCT doc_id) AS doc_freq, max(n_docs) AS n_docs FROM grams, nd GROUP BY gram HAVING count(DISTINCT doc_id) >= greatest(2, ceil(max(n_docs) * 0.02)))"
LABEL = "array_to_string(list_transform(string_split(replace(regexp_replace(flag, '_flag$', ''), '_', ' '), ' '), lambda w: upper(w[1]) || substr(w, 2)), ' ')"
TIER = "CASE WHEN flag IN (" + ", ".join(f"'{f}'" for f in products.SERIOUS) + ") THEN 'serious' ELSE 'notable' END"


def _with(base: str, *more: str) -> str:
    return f"WITH base AS ({base}), parts AS ({PARTS})" + "".join(f", {m}" for m in more) + " "


_FM = f"fm AS (SELECT filing_id, section, {RATIOS}, {DENSITY_SELECT} FROM parts)"
_AT = lambda s, m: f"max(CASE WHEN section = '{s}' THEN {m} END)"
_FLAGGED = "fl AS (SELECT filing_id, " + ", ".join(f"bool_or({f}) AS {f}" for f in P.FLAG_PATTERNS) + " FROM flags GROUP BY filing_id)"


def _mean(*pairs: tuple[str, float]) -> str:
    """Weighted mean over what isn't null."""
    top = " + ".join(f"coalesce(({v}) * {w}, 0)" for v, w in pairs)
    return f"(({top}) / nullif({' + '.join(f'CASE WHEN ({v}) IS NULL THEN 0 ELSE {w} END' for v, w in pairs)}, 0))"


def _clamped(value: str) -> str:
    """0 to 100; null stays null, which least and greatest would pass over."""
    return f"CASE WHEN ({value}) IS NOT NULL THEN least(100.0, greatest(0.0, {value})) END"


def _six(value: str) -> str:
    """Half up at the sixth place of the decimal value; round() of a double leaves halves to the product with a million."""
    return f"CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38, 25)), 6) AS DOUBLE)"


def _boost(value: str, *flags: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN NULL ELSE least(100.0, {value} + CASE WHEN {' OR '.join(flags)} THEN 15.0 ELSE 0.0 END) END"


_R, _M7, _M2 = "item_1a_risk_factors", "item_7_mdna", "item_2_mdna"
_MD = lambda m: f"CASE WHEN {_AT(_M7, '1')} = 1 THEN {_AT(_M7, m)} ELSE {_AT(_M2, m)} END"
_WIDE = f"wide AS (SELECT filing_id, {_AT(_R, '1')} AS has1a, {_AT(_R, 'negative_word_ratio')} * 100 AS neg, {_AT(_R, 'uncertainty_word_ratio')} * 100 AS unc, {_AT(_R, 'litigious_word_ratio')} * 100 AS lit, {_AT(_R, 'constraining_word_ratio')} * 100 AS con, ({_MD('constraining_word_ratio')}) * 100 AS mcon, ({_MD('uncertainty_word_ratio')}) * 100 AS munc, {_MD('liquidity_constraint_density')} AS mliq FROM fm GROUP BY filing_id)"
_COMPONENTS = f"""comps AS (SELECT w.filing_id,
  CASE WHEN has1a = 1 THEN {_mean(('neg', 0.375), ('unc', 0.375))} END AS risk_factor_intensity_score,
  {_boost(f"CASE WHEN has1a = 1 THEN {_mean(('lit', 0.7))} END", 'investigation_flag', 'material_legal_proceeding_flag')} AS legal_regulatory_risk_score,
  {_boost(_mean(('mcon', 0.5), ('mliq', 0.35)), 'going_concern_flag', 'covenant_breach_flag')} AS liquidity_stress_score,
  {_boost(_mean(('con', 0.4)), 'material_weakness_flag', 'restatement_flag', 'ineffective_controls_flag')} AS internal_controls_risk_score,
  {_mean(('neg', 0.5), ('munc', 0.5))} AS tone_negativity_score
  FROM wide w JOIN fl USING (filing_id))"""
_NAMED = ("risk_factor_intensity_score", "legal_regulatory_risk_score", "liquidity_stress_score", "internal_controls_risk_score", "tone_negativity_score")
_BAND = "CASE WHEN score IS NULL THEN 'missing' WHEN score <= 25 THEN 'low' WHEN score <= 50 THEN 'moderate' WHEN score <= 75 THEN 'elevated' ELSE 'high' END"

_ENTITIES = _with(SECTIONS_SQL) + rf"""SELECT doc_id, CAST((SELECT coalesce(sum(len(regexp_extract_all(replace(text, ' ', '  '), '(?:^|[^\p{{L}}\p{{N}}_])' || replace(name, ' ', '  ') || '(?:$|[^\p{{L}}\p{{N}}_])'))), 0) FROM g) AS BIGINT) AS n_entities,
    len(tokens) AS n_tokens, len(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]+'))) / greatest(len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')), 1) AS specificity FROM parts"""
_ENTITIES = _ENTITIES.replace("WITH ", "WITH g AS (SELECT array_to_string(list_transform(string_split(lower(n), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name FROM (SELECT n_name AS n FROM nation UNION ALL SELECT r_name FROM region) UNION ALL SELECT 'Department of Justice'), ", 1)
ORACLES = {
    "entity_density": f"SELECT doc_id, n_entities, round(CASE WHEN n_tokens > 0 THEN n_entities / n_tokens ELSE 0 END, 6) AS density FROM ({_ENTITIES})",
    "entity_correlation": f"WITH e AS ({_ENTITIES}), r AS (SELECT row_number() OVER (ORDER BY round(CASE WHEN n_tokens > 0 THEN n_entities / n_tokens ELSE 0 END, 6), doc_id) AS a, row_number() OVER (ORDER BY specificity, doc_id) AS b FROM e) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r",
    "section_metrics": _with(SECTIONS_SQL) + f"SELECT doc_id, section, {METRICS_SELECT} FROM parts",
    "specificity": _with(SECTIONS_SQL) + rf"""SELECT doc_id, len(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]+'))) AS capitalised,
        CAST({present(P.GEOGRAPHY)} + {present(P.SEGMENT)} AS BIGINT) AS named,
        len(regexp_extract_all(text, '(?i)(?:\$)?\d[\d,]*(?:\.\d+)?%?|\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{{1,2}},?\s+\d{{4}}\b|\b\d{{4}}\b')) AS numbers, true AS scored FROM parts""",
    "metric_families": _with(SECTIONS_SQL, f"m AS (SELECT {METRICS_SELECT} FROM parts)", "long AS (SELECT 'tone' AS metric_family, 'negative_word_ratio' AS metric_name, negative_word_ratio AS v FROM m UNION ALL SELECT 'tone', 'uncertainty_word_ratio', uncertainty_word_ratio FROM m UNION ALL SELECT 'liquidity', 'constraining_word_ratio', constraining_word_ratio FROM m UNION ALL SELECT 'internal_controls', 'modal_word_ratio', modal_word_ratio FROM m UNION ALL SELECT 'boilerplate', 'boilerplate_phrase_ratio', boilerplate_phrase_ratio FROM m)")
    + "SELECT metric_family, metric_name, count(*) AS n, round(avg(v), 6) AS mean_raw, round(max(v * 100), 6) AS max_normalized FROM long GROUP BY 1, 2",
    "section_flags": _with(SECTIONS_SQL, FLAGS_CTE) + f"SELECT doc_id, section, {', '.join(P.FLAG_PATTERNS)} FROM flags",
    "densities": _with(SECTIONS_SQL) + f"SELECT doc_id, {DENSITY_SELECT} FROM parts",
    "gram_baseline": _with(SECTIONS_SQL, GRAMS_CTE) + "SELECT gram, doc_freq, n_docs FROM baseline",
    "cross_firm": _with(SECTIONS_SQL, GRAMS_CTE, "cov AS (SELECT doc_id, count(*) AS covered FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + 4)) AS p FROM grams JOIN baseline USING (gram)) GROUP BY doc_id)")
    + "SELECT doc_id, coalesce(covered, 0) AS covered_words, round(CASE WHEN len(tokens) > 0 THEN coalesce(covered, 0) / len(tokens) ELSE 0.0 END, 6) AS boilerplate_cross_firm_ratio FROM parts LEFT JOIN cov USING (doc_id)",
    "headline_scores": _with(FILINGS_SQL, FLAGS_CTE, _FM, _FLAGGED, _WIDE, _COMPONENTS)
    + f"SELECT filing_id, {', '.join(f'{_six(_clamped(c))} AS {c}' for c in _NAMED)}, {_six(_mean(*((c, scoring.WEIGHTS[c]) for c in _NAMED)))} AS weighted, CAST({' + '.join(f'CAST({c} IS NOT NULL AS INT)' for c in _NAMED)} AS BIGINT) AS n_present FROM comps",
    "active_flags": _with(SECTIONS_SQL, FLAGS_CTE) + f"SELECT doc_id, section, flag, {LABEL} AS label, {TIER} AS tier FROM (" + " UNION ALL ".join(f"SELECT doc_id, section, '{f}' AS flag FROM flags WHERE {f}" for f in P.FLAG_PATTERNS) + ")",
    "flag_summary": _with(FILINGS_SQL, FLAGS_CTE) + f"SELECT filing_id, flag, {LABEL} AS label, {TIER} AS tier, count(DISTINCT section) AS n_sections, string_agg(DISTINCT section, ',' ORDER BY section) AS sections FROM (" + " UNION ALL ".join(f"SELECT filing_id, section, '{f}' AS flag FROM flags WHERE {f}" for f in P.FLAG_PATTERNS) + ") GROUP BY filing_id, flag",
    "score_cards": _with(FILINGS_SQL, FLAGS_CTE, _FM, _FLAGGED, _WIDE, _COMPONENTS, "card AS (SELECT 'tone_negativity_score' AS component, 'Tone Negativity' AS label, tone_negativity_score AS score, 5.0 AS weight_pct FROM comps UNION ALL SELECT 'legal_regulatory_risk_score', 'Legal Regulatory Risk', legal_regulatory_risk_score, 10.0 FROM comps)")
    + f"SELECT component, label, {_BAND} AS band, count(*) AS n, CAST(max(weight_pct) AS DOUBLE) AS weight_pct FROM card GROUP BY 1, 2, 3",
}
