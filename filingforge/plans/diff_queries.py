"""Comparison with the prior period: similarity, alignment, topics, numbers and change scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingforge.functions import term_packs as P
from filingforge.functions import text as T
from filingforge.operators import diff, latent, metrics, products, scoring

from .corpus import FILINGS_SQL, TURNS_SQL, frame
from .metric_queries import DOUBLED, SENTENCES, TOKENS, any_of

NUMBER_SQL = r"(?i)(?:\$)?\d[\d,]*(?:\.\d+)?%?|\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2},?\s+\d{4}\b|\b\d{4}\b"

#: Years that filings are put off by to leave a gap, more than there are filings of an entity; years stay integers.
FAR_YEARS = 1_000_000_000


def with_parts(pairs: DataFrame, parts: tuple[str, ...] = ("tokens", "sentences")) -> DataFrame:
    """Lower-cased text and the parts on both sides."""
    cur = T.once(metrics.with_text_parts(pairs, parts=parts), {"prior_lower": F.lower("prior_text")})
    makers = {"tokens": lambda: T.tokens_of("prior_lower"), "sentences": lambda: T.sentences("prior_text")}
    return T.once(cur, {f"prior_{p}": makers[p]() for p in parts}) if parts else cur


def turns(spark: SparkSession, sf_dir: str, parts: tuple[str, ...] = ("tokens", "sentences")) -> DataFrame:
    return with_parts(frame(spark, sf_dir, TURNS_SQL, "conversations"), parts)


def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term-weight cosine of each turn and the turn before."""
    out = diff.with_alignment(turns(spark, sf_dir))
    return out.where("prior_text IS NOT NULL").select("id", F.round("lexical_similarity", 6).alias("lexical_similarity"))


def latent_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each turn and the turn before by latent vectors of all turns, and the change score that follows from it."""
    pairs = turns(spark, sf_dir)
    model = latent.fit(frame(spark, sf_dir, TURNS_SQL, "conversations").select("text"), directions=16)
    out = diff.section_diffs(latent.with_similarity(pairs, model))
    return out.where("prior_text IS NOT NULL").select("id", F.round("semantic_similarity", 4).alias("latent_similarity"), F.round("change_v1", 2).alias("change_v1"))


def sentence_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sentences match, come and go between turns."""
    out = diff.with_alignment(turns(spark, sf_dir)).where("prior_text IS NOT NULL")
    n = F.size("matched")
    return out.select("id", n.cast("long").alias("matched"), (F.size("sentences") - n).cast("long").alias("added"), (F.size("prior_sentences") - n).cast("long").alias("removed"))


def topic_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics that come and go between turns."""
    packs = P.TermPacks()
    t = T.once(turns(spark, sf_dir, ()).where("prior_text IS NOT NULL"), {"topics": diff.topics_in("lower", packs), "prior_topics": diff.topics_in("prior_lower", packs)})
    return t.select("id", F.array_join(F.array_except("topics", "prior_topics"), ",").alias("new_topics"), F.array_join(F.array_except("prior_topics", "topics"), ",").alias("removed_topics"), F.array_join(F.array_intersect("topics", "prior_topics"), ",").alias("shared_topics"))


def numeric_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that are only in a turn or only in the one before."""
    t = turns(spark, sf_dir, ()).where("prior_text IS NOT NULL").withColumns({"now": T.numeric_tokens("text"), "before": T.numeric_tokens("prior_text")})
    return t.select("id", F.array_join(F.array_sort(F.array_except("now", "before")), ";").alias("added_numbers"), F.array_join(F.array_sort(F.array_except("before", "now")), ";").alias("removed_numbers"))


def language_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of tone ratios between turns, in hundredths."""
    packs = P.TermPacks()
    t = turns(spark, sf_dir, ("tokens",)).where("prior_text IS NOT NULL")
    return t.select("id", *[F.round((diff.share("tokens", getattr(packs, p)) - diff.share("prior_tokens", getattr(packs, p))) * 100, 4).alias(n) for n, p in diff.DELTAS.items()])


def section_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole diff of each turn with the one before."""
    out = diff.section_diffs(turns(spark, sf_dir))
    return out.select("id", "change_v1", "change_v2", F.round("lexical_similarity", 6).alias("lexical_similarity"), "added_sentence_count", "removed_sentence_count", "changed_numeric_count", F.round("added_risk_language_score", 6).alias("added_risk"), F.array_join("intensified_topics", ",").alias("intensified"), "diff_confidence", "diff_summary")


def change_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change rows for readers: score, reason for none, largest delta."""
    return products.change_rows(diff.section_diffs(turns(spark, sf_dir)), ["id"]).select("id", F.round("change_score", 4).alias("change_score"), "missing_reason", "top_delta", F.round("top_delta_value", 4).alias("top_delta_value"))


def filings_with_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six entities' filings, one a year; each seventh is of a far year, which leaves a gap in its place."""
    f = frame(spark, sf_dir, FILINGS_SQL, "documents")
    year = 2000 + F.floor(F.col("filing_id") / 6) + F.when(F.col("filing_id") % 7 == 3, FAR_YEARS).otherwise(0)
    return f.select(
        "doc_id", "filing_id", (F.col("filing_id") % 6).cast("string").alias("entity"), F.lit("10-K").alias("form_type"), year.cast("int").alias("fiscal_year"),
        F.lit(None).cast("string").alias("quarter"), "section", "section_ord", "text",
    )


def prior_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prior_pairs_all under its first name."""
    return prior_pairs_all(spark, sf_dir)


def prior_pairs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each section with its counterpart of the year before; a gap stays a gap."""
    pairs = diff.pair_with_prior(filings_with_periods(spark, sf_dir), columns=("doc_id", "text"))
    return pairs.select("doc_id", F.col("prior_doc_id").alias("prior_doc_id"), F.length("prior_text").cast("long").alias("prior_length"))


def scores_with_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline scores, model 2, where filings have priors and so diffs."""
    # Sections meet as bare texts; the pair's row then carries the diff and the metrics, and only filings are shuffled again.
    pairs = with_parts(diff.pair_with_prior(filings_with_periods(spark, sf_dir), columns=("text",)))
    kept = ["filing_id", "section", "section_ord"]
    d = diff.section_diffs(pairs).select(*kept, "text", "tokens", "sentences", "lower", "change_v1", "change_v2", *diff.DELTAS)
    measured = metrics.section_densities(metrics.section_flags(metrics.section_metrics(d)))
    out = scoring.component_scores(scoring.filing_rows(measured, with_diffs=True), model=2)
    return out.select("filing_id", *[F.round(c, 4).alias(c) for c in (*scoring.COMPONENTS, *scoring.AGGREGATES)])


QUERIES = {f.__name__: f for f in (text_similarity, latent_similarity, sentence_alignment, topic_changes, numeric_changes, language_deltas, section_diffs, change_products, prior_pairs, prior_pairs_all, scores_with_priors)}


def _topics(column: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {any_of(words, column)} THEN '{topic}' END" for topic, words in sorted(P.TOPICS.items())) + "], lambda t: t IS NOT NULL)"


def _numbers(column: str) -> str:
    plain = f"list_transform(regexp_extract_all({column}, '{NUMBER_SQL}'), lambda x: regexp_replace(replace(lower(x), ',', ''), '^\\$', ''))"
    return f"list_transform({plain}, lambda x: CASE WHEN ends_with(x, '%') THEN 'pct:' || left(x, length(x) - 1) ELSE x END)"


def _side(column: str, expression: str) -> str:
    return expression.replace("(text", f"({column}")


_PAIRS = f"WITH t AS ({TURNS_SQL}), p AS (SELECT * FROM t WHERE prior_text IS NOT NULL)"
_TERMS = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]{{2,}}')"
# Documents of a comparison: for similarity the two texts, for alignment all sentences of both.
_WEIGHTS = """, tf AS (SELECT id, side, s, term, count(*) AS n FROM words GROUP BY ALL), docs AS (SELECT id, count(*) AS nd FROM units GROUP BY id),
df AS (SELECT id, term, count(*) AS df FROM tf GROUP BY id, term), w AS (SELECT tf.id, side, s, term, n * (ln((1 + nd) / (1 + df)) + 1) AS x FROM tf JOIN df USING (id, term) JOIN docs USING (id)),
norm AS (SELECT id, side, s, sqrt(sum(x * x)) AS z FROM w GROUP BY ALL), u AS (SELECT id, side, s, term, x / z AS x FROM w JOIN norm USING (id, side, s)),
sims AS (SELECT a.id, a.s AS ci, b.s AS pi, round(sum(a.x * b.x), 9) AS sim FROM u a JOIN u b ON a.id = b.id AND a.term = b.term AND a.side = 0 AND b.side = 1 GROUP BY ALL)"""

ORACLES = {
    "text_similarity": _PAIRS
    + f", units AS (SELECT id, 0 AS side, 1 AS s, text AS t FROM p UNION ALL SELECT id, 1, 1, prior_text FROM p), words AS (SELECT id, side, s, unnest({_TERMS.format(c='t')}) AS term FROM units)"
    + _WEIGHTS
    + " SELECT id, round(least(1.0, coalesce(sim, 0.0)), 6) AS lexical_similarity FROM p LEFT JOIN sims USING (id)",
    "sentence_alignment": _PAIRS
    + f", sp AS (SELECT id, {_side('text', SENTENCES)} AS a, {_side('prior_text', SENTENCES)} AS b FROM p), units AS (SELECT id, 0 AS side, unnest(range(len(a))) AS s, unnest(a) AS t FROM sp UNION ALL SELECT id, 1, unnest(range(len(b))), unnest(b) FROM sp), words AS (SELECT id, side, s, unnest({_TERMS.format(c='t')}) AS term FROM units)"
    + _WEIGHTS
    + ", best AS (SELECT id, ci, pi, sim, row_number() OVER (PARTITION BY id, ci ORDER BY sim DESC, pi) AS k FROM sims), first AS (SELECT id, ci, pi, row_number() OVER (PARTITION BY id, pi ORDER BY ci) AS k FROM best WHERE k = 1 AND sim >= 0.55), m AS (SELECT id, count(*) AS n FROM first WHERE k = 1 GROUP BY id)"
    + " SELECT id, coalesce(n, 0) AS matched, len(a) - coalesce(n, 0) AS added, len(b) - coalesce(n, 0) AS removed FROM sp LEFT JOIN m USING (id)",
    "topic_changes": _PAIRS
    + f", d AS (SELECT id, {_side('text', DOUBLED)} AS x, {_side('prior_text', DOUBLED)} AS y FROM p), q AS (SELECT id, {_topics('x')} AS a, {_topics('y')} AS b FROM d)"
    + " SELECT id, array_to_string(list_filter(a, lambda t: NOT list_contains(b, t)), ',') AS new_topics, array_to_string(list_filter(b, lambda t: NOT list_contains(a, t)), ',') AS removed_topics, array_to_string(list_filter(a, lambda t: list_contains(b, t)), ',') AS shared_topics FROM q",
    "numeric_changes": _PAIRS
    + f", q AS (SELECT id, {_numbers('text')} AS a, {_numbers('prior_text')} AS b FROM p)"
    + " SELECT id, array_to_string(list_sort(list_distinct(list_filter(a, lambda t: NOT list_contains(b, t)))), ';') AS added_numbers, array_to_string(list_sort(list_distinct(list_filter(b, lambda t: NOT list_contains(a, t)))), ';') AS removed_numbers FROM q",
    "language_deltas": _PAIRS
    + f", k AS (SELECT id, {_side('text', TOKENS)} AS a, {_side('prior_text', TOKENS)} AS b FROM p) SELECT id, "
    + ", ".join(
        "round((" + " - ".join(f"round(len(list_filter({side}, lambda w: list_contains([{', '.join(repr(x) for x in getattr(P.TermPacks(), pack))}], w))) / greatest(len({side}), 1), 6)" for side in ("a", "b")) + f") * 100, 4) AS {name}"
        for name, pack in diff.DELTAS.items()
    )
    + " FROM k",
}
#: All filings; a year is put off as in the query.
ORACLES |= {
    "prior_pairs_all": f"WITH f AS (SELECT doc_id, filing_id % 6 AS e, floor(filing_id / 6) + CASE WHEN filing_id % 7 = 3 THEN {FAR_YEARS} ELSE 0 END AS y, section, text FROM ({FILINGS_SQL}) AS s)"
    + " SELECT a.doc_id, b.doc_id AS prior_doc_id, length(b.text) AS prior_length FROM f a LEFT JOIN f b ON a.e = b.e AND b.y = a.y - 1 AND a.section = b.section",
}
ORACLES["prior_pairs"] = ORACLES["prior_pairs_all"]
