import pytest
from pyspark.sql import functions as F

from filingforge.functions import term_packs as P
from filingforge.functions import text as T
from filingforge.operators import metrics
from filingforge.plans import diff_queries, metric_queries

SF = "/root/testdata/sf0.001"
WORDS, SENTENCES, RUNS = T.PLAIN_WORD, "[.!?]+", f"{T.PHRASE_RUN}, 0"


@pytest.fixture
def plan(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    yield lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_topics_need_no_tokens_and_no_sentences(spark, plan):
    text = plan(diff_queries.topic_changes(spark, SF))
    assert WORDS not in text and SENTENCES not in text and text.count(RUNS) == 2


def test_flags_need_no_tokens(spark, plan):
    text = plan(metric_queries.flag_summary(spark, SF))
    assert WORDS not in text and text.count(RUNS) == 1


def test_scores_search_all_phrases_at_once(spark, plan):
    text = plan(metric_queries.scored(spark, SF))
    assert text.count(RUNS) == 1 and text.count(WORDS) == 1


def test_ends_are_stripped_of_white_space_alone(spark):
    texts = ["", " \t\n", "a", "\x0b a b \f\r\n", "a.  ", " a "]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "text string").select(T.stripped("text").alias("t")).collect()]
    assert got == [t.strip(" \t\n\x0b\f\r") for t in texts]


def test_shared_runs_and_near_sentences_give_the_same(spark):
    every = [p for packs in (*P.FLAG_PATTERNS.values(), *P.DENSITIES.values(), P.BOILERPLATE, P.LEGAL_REGULATORY) for p in packs]
    texts = [*P.BOILERPLATE, *[f"Fine. We say {p.upper()}! No {p}x, x{p}; {p}." for p in every], "No material weakness was found. A Material-Weakness exists.", "", None]
    rows = [(i, s, 0, t) for s in ("item_1a_risk_factors", "item_7_mdna", "item_9a_controls") for i, t in enumerate(texts)]
    own = metrics.with_text_parts(spark.createDataFrame(rows, "filing_id long, section string, section_ord int, text string"))
    found = lambda s: metrics.section_densities(metrics.section_flags(metrics.section_metrics(s))).drop("phrase_runs", "tokens", "sentences", "lower")
    assert sorted(map(str, found(metrics.with_phrase_runs(own)).collect())) == sorted(map(str, found(own).collect()))
    packs = P.TermPacks()
    plain = own.select("filing_id", "section", *[metrics.flag_column(f, packs).alias(f) for f in P.FLAG_PATTERNS], T.sentence_phrase_hits("sentences", P.BOILERPLATE).alias("n"))
    near = metrics.section_flags(own).select("filing_id", "section", *P.FLAG_PATTERNS, T.sentence_phrase_hits("sentences", P.BOILERPLATE, T.runs_of("lower", P.BOILERPLATE)).alias("n"))
    assert sorted(map(str, near.collect())) == sorted(map(str, plain.collect())) and near.where(F.col("n") > 0).count() >= 3 * len(P.BOILERPLATE)
