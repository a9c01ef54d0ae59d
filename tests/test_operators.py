import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from filingforge.functions import term_packs as P
from filingforge.operators import boilerplate, diff, metrics, products, resolution, scoring, sections, validation

A1, MD, C9 = "item_1a_risk_factors", "item_7_mdna", "item_9a_controls"


def parts(spark, rows):
    return metrics.with_text_parts(spark.createDataFrame(rows, "filing_id long, section string, section_ord int, text string"))


FLAG_CASES = [
    (A1, "We identified a material weakness in controls.", "material_weakness_flag", True),
    (A1, "No material weakness was found.", "material_weakness_flag", False),
    (A1, "No material weakness was found. But a material-weakness appeared.", "material_weakness_flag", True),
    (MD, "We identified a material weakness.", "material_weakness_flag", False),
    (MD, "Substantial doubt exists about the lender.", "going_concern_flag", True),
    (MD, "Default settings apply to default under rules.", "covenant_breach_flag", False),
    (MD, "An event of default occurred.", "covenant_breach_flag", True),
    ("item_1_05", "Ransomware hit us.", "cybersecurity_incident_flag", True),
    ("item_1_05", "Board oversight covers incident response.", "cybersecurity_incident_flag", False),
    ("item_2_02", "We withdraw our guidance.", "guidance_withdrawal_flag", True),
    (A1, "Reinvestigations continue.", "investigation_flag", False),
    (A1, None, "investigation_flag", False),
]


def test_flags(spark):
    rows = [(i, s, 0, t) for i, (s, t, _, _) in enumerate(FLAG_CASES)]
    got = {r.filing_id: r for r in metrics.section_flags(parts(spark, rows)).collect()}
    for i, (_, _, flag, want) in enumerate(FLAG_CASES):
        assert got[i][flag] is want, FLAG_CASES[i]


def test_metrics_of_known_text(spark):
    text = "Losses may decline. We cannot assure you of 5% or $3,000 in China markets. Default must follow."
    r = metrics.section_metrics(parts(spark, [(1, A1, 0, text), (2, A1, 0, None)])).orderBy("filing_id").collect()
    assert (r[0].word_count, r[0].sentence_count) == (15, 3)
    assert r[0].negative_word_ratio == round(3 / 15, 6) and r[0].weak_modal_word_ratio == round(1 / 15, 6) and r[0].strong_modal_word_ratio == round(1 / 15, 6)
    assert r[0].boilerplate_phrase_ratio == round(1 / 3, 6) and r[0].boilerplate_combined_ratio == round(0.4 / 3, 6)
    assert r[0].numeric_specificity_score == 100.0
    assert (r[1].word_count, r[1].readability_score, r[1].company_specificity_score) == (0, 0.0, 0.0)


def test_densities_are_zero_outside_of_discussions(spark):
    text = "Demand declined and may remain uncertain; working capital deficit."
    got = {r.section: r for r in metrics.section_densities(parts(spark, [(1, A1, 0, text), (1, MD, 1, text)])).collect()}
    assert got[A1].demand_softness_density == 0.0 and got[MD].demand_softness_density == 100.0 and got[MD].liquidity_constraint_density == 100.0


def wide(spark, rows, diffs=None):
    s = metrics.section_densities(metrics.section_flags(metrics.section_metrics(parts(spark, rows))))
    return scoring.filing_rows(s, diffs)


def test_null_is_not_zero(spark):
    r = scoring.component_scores(wide(spark, [(1, MD, 0, "Plain words only here.")]), model=1).first()
    assert r.risk_factor_intensity_score is None and r.disclosure_change_score is None and r.boilerplate_risk_score is None
    assert r.mdna_uncertainty_score is not None and r.liquidity_stress_score == 0.0
    assert r.score_coverage_ratio == pytest.approx(3 / 9) and "risk_factor_intensity_score" in r.missing_components
    weights = scoring.WEIGHTS
    present = [c for c in weights if r[c] is not None]
    assert r.overall_disclosure_risk_score == pytest.approx(sum(r[c] * weights[c] for c in present) / sum(weights[c] for c in present))


def test_flags_alone_carry_the_second_model(spark):
    rows = [(1, "item_8_01", 0, "Going concern. We received a subpoena.")]
    one, two = (scoring.component_scores(wide(spark, rows), model=m).first() for m in (1, 2))
    assert one.liquidity_stress_score is None and two.liquidity_stress_score == 65.0 and two.legal_regulatory_risk_score == 65.0
    assert two.event_severity_score is None and two.event_materiality_score == pytest.approx((65 * 0.45 * 2 + 0 * 0.25) / (0.45 * 2 + 0.25))
    names = {(e.component, e.name, e.section) for e in scoring.evidence(wide(spark, rows)).collect()}
    assert ("liquidity_stress_score", "going_concern_flag", "item_8_01") in names


def test_boosts_are_capped_and_need_a_base(spark):
    config = scoring.ScoringConfig(flag_points=100)
    r = scoring.component_scores(wide(spark, [(1, MD, 0, "Covenant breach and debt.")]), config, model=1).first()
    assert r.liquidity_stress_score == 100.0 and r.internal_controls_risk_score is None
    with pytest.raises(ValueError):
        scoring.ScoringConfig(weights={"tone_negativity_score": 1.0})


def test_the_first_section_decides_where_an_incident_counts(spark):
    rows = [(1, "item_1c_cybersecurity", 0, "A data breach."), (1, A1, 1, "A data breach."), (2, A1, 0, "A data breach."), (2, "item_1c_cybersecurity", 1, "A data breach.")]
    got = {r.filing_id: r.cybersecurity_incident_risk_score for r in scoring.component_scores(wide(spark, rows)).collect()}
    assert got == {1: None, 2: 65.0}


def test_calibration_and_confidence(spark):
    refs = [0.01, 0.02, 0.03, 0.04]
    df = spark.createDataFrame([(0.02,), (0.5,), (None,)], "v double")
    assert [r[0] for r in df.select(scoring.percentile_rank(F.col("v"), refs)).collect()] == [37.5, 100.0, None]
    scores = spark.createDataFrame([(0.5,)], "score_coverage_ratio double")
    c = scoring.confidence(scores, extraction=F.lit(0.9), diff=F.lit(None).cast("double"), warnings=F.array(F.lit("short_section"), F.lit("other")), required_present=F.lit(False), has_prior=F.lit(False)).first()
    assert c.confidence_base == pytest.approx(0.7) and c.confidence_penalty == pytest.approx(0.25 + 0.1 + 0.08 + 0.1) and c.confidence_score == pytest.approx(0.17)


def test_alignment_is_first_come_first_served():
    same = "alpha beta gamma delta"
    assert diff.align([same, same], [same]) == [(0, 0, 1.0)]
    assert diff.align([], [same]) == [] and diff.align(["x y"], []) == []
    assert diff.align(["one two three four"], ["five six seven", "one two three five"])[0][:2] == (0, 1)
    assert diff.text_similarity("aa bb", "aa bb", 10) == pytest.approx(1.0) and diff.text_similarity("aa", " ", 10) == 0.0
    assert diff.text_similarity("aa aa bb", "cc", 1) == 0.0


def test_diffs(spark):
    pairs = [("Sales grew 5%. Stable outlook.", "Sales grew 5%. Stable outlook."), ("Sales fell 9%. We face litigation and severe losses.", "Sales grew 5%. Stable outlook."), ("New text.", None), ("New text.", "")]
    df = metrics.with_text_parts(spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, text string, prior_text string"))
    from filingforge.functions import text as T

    df = df.withColumns({"prior_tokens": T.tokens("prior_text"), "prior_sentences": T.sentences("prior_text"), "prior_lower": F.lower("prior_text")})
    r = {x.id: x for x in diff.section_diffs(df).collect()}
    assert r[0].change_v1 == 0.0 and r[0].change_v2 == 0.0 and r[0].diff_summary == "Minor wording changes detected." and r[0].diff_confidence == 0.9
    assert r[1].new_topics == ["legal/regulatory"] and r[1].added_sentence_count >= 1 and r[1].changed_numeric_count >= 2 and r[1].change_v2 > r[0].change_v2
    for i in (2, 3):
        assert r[i].change_v1 is None and r[i].diff_confidence == 0.2 and r[i].lexical_similarity is None and r[i].added_sentence_count is None


def test_prior_periods_leave_gaps(spark):
    rows = [("e", "10-K", 2020, None, A1, 0, "t20"), ("e", "10-K", 2021, None, A1, 0, "t21"), ("e", "10-K", 2021, None, A1, 1, "t21b"), ("e", "10-K", 2023, None, A1, 0, "t23"), ("e", "10-Q", 2021, "Q1", A1, 0, "q1"), ("e", "10-Q", 2020, "Q3", A1, 0, "q3"), ("e", "10-Q", 2021, "Q2", A1, 0, "q2"), ("e", "10-K", 2022, None, MD, 0, "m22")]
    df = spark.createDataFrame(rows, "entity string, form_type string, fiscal_year int, quarter string, section string, section_ord int, text string")
    got = {r.text: r.prior_text for r in diff.pair_with_prior(df, columns=("text",)).collect()}
    assert got == {"t20": None, "t21": "t20", "t21b": "t20", "t23": None, "q1": "q3", "q3": None, "q2": "q1", "m22": None}


def test_gram_baseline_and_cover(spark):
    shared = "we face many known risks today"
    rows = [(i, A1, 0, f"{shared} and item{chr(97 + i)} differs entirely here") for i in range(4)] + [(9, A1, 0, "two words"), (10, A1, 0, None)]
    s = parts(spark, rows)
    base = boilerplate.gram_baseline(s, min_doc_freq=3, min_doc_frac=0.1)
    grams = {r.gram for r in base.collect()}
    assert "we face many known" in grams and all("item" not in g for g in grams)
    got = {r.filing_id: r for r in boilerplate.cross_firm_ratio(s, base, key="filing_id").collect()}
    assert got[0].covered_words == 7 and got[9].covered_words == 0 and got[10].boilerplate_cross_firm_ratio == 0.0


def test_grams_are_looked_up_where_the_texts_are(spark, monkeypatch):
    words = ["we", "face", "many", "known", "risks", "today"]
    rows = [(i, A1, 0, " ".join(words[(i * j + j) % 6] for j in range(i))) for i in range(60)] + [(60, A1, 0, None), (61, A1, 0, "one two")]
    s = parts(spark, rows).repartition(3)
    results = []
    for most in (boilerplate.BROADCAST_GRAMS, 0):
        monkeypatch.setattr(boilerplate, "BROADCAST_GRAMS", most)
        base = boilerplate.gram_baseline(s, min_doc_freq=5, min_doc_frac=0.05)
        cover = boilerplate.cross_firm_ratio(s, base, key="filing_id")
        assert ("Join" in cover._jdf.queryExecution().optimizedPlan().toString()) == (most == 0)
        results.append((sorted(map(tuple, base.collect())), sorted(map(tuple, cover.collect()))))
    tokens = [(i, (t or "").split()) for i, _, _, t in rows]
    grams = {}
    for i, t in tokens:
        for g in {tuple(t[k : k + 4]) for k in range(len(t) - 3)}:
            grams.setdefault(g, set()).add(i)
    kept = {g for g, at in grams.items() if len(at) >= 5}
    covered = {i: len({k + d for k in range(len(t) - 3) if tuple(t[k : k + 4]) in kept for d in range(4)}) for i, t in tokens}
    assert results[0] == results[1] and {tuple(g.split()): n for g, n, _ in results[0][0]} == {g: len(grams[g]) for g in kept} and kept
    assert {i: n for i, n, _ in results[0][1]} == covered and sum(covered.values()) > 100


def test_a_hash_that_meets_another_gram_is_no_hit(spark):
    texts = spark.createDataFrame([(1, ["a", "b", "c", "d", "e"]), (2, None), (3, ["a"])], "id int, tokens array<string>")
    wanted = spark.createDataFrame([("a b c d",), ("b c d e",)], "gram string").withColumn("h", boilerplate.hash_of())
    other = wanted.withColumn("gram", F.when(F.col("gram") == "a b c d", F.lit("x y z w")).otherwise(F.col("gram")))
    got = [{r.id: (r.n_tokens, r.pos, r.grams) for r in boilerplate.hits(texts, "id", w, n=4, tokens="tokens").collect()} for w in (wanted, other, wanted.limit(0))]
    assert got[0] == {1: (5, [0, 1], ["a b c d", "b c d e"]), 2: (0, [], []), 3: (1, [], [])}
    assert got[1][1] == (5, [1], ["b c d e"]) and got[2][1] == (5, [], [])


def test_quintiles_use_floors(spark):
    for n in (5, 7, 13):
        df = spark.createDataFrame([(i, float(i)) for i in range(n)] + [(98, float("nan")), (99, None)], "k int, v double").repartition(3)
        got = {r.k: r.quintile for r in validation.with_quintiles(df, "v", "k").collect()}
        assert got == {i: min(5, i * 5 // n + 1) for i in range(n)}


def test_time_joins(spark):
    filings = spark.createDataFrame([("a", date(2024, 1, 1)), ("a", date(2024, 1, 5)), ("b", date(2024, 1, 1))], "ticker string, filing_date date")
    events = spark.createDataFrame([("a", date(2024, 1, 1), 1.0), ("a", date(2024, 1, 5), 2.0), ("a", date(2024, 2, 1), 3.0)], "ticker string, event_date date, value double")
    got = {(r.ticker, r.filing_date.day): r.next_event_value for r in validation.first_after(filings, events).collect()}
    assert got == {("a", 1): 2.0, ("a", 5): 3.0, ("b", 1): None}
    closes = [100.0, 101.0, 99.0, 102.0]
    bars = spark.createDataFrame([("a", date(2024, 1, 2 + i), c) for i, c in enumerate(closes)], "ticker string, date date, close double")
    r = validation.realised_volatility(filings.limit(1), bars, days=90, least=3).first()
    logs = [math.log(b / a) for a, b in zip(closes, closes[1:])]
    mean = sum(logs) / 3
    assert r.trading_days == 4 and r.realized_vol == pytest.approx((sum((x - mean) ** 2 for x in logs) / 2) ** 0.5 * 252**0.5)


def test_resolution(spark):
    subs = [("1", "o", "10-K", "2022-02-01", "2021-12-31", 2021, "FY"), ("1", "a", "10-K/A", "2022-05-01", "2021-12-31", 2021, "FY"), ("1", "w", "10-K", "2021-02-01", "2020-12-31", None, None), ("1", "q", "10-Q", "2021-05-01", "2021-03-31", 2021, "Q1")]
    targets = [(1, "1", "10-K", 2021, None), (2, "1", "10-Q", 2021, "Q1"), (3, "1", "10-K", 2015, None), (4, "1", "10-Q", 2021, "Q2")]
    s = spark.createDataFrame(subs, "cik string, accession string, form string, filing_date string, report_date string, dei_fiscal_year int, dei_period string")
    t = spark.createDataFrame(targets, "target_id int, cik string, form_type string, fiscal_year int, quarter string")
    assert {r.target_id: r.accession for r in resolution.resolve(s, t).collect()} == {1: "o", 2: "q", 3: None, 4: None}
    html = spark.createDataFrame([("<ix:nonNumeric name='dei:DocumentFiscalYearFocus' x> 2023</ix>", ), (None,)], "h string")
    assert [r[0] for r in html.select(resolution.fiscal_tags(F.col("h"))[0]).collect()] == [2023, None]


def test_sections_and_clean_text(spark):
    page = "<html><script>var a='</p>';</script><style>x{}</style><p>Hello&nbsp;  <b>there</b></p><!-- c --><p>Nav</p><p>Nav</p><p>A &amp; B</p></html>"
    assert spark.range(1).select(sections.clean_html(F.lit(page))).first()[0] == "Hello\n\nthere\n\nNav\n\nA & B"
    body = "risk " * 300
    text = f"Item 1A. Risk Factors .......... 5 Item 7. Management .......... 9 Item 1A. Risk Factors {body} Item 7. Management discussion {'word ' * 60}"
    got = {r.section: r for r in sections.extract_sections(spark.createDataFrame([(1, text), (2, None), (3, "none")], "filing_id int, text string"), "10-K").collect()}
    assert got[A1].word_count == 304 and got[A1].section_ord == 1 and got[MD].word_count == 64 and got[MD].warnings == ["end_of_document"]
    assert got[A1].extraction_confidence == 0.9


def test_products(spark):
    df = spark.createDataFrame([(10.0,), (50.0,), (80.0,), (None,)], "s double")
    assert [r[0] for r in df.select(products.risk_band(F.col("s"))).collect()] == ["low", "moderate", "high", "missing"]
    req = spark.createDataFrame([(2, 0), (1, 1)], "filing_id int, ordinal int")
    got = products.panel(req, spark.createDataFrame([(1, 5.0)], "filing_id int, score double")).collect()
    assert [(r.ordinal, r.status, r.score) for r in got] == [(0, "error", None), (1, "ok", 5.0)]
    assert P.REQUIRED_SECTIONS["8-K"] == ("item_2_02",)
