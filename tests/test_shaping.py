"""Parameters, orders, formats, chunks, exact rounding, gates and baselines."""

import random

import pytest
from pyspark.sql import functions as F

from filingforge.operators import reports, resolution, scoring, shaping


def test_parameters():
    assert shaping.sections_param(" item_7_mdna , item_1a_risk_factors", "10-K/A") == {"item_7_mdna", "item_1a_risk_factors"} and shaping.sections_param(" ", "10-K") is None
    assert shaping.include_param(None) == {"metrics", "provenance"} and shaping.include_param("") == set() and shaping.fields_param("overall") == {"overall"}
    assert (shaping.form_of("10-q/a"), shaping.quarter_of(" q2 "), shaping.quarter_of(""), shaping.scoring_version(" V1 "), shaping.compare_param("none")) == ("10-Q", "Q2", None, 1, False)
    for call in (lambda: shaping.sections_param("item_2_mdna", "10-K"), lambda: shaping.fields_param("x"), lambda: shaping.include_param("y"), lambda: shaping.form_of("S-1"), lambda: shaping.quarter_of("Q5"), lambda: shaping.compare_param("z"), lambda: shaping.scoring_version("v3")):
        with pytest.raises(ValueError):
            call()


def test_rounding_is_that_of_exact_values(spark):
    r = random.Random(1)
    values = [2.675, 1.005, 0.125, 0.375, 2.5, 0.5, -0.125, -2.675, 1e17, 0.0, 1.45, 8.345, 123456.785] + [r.randrange(10**7) / 1000 for _ in range(2000)] + [r.random() * 10 ** r.randrange(6) for _ in range(1000)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    got = frame.select("v", *[shaping.round_exact(F.col("v"), n).alias(f"r{n}") for n in (1, 2, 4, 6)]).collect()
    for x in got:
        assert (x.r1, x.r2, x.r4, x.r6) == (round(x.v, 1), round(x.v, 2), round(x.v, 4), round(x.v, 6)), x.v


def test_formats_orders_and_facts(spark):
    row = spark.range(1).select(shaping.score_text(F.lit(12.34)).alias("a"), shaping.score_text(F.lit(None).cast("double")).alias("b"), shaping.delta_text(F.lit(0.5)).alias("c"), shaping.delta_text(F.lit(-1.0)).alias("d"), shaping.delta_label(F.lit("legal_language_delta")).alias("e"), shaping.delta_label(F.lit("tone_x_delta")).alias("f")).first()
    assert tuple(row) == ("12.3", "—", "+0.50 pp", "-1.00 pp", "Legal language", "Tone X")
    changes = spark.createDataFrame([(1, "a", None), (1, "b", 2.0), (1, "c", 5.0)], "filing_id long, section string, change_score double")
    assert [r.section for r in shaping.change_order(changes, "filing_id").orderBy("place").collect()] == ["c", "b", "a"]
    flags = spark.createDataFrame([(1, "settlement_flag", "A"), (1, "restatement_flag", "Z")], "filing_id long, flag string, label string").withColumn("section", F.lit("s"))
    assert [r.label for r in shaping.flag_order(flags, "filing_id").orderBy("place").collect()] == ["Z", "A"]
    found = spark.createDataFrame([(1, "item_1a_risk_factors", 1, ["b", "a"]), (1, "item_7_mdna", 2, ["a", "c"]), (2, "item_7_mdna", 1, [])], "filing_id long, section string, section_ord int, warnings array<string>")
    facts = {r.filing_id: (r.warnings, r.required_sections_present) for r in shaping.extraction_facts(found, "10-K").collect()}
    assert facts == {1: (["b", "a", "c"], True), 2: (["missing_required_section"], False)}
    assert shaping.only_sections(found, {"item_7_mdna"}).count() == 2


def test_chunks(spark):
    def brute(text, most):
        lines = [p.strip() for p in text.split("\n") if p.strip()]
        out, now = [], ""
        for p in lines:
            if len(now) + len(p) + 1 <= most:
                now = f"{now}\n{p}".strip()
            else:
                if now:
                    out.append(now)
                now = p
        return (out + [now]) if lines else [""]

    texts = ["", "\n \n", "a\nb\nc", "x" * 30 + "\ny\nz", "ab\n" * 9, " lead \n trail "]
    got = {r.t: r.c for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", shaping.chunks(F.col("t"), 8).alias("c")).collect()}
    assert got == {t: brute(t, 8) for t in texts}


def test_baselines_fall_back(spark):
    refs = [("m", "10-K", "tech", 2024, [1.0, 3.0]), ("m", "10-K", "tech", None, [2.0]), ("m", "10-K", None, 2024, [5.0, 7.0]), ("m", "10-K", None, None, [9.0])]
    table = spark.createDataFrame(refs, "metric string, form_type string, sector string, fiscal_year int, references array<double>")
    rows = spark.createDataFrame([(1, "m", "10-K", " Tech", 2024), (2, "m", None, "tech", 2020), (3, "m", "10-K", "x", 2024), (4, "m", "10-K", None, None), (5, "n", "10-K", None, None)], "id long, metric string, form_type string, sector string, fiscal_year int")
    got = {r.id: (r.references, r.cohort, r.n, r.mean, r.std) for r in scoring.lookup_baseline(rows, table).collect()}
    assert got[1] == ([1.0, 3.0], "tech:10-K:2024", 2, 2.0, 2.0**0.5) and got[2][:2] == ([2.0], "tech:10-K") and got[2][4] is None
    assert got[3][:2] == ([5.0, 7.0], "10-K:2024") and got[4][:2] == ([9.0], "10-K") and got[5] == (None, None, None, None, None)


def test_targets_with_priors_and_pages(spark):
    subs = spark.createDataFrame([("1", "a24", "10-K", "2025-02-01", "2024-12-31", 2024, "FY", None, None), ("1", "a23", "10-K", "2024-02-01", "2023-12-31", 2023, "FY", None, None), ("2", "h", "10-K", "2021-05-01", "2020-12-31", 2020, "FY", 2024, "FY"), ("2", "q", "10-K", "2025-05-01", "2024-12-31", 2024, "FY", 2024, "Q2")], "cik string, accession string, form string, filing_date string, report_date string, dei_fiscal_year int, dei_period string, html_fiscal_year int, html_period string")
    targets = spark.createDataFrame([(1, "1", "10-K", 2024, None), (2, "2", "10-K", 2024, None), (3, "9", "10-K", 2024, None)], "target_id long, cik string, form_type string, fiscal_year int, quarter string")
    got = {r.target_id: (r.accession, r.prior_accession, r.unresolved) for r in resolution.resolve_with_prior(subs, targets).collect()}
    assert got == {1: ("a24", "a23", False), 2: ("h", None, False), 3: (None, None, True)}
    pages = spark.createDataFrame([("a24", "<p>now</p>")], "accession string, html string")
    both = {r.target_id: (r.html, r.prior_accession, r.has_prior) for r in resolution.bundles(resolution.resolve_with_prior(subs, targets), pages).collect()}
    assert both[1] == ("<p>now</p>", None, False)
    with pytest.raises(Exception, match="no filing for target 3"):
        resolution.resolve_with_prior(subs, targets, required=True).collect()


def test_reports(spark):
    assert {r.status for r in reports.edgar_gates(spark.createDataFrame([], "extraction_confidence double"), universe_expected=0, n_input=0).collect()} == {"fail"}
    empty = reports.matrix_gates(spark.createDataFrame([], "filing_id long, form_type string, section string, text string, extraction_confidence double"), spark.createDataFrame([], "a double"), components=("a",))
    assert {r.name: r.status for r in empty.collect()}["non_empty_corpus"] == "fail"
    rows = spark.createDataFrame([("A", "item_1a_risk_factors", "t", 300, 0.8), ("B", "item_1a_risk_factors", "t", 100, 0.9)], "ticker string, section string, text string, word_count int, extraction_confidence double")
    assert {r.ticker: r.quality_tier for r in reports.corpus_rows(rows).collect()} == {"A": "analysis", "B": "extracted"}
    asked, filings = spark.createDataFrame([("A",), ("C",), ("D",)], "ticker string"), spark.createDataFrame([("A",), ("C",)], "ticker string")
    assert {(r.ticker, r.reason) for r in reports.missing_reasons(asked, filings, reports.corpus_rows(rows)).collect()} == {("C", "no_section"), ("D", "filing_not_found")}
    have = spark.createDataFrame([("r", {"parser_version": "1", "dictionary_version": "9"})], "path string, versions map<string,string>")
    want = spark.createDataFrame([("r", {"parser_version": "2", "dictionary_version": "8", "x": "1"}), ("s", {"parser_version": "2"})], "path string, versions map<string,string>")
    assert {(r.path, r.key, r.problem) for r in reports.stale_versions(have, want).collect()} == {("r", "parser_version", "stale version"), ("r", "x", "missing version"), ("s", "parser_version", "missing report")}
    assert reports.taxonomy(spark).where("kind = 'flag'").count() == 13
    scored = reports.score_corpus(spark.createDataFrame([("A", "item_1a_risk_factors", 0, "Losses may decline and adverse claims are pending in 2023.")], "ticker string, section string, section_ord int, text string")).first()
    assert scored.risk_factor_intensity_score > 0 and scored.disclosure_change_score is None
