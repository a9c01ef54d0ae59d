"""Readers, artifacts and products that queries don't call."""

import json

import pytest
from pyspark.sql import functions as F

from filingforge.operators import boilerplate, products, reports, resolution, shaping
from filingforge.sources import tables


def test_gram_artifacts_by_year_with_fallback(spark, tmp_path):
    path = str(tmp_path / "grams")
    rows = [(2023, "a", "we face many risks", 3), (2024, "a", "no assurance can be", 4), (2024, "b", "other section grams here", 5)]
    tables.write_artifact(spark.createDataFrame(rows, "fiscal_year int, section string, gram string, doc_freq int"), path)
    stored = spark.read.parquet(path)
    pick = lambda year, section: sorted(r.gram for r in boilerplate.latest_artifact(stored, year, section).collect())
    assert pick(2023, "a") == ["we face many risks"] and pick(2024, "a") == ["no assurance can be"]
    assert pick(2019, "a") == ["no assurance can be"] and pick(2019, "b") == ["other section grams here"] and pick(2024, "c") == []


def test_manifest_and_report_files(spark, tmp_path):
    manifest = {"fiscal_year": 2025, "form": "10-K", "universe": "x", "n_written": 2, "failures": [{"ticker": "A", "reason": "no filing"}, {"ticker": "B", "reason": "no text"}]}
    (tmp_path / "m.json").write_text(json.dumps(manifest, indent=1))
    (tmp_path / "n.json").write_text(json.dumps(manifest | {"fiscal_year": 2024, "failures": []}))
    got = sorted(map(tuple, tables.read_manifest(spark, str(tmp_path / "m.json")).collect()))
    assert got == [(2025, "10-K", 2, "A", "no filing"), (2025, "10-K", 2, "B", "no text")]
    assert [tuple(r) for r in tables.read_manifest(spark, str(tmp_path / "n.json")).collect()] == [(2024, "10-K", 2, None, None)]
    report = spark.createDataFrame([("gate", 0.5, "pass"), ("other", None, "fail")], "name string, value double, status string")
    tables.write_report(report, str(tmp_path / "report"))
    assert sorted(map(str, spark.read.schema(report.schema).json(str(tmp_path / "report")).collect())) == sorted(map(str, report.collect()))


def test_corpus_summary(spark):
    scores = lambda *xs: spark.createDataFrame([(str(i), x) for i, x in enumerate(xs)], "ticker string, score double")
    row = lambda *xs: tuple(tables.corpus_summary(scores(*xs)).first())
    assert row(1.0, 4.0, None, 2.0, 3.0) == (4, 2.5, 1.0, 4.0) and row(5.25, 1.0, 9.0) == (3, 5.3, 1.0, 9.0)
    assert row(None) == (0, None, None, None)


def test_flags_by_section_and_panels(spark):
    active = spark.createDataFrame([(1, "s1", "b_flag", "B", "x"), (1, "s1", "a_flag", "A", "x"), (1, "s2", "a_flag", "A", "x"), (1, "s1", "a_flag", "A", "x")], "filing_id int, section string, flag string, label string, tier string")
    assert sorted(map(tuple, products.flag_groups(active, "filing_id").collect())) == [(1, "s1", "A,B", 2), (1, "s2", "A", 1)]
    panel = spark.createDataFrame([("ok",), ("ok",), ("error",)], "status string")
    assert {r.status: r.n for r in products.panel_summary(panel).collect()} == {"ok": 2, "error": 1}
    scores = spark.createDataFrame([(1, 2.0, 0.5, 3.0, 4.0, 9.0)], "filing_id int, overall_disclosure_risk_score double, score_coverage_ratio double, disclosure_quality_score double, disclosure_change_risk_score double, other double")
    assert products.preset(scores, ["filing_id"], "lite").columns == ["filing_id", "overall_disclosure_risk_score", "score_coverage_ratio"]
    assert len(products.preset(scores, ["filing_id"], "standard").columns) == 5 and products.preset(scores, ["filing_id"], "analyst").columns == scores.columns
    with pytest.raises(KeyError):
        products.preset(scores, ["filing_id"], "none")


def test_construct_report(spark):
    rows = spark.createDataFrame([(str(i), float(i), float(i * i), float(-i), None if i == 2 else float(i % 3)) for i in range(9)], "ticker string, a double, b double, c double, d double")
    got = {r.name: (r.n, r.rho) for r in reports.construct_report(rows, {"same": ("a", "b"), "against": ("a", "c"), "part": ("a", "d")}).collect()}
    assert got["same"] == (9, pytest.approx(1.0)) and got["against"] == (9, pytest.approx(-1.0)) and got["part"][0] == 8


def test_listings_and_pages(spark):
    schema = "cik string, accession string, form string, filing_date string, dei_period string"
    a = spark.createDataFrame([("1", "x", "10-K", "2024-02-01", "FY"), ("1", "y", "10-K/A", "2024-02-01", "FY"), ("1", "z", "10-K/A", "2024-03-05", "FY")], schema)
    b = spark.createDataFrame([("1", "x", "10-K", "2024-02-01"), ("2", "w", "10-Q", "2024-05-01")], "cik string, accession string, form string, filing_date string")
    every = resolution.all_pages([a, b])
    assert sorted(r.accession for r in every.collect()) == ["w", "x", "y", "z"] and every.where("accession = 'w' AND dei_period IS NULL").count() == 1
    # A day is worth one, a month a hundred: an original is a hundred above an amendment of its day.
    best = {(r.cik, r.form_type): r.accession for r in resolution.best_listing(every).collect()}
    assert best == {("1", "10-K"): "z", ("2", "10-Q"): "w"}
    assert resolution.best_listing(a.where("accession <> 'z'")).first().accession == "x"


def test_summaries_evidence_and_published_places(spark):
    sections = spark.createDataFrame([(1, "s", 3, 0.5, ["w"], "text")], "filing_id int, section string, word_count int, extraction_confidence double, warnings array<string>, text string")
    assert shaping.section_summaries(sections, ["filing_id"]).columns == ["filing_id", "section", "word_count", "extraction_confidence", "warnings"]
    assert shaping.section_summaries(sections, ["filing_id"], include_text=True).first().text == "text"
    rows = spark.createDataFrame([(1, 0.12345, 1.005, 2.675, None)], "id int, lexical_similarity double, change_v1 double, change_v2 double, diff_confidence double")
    assert tuple(shaping.as_published(rows).first()) == (1, round(0.12345, 4), round(1.005, 2), round(2.675, 2), None)
    from filingforge.operators import diff
    from filingforge.plans.diff_queries import with_parts

    pairs = with_parts(spark.createDataFrame([(1, "We may face 30 claims. Demand fell.", "We face 20 claims.", 1)], "id int, text string, prior_text string, n int"))
    evidence = shaping.diff_evidence(diff.section_diffs(pairs)).first().evidence
    assert list(evidence.added_numbers) == ["30"] and list(evidence.removed_numbers) == ["20"] and len(evidence.added_sentences) <= 3


def test_every_sample_has_a_bound(spark):
    got = spark.range(1).select(shaping.samples(F.sequence(F.lit(1), F.lit(50)), 20).alias("a")).first().a
    assert got == list(range(1, 21))
