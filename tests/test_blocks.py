"""Sections from typed blocks of small pages."""

import re

import pytest
from pyspark.sql import functions as F

from filingforge.functions.term_packs import FORM_PATTERNS
from filingforge.operators import blocks, sections

BODY = "We operate in markets that change and our results depend on demand for our products. " * 8
LEGAL = "A claim was filed against us and we defend it with care in the court of the state. " * 6


def page(*parts: str) -> str:
    return "<html><body>" + "".join(parts) + "</body></html>"


TOC = "<p>Table of contents Item 1A. Risk Factors ..... 3 Item 1B. Staff Comments ..... 8 Item 3. Legal Proceedings ..... 9 Item 7. Management ..... 12</p>"
PAGES = [
    (1, page(TOC, "<p>" + BODY + "</p>", "<h2>Item 1A. Risk Factors</h2>", f"<p>{BODY}</p><p>{BODY}</p>", "<h2>Item 1B. Staff Comments</h2>", "<h2>Item 3. Legal Proceedings</h2>", f"<p>{LEGAL}</p>", "<h2>Item 7. Management's Discussion</h2>", f"<div>{BODY}</div>")),
    (2, page("<p>" + BODY + "</p>", "<p>See Item 1A. Risk Factors for more.</p>", "<p><b>Item 1A. Risk Factors</b></p>", f"<p>{BODY}</p>", "<table><tr><td>Item 7. Management</td><td>12</td></tr></table>", "<p><b>Item 7. Management</b></p>", f"<p>{BODY}</p>")),
    (3, page("<p>Nothing here.</p>")),
    (4, None),
    (5, ""),
    (6, page("<h2>Item 1A. Risk Factors</h2>", f"<p>{BODY[:600]}</p>", "<h2>Item 1B. Staff Comments</h2>")),
]


@pytest.fixture(scope="module")
def filings(spark):
    return spark.createDataFrame(PAGES, "filing_id long, html string")


def test_blocks_types_and_offsets(filings):
    ready = blocks.with_blocks(filings)
    full = {r.filing_id: r.full_text for r in ready.select("filing_id", "full_text").collect()}
    rows = blocks.block_rows(ready).collect()
    assert all(full[r.filing_id][r.start : r.start + len(r.text)] == r.text for r in rows)
    assert {r.type for r in rows} == {"text", "title", "table"} and {r.filing_id for r in rows} == {1, 2, 3, 6}
    assert [r.text for r in rows if r.filing_id == 2 and r.is_title] == ["Item 1A. Risk Factors", "Item 7. Management"]
    assert [r.is_toc for r in rows if r.filing_id == 1][0]


def test_titles_win_over_contents_mentions_and_tables(filings):
    found = {(r.filing_id, r.section): r for r in blocks.heading_candidates(blocks.block_rows(blocks.with_blocks(filings)), "10-K").where("score >= 50").collect()}
    assert set(found) == {(1, "item_1a_risk_factors"), (1, "item_3_legal_proceedings"), (1, "item_7_mdna"), (2, "item_1a_risk_factors"), (2, "item_7_mdna"), (6, "item_1a_risk_factors")}
    assert all(r.score == 105 for r in found.values())
    weak = blocks.heading_candidates(blocks.block_rows(blocks.with_blocks(filings)), "10-K").where("score < 50").collect()
    assert {"toc_suppressed"} <= {w for r in weak for w in r.warnings} and all("low_candidate_score" in r.warnings for r in weak)


def test_sections_run_to_the_next_one(filings):
    got = {(r.filing_id, r.section): r for r in blocks.extract(filings, "10-K").collect()}
    assert {s for f, s in got if f == 1} == {"item_1a_risk_factors", "item_3_legal_proceedings", "item_7_mdna"} and {f for f, _ in got} == {1, 2, 6}
    risks = got[1, "item_1a_risk_factors"]
    assert risks.text.startswith("Item 1A. Risk Factors") and "claim was filed" not in risks.text and risks.word_count > 200
    assert [got[1, s].section_ord for s in ("item_1a_risk_factors", "item_3_legal_proceedings", "item_7_mdna")] == [1, 2, 3]
    assert "open_ended_boundary" in got[1, "item_7_mdna"].warnings and got[1, "item_7_mdna"].extraction_confidence <= 0.76
    assert "item1a_resliced" in got[2, "item_1a_risk_factors"].warnings and got[2, "item_1a_risk_factors"].extraction_method == "best_match"
    assert "extraction_suspect" in got[6, "item_1a_risk_factors"].warnings and got[6, "item_1a_risk_factors"].word_count < 200


def test_best_item_1a_and_other_forms(filings):
    best = {r.filing_id: r for r in blocks.best_item_1a(blocks.with_blocks(filings), "10-K").collect()}
    assert set(best) == {1, 2, 6} and best[1].word_count > 200
    assert blocks.extract(filings, "8-K").count() == 0 and blocks.extract(filings.limit(0), "10-Q").count() == 0


def test_parse_warnings_go_to_the_first_section(spark, filings):
    from pyspark.sql import functions as F

    got = blocks.tagged(blocks.block_sections(blocks.with_blocks(filings), "10-K"), parse_warning=F.lit("sec_parser_unavailable")).collect()
    assert all(("sec_parser_unavailable" in r.warnings) == (r.section_ord == 1) for r in got) and got


def test_what_is_not_read_of_a_section_is_not_computed(spark, filings):
    ready = blocks.with_blocks(filings)
    for found in (blocks.block_sections(ready, "10-K"), blocks.extract(filings, "10-K"), sections.extract_sections(filings, "10-K", text="html")):
        plan = found.select("filing_id", "section", "word_count")._jdf.queryExecution().optimizedPlan().toString()
        assert "sha2" not in plan and "sha2" in found._jdf.queryExecution().optimizedPlan().toString()


def test_headings_of_all_sections_are_found_in_one_search(spark):
    texts = ["item 1a. risk factors 7a) quantitative 7. 3 legal proceedings x7 management item 9a 1c. cybersecurity", "Item 3. 7 Management 9a controls 7a. 7 management item\n1a - 1a risk\nfactors", "risk factors 1a", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "filing_id long, text string")
    for form, patterns in FORM_PATTERNS.items():
        got = {r.filing_id: [(x.at, x.section) for x in r.headings] for r in sections.heading_places(df, form, text="text").collect() if r.text}
        for i, t in enumerate(texts):
            if t:
                every = {s: [m.start() for m in re.finditer(rf"(?<![a-z0-9]){p}", t.lower())] for s, p in patterns.items()}
                assert sorted(s for _, s in got[i]) == sorted(s for s in every if every[s]) and all(at in every[s] for at, s in got[i])


def test_words_are_counted_up_to_a_body(spark):
    texts = ["", "...", "one", "...two, words", "a " * 49, "a " * 50, "a-" * 1000, "é1_ß 日本 x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(blocks.first_words(F.col("t"))).collect()] == [min(50, len(re.findall(r"\w+", t))) for t in texts]
