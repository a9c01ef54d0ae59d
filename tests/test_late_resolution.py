"""Two-phase resolution: pages are read for undecided targets alone."""

import glob

from pyspark.sql import functions as F

from filingforge.operators import resolution

SUBMISSIONS = "cik string, accession string, form string, filing_date string, report_date string"
TARGETS = "target_id int, cik string, form_type string, fiscal_year int, quarter string"
PAGES = "accession string, html string, form_type string, filing_year int"


def page(year, period):
    return f'<html><ix:nonNumeric name="dei:DocumentFiscalYearFocus" x="1"> {year}</ix:nonNumeric><b name="DocumentFiscalPeriodFocus">{period}</b></html>'


ROWS = [
    # Decided by metadata: one row has the best score.
    ("1", "1a", "10-K", "2022-02-01", "2021-12-31"), ("1", "1b", "10-K/A", "2022-05-01", "2021-12-31"),
    # A tie by the filing's year; the page of the second names the year.
    ("2", "2a", "10-K", "2021-03-01", None), ("2", "2b", "10-K", "2021-03-01", None),
    # No row fits; four are dated near the year, of which the first three by report date are looked up.
    ("3", "3a", "10-K", "2019-03-01", "2018-12-31"), ("3", "3b", "10-K", "2019-06-01", "2019-03-31"), ("3", "3c", "10-K", "2019-07-01", "2019-04-30"), ("3", "3d", "10-K", "2019-08-01", "2019-05-31"), ("3", "3e", "10-K", "2016-01-01", None),
    # The page of the only hint is that of a quarter; another's isn't landed.
    ("4", "4a", "10-K", "2019-03-01", "2018-12-31"), ("5", "5a", "10-K", "2019-03-01", "2018-12-31"),
    # Quarters: metadata hold no period, so pages decide.
    ("6", "6a", "10-Q", "2020-05-01", "2020-03-31"), ("6", "6b", "10-Q", "2020-08-01", "2020-06-30"),
]
ASKED = [(1, "1", "10-K", 2021, None), (2, "2", "10-K", 2021, None), (3, "3", "10-K", 2020, None), (4, "4", "10-K", 2020, None), (5, "5", "10-K", 2020, None), (6, "6", "10-Q", 2020, "Q2"), (7, "none", "10-K", 2020, None), (8, "3", "10-K", 2010, None)]
LANDED = [("1a", page(1999, "Q1")), ("1b", page(2021, "FY")), ("2a", page(2020, "FY")), ("2b", page(2021, "fy")), ("3b", page(2020, "FY")), ("3d", page(2020, "FY")), ("3e", page(2020, "FY")), ("4a", page(2020, "Q2")), ("6a", page(2020, "Q1")), ("6b", page(2020, "Q2"))]


def landed(spark):
    years = {r[1]: int(r[3][:4]) for r in ROWS}
    forms = {r[1]: r[2][:4] for r in ROWS}
    return spark.createDataFrame([(a, h, forms[a], years[a]) for a, h in LANDED], PAGES)


def test_pages_decide_what_metadata_leave_open(spark):
    got = resolution.resolve_late(spark.createDataFrame(ROWS, SUBMISSIONS), spark.createDataFrame(ASKED, TARGETS), landed(spark)).collect()
    assert {r.target_id: (r.accession, r.decided_by) for r in got} == {
        1: ("1a", "metadata"), 2: ("2b", "page"), 3: ("3b", "page"), 4: (None, None), 5: (None, None), 6: ("6b", "page"), 7: (None, None), 8: (None, None),
    }
    assert {r.target_id: r.score for r in got}[2] == 3e9 + 1e5 + 20210301


def test_at_most_three_candidates(spark):
    kept = resolution.page_candidates(spark.createDataFrame(ROWS, SUBMISSIONS), spark.createDataFrame(ASKED, TARGETS)).collect()
    by = {}
    for r in sorted(kept, key=lambda r: r["rank"]):
        by.setdefault(r.target_id, []).append(r.accession)
    assert by == {1: ["1a"], 2: ["2a", "2b"], 3: ["3a", "3b", "3c"], 4: ["4a"], 5: ["5a"], 6: ["6a", "6b"]}
    assert {r.target_id for r in kept if r.open} == {2, 3, 4, 5, 6}


def test_pages_of_decided_targets_are_never_read(spark, tmp_path):
    path = str(tmp_path / "pages")
    landed(spark).write.partitionBy("form_type", "filing_year").parquet(path)
    spoiled = glob.glob(f"{path}/form_type=10-K/filing_year=2022/*.parquet") + glob.glob(f"{path}/form_type=10-K/filing_year=2016/*.parquet")
    assert len(spoiled) >= 2
    for name in spoiled:  # a reader that opened these would fail
        with open(name, "wb") as file:
            file.write(b"not a table")
    pages = spark.read.schema(PAGES).parquet(path)
    got = resolution.resolve_late(spark.createDataFrame(ROWS, SUBMISSIONS), spark.createDataFrame(ASKED, TARGETS), pages).collect()
    assert {r.target_id for r in got if r.decided_by == "page"} == {2, 3, 6}


def test_empty_and_repeated(spark):
    subs, asked = spark.createDataFrame(ROWS, SUBMISSIONS), spark.createDataFrame(ASKED, TARGETS)
    assert resolution.resolve_late(subs.limit(0), asked, landed(spark)).where("accession is null").count() == len(ASKED)
    assert resolution.resolve_late(subs, asked.limit(0), landed(spark)).count() == 0
    again = resolution.resolve_late(subs, asked, landed(spark).union(landed(spark))).where("decided_by = 'page'")
    assert sorted(r.accession for r in again.collect()) == ["2b", "3b", "6b"]
