from collections import Counter

import duckdb
import pytest

from filingforge.plans import registry

SF = "/root/testdata/sf0.001"


def rows_of_sql(name):
    con = duckdb.connect()
    for t in ("customer", "lineitem", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con.execute(registry.ORACLES[name]).fetchall()


def plain(rows):
    return Counter(tuple(round(float(x), 5) if isinstance(x, float) else str(x) for x in r) for r in rows)


def rows_of_query(spark, name):
    return [tuple(r) for r in registry.QUERIES[name](spark, SF).collect()]


@pytest.mark.parametrize("name, source", [("calibration_all", "lineitem"), ("panel_all", "customer"), ("prior_pairs_all", "documents")])
def test_whole_tables_are_read(spark, name, source):
    got = rows_of_query(spark, name)
    assert len(got) == spark.read.parquet(f"{SF}/{source}.parquet").count() and plain(got) == plain(rows_of_sql(name))


@pytest.mark.parametrize("name", ["calibration", "panel", "prior_pairs"])
def test_limited_names_keep_the_results_of_their_sql(spark, name):
    assert plain(rows_of_query(spark, name)) == plain(rows_of_sql(name))


def test_each_filing_has_a_score(spark):
    ids = {r[0] for r in rows_of_query(spark, "scores_with_priors")}
    assert ids == {r.doc_id // 6 for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}


def test_item_7_holds_the_whole_text(spark):
    counts = {}
    for r in rows_of_query(spark, "section_extraction"):
        counts.setdefault(r[1], {})[r[0]] = r[3]
    whole, last = counts["item_1a_risk_factors"], counts["item_7_mdna"]
    assert max(whole.values()) > 2000 and {d: last[d] - n for d, n in whole.items() if not -3 <= last[d] - n <= 3} == {}



def test_required_sections_match_their_sql(spark):
    assert plain(rows_of_query(spark, "required_sections")) == plain(rows_of_sql("required_sections"))
