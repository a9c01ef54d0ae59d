import duckdb
import pytest

from filingforge.plans import metric_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kept", ["doc_id <= 6", "doc_id % 6 <> 0"])
def test_scores_without_their_sections_are_null_in_the_sql_too(spark, tmp_path, kept):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{SF}/documents.parquet' WHERE {kept}) TO '{tmp_path}/documents.parquet'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    wanted = {r[0]: r for r in con.execute(metric_queries.ORACLES["headline_scores"]).fetchall()}
    got = {r[0]: tuple(r) for r in metric_queries.headline_scores(spark, str(tmp_path)).collect()}
    assert got == wanted and any(None in r for r in got.values())


def test_the_sql_rounds_halves_up():
    value = lambda sql: duckdb.connect().execute(f"SELECT {sql}").fetchone()[0]
    halves = [(f"CAST({n}.5177375 AS DOUBLE)", n + 0.517738) for n in range(5)] + [("CAST(4.0144125 AS DOUBLE)", 4.014413), ("CAST(NULL AS DOUBLE)", None), ("1e-7::DOUBLE", 0.0), ("100.0::DOUBLE", 100.0)]
    assert [value(metric_queries._six(sql)) for sql, _ in halves] == [x for _, x in halves]
