import json

from pyspark.sql import functions as F

from filingforge.sources import tables
from filingforge.streaming import ingest


def test_readers(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text(json.dumps({"ticker": "a", "fiscal_year": 2024, "cleaned_text": "x"}) + "\n{broken\n")
    got = tables.read_corpus(spark, str(tmp_path / "c.jsonl")).cache()
    assert sorted(r.parse_error for r in got.collect()) == [False, True]
    (tmp_path / "u.csv").write_text("Symbol,CIK,Security\n brk.b ,320193,Some Co\n,1,None\n")
    assert [tuple(r) for r in tables.read_universe(spark, str(tmp_path / "u.csv")).collect()] == [("BRK.B", "0000320193", "Some Co")]
    (tmp_path / "h.txt").write_text("# all\naapl # one\n\nmsft\n")
    assert {r.ticker for r in tables.read_holdout(spark, str(tmp_path / "h.txt")).collect()} == {"AAPL", "MSFT"}
    page = {"cik": "12", "filings": {"recent": {"accessionNumber": ["a", "b"], "form": ["10-K", "8-K"], "filingDate": ["2024-01-01", "2024-02-01"], "reportDate": ["2023-12-31", ""], "primaryDocument": ["x.htm", "y.htm"]}}}
    (tmp_path / "s.json").write_text(json.dumps(page, indent=1))
    rows = tables.read_submissions(spark, str(tmp_path / "s.json")).orderBy("accession").collect()
    assert [(r.cik, r.accession, r.report_date) for r in rows] == [("0000000012", "a", "2023-12-31"), ("0000000012", "b", None)]
    matrix = {"ticker": "a", "form_type": "10-K", "fiscal_year": 2024, "sections": {"s1": "t1", "s2": "t2"}, "prior_sections": {"s1": "p1"}, "quality": {"s1": {"word_count": 3, "extraction_confidence": 0.9, "warnings": []}}}
    (tmp_path / "m.jsonl").write_text(json.dumps(matrix) + "\n")
    assert {(r.section, r.prior_text) for r in tables.read_matrix_corpus(spark, str(tmp_path / "m.jsonl")).collect()} == {("s1", "p1"), ("s2", None)}
    (tmp_path / "p.html").write_bytes(b"<p>ok\xff</p>")
    assert tables.read_html(spark, str(tmp_path / "p.html")).first().html == "<p>ok</p>"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("1", "acc", "10-K", 2024, "<p>"), ("2", "b", "10-Q", 2023, "<p>")], "cik string, accession string, form_type string, fiscal_year int, html string")
    tables.write_filings(rows, str(tmp_path / "f"))
    assert tables.read_filing(spark, str(tmp_path / "f"), form_type="10-K", fiscal_year=2024, cik="1", accession="acc").count() == 1
    assert rows.select(tables.document_url(F.lit("0001"), F.lit("1-2-3"), F.lit("d.htm"))).first()[0] == "1/123/d.htm"


def test_a_stream_measures_each_section_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = {"filing_id": "f", "section": "item_1a_risk_factors", "section_ord": 0, "text": "Losses may grow.", "landed_at": "2024-01-01T00:00:00"}
    (tmp_path / "in" / "a.json").write_text((json.dumps(line) + "\n") * 2)
    query = ingest.start(ingest.metrics_stream(ingest.read_landed(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 1 and got[0].word_count == 3


def test_the_last_line_wins_at_any_split_size(spark, tmp_path):
    """Many files of many splits: the winner is that of reading all lines in order."""
    import json
    import random

    r, want, n = random.Random(7), {}, 0
    folder = tmp_path / "lines"
    folder.mkdir()
    for name in ("a.jsonl", "b.jsonl", "c.jsonl"):
        with open(folder / name, "w") as file:
            for _ in range(400):
                n += 1
                ticker = r.choice(["aa", "AA", "b", "cé", "d" * 50])
                if n % 17 == 0:
                    file.write(r.choice(["{broken", "", "null", '{"ticker": null}']) + "\n")
                    continue
                want[ticker.upper()] = n
                file.write(json.dumps({"ticker": ticker, "fiscal_year": n, "cleaned_text": "x" * r.randrange(60)}) + "\n")
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        for size in ("97b", "1k", "7k", "128m"):
            spark.conf.set(name, size)
            rows = tables.read_last_lines(spark, str(folder)).collect()
            assert {x.ticker.upper(): x.fiscal_year for x in rows} == want and len(rows) == 4
    finally:
        spark.conf.set(name, before)
