"""Readers and writers of the tables that filings arrive in and results leave by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS_SCHEMA = "ticker string, fiscal_year int, section_name string, cleaned_text string, word_count int, extraction_confidence double, form_type string, html_path string, accession_number string, filing_date string, cik string, warnings array<string>"
MATRIX_SCHEMA = "ticker string, form_type string, fiscal_year int, sections map<string,string>, prior_sections map<string,string>, quality map<string,struct<word_count:int,extraction_confidence:double,warnings:array<string>>>"
SUBMISSIONS_SCHEMA = "cik string, filings struct<recent:struct<accessionNumber:array<string>,form:array<string>,filingDate:array<string>,reportDate:array<string>,primaryDocument:array<string>>>"


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """path, html: one row a file, undecodable bytes dropped."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit("")).alias("html"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of section texts; a broken line is a row with parse_error true."""
    rows = spark.read.schema(f"{CORPUS_SCHEMA}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.withColumn("parse_error", F.col("_broken").isNotNull()).drop("_broken")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, place: the lines of text files and where they stand, in an order that no split of the files changes.

    A place is a file's path, the start of the split and a number that rises with the lines of a task: a split is read by one
    task, from its start to its end, so places compare as lines of the files do, one file after the other by name.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select("value", place.alias("place"))


def last_per_ticker(rows: DataFrame, order: str = "place") -> DataFrame:
    """The last row of each ticker (in any case of letters) by `order`; combined where the rows are, so no ticker is hot."""
    name = F.upper(F.col("ticker"))
    return rows.groupBy(name.alias("_ticker")).agg(F.max_by(F.struct("*"), order).alias("_row")).select("_row.*")


def read_last_lines(spark: SparkSession, path: str, schema: str = CORPUS_SCHEMA) -> DataFrame:
    """The last line of each ticker of JSON lines; lines that aren't JSON, and those without a ticker, are passed over."""
    parsed = read_lines(spark, path).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), "place")
    return last_per_ticker(parsed.select("r.*", "place").where(F.col("ticker").isNotNull())).drop("place")


def read_matrix_corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of filings as long rows: ticker, form_type, fiscal_year, section, text, prior_text, quality."""
    rows = spark.read.schema(MATRIX_SCHEMA).json(path)
    long = rows.select("ticker", "form_type", "fiscal_year", "prior_sections", "quality", F.posexplode("sections").alias("section_ord", "section", "text"))
    return long.withColumns({"prior_text": F.try_element_at("prior_sections", "section"), "quality": F.try_element_at("quality", "section")}).drop("prior_sections")


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """ticker, cik (ten digits), company_name of a CSV whose header may be spelled in any case."""
    rows = spark.read.option("header", True).csv(path)
    names = {c.strip().lower(): c for c in rows.columns}
    pick = lambda *options: next((F.col(f"`{names[o]}`") for o in options if o in names), F.lit(None).cast("string"))
    ticker, cik = F.upper(F.trim(pick("ticker", "symbol"))), F.regexp_replace(pick("cik"), r"\D", "")
    out = rows.select(ticker.alias("ticker"), F.when(cik != "", F.lpad(cik, 10, "0")).alias("cik"), F.trim(pick("company_name", "name", "security")).alias("company_name"))
    return out.where(F.col("ticker") != "")


def read_holdout(spark: SparkSession, path: str) -> DataFrame:
    """ticker: the lines of a text file without comments and blanks."""
    return spark.read.text(path).select(F.upper(F.trim(F.regexp_replace("value", "#.*$", ""))).alias("ticker")).where("ticker <> ''").distinct()


def flatten_submissions(pages: DataFrame) -> DataFrame:
    """Columnar submission pages as rows: cik, accession, form, filing_date, report_date, primary_document."""
    zipped = F.arrays_zip(*[F.col(f"filings.recent.{c}").alias(c) for c in ("accessionNumber", "form", "filingDate", "reportDate", "primaryDocument")])
    rows = pages.select(F.lpad("cik", 10, "0").alias("cik"), F.inline(zipped))
    return rows.select("cik", F.col("accessionNumber").alias("accession"), "form", F.col("filingDate").alias("filing_date"), F.when(F.col("reportDate") != "", F.col("reportDate")).alias("report_date"), F.col("primaryDocument").alias("primary_document"))


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """Submission rows of JSON pages, one document a file."""
    return flatten_submissions(spark.read.schema(SUBMISSIONS_SCHEMA).option("multiLine", True).json(path))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """fiscal_year, n_written and one row a failure (ticker, reason)."""
    schema = "fiscal_year int, form string, universe string, n_written int, failures array<struct<ticker:string,reason:string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select("fiscal_year", "form", "n_written", F.explode_outer("failures").alias("f")).select("fiscal_year", "form", "n_written", "f.*")


def document_url(cik: Column, accession: Column, document: Column) -> Column:
    """The archive address of a filing's document, below a base the caller prepends."""
    return F.concat_ws("/", F.regexp_replace(cik, "^0+", ""), F.replace(accession, F.lit("-"), F.lit("")), document)


def write_filings(filings: DataFrame, path: str) -> None:
    """Landed filings by form and year, so that reads prune."""
    filings.write.mode("append").partitionBy("form_type", "fiscal_year").parquet(path)


def read_filing(spark: SparkSession, path: str, *, form_type: str, fiscal_year: int, cik: str, accession: str) -> DataFrame:
    """A point look-up that reads one partition's matching row groups."""
    rows = spark.read.parquet(path).where((F.col("form_type") == form_type) & (F.col("fiscal_year") == fiscal_year))
    return rows.where((F.col("cik") == cik) & (F.col("accession") == accession))


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    report.write.mode("overwrite").json(path)


def write_artifact(baseline: DataFrame, path: str) -> None:
    """An n-gram baseline, sorted by gram within files, by section and year."""
    baseline.sortWithinPartitions("gram").write.mode("overwrite").partitionBy("section", "fiscal_year").parquet(path)


def corpus_summary(scores: DataFrame, *, key: str = "ticker", score: str = "score") -> DataFrame:
    """One row: n, median to one place (by global ranks), least and most."""
    from filingforge.operators.validation import medians

    good = scores.where(F.col(score).isNotNull()).select(F.lit(1).alias("_all"), F.col(score).cast("double").alias("_score"))
    middle = medians(good, ["_all"], "_score").select(F.round("median", 1).alias("median"))
    ends = good.agg(F.count("*").alias("n"), F.round(F.min("_score"), 6).alias("least"), F.round(F.max("_score"), 6).alias("most"))
    return ends.join(F.broadcast(middle), how="left").select("n", "median", "least", "most")
