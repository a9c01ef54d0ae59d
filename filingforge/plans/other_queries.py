"""Validation statistics, time joins, resolution, HTML text and panels over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingforge.functions import text as T
from filingforge.operators import blocks, distribution, products, reports, resolution, scoring, sections, shaping, validation
from filingforge.session import spread, table
from filingforge.sources import landed, results, tables
from filingforge.staging import scratch

from .corpus import frame


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean text of each page, by length and digest."""
    t = table(spark, sf_dir, "pages").withColumn("t", sections.clean_html(F.col("html")))
    return t.select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


#: A filing of three documents under headings, after a table of contents.
HEADED_SQL = """SELECT doc_id AS filing_id, 'Table of contents. Item 1A. Risk Factors .......... 3 Item 7. Management .......... 9 ' || 'Item 1A. Risk Factors ' || coalesce(text, '')
  || ' Item 3. Legal Proceedings None. Item 7. Management discussion ' || coalesce(text, '') AS text FROM documents"""


def section_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections cut from headed texts."""
    out = sections.extract_sections(frame(spark, sf_dir, HEADED_SQL, "documents"), "10-K")
    return out.select("filing_id", "section", "section_ord", F.col("word_count").cast("long").alias("word_count"), "extraction_confidence", F.array_join("warnings", ",").alias("warnings"))


def required_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which filings have all required sections."""
    found = sections.extract_sections(frame(spark, sf_dir, HEADED_SQL, "documents"), "10-K")
    return sections.required_present(found, "10-K").select("filing_id", "required_sections_present", F.array_join("missing", ",").alias("missing"))


#: Filings of a document each, from which, by their number, the risks, the discussion or both are missing: filing_id, text.
PARTIAL_SQL = """SELECT doc_id AS filing_id, 'Cover page. ' || CASE WHEN doc_id % 4 IN (0, 1) THEN 'Item 1A. Risk Factors ' || coalesce(text, '') ELSE '' END || ' Item 3. Legal Proceedings None. '
  || CASE WHEN doc_id % 4 IN (0, 2) THEN 'Item 7. Management discussion ' || coalesce(text, '') ELSE '' END AS text FROM documents"""


def required_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which required sections filings lack."""
    found = sections.extract_sections(frame(spark, sf_dir, PARTIAL_SQL, "documents"), "10-K")
    return sections.required_present(found, "10-K").select("filing_id", "required_sections_present", F.array_join("missing", ",").alias("missing"))


def filing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each supplier, written as one file each and read back."""
    path = scratch(spark, "filings")
    rows = F.array(F.struct(F.lit("Balance & rest").alias("label"), F.format_string("%.2f", F.col("s_acctbal")).alias("value"), F.when(F.col("s_acctbal") < 0, F.lit("low")).otherwise(F.lit("high")).alias("band")))
    landed.write_pages(table(spark, sf_dir, "supplier"), path, name="s_name", content=landed.score_page(F.concat(F.lit("<"), F.col("s_name"), F.lit(">")), rows))
    return tables.read_html(spark, f"{path}/part-*").select(F.regexp_extract("html", "<h1>&lt;(.*?)&gt;</h1>", 1).alias("s_name"), F.md5("html").alias("digest"))


def quintiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance quintiles of customers with their size and mean."""
    q = validation.with_quintiles(table(spark, sf_dir, "customer"), "c_acctbal", "c_custkey")
    return q.groupBy("quintile").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 6).alias("mean_balance"), F.min("c_custkey").alias("least_key"))


def monotonicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether expensive parts are larger, by first and last quintile."""
    out = validation.quintile_monotonicity(table(spark, sf_dir, "part").withColumn("size", F.col("p_size").cast("double")), "p_retailprice", "size", "p_partkey")
    return out.select("n", "q1_n", "q5_n", F.round("q1_mean", 6).alias("q1_mean"), F.round("q5_mean", 6).alias("q5_mean"), F.round("q5_q1_ratio", 6).alias("q5_q1_ratio"), "status")


def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spearman correlation of documents' lengths and their quality labels' order."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.col("n_chars").cast("double").alias("x"), (F.col("quality") * 2 + F.col("toxic")).cast("double").alias("y"))
    return validation.spearman(d, "x", "y", "doc_id").select("n", F.round("rho", 6).alias("rho"))


def rank_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty parts whose ranks by price and by size differ most."""
    p = table(spark, sf_dir, "part").withColumn("size", F.col("p_size").cast("double"))
    return validation.rank_gaps(p, "p_retailprice", "size", "p_partkey").select("p_partkey", "gap", "rx", "ry")


BARS_SQL = "SELECT CAST(user_id AS STRING) AS ticker, CAST(ts AS DATE) AS date, max(value) + 1 AS close FROM events WHERE value IS NOT NULL GROUP BY 1, 2"
FILED_SQL = "SELECT CAST(user_id AS STRING) AS ticker, min(CAST(ts AS DATE)) AS filing_date FROM events GROUP BY 1"


def volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annualised volatility in the 25 days after each user's first day."""
    bars, filed = (frame(spark, sf_dir, q, "events") for q in (BARS_SQL, FILED_SQL))
    out = validation.realised_volatility(filed, bars, days=25, least=3)
    return out.select("ticker", "trading_days", F.round("realized_vol", 6).alias("realized_vol"))


def log_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily log returns of each user's values."""
    out = validation.log_returns(frame(spark, sf_dir, BARS_SQL, "events"))
    return out.select("ticker", F.col("date").cast("string").alias("date"), F.round("log_return", 6).alias("log_return"))


def next_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order of each customer strictly after each customer's large orders."""
    o = table(spark, sf_dir, "orders")
    large = o.where("o_totalprice > 200000").select(F.col("o_custkey").alias("ticker"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("filing_date"))
    after = o.groupBy(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("event_date")).agg(F.max("o_totalprice").alias("value"))
    return validation.first_after(large, after).select("id", F.col("next_event_date").cast("string").alias("next_event_date"), "next_event_value")


def corpus_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's length among those of its language."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("score"))
    return products.corpus_context(d, "score", ["lang"]).select("doc_id", "cohort_n", "cohort_median", "percentile")


def stored_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's price among those of its size, by a stored distribution that three batches have extended, one of them sent twice."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_retailprice").alias("score"))
    path = scratch(spark, "distribution")
    for batch in (0, 1, 2, 1):
        distribution.extend(spark, distribution.histogram(p.where(F.col("p_partkey") % 3 == batch), "score", ["p_size"]), path, str(batch))
    out = distribution.with_context(p, distribution.load(spark, path, ["p_size"]), "score", ["p_size"])
    return out.select("p_partkey", "cohort_n", "cohort_median", "percentile")


def cached_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts of documents, kept by content; the second run, after a tenth of the texts changed, computes these alone."""
    path, schema, versions = scratch(spark, "results"), "n_words long, digest string", {"metrics": "3"}
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    compute = lambda rows: rows.select("cache_key", F.size(T.word_runs("text")).cast("long").alias("n_words"), F.md5("text").alias("digest"))
    results.cached(docs, compute, path, columns=["text"], versions=versions, schema=schema)
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" changed once"))).otherwise(F.col("text")))
    return results.cached(changed, compute, path, columns=["text"], versions=versions, schema=schema).select("doc_id", "n_words", "digest", "cache_new")


def last_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last line of each customer in files of orders as JSON lines, written in the order of their keys."""
    path = scratch(spark, "lines")
    lines = table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(F.concat(F.lit("c"), F.col("o_custkey")).alias("ticker"), F.col("o_orderkey").alias("number"))).alias("value"))
    lines.repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").select("value").write.text(path)
    return tables.read_last_lines(spark, path, "ticker string, number long")


CHECKS = (("parse_error", "text IS NULL"), ("holdout", "doc_id % 11 = 0"), ("wrong_section", "lang NOT IN ('en', 'de')"), ("short_text", "n_chars < 800"), ("low_confidence", "(doc_id % 20) / 20.0 < 0.15"))


def filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First reason to leave a row out, counted."""
    out = validation.filter_reasons(table(spark, sf_dir, "documents"), [(n, F.expr(e)) for n, e in CHECKS])
    return out.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


SUBMISSIONS_SQL = """SELECT CAST(o_custkey AS STRING) AS cik, CAST(o_orderkey AS STRING) AS accession, CASE o_orderkey % 5 WHEN 0 THEN '10-K/A' WHEN 1 THEN '8-K' WHEN 2 THEN '10-Q' ELSE '10-K' END AS form,
  substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 10) AS filing_date, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE substr(CAST(CAST(o_orderdate AS DATE) - INTERVAL 60 DAY AS STRING), 1, 10) END AS report_date,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4) AS INT) END AS dei_fiscal_year, CASE WHEN o_orderkey % 4 = 0 THEN 'FY' END AS dei_period FROM orders"""
TARGETS_SQL = "SELECT c_custkey AS target_id, CAST(c_custkey AS STRING) AS cik, '10-K' AS form_type, CAST(1993 + c_custkey % 5 AS INT) AS fiscal_year, CAST(NULL AS STRING) AS quarter FROM customer"


def filing_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best submission of each target."""
    out = resolution.resolve(frame(spark, sf_dir, SUBMISSIONS_SQL, "orders"), frame(spark, sf_dir, TARGETS_SQL, "customer"))
    return out.select("target_id", "accession", "score")


#: Submissions that metadata can't tell apart: filed on one day a year, some without a report date; their landed pages name years and periods.
LATE_SUBMISSIONS_SQL = """SELECT CAST(o_custkey AS STRING) AS cik, CAST(o_orderkey AS STRING) AS accession, CASE WHEN o_orderkey % 5 = 0 THEN '10-K/A' ELSE '10-K' END AS form,
  CONCAT(substr(CAST(o_orderdate AS STRING), 1, 4), '-03-01') AS filing_date, CASE WHEN o_orderkey % 3 > 0 THEN CONCAT(CAST(CAST(substr(CAST(o_orderdate AS STRING), 1, 4) AS INT) - 1 AS STRING), '-12-31') END AS report_date FROM orders"""
LATE_TARGETS_SQL = "SELECT c_custkey AS target_id, CAST(c_custkey AS STRING) AS cik, '10-K' AS form_type, CAST(1990 + c_custkey % 10 AS INT) AS fiscal_year, CAST(NULL AS STRING) AS quarter FROM customer"
LATE_PAGES_SQL = """SELECT CAST(o_orderkey AS STRING) AS accession, '10-K' AS form_type, CAST(substr(CAST(o_orderdate AS STRING), 1, 4) AS INT) AS filing_year,
  CONCAT('<html><ix:nonNumeric name="dei:DocumentFiscalYearFocus" id="y">', CAST(CAST(substr(CAST(o_orderdate AS STRING), 1, 4) AS INT) + o_orderkey % 4 - 2 AS STRING), '</ix:nonNumeric><ix:nonNumeric name="dei:DocumentFiscalPeriodFocus">', CASE WHEN o_orderkey % 7 = 0 THEN 'q3' ELSE 'fy' END, '</ix:nonNumeric><p>text</p></html>') AS html
  FROM orders WHERE o_orderkey % 5 <> 3"""


def late_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that metadata decide, and targets that landed pages decide."""
    out = resolution.resolve_late(frame(spark, sf_dir, LATE_SUBMISSIONS_SQL, "orders"), frame(spark, sf_dir, LATE_TARGETS_SQL, "customer"), frame(spark, sf_dir, LATE_PAGES_SQL, "orders"))
    return out.select("target_id", "accession", "score", "decided_by")


def ticker_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier names with dots found under names with hyphens."""
    s = table(spark, sf_dir, "supplier")
    companies = s.select(F.concat(F.lit("S-"), F.col("s_suppkey").cast("string")).alias("ticker"), F.col("s_suppkey").alias("cik"))
    requests = s.select("s_suppkey", F.concat(F.when(F.col("s_suppkey") % 2 == 0, F.lit("s.")).otherwise(F.lit("S-")), (F.col("s_suppkey") + F.col("s_suppkey") % 3).cast("string")).alias("ticker"))
    return resolution.ticker_to_cik(requests, companies).select("s_suppkey", "cik")


def vector_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector and the next one by id."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("u")), "vec_id")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    dot, norm = total(F.zip_with("v", "u", lambda x, y: x * y)), lambda c: F.sqrt(total(F.transform(c, lambda x: x * x)))
    return pairs.select("vec_id", F.round(F.when((norm("v") > 0) & (norm("u") > 0), dot / (norm("v") * norm("u"))).otherwise(0.0), 6).alias("cosine"))


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of the documents against thresholds."""
    d = table(spark, sf_dir, "documents")
    n = F.count("*")
    # The median by global ranks: no task holds all lengths.
    middle = F.broadcast(validation.medians(d.select(F.lit(1).alias("one"), F.col("n_chars").cast("double").alias("x")), ["one"], "x").select("median"))
    long = d.crossJoin(middle).agg(F.array(
        validation.gate("share_english", F.avg((F.col("lang") == "en").cast("double")), 0.5, n), validation.gate("share_long", F.avg((F.col("n_chars") >= 1000).cast("double")), 0.9, n),
        validation.gate("median_chars", F.max("median"), 500, n), validation.gate("share_null", F.avg(F.col("text").isNull().cast("double")), 0.01, n, at_least=False),
    ).alias("g")).select(F.inline("g"))
    return long.select("name", F.round("value", 6).alias("value"), "threshold", "n", "status")


def gate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether at least two gates pass."""
    return validation.overall(gates(spark, sf_dir), need=2)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """panel_all under its first name."""
    return panel_all(spark, sf_dir)


def panel_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each customer, of which some are unknown, in order."""
    c = table(spark, sf_dir, "customer")
    requests = c.select((F.col("c_custkey") * 41).alias("filing_id"), F.col("c_custkey").alias("ordinal"))
    return products.panel(requests, c.select(F.col("c_custkey").alias("filing_id"), F.round("c_acctbal", 2).alias("score"))).select("ordinal", "filing_id", "score", "status", "error")


def risk_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by band of a score."""
    score = F.when(F.col("c_custkey") % 13 != 0, F.col("c_acctbal") / 100)
    return table(spark, sf_dir, "customer").select(products.risk_band(score).alias("band"), products.risk_band(score, inverted=True).alias("inverted")).groupBy("band", "inverted").agg(F.count("*").alias("n"))


def blend_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which weight of price and size correlates best with the part's key."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("a"), F.col("p_size").cast("double").alias("b"), (F.col("p_partkey") % 97).cast("double").alias("target"))
    return validation.best_weights(p, "a", "b", "target", "p_partkey").select("weight", "n", F.round("rho", 6).alias("rho"))


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """calibration_all under its first name."""
    return calibration_all(spark, sf_dir)


def calibration_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mid-rank percentiles, robust z and winsorised positions of all lines among fixed references."""
    refs = scoring.DECILES["", "10-K", "negative_word_ratio"]
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("v"))
    arr = F.lit(list(refs))
    return d.select("l_orderkey", "l_linenumber", F.round(scoring.percentile_rank(F.col("v"), refs), 6).alias("percentile"), F.round(scoring.robust_z(F.col("v"), arr), 6).alias("robust_z"), F.round(scoring.winsorized(F.col("v"), arr), 6).alias("position"))


def upper_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True and upper medians of suppliers' balances by nation."""
    out = validation.medians(table(spark, sf_dir, "supplier"), ["s_nationkey"], "s_acctbal")
    return out.select("s_nationkey", F.round("median", 6).alias("median"), "upper_median")


#: Pages whose body holds item headings between their own text: filing_id, html.
PAGES_SQL = """SELECT page_id AS filing_id, '<p>Table of contents Item 1A. Risk Factors ..... 3 Item 7. Management ..... 9</p><h2>Item 1A. Risk Factors</h2><div>' || coalesce(html, '')
  || '</div><h2>Item 3. Legal Proceedings</h2><p>None.</p><h2>Item 7. Management discussion</h2><p>' || url || '</p>' AS html FROM pages"""


def block_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of headed pages by typed blocks."""
    out = blocks.extract(frame(spark, sf_dir, PAGES_SQL, "pages"), "10-K")
    return out.select("filing_id", "section", "section_ord", F.col("word_count").cast("long"), "extraction_confidence", "extraction_method", F.array_join("warnings", ",").alias("warnings"))


#: Words that make every section long enough to need no repair.
LONG_BODY = "lorem ipsum dolor sit amet " * 42
#: Pages of three known sections around documents' texts, with a contents table and a mention that don't count: filing_id, html.
KNOWN_PAGES_SQL = f"""SELECT doc_id AS filing_id, '<table><tr><td>Item 1A. Risk Factors</td><td>3</td></tr><tr><td><table><tr><td>Item 7. Management</td></tr></table></td></tr></table><h2>Item 1A. <i>Risk Factors</i></h2><p>'
  || replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;') || ' {LONG_BODY}<p>See <b>Item 3. Legal Proceedings</b> below.<p><b>Item 3. Legal</b> <b>Proceedings</b></p><div>{LONG_BODY}</div><h3>Item 7. Management&#39;s discussion</h3><ul><li>'
  || coalesce(lang, '') || ' {LONG_BODY}</ul>' AS html FROM documents"""


def block_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of pages whose sections are known, by typed blocks alone."""
    out = blocks.block_sections(blocks.with_blocks(frame(spark, sf_dir, KNOWN_PAGES_SQL, "documents")), "10-K")
    return out.select("filing_id", "section", F.col("word_count").cast("long"), F.sha2("text", 256).alias("digest"), "start_offset", "extraction_confidence", F.array_join("warnings", ",").alias("warnings"))


def edgar_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 to E5 of customers as an analysed universe, their balance as confidence."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").withColumn("extraction_confidence", F.col("c_acctbal") / 10000)
    n = table(spark, sf_dir, "customer").count()
    return reports.edgar_gates(c, universe_expected=n, n_input=n)


def matrix_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates of a corpus whose filings are orders, whose sections are their lines, and whose scores are customers' balances."""
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("filing_id"), F.lit("10-Q").alias("form_type"), F.element_at(F.array(*map(F.lit, ("item_1a_risk_factors", "item_2_mdna", "item_4_controls", "other"))), (F.col("l_linenumber") % 4 + 1).cast("int")).alias("section"), F.when(F.col("l_quantity") > 5, F.lit("x")).alias("text"), (1 - F.col("l_discount")).alias("extraction_confidence"))
    scores = table(spark, sf_dir, "customer").select(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("a"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).alias("b"))
    return reports.matrix_gates(s, scores, components=("a", "b"))


def universe_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which customers have orders."""
    have, want = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("ticker")), table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey")).alias("ticker"))
    return reports.coverage(have, want).select("expected", "present", "n_missing", F.array_join("missing", ",").alias("missing"))


def outcomes_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether expensive parts are larger, as a report of outcomes; no change scores."""
    p = table(spark, sf_dir, "part")
    scores = p.select(F.concat(F.lit("p"), F.col("p_partkey")).alias("ticker"), F.col("p_retailprice").alias("overall_disclosure_risk_score"), F.lit(None).cast("double").alias("disclosure_change_score"))
    results = p.select(F.concat(F.lit("P"), F.col("p_partkey")).alias("ticker"), F.col("p_size").cast("double").alias("realized_vol_90d"), F.lit(1.0).alias("earnings_surprise_abs"))
    out = reports.outcomes_report(reports.with_outcomes(results, scores))
    return out.select("name", "n", "q1_n", "q5_n", F.round("q1_mean", 6).alias("q1_mean"), F.round("q5_mean", 6).alias("q5_mean"), "status")


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents' texts by lines."""
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", shaping.chunks(F.coalesce("text", F.lit("")), 500).alias("c"))
    return d.select("doc_id", F.size("c").cast("long").alias("n_chunks"), F.length(F.array_join("c", "")).cast("long").alias("n_chars"))


def published_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices times discounts, rounded by their exact binary value."""
    v = F.col("l_extendedprice") * F.col("l_discount") / 100
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", shaping.round_exact(v, 2).alias("two"), shaping.round_exact(v, 4).alias("four"))


QUERIES = {f.__name__: f for f in (block_extraction, block_sections, edgar_gates, matrix_gates, universe_coverage, outcomes_report, text_chunks, published_rounding, html_text, section_extraction, stored_context, cached_metrics, last_lines, required_missing, filing_files, required_sections, quintiles, monotonicity, rank_correlation, rank_gaps, volatility, log_returns, next_event, corpus_context, filter_reasons, filing_resolution, late_resolution, ticker_lookup, vector_cosine, gates, gate_verdict, panel, panel_all, risk_bands, blend_search, calibration, calibration_all, upper_medians)}

_SPACED = r"trim(regexp_replace({t}, '[\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x1c-\x1f\v]+', ' ', 'g'))"
#: The sections of KNOWN_PAGES_SQL: their texts by name, each scored as a title at the start of a block with a body.
_KNOWN = f"""
WITH t AS (
  SELECT doc_id AS filing_id, 'Item 1A. Risk Factors' || chr(10) || chr(10) || {_SPACED.format(t=f"coalesce(text, '') || ' {LONG_BODY}'")} || chr(10) || chr(10) || 'See Item 3. Legal Proceedings below.' AS a,
    'Item 3. Legal Proceedings' || chr(10) || chr(10) || trim('{LONG_BODY}') AS b, 'Item 7. Management''s discussion' || chr(10) || chr(10) || trim(coalesce(lang, '') || ' {LONG_BODY}') AS c
  FROM documents
), s AS (
  SELECT filing_id, 'item_1a_risk_factors' AS section, a AS text, 44 AS start_offset, 0.95 AS base, '' AS warnings FROM t
  UNION ALL SELECT filing_id, 'item_3_legal_proceedings', b, 44 + length(a) + 2, 0.95, '' FROM t
  UNION ALL SELECT filing_id, 'item_7_mdna', c, 44 + length(a) + 2 + length(b) + 2, 0.76, 'open_ended_boundary' FROM t
)
SELECT filing_id, section, CAST(len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS BIGINT) AS word_count, sha256(replace(text, chr(10) || chr(10), ' ')) AS digest, CAST(start_offset AS INT) AS start_offset, CAST(base AS DOUBLE) AS extraction_confidence, warnings FROM s
"""

_Q = "least(5, floor((row_number() OVER (ORDER BY {v}, {k}) - 1) * 5 / count(*) OVER ()) + 1)"
_STRIP = "html"
for _tag in ("script", "style", "noscript"):
    _STRIP = rf"regexp_replace({_STRIP}, '(?is)<{_tag}\b[^>]*>.*?</{_tag}\s*>', chr(10), 'g')"
_STRIP = rf"regexp_replace(regexp_replace({_STRIP}, '(?s)<!--.*?-->', chr(10), 'g'), '(?s)<[!/?a-zA-Z][^>]*>', chr(10), 'g')"
for _n, _c in sections.ENTITIES.items():
    _STRIP = f"replace({_STRIP}, '{_n}', '{_c.replace(chr(39), chr(39) * 2)}')"
_REFS = "[" + ", ".join(map(str, scoring.DECILES["", "10-K", "negative_word_ratio"])) + "]"
_RULE = " ".join(f"WHEN {e} THEN '{n}'" for n, e in CHECKS)
_BAND = "CASE WHEN {s} IS NULL THEN 'missing' WHEN {s} <= 25 THEN 'low' WHEN {s} <= 50 THEN 'moderate' WHEN {s} <= 75 THEN 'elevated' ELSE 'high' END"

ORACLES = {
    "block_sections": _KNOWN,
    "html_text": rf"""WITH l AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array({_STRIP}, '\r?\n'), lambda s: trim(regexp_replace(s, '[\s\x{{A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+', ' ', 'g'))), lambda s: s <> '') AS x FROM pages),
        k AS (SELECT page_id, array_to_string(list_filter(x, lambda s, i: length(s) >= 40 OR list_position(x, s) = i), chr(10) || chr(10)) AS t FROM l) SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM k""",
    "quintiles": f"SELECT CAST(q AS INT) AS quintile, count(*) AS n, round(avg(c_acctbal), 6) AS mean_balance, min(c_custkey) AS least_key FROM (SELECT *, {_Q.format(v='c_acctbal', k='c_custkey')} AS q FROM customer) GROUP BY q",
    "monotonicity": f"WITH q AS (SELECT p_size AS s, {_Q.format(v='p_retailprice', k='p_partkey')} AS q FROM part), a AS (SELECT count(*) AS n, count(*) FILTER (q = 1) AS q1_n, count(*) FILTER (q = 5) AS q5_n, avg(s) FILTER (q = 1) AS a, avg(s) FILTER (q = 5) AS b FROM q)"
    + " SELECT n, q1_n, q5_n, round(a, 6) AS q1_mean, round(b, 6) AS q5_mean, round(b / a, 6) AS q5_q1_ratio, CASE WHEN n < 50 OR q1_n < 5 OR q5_n < 5 THEN 'insufficient' WHEN b > a THEN 'pass' ELSE 'fail' END AS status FROM a",
    "rank_correlation": "WITH j AS (SELECT doc_id, n_chars AS x, quality * 2 + toxic AS y FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL AND n_chars IS NOT NULL), r AS (SELECT row_number() OVER (ORDER BY x, doc_id) AS a, row_number() OVER (ORDER BY y, doc_id) AS b FROM j) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r",
    "rank_gaps": "WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS rx, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS ry FROM part) SELECT p_partkey, abs(rx - ry) AS gap, rx, ry FROM r ORDER BY gap DESC, p_partkey DESC LIMIT 20",
    "volatility": f"WITH bars AS ({BARS_SQL}), f AS ({FILED_SQL}), b AS (SELECT ticker, date, close, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS p FROM bars JOIN f USING (ticker) WHERE date > filing_date AND date <= filing_date + 25), r AS (SELECT ticker, CASE WHEN p > 0 AND close > 0 THEN ln(close / p) END AS r FROM b)"
    + " SELECT ticker, count(*) AS trading_days, round(CASE WHEN count(r) >= 3 THEN stddev_samp(r) * sqrt(252) END, 6) AS realized_vol FROM r GROUP BY ticker",
    "log_returns": f"WITH bars AS ({BARS_SQL}), b AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS p FROM bars) SELECT ticker, CAST(date AS VARCHAR) AS date, round(CASE WHEN p > 0 AND close > 0 THEN ln(close / p) END, 6) AS log_return FROM b",
    "next_event": "WITH e AS (SELECT o_custkey AS c, CAST(o_orderdate AS DATE) AS d, max(o_totalprice) AS v FROM orders GROUP BY 1, 2), l AS (SELECT o_custkey AS c, o_orderkey AS id, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_totalprice > 200000) SELECT id, CAST(min(e.d) AS VARCHAR) AS next_event_date, arg_min(e.v, e.d) AS next_event_value FROM l LEFT JOIN e ON e.c = l.c AND e.d > l.d GROUP BY id",
    "corpus_context": "WITH d AS (SELECT doc_id, lang, n_chars AS s FROM documents WHERE n_chars IS NOT NULL), c AS (SELECT lang, count(*) AS n, round(median(s), 1) AS m FROM d GROUP BY lang) SELECT doc_id, n AS cohort_n, m AS cohort_median, CAST(round_even((rank() OVER (PARTITION BY lang ORDER BY s) - 1) * 100 / n, 0) AS INT) AS percentile FROM d JOIN c USING (lang)",
    "required_missing": "SELECT doc_id AS filing_id, doc_id % 4 = 0 AS required_sections_present, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'item_7_mdna' WHEN 2 THEN 'item_1a_risk_factors' ELSE 'item_1a_risk_factors,item_7_mdna' END AS missing FROM documents",
    "filing_files": """SELECT s_name, md5('<!DOCTYPE html><html><head><title>&lt;' || s_name || '&gt;</title></head><body><h1>&lt;' || s_name || '&gt;</h1><table><tr><th>Balance &amp; rest</th><td>' || printf('%.2f', s_acctbal) || '</td><td class="' || b || '">' || b || '</td></tr></table></body></html>') AS digest
        FROM (SELECT *, CASE WHEN s_acctbal < 0 THEN 'low' ELSE 'high' END AS b FROM supplier)""",
    "text_chunks": """WITH l AS (SELECT doc_id, list_transform(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), lambda x: {'c': 1, 't': 0, 'n': length(x)}) AS x FROM documents),
        r AS (SELECT doc_id, CASE WHEN len(x) = 0 THEN {'c': 1, 't': 0, 'n': 0} ELSE list_reduce(x, lambda a, b: CASE WHEN a.n + b.n + 1 <= 500 THEN {'c': a.c, 't': a.t, 'n': a.n + b.n + 1} ELSE {'c': a.c + 1, 't': a.t + a.n, 'n': b.n} END) END AS z FROM l)
        SELECT doc_id, CAST(z.c AS BIGINT) AS n_chunks, CAST(z.t + z.n AS BIGINT) AS n_chars FROM r""",
    "published_rounding": """WITH v AS (SELECT l_orderkey, l_linenumber, CAST(printf('%.30f', l_extendedprice * l_discount / 100) AS DECIMAL(38, 30)) AS d FROM lineitem)
        SELECT l_orderkey, l_linenumber, """ + ", ".join(f"(floor(d * {p}) + CASE WHEN d * {p} - floor(d * {p}) > 0.5 OR (d * {p} - floor(d * {p}) = 0.5 AND floor(d * {p}) % 2 = 1) THEN 1 ELSE 0 END)::BIGINT / {p}.0::DOUBLE AS {n}" for p, n in ((100, "two"), (10000, "four"))) + " FROM v",
    "section_extraction": r"""WITH t AS (SELECT doc_id AS filing_id, coalesce(text, '') AS text FROM documents),
        s AS (
          SELECT filing_id, 1 AS section_ord, 'item_1a_risk_factors' AS section, 'Item 1A. Risk Factors ' || text AS body, false AS last, substr('Item 1A. Risk Factors ' || text || ' Item 3. Legal Proceedings None. Item 7. Management discussion ' || text, 1, 200) AS w FROM t
          UNION ALL SELECT filing_id, 2, 'item_3_legal_proceedings', 'Item 3. Legal Proceedings None.', false, substr('Item 3. Legal Proceedings None. Item 7. Management discussion ' || text, 1, 200) FROM t
          UNION ALL SELECT filing_id, 3, 'item_7_mdna', 'Item 7. Management discussion ' || text, true, substr('Item 7. Management discussion ' || text, 1, 200) FROM t
        ), c AS (SELECT *, len(regexp_extract_all(body, '[\p{L}\p{N}_]+')) AS n, contains(w, '...') OR regexp_matches(w, '\t\d+\s*$') AS toc FROM s),
        b AS (SELECT *, CASE WHEN toc THEN 0.4 ELSE 0.9 END AS base FROM c)
        SELECT filing_id, section, CAST(section_ord AS INT) AS section_ord, CAST(n AS BIGINT) AS word_count, CAST(CASE WHEN n < 50 THEN 0.35 WHEN n >= 2000 THEN greatest(0.85, CASE WHEN last THEN least(base, 0.75) ELSE base END)
          WHEN n >= 200 THEN greatest(0.76, CASE WHEN last THEN least(base, 0.75) ELSE base END) WHEN last THEN least(base, 0.75) ELSE base END AS DOUBLE) AS extraction_confidence,
          concat_ws(',', CASE WHEN toc THEN 'toc_like' END, CASE WHEN n < 50 THEN 'short_section' END, CASE WHEN last THEN 'end_of_document' END) AS warnings FROM b""",
    "stored_context": "WITH c AS (SELECT p_size, count(*) AS n, round(median(p_retailprice), 1) AS m FROM part GROUP BY p_size) SELECT p_partkey, n AS cohort_n, m AS cohort_median, CAST(round_even((rank() OVER (PARTITION BY p_size ORDER BY p_retailprice) - 1) * 100 / n, 0) AS INT) AS percentile FROM part JOIN c USING (p_size)",
    "cached_metrics": r"WITH d AS (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 10 = 0 THEN ' changed once' ELSE '' END AS t FROM documents) SELECT doc_id, CAST(len(regexp_extract_all(t, '[\p{L}\p{N}_]+')) AS BIGINT) AS n_words, md5(t) AS digest, doc_id % 10 = 0 AS cache_new FROM d",
    "last_lines": "SELECT 'c' || o_custkey AS ticker, max(o_orderkey) AS number FROM orders GROUP BY o_custkey",
    "filter_reasons": f"SELECT coalesce(CASE {_RULE} END, 'kept') AS reason, count(*) AS n FROM documents GROUP BY 1",
    "filing_resolution": f"""WITH s AS ({SUBMISSIONS_SQL}), t AS ({TARGETS_SQL}), x AS (SELECT t.target_id, accession, filing_date, report_date, fiscal_year, CASE WHEN coalesce(dei_fiscal_year, CAST(substr(report_date, 1, 4) AS INT)) = fiscal_year THEN 3 WHEN CAST(substr(report_date, 1, 4) AS INT) = fiscal_year THEN 2
        WHEN CAST(substr(filing_date, 1, 4) AS INT) = fiscal_year THEN 1 END * 1e9 + CASE WHEN ends_with(form, '/A') THEN 0 ELSE 1e5 END + CAST(replace(filing_date, '-', '') AS DOUBLE) AS score FROM t JOIN s ON t.cik = s.cik AND replace(form, '/A', '') = form_type WHERE coalesce(dei_period, '') IN ('', 'FY')),
        r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, abs(coalesce(CAST(substr(report_date, 1, 4) AS INT), 0) - fiscal_year), report_date DESC NULLS LAST, filing_date DESC, accession) AS k FROM x WHERE score IS NOT NULL)
        SELECT t.target_id, accession, score FROM t LEFT JOIN r ON t.target_id = r.target_id AND k = 1""",
    "ticker_lookup": "SELECT a.s_suppkey, lpad(CAST(b.s_suppkey AS VARCHAR), 10, '0') AS cik FROM supplier a LEFT JOIN supplier b ON b.s_suppkey = a.s_suppkey + a.s_suppkey % 3",
    "vector_cosine": "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM e a JOIN e b ON b.vec_id = a.vec_id + 1",
    "gates": "WITH a AS (SELECT count(*) AS n, avg(CAST(lang = 'en' AS INT)) AS e, avg(CAST(n_chars >= 1000 AS INT)) AS l, median(n_chars) AS m, avg(CAST(text IS NULL AS INT)) AS z FROM documents) SELECT name, round(CAST(v AS DOUBLE), 6) AS value, CAST(t AS DOUBLE) AS threshold, n, CASE WHEN ok THEN 'pass' ELSE 'fail' END AS status FROM (SELECT 'share_english' AS name, e AS v, 0.5 AS t, n, e >= 0.5 AS ok FROM a UNION ALL SELECT 'share_long', l, 0.9, n, l >= 0.9 FROM a UNION ALL SELECT 'median_chars', m, 500, n, m >= 500 FROM a UNION ALL SELECT 'share_null', z, 0.01, n, z <= 0.01 FROM a)",
    "panel": "WITH r AS (SELECT c_custkey * 41 AS filing_id, c_custkey AS ordinal FROM customer) SELECT ordinal, filing_id, round(c_acctbal, 2) AS score, CASE WHEN c_custkey IS NULL THEN 'error' ELSE 'ok' END AS status, CASE WHEN c_custkey IS NULL THEN 'not found' END AS error FROM r LEFT JOIN customer ON c_custkey = filing_id",
    "risk_bands": "WITH s AS (SELECT CASE WHEN c_custkey % 13 <> 0 THEN c_acctbal / 100 END AS s FROM customer) SELECT " + _BAND.format(s="s") + " AS band, " + _BAND.format(s="(100 - s)") + " AS inverted, count(*) AS n FROM s GROUP BY 1, 2",
    "blend_search": "WITH g AS (SELECT w, p_partkey AS k, p_retailprice * w + p_size * (1 - w) AS m, p_partkey % 97 AS t FROM part, (SELECT unnest([CAST(0.5 AS DOUBLE), 0.6, 0.7]) AS w)), r AS (SELECT w, row_number() OVER (PARTITION BY w ORDER BY m, k) AS a, row_number() OVER (PARTITION BY w ORDER BY t, k) AS b FROM g) SELECT w AS weight, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY w",
    "calibration": f"SELECT l_orderkey, l_linenumber, round(100 * (len(list_filter({_REFS}, lambda r: r < l_discount)) + 0.5 * len(list_filter({_REFS}, lambda r: r = l_discount))) / 10, 6) AS percentile, round((l_discount - 0.06) / (1.4826 * 0.04), 6) AS robust_z, round(100 * (greatest(0.01, least(0.12, l_discount)) - 0.01) / (0.12 - 0.01), 6) AS position FROM lineitem",
    "upper_medians": "SELECT s_nationkey, round(median(s_acctbal), 6) AS median, list_sort(list(s_acctbal))[len(list(s_acctbal)) // 2 + 1] AS upper_median FROM supplier GROUP BY s_nationkey",
    "required_sections": "SELECT doc_id AS filing_id, true AS required_sections_present, '' AS missing FROM documents",
}
_YEAR = "CAST(substr({c}, 1, 4) AS INT)"
ORACLES["late_resolution"] = f"""
WITH s AS ({LATE_SUBMISSIONS_SQL}), t AS ({LATE_TARGETS_SQL}), p AS ({LATE_PAGES_SQL}),
r AS (
  SELECT t.target_id, t.fiscal_year AS y, s.*, {_YEAR.format(c="report_date")} AS ry, {_YEAR.format(c="filing_date")} AS fy,
    CASE WHEN form = '10-K' THEN 1e5 ELSE 0 END + CAST(replace(filing_date, '-', '') AS DOUBLE) AS rest FROM t JOIN s USING (cik)
), m AS (SELECT *, CASE WHEN ry = y THEN 3 WHEN fy = y THEN 1 END * 1e9 + rest AS score, least(abs(ry - y), abs(fy - y)) AS distance FROM r),
k AS (SELECT *, max(score) OVER (PARTITION BY target_id) AS top FROM m),
c AS (SELECT *, count(*) OVER (PARTITION BY target_id) AS n, row_number() OVER (PARTITION BY target_id ORDER BY CASE WHEN top IS NULL THEN distance END, CASE WHEN top IS NULL THEN coalesce(report_date, '') END, CASE WHEN top IS NULL THEN filing_date END, filing_date DESC, accession) AS rank
  FROM k WHERE score = top OR (top IS NULL AND distance <= 1)),
g AS (
  SELECT c.*, CAST(regexp_extract(html, 'YearFocus[^>]*>(\\d+)', 1) AS INT) AS py, upper(regexp_extract(html, 'PeriodFocus[^>]*>(\\w+)', 1)) AS pp FROM c JOIN p USING (accession) WHERE rank <= 3 AND (top IS NULL OR n > 1)
), h AS (SELECT *, CASE WHEN pp = 'FY' THEN CASE WHEN py = y THEN 3 WHEN ry = y THEN 2 WHEN fy = y THEN 1 END * 1e9 + rest END AS page FROM g),
b AS (SELECT target_id, accession, page, row_number() OVER (PARTITION BY target_id ORDER BY page DESC, rank) AS i FROM h WHERE page > coalesce(top, -1))
SELECT t.target_id, coalesce(b.accession, c.accession) AS accession, coalesce(page, top) AS score, CASE WHEN b.accession IS NOT NULL THEN 'page' WHEN c.accession IS NOT NULL THEN 'metadata' END AS decided_by
FROM t LEFT JOIN b ON b.target_id = t.target_id AND i = 1 LEFT JOIN c ON c.target_id = t.target_id AND c.rank = 1 AND c.top IS NOT NULL
"""
ORACLES |= {
    "edgar_gates": "WITH a AS (SELECT count(*) AS n, median(c_acctbal / 10000) AS m, (SELECT count(*) FROM customer) AS u FROM customer WHERE c_acctbal > 0) SELECT name, round(CAST(v AS DOUBLE), 4) AS value, CAST(t AS DOUBLE) AS threshold, CASE WHEN v >= t THEN 'pass' ELSE 'fail' END AS status FROM (SELECT unnest(['E1_fetch_rate', 'E2_analysis_rate', 'E3_filter_retention', 'E4_median_confidence', 'E5_min_analysis_n']) AS name, unnest([1.0, n / u, n / u, m, n]) AS v, unnest([0.9, 0.85, 0.85, 0.75, 80.0]) AS t FROM a)",
    "matrix_gates": """WITH s AS (SELECT l_orderkey AS f, l_linenumber % 4 < 3 AND l_quantity > 5 AS hit, 1 - l_discount AS c FROM lineitem), f AS (SELECT sum(CAST(hit AS INT)) AS hits, count(DISTINCT f) AS n FROM s),
        m AS (SELECT c FROM (SELECT c, row_number() OVER (ORDER BY c) - 1 AS r, count(*) OVER () AS n FROM s WHERE hit) WHERE r = n // 2), k AS (SELECT (avg(CAST(c_acctbal > 0 AS INT)) + avg(CAST(c_custkey % 3 = 0 AS INT))) / 2 AS v FROM customer)
        SELECT 'non_empty_corpus' AS name, CAST(n AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS threshold, 'pass' AS status FROM f UNION ALL SELECT 'required_section_extraction_rate', round(hits / (4 * n), 4), 0.5, CASE WHEN hits / (4 * n) >= 0.5 THEN 'pass' ELSE 'fail' END FROM f
        UNION ALL SELECT 'median_extraction_confidence', round(c, 4), 0.6, CASE WHEN c >= 0.6 THEN 'pass' ELSE 'fail' END FROM m UNION ALL SELECT 'component_coverage', round(v, 4), 0.4, CASE WHEN v >= 0.4 THEN 'pass' ELSE 'fail' END FROM k""",
    "universe_coverage": "WITH m AS (SELECT 'C' || c_custkey AS t, c_custkey IN (SELECT o_custkey FROM orders) AS here FROM customer) SELECT count(*) AS expected, CAST(sum(CAST(here AS INT)) AS BIGINT) AS present, CAST(sum(CAST(NOT here AS INT)) AS BIGINT) AS n_missing, coalesce((SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT t FROM m WHERE NOT here ORDER BY t LIMIT 50)), '') AS missing FROM m",
    "outcomes_report": f"WITH q AS (SELECT p_size AS s, {_Q.format(v='p_retailprice', k=chr(39) + 'P' + chr(39) + ' || p_partkey')} AS q FROM part), a AS (SELECT count(*) AS n, count(*) FILTER (q = 1) AS q1_n, count(*) FILTER (q = 5) AS q5_n, avg(s) FILTER (q = 1) AS a, avg(s) FILTER (q = 5) AS b FROM q)"
    + " SELECT 'volatility_vs_overall' AS name, n, q1_n, q5_n, round(a, 6) AS q1_mean, round(b, 6) AS q5_mean, CASE WHEN n < 50 OR q1_n < 5 OR q5_n < 5 THEN 'insufficient' WHEN b > a THEN 'pass' ELSE 'fail' END AS status FROM a UNION ALL SELECT 'earnings_surprise_vs_change', 0, 0, 0, NULL, NULL, 'skipped'",
}
#: Both names of a query cover whole tables.
ORACLES["gate_verdict"] = f"SELECT count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status <> 'skip') AS total, count(*) FILTER (status = 'pass') >= 2 AS overall_pass FROM ({ORACLES['gates']})"
ORACLES |= {"panel_all": ORACLES["panel"], "calibration_all": ORACLES["calibration"]}
