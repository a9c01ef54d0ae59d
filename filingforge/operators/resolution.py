"""Which filing answers a request: scoring of submission rows and arg-max per target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingforge.operators.diff import prior_targets
from filingforge.staging import staged

TIER_POINTS, ORIGINAL_POINTS, HTML_POINTS = 1e9, 1e5, 5e8


def normal_form(form: Column) -> Column:
    """Upper case without an amendment mark."""
    return F.regexp_replace(F.upper(F.trim(form)), r"[/-]A$", "")


def is_amendment(form: Column) -> Column:
    return F.upper(F.trim(form)).rlike(r"[/-]A$")


def year_of(date: Column) -> Column:
    """The year of an ISO date string, null if there is none."""
    return F.substring(date, 1, 4).try_cast("int")


def day_number(date: Column) -> Column:
    """yyyymmdd of an ISO date string, 0 if there is none."""
    return F.coalesce(F.replace(date, F.lit("-"), F.lit("")).try_cast("double"), F.lit(0.0))


def row_score(fiscal_year: Column) -> Column:
    """Points of a submission row for a target year; null where no year fits.

    Tier 3: the filing's own fiscal year, or without one the report date's; 1: the filing date's year. Originals come
    before amendments, later days before earlier ones.
    """
    own = F.coalesce(F.col("dei_fiscal_year"), year_of(F.col("report_date")))
    tier = F.when(own == fiscal_year, 3).when(year_of(F.col("report_date")) == fiscal_year, 2).when(year_of(F.col("filing_date")) == fiscal_year, 1)
    return tier * F.lit(TIER_POINTS) + F.when(is_amendment(F.col("form")), F.lit(0.0)).otherwise(F.lit(ORIGINAL_POINTS)) + day_number(F.col("filing_date"))


def period_fits(form: Column, quarter: Column, period: Column) -> Column:
    """Annual filings take no period or the full year; quarterly ones need theirs."""
    p = F.upper(F.coalesce(period, F.lit("")))
    return F.when(form == "10-Q", p == F.upper(F.coalesce(quarter, F.lit("")))).when(form == "10-K", p.isin("", "FY")).otherwise(F.lit(True))


def html_score(fiscal_year: Column, quarter: Column) -> Column:
    """Points of a row whose metadata don't fit, but whose page names the year (html_fiscal_year) and period (html_period)."""
    own = (F.col("html_fiscal_year") == fiscal_year) & period_fits(F.col("form_type"), quarter, F.col("html_period"))
    return F.when(own, F.lit(HTML_POINTS) + F.when(is_amendment(F.col("form")), F.lit(0.0)).otherwise(F.lit(ORIGINAL_POINTS)) + day_number(F.col("filing_date")))


def resolve(submissions: DataFrame, targets: DataFrame, *, ties: int = 3) -> DataFrame:
    """Targets left-joined with their best submission: accession, score, and up to `ties` accessions that tie with it.

    submissions: cik, accession, form, filing_date, report_date, dei_fiscal_year, dei_period; targets: target_id, cik,
    form_type, fiscal_year, quarter. A target without a row that fits keeps nulls. With columns html_fiscal_year and
    html_period, tags of landed pages, a row that its metadata rule out can still fit by these, below all others; an
    annual filing whose page names a quarter is no candidate.
    """
    rows = submissions.withColumn("_form", normal_form(F.col("form")))
    fits = targets.join(rows.withColumnRenamed("cik", "_cik"), (F.col("cik") == F.col("_cik")) & (F.col("form_type") == F.col("_form")))
    points = F.when(period_fits(F.col("form_type"), F.col("quarter"), F.col("dei_period")), row_score(F.col("fiscal_year")))
    if "html_fiscal_year" in submissions.columns:
        fits = fits.where(~F.coalesce((F.col("form_type") == "10-K") & F.col("html_period").isin("Q1", "Q2", "Q3", "Q4"), F.lit(False)))
        points = F.coalesce(points, html_score(F.col("fiscal_year"), F.col("quarter")))
    scored = fits.withColumn("score", points).where(F.col("score").isNotNull())
    w = Window.partitionBy("target_id").orderBy(F.desc("score"), F.abs(F.coalesce(year_of(F.col("report_date")), F.lit(0)) - F.col("fiscal_year")), F.desc("report_date"), F.desc("filing_date"), "accession")
    best = scored.withColumns({"_n": F.row_number().over(w), "_top": F.max("score").over(Window.partitionBy("target_id"))})
    tied = best.where((F.col("score") == F.col("_top")) & (F.col("_n") <= ties))
    found = tied.groupBy("target_id").agg(F.min_by("accession", "_n").alias("accession"), F.max("score").alias("score"), F.transform(F.array_sort(F.collect_list(F.struct("_n", "accession"))), lambda x: x["accession"]).alias("candidates"))
    return targets.join(found, "target_id", "left")


#: Candidates of a target whose pages are read, and years by which a date may miss the target's to be a hint.
MOST_PAGES, HINT_YEARS = 3, 1
QUARTERS = ("Q1", "Q2", "Q3", "Q4")
#: Pages to be looked up that are broadcast to where pages lie; more are joined by shuffling their names.
BROADCAST_NAMES = 200_000


def year_distance(fiscal_year: Column) -> Column:
    """How far the nearer of a row's report and filing year is from the target's; null without dates."""
    return F.least(*[F.abs(year_of(F.col(c)) - fiscal_year) for c in ("report_date", "filing_date")])


def page_candidates(submissions: DataFrame, targets: DataFrame, *, most: int = MOST_PAGES) -> DataFrame:
    """What metadata leave of each target: its rows (rank from 1), decided or not; no page is read.

    target_id and the target's columns, accession, form, report_date, filing_date, top (the best score by metadata, null where
    no row fits), rank, open. A target is open where several rows share its top, whose rows it keeps then, or where none
    fits, and then it keeps rows dated within HINT_YEARS of its year, nearest first. At most `most` rows are kept.
    """
    own = {c: F.col(c) if c in submissions.columns else F.lit(None).cast(t) for c, t in (("dei_fiscal_year", "int"), ("dei_period", "string"))}
    rows = submissions.withColumns(own).withColumn("_form", normal_form(F.col("form"))).withColumnRenamed("cik", "_cik")
    fits = targets.join(rows, (F.col("cik") == F.col("_cik")) & (F.col("form_type") == F.col("_form"))).drop("_cik", "_form")
    year = F.col("fiscal_year")
    scored = fits.withColumn("score", F.when(period_fits(F.col("form_type"), F.col("quarter"), F.col("dei_period")), row_score(year)))
    by = Window.partitionBy("target_id")
    known = scored.withColumns({"top": F.max("score").over(by), "distance": year_distance(year)})
    kept = known.where((F.col("score") == F.col("top")) | (F.col("top").isNull() & (F.col("distance") <= HINT_YEARS)))
    missed = F.col("top").isNull()
    order = [F.when(missed, F.col("distance")), F.when(missed, F.coalesce("report_date", F.lit(""))), F.when(missed, F.coalesce("filing_date", F.lit(""))), F.desc("filing_date"), "accession"]
    ranked = kept.withColumns({"rank": F.row_number().over(by.orderBy(*order)), "open": missed | (F.count("*").over(by) > 1)})
    return ranked.where(F.col("rank") <= most).drop("score", "distance", "dei_fiscal_year", "dei_period")


def page_score() -> Column:
    """Points of a candidate with the tags of its page (page_year, page_period); null where it doesn't fit, or isn't landed."""
    year, quarter = F.col("fiscal_year"), F.col("quarter")
    own = F.coalesce("page_year", year_of(F.col("report_date")))
    tier = F.when(own == year, 3).when(year_of(F.col("report_date")) == year, 2).when(year_of(F.col("filing_date")) == year, 1)
    rest = F.when(is_amendment(F.col("form")), F.lit(0.0)).otherwise(F.lit(ORIGINAL_POINTS)) + day_number(F.col("filing_date"))
    fits = period_fits(F.col("form_type"), quarter, F.col("page_period"))
    points = F.coalesce(F.when(fits, tier * F.lit(TIER_POINTS)), F.when(fits & (F.col("page_year") == year), F.lit(HTML_POINTS))) + rest
    other_period = F.coalesce((F.col("form_type") == "10-K") & F.col("page_period").isin(*QUARTERS), F.lit(False))
    return F.when(F.col("landed") & ~other_period, points)


def landed_tags(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """accession, page_year, page_period, landed of the candidates' pages alone.

    pages: accession, html, and any of form_type and filing_year, by which landed pages are best partitioned: just the
    partitions of candidates are read, a list that the calendar bounds, and only tags leave the place where a page lies.
    """
    parts = [c for c in ("form_type", "filing_year") if c in pages.columns]
    names = candidates.withColumn("filing_year", year_of(F.col("filing_date"))).select("accession", *parts).distinct()
    for c in parts:
        pages = pages.where(F.col(c).isin([r[0] for r in names.select(c).distinct().collect() if r[0] is not None]))
    wanted = F.broadcast(names) if names.count() <= BROADCAST_NAMES else names
    year, period = fiscal_tags(F.col("html"))
    found = pages.join(wanted, ["accession", *parts], "left_semi").select("accession", year.alias("page_year"), period.alias("page_period"))
    return found.groupBy("accession").agg(F.max("page_year").alias("page_year"), F.max("page_period").alias("page_period")).withColumn("landed", F.lit(True))


def resolve_late(submissions: DataFrame, targets: DataFrame, pages: DataFrame, *, most: int = MOST_PAGES) -> DataFrame:
    """Targets with accession, score and decided_by (metadata, page or null), in two phases.

    Metadata decide most targets. Of the others, the few candidates' pages are looked up among the landed ones, scored by the
    tags in their heads, and the best replaces the metadata's choice where it scores more. A candidate whose page isn't
    landed is passed over. Candidates are written before pages are read, so that both phases see the same.
    """
    ranked = staged(targets.sparkSession, page_candidates(submissions, targets, most=most), "page-candidates")
    looked = ranked.where("open")
    tagged = looked.join(landed_tags(looked, pages), "accession", "left").withColumn("landed", F.coalesce("landed", F.lit(False)))
    better = tagged.withColumn("score", page_score()).where(F.col("score") > F.coalesce("top", F.lit(-1.0)))
    best = better.groupBy("target_id").agg(F.max_by(F.struct("accession", "score"), F.struct("score", -F.col("rank"))).alias("_page"))
    first = ranked.where((F.col("rank") == 1) & F.col("top").isNotNull()).select("target_id", F.struct("accession", F.col("top").alias("score")).alias("_own"))
    out = targets.join(first, "target_id", "left").join(best, "target_id", "left")
    decided = F.when(F.col("_page").isNotNull(), F.lit("page")).when(F.col("_own").isNotNull(), F.lit("metadata"))
    return out.select(*targets.columns, F.coalesce("_page", "_own").alias("_x"), decided.alias("decided_by")).select(*targets.columns, "_x.*", "decided_by")


def resolve_with_prior(submissions: DataFrame, targets: DataFrame, *, required: bool = False) -> DataFrame:
    """Targets with their own filing and that of the period before: accession, prior_accession, and unresolved.

    A prior that isn't there is null. required: a target without a filing of its own raises when it is read.
    """
    own = resolve(submissions, targets)
    before = prior_targets(targets).select("target_id", "cik", "form_type", F.col("prior_year").alias("fiscal_year"), F.col("prior_quarter").alias("quarter"))
    prior = resolve(submissions, before).select("target_id", F.col("accession").alias("prior_accession"))
    out = own.join(prior, "target_id").withColumn("unresolved", F.col("accession").isNull())
    if required:
        missing = F.raise_error(F.concat(F.lit("no filing for target "), F.col("target_id").cast("string"))).cast("string")
        out = out.withColumn("accession", F.when(F.col("unresolved"), missing).otherwise(F.col("accession")))
    return out


def bundles(resolved: DataFrame, pages: DataFrame) -> DataFrame:
    """Targets with html and prior_html of landed pages (accession, html); a prior page that isn't there leaves no prior."""
    own = pages.select(F.col("accession").alias("_a"), "html")
    prior = pages.select(F.col("accession").alias("_p"), F.col("html").alias("prior_html"))
    out = resolved.join(own, F.col("accession") == F.col("_a"), "left").join(prior, F.col("prior_accession") == F.col("_p"), "left").drop("_a", "_p")
    return out.withColumns({"has_prior": F.col("prior_html").isNotNull(), "prior_accession": F.when(F.col("prior_html").isNotNull(), F.col("prior_accession"))})


def all_pages(pages: list[DataFrame]) -> DataFrame:
    """Submission rows of several pages, each once; columns that a page lacks are null."""
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page, allowMissingColumns=True)
    return out.dropDuplicates(["cik", "accession"])


def best_listing(submissions: DataFrame) -> DataFrame:
    """The best row of each (cik, form, period): an amendment counts 100 less than an original filed the same day."""
    points = F.when(is_amendment(F.col("form")), F.lit(0.0)).otherwise(F.lit(100.0)) + day_number(F.col("filing_date"))
    base = submissions.withColumns({"form_type": normal_form(F.col("form")), "_points": points})
    w = Window.partitionBy("cik", "form_type", "dei_period").orderBy(F.desc("_points"), "accession")
    return base.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_points")


def ticker_to_cik(requests: DataFrame, companies: DataFrame) -> DataFrame:
    """requests (ticker) left-joined with cik: as written, then with - for ., then with . for -."""
    name = F.upper(F.trim("ticker"))
    aliases = F.array(name, F.replace(name, F.lit("."), F.lit("-")), F.replace(name, F.lit("-"), F.lit(".")))
    tried = requests.select("ticker").distinct().select("ticker", F.posexplode(aliases).alias("_order", "_alias"))
    known = companies.select(F.upper("ticker").alias("_alias"), F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"))
    found = tried.join(known, "_alias").groupBy("ticker").agg(F.min_by("cik", "_order").alias("cik"))
    return requests.join(found, "ticker", "left")


def fiscal_tags(html: Column) -> tuple[Column, Column]:
    """Fiscal year and period of inline tags in a document's head."""
    head = F.substring(html, 1, 131072)
    year = F.regexp_extract(head, r"(?is)DocumentFiscalYearFocus[^>]*>\s*(\d{4})", 1)
    period = F.regexp_extract(head, r"(?is)DocumentFiscalPeriodFocus[^>]*>\s*([A-Za-z0-9]+)", 1)
    return F.when(year != "", year.cast("int")), F.when(period != "", F.upper(period))
