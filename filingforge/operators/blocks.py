"""Sections from typed blocks: every mention of an item is a candidate, scored by where and how it stands.

A page is parsed once (markup.parsed) and stays in its row: flags, neighbours, candidates, boundaries and repairs are array
expressions over its blocks, and sections are cut where the page is. Nothing is shuffled: only finished sections leave a
row. Candidates that score enough bound the sections; short sections are repaired from the next strong candidate or the
second-best one; the result is merged with the plain heading search and with the best match of Item 1A.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingforge.functions import markup
from filingforge.functions import text as T
from filingforge.functions.term_packs import FORM_PATTERNS, HEADINGS, form_base
from filingforge.operators import sections as S
from filingforge.operators.sections import let

RISKS = "item_1a_risk_factors"
#: Points of a candidate, and the score from which it counts.
ITEM, TITLE, TITLE_BLOCK, BLOCK_START, TRANSITION, INLINE, BODY, TOC, EARLY, STRONG = 40, 25, 15, 15, 25, -25, 10, -50, -15, 50
#: Characters looked at behind a heading, before it in its block and in the block before, and of a filing's start.
AHEAD, BACK, BACK_BEFORE, START = 180, 400, 200, 500
#: Words of a body, blocks it may span, least distance of an extended end, and words of a usable section.
BODY_WORDS, BODY_BLOCKS, EXTEND, USABLE = 50, 5, 200, 200
#: Where Item 1A ends.
RISKS_END = r"(?i)(?<![a-z])item\s*(?:1b|2\.?(?![a-z0-9])|2\s)"
ITEM_MENTION = r"item\s+\d+[a-z]?(?:\.\d+)?\.?"
#: A section before its text is cut (section_of).
SECTION_TYPE = "struct<section:string,word_count:int,start_offset:int,end_offset:int,warnings:array<string>,extraction_confidence:double,extraction_method:string>"


def with_blocks(filings: DataFrame, *, key: str = "filing_id", html: str = "html") -> DataFrame:
    """key, blocks, full_text, clean_text, parse_warning and marks, the blocks with what candidates look at."""
    return T.once(markup.parsed(filings, key=key, html=html), {"marks": marked(F.col("blocks"))})


def marked(blocks: Column) -> Column:
    """Of each block: index, type, text, start, is_toc, is_table, is_title, words (up to BODY_WORDS, which is all that counts), prior_text (its end), words_after (of the next blocks)."""
    counted = F.transform(blocks, lambda b: b.withField("words", first_words(b["text"])))
    first_title = F.array_position(F.transform(blocks, lambda b: b["type"]), F.lit("title"))

    def mark(all_blocks: Column, b: Column, i: Column) -> Column:
        introductory = i + 1 < first_title
        listed = introductory & (F.regexp_count(F.lower(b["text"]), F.lit(rf"(?<![a-z0-9_]){ITEM_MENTION}")) >= 3)
        return F.struct(
            i.cast("int").alias("index"), b["type"].alias("type"), b["text"].alias("text"), b["start"].alias("start"),
            (listed | F.contains(F.substring(F.lower(F.substring(b["text"], 1, 80)), 1, 80), F.lit("table of contents"))).alias("is_toc"), (b["type"] == "table").alias("is_table"), (b["type"] == "title").alias("is_title"), b["words"].alias("words"),
            F.when(i > 0, F.right(F.get(all_blocks, i - 1)["text"], F.lit(BACK_BEFORE))).alias("prior_text"),
            F.aggregate(F.slice(all_blocks, i + 2, F.lit(BODY_BLOCKS - 1)), F.lit(0), lambda n, x: n + x["words"]).alias("words_after"),
        )

    return let(counted, lambda all_blocks: F.transform(all_blocks, lambda b, i: mark(all_blocks, b, i)))


def first_words(text: Column) -> Column:
    """The number of words, up to BODY_WORDS: the text behind these isn't read."""
    return S.word_count(F.regexp_extract(text, rf"\A(?:[^\p{{L}}\p{{N}}_]*+[\p{{L}}\p{{N}}_]++){{1,{BODY_WORDS}}}", 0))


def block_rows(filings: DataFrame, *, key: str = "filing_id") -> DataFrame:
    """A row for each block of with_blocks() rows."""
    return filings.select(key, F.inline("marks"))


def heading_pattern(section: str) -> str:
    """The heading of a section: its item number and, where it has one, its title within 80 other characters."""
    item, title = HEADINGS[section]
    number = re.escape(item)
    if title:
        return rf"(?i)(?<![a-z])item\s*{number}\.?(?![a-z0-9])[\s\W]{{0,80}}" + r"\s+".join(map(re.escape, title.split()))
    return rf"(?i)(?<![a-z])item\s*{number}" + (r"(?!\d)" if "." in item else "(?![a-z0-9])")


def matches(text: Column, pattern: str) -> Column:
    """array<struct<at, found>>: all matches and their places (from 0) in a text."""
    return S.places(text, pattern)


def candidates_of(block: Column, form_type: str) -> Column:
    """array<struct<section, start, end, score, warnings>> of a marked block."""
    text, none = block["text"], F.array().cast("array<struct<section:string,start:int,end:int,score:int,warnings:array<string>>>")
    of = lambda s: F.transform(matches(text, heading_pattern(s)), lambda m: _candidate(block, m, s))
    found = F.flatten(F.array(*map(of, FORM_PATTERNS[form_base(form_type)])))
    return F.when(text.rlike(r"(?i)item\s*\d"), found).otherwise(none)


def _candidate(block: Column, match: Column, section: str) -> Column:
    text, at, stop, title = block["text"], match["at"], match["at"] + F.length(match["found"]), HEADINGS[section][1]
    back = F.substring(text, F.greatest(at - BACK, F.lit(0)) + 1, F.least(at, F.lit(BACK)))
    context = F.when(block["index"] > 0, F.concat(block["prior_text"], F.lit(" "), back)).otherwise(back)
    window = F.substring(text, at + 1, F.length(match["found"]) + AHEAD)
    toc = block["is_toc"] | block["is_table"] | window.rlike(r"\.{3,}") | window.rlike(r"(?i)(?<![a-z0-9_])\d+\s*(?:item\s+\d|part\s+[ivx])")
    body = first_words(F.substring(text, stop + 1, F.length(text))) + block["words_after"]
    at_start, transition = at <= 5, context.rlike(rf"(?i){ITEM_MENTION}")
    inline = ~at_start & ~transition & ~block["is_title"]
    early = (block["start"] < START) & ~block["is_title"]
    points = lambda test, n: F.when(test, F.lit(n)).otherwise(F.lit(0))
    score = (
        F.lit(ITEM) + (points(F.contains(F.lower(match["found"]), F.lit(title)), TITLE) if title else F.lit(0)) + points(block["is_title"], TITLE_BLOCK)
        + F.when(at_start, F.lit(BLOCK_START)).when(transition, F.lit(TRANSITION)).when(inline, F.lit(INLINE)).otherwise(F.lit(0))
        + points(body >= BODY_WORDS, BODY) + points(toc, TOC) + points(early, EARLY)
    )
    named = [F.when(test, F.lit(name)) for test, name in ((inline, "inline_reference"), (toc, "toc_suppressed"), (early, "early_candidate"))]
    start = block["start"]
    return let(score, lambda s: F.struct(F.lit(section).alias("section"), (start + at).cast("int").alias("start"), (start + stop).cast("int").alias("end"), s.alias("score"), F.array_compact(F.array(*named, F.when(s < STRONG, F.lit("low_candidate_score")))).alias("warnings")))


def heading_candidates(blocks: DataFrame, form_type: str, *, key: str = "filing_id") -> DataFrame:
    """key, section, start, end, score, warnings of every place where a section's heading matches; of block_rows()."""
    return blocks.select(key, F.inline(candidates_of(F.struct(*[c for c in blocks.columns if c != key]), form_type)))


def section_fields(name: Column, words: Column, start: Column, stop: Column, eof: Column, score: Column, warnings: Column, method: str, eof_warning: str = "open_ended_boundary") -> list[Column]:
    """What is known of a section by its place and number of words: the fields of SECTION_TYPE."""
    short = words < S.SHORT
    listed = F.array_distinct(F.concat(warnings, F.array_compact(F.array(F.when(short, F.lit("short_section")), F.when(eof, F.lit(eof_warning))))))
    base = F.greatest(F.lit(0.4), F.least(F.lit(0.95), score / 100))
    value = F.when(eof, F.least(base, F.lit(0.75))).otherwise(base)
    value = F.when(words >= S.LONG, F.greatest(value, F.lit(0.85))).when(words >= S.FULL, F.greatest(value, F.lit(0.76))).otherwise(value)
    value = F.when(short, F.least(base, F.lit(0.35))).otherwise(value)
    fields = {"section": name, "word_count": words, "start_offset": start.cast("int"), "end_offset": stop.cast("int"), "warnings": listed, "extraction_confidence": F.round(value, 2), "extraction_method": F.lit(method)}
    return [v.alias(k) for k, v in fields.items()]


def section_of(name: Column, text: Column, start: Column, stop: Column, score: Column, warnings: Column, method: str, eof_warning: str = "open_ended_boundary") -> Column:
    """The section of a text from start to stop, with its words, warnings and confidence; with_texts() cuts those that remain."""
    # White space is no part of words: they count alike before it is normalised.
    words = S.word_count(F.substring(text, start + 1, stop - start))
    return let(words, lambda w: F.struct(*section_fields(name, w, start, stop, stop >= F.length(text), score, warnings, method, eof_warning)))


def with_texts(rows: DataFrame) -> DataFrame:
    """Adds text, sentence_count and text_hash to section rows with _raw, their part of the source: as rows, so what isn't read isn't computed."""
    text = F.col("text")
    sentences = F.greatest(F.size(T.sentences(text)), F.when(text != "", F.lit(1)).otherwise(F.lit(0)))
    return rows.withColumn("text", S.normal_whitespace(F.col("_raw"))).withColumns({"sentence_count": F.when(text.isNotNull(), sentences), "text_hash": F.sha2(text, 256)}).drop("_raw")


def cut_out(section: Column, text: Column) -> Column:
    """The section with _raw, its part of the text."""
    return section.withField("_raw", F.substring(text, section["start_offset"] + 1, section["end_offset"] - section["start_offset"]))


def primary_sections(filings: DataFrame, form_type: str) -> DataFrame:
    """Adds primary: the sections of with_blocks() rows by their candidates."""
    names = list(FORM_PATTERNS[form_base(form_type)])
    df = T.once(filings, {"_strong": F.filter(F.flatten(F.transform("marks", lambda b: candidates_of(b, form_type))), lambda c: c["score"] >= STRONG)})
    order = lambda c: F.struct((-c["score"]).alias("low"), c["start"].alias("start"), c["score"].alias("score"), c["warnings"].alias("warnings"))
    best = lambda s: let(F.array_sort(F.transform(F.filter("_strong", lambda c: c["section"] == s), order)), lambda x: F.struct(F.get(x, F.lit(0))["start"].alias("start"), F.lit(s).alias("section"), F.get(x, F.lit(0)).alias("one"), F.get(x, F.lit(1)).alias("two")))
    picks = F.array_sort(F.filter(F.array(*map(best, names)), lambda p: p["start"].isNotNull()))
    bounds = F.array_sort(F.transform("_strong", lambda c: F.struct(c["start"].alias("start"), c["section"].alias("section"))))
    df = T.once(df, {"_picks": picks, "_bounds": bounds})
    text = F.col("full_text")

    def cut(pick: Column, start: Column, stop: Column, one: Column, *more: str) -> Column:
        return section_of(pick["section"], text, start, stop, one["score"], F.concat(one["warnings"], F.array(*map(F.lit, more)).cast("array<string>")), "block_sequence")

    def repaired(pick: Column, stop: Column) -> Column:
        later = F.filter("_bounds", lambda b: (b["start"] >= pick["start"] + EXTEND) & (b["section"] != pick["section"]))
        longer = F.get(later, F.lit(0))["start"]

        def extended(first: Column) -> Column:
            return F.when((first["word_count"] < BODY_WORDS) & (longer > stop), cut(pick, pick["start"], longer, pick["one"], "boundary_extended")).otherwise(first)

        def alternated(now: Column) -> Column:
            weak = (now["word_count"] < USABLE) & (F.array_contains(now["warnings"], "short_section") | F.array_contains(now["warnings"], "early_candidate"))
            other = F.when(weak & pick["two"].isNotNull(), cut(pick, pick["two"]["start"], stop, pick["two"], "alternate_candidate"))
            return let(other, lambda o: F.when(o["word_count"] > now["word_count"], o).otherwise(now))

        return let(let(cut(pick, pick["start"], stop, pick["one"]), extended), alternated)

    found = F.transform("_picks", lambda p, i: repaired(p, F.coalesce(F.get("_picks", i + 1)["start"], F.length(text))))
    return T.once(df, {"primary": found}).drop("_strong", "_picks", "_bounds")


def block_sections(filings: DataFrame, form_type: str, *, key: str = "filing_id") -> DataFrame:
    """Sections of with_blocks() rows: key, section, text, counts, offsets, confidence, method and warnings."""
    found = primary_sections(filings, form_type).select(key, F.inline(F.transform("primary", lambda x: cut_out(x, F.col("full_text")))))
    return with_texts(found).select(*block_columns(key))


def risk_places(text: Column, form_type: str) -> Column:
    """The mentions of Item 1A in a text, by its heading or by a shorter one."""
    return matches(text, rf"(?i)(?:{FORM_PATTERNS[form_base(form_type)][RISKS]}|(?:item\s*)?1a\.?[^a-z]{{0,60}}risk)")


def risk_section(text: Column, place: Column, score: int, method: str, *warnings: str) -> Column:
    """From a mention of Item 1A to the next Item 1B or 2."""
    stop = place["at"] + F.length(place["found"])
    rest = F.substring(text, stop + 1, F.length(text))
    end = stop + F.length(F.element_at(F.split(rest, RISKS_END, 2), 1))
    return section_of(F.lit(RISKS), text, place["at"], end, F.lit(score), F.array(*map(F.lit, warnings)).cast("array<string>"), method)


def item_1a(filings: DataFrame, form_type: str, text: str) -> DataFrame:
    """Adds risks: Item 1A by its best match, a text of BODY_WORDS words at least, or, where none has them, by its first match."""
    if form_base(form_type) not in ("10-K", "10-Q"):
        return filings.withColumn("risks", F.lit(None).cast(SECTION_TYPE))
    df = T.once(filings, {"_places": risk_places(F.col(text), form_type)})
    df = T.once(df, {"_cuts": F.transform("_places", lambda p: risk_section(F.col(text), p, 76, "best_match"))})
    usable = F.array_sort(F.transform(F.filter("_cuts", lambda c: c["word_count"] >= BODY_WORDS), lambda c: F.struct((-c["word_count"]).alias("low"), c["start_offset"].alias("at"), c.alias("cut"))), _shorter)
    last_resort = F.when(F.size("_places") > 0, risk_section(F.col(text), F.get("_places", F.lit(0)), 70, "last_resort", "last_resort_extraction"))
    return T.once(df, {"risks": F.coalesce(F.get(usable, F.lit(0))["cut"], last_resort)}).drop("_places", "_cuts")


def _shorter(a: Column, b: Column) -> Column:
    left, right = F.struct(a["low"], a["at"]), F.struct(b["low"], b["at"])
    return F.when(left < right, F.lit(-1)).when(left > right, F.lit(1)).otherwise(F.lit(0))


def best_item_1a(filings: DataFrame, form_type: str, *, key: str = "filing_id", text: str = "full_text") -> DataFrame:
    """The longest text from any mention of Item 1A to the next Item 1B or 2; annual and quarterly forms."""
    found = item_1a(filings, form_type, text).where(F.col("risks").isNotNull()).select(key, cut_out(F.col("risks"), F.col(text)).alias("risks"))
    return with_texts(found.select(key, "risks.*")).select(*block_columns(key))


def block_columns(key: str) -> list[str]:
    return [key, "section", "text", "word_count", "start_offset", "end_offset", "warnings", "extraction_confidence", "sentence_count", "text_hash", "extraction_method"]


def merged_sections(form_type: str) -> Column:
    """primary and fallback by section: the fallback counts where the primary is missing, or short and clearly shorter."""
    own = lambda name, s: F.get(F.filter(name, lambda x: x["section"] == s), F.lit(0))

    def pick(s: str) -> Column:
        a, b = own("primary", s), own("fallback", s)
        clear = (a["word_count"] < S.FULL) & ((b["word_count"] >= S.FULL) | (b["word_count"] > 2 * a["word_count"]))
        renewed = b.withField("warnings", F.array_distinct(F.concat(a["warnings"], b["warnings"], F.array(F.lit("merged_from_fallback"))))).withField("extraction_method", F.concat(b["extraction_method"], F.lit("_merged")))
        return F.when(a.isNull(), b).when(F.coalesce(clear, F.lit(False)), renewed).otherwise(a)

    return F.array_compact(F.array(*map(pick, FORM_PATTERNS[form_base(form_type)])))


def with_item_1a(found: Column, risks: Column) -> Column:
    """Item 1A is the other match where it is missing, or where that is longer and usable or twice as long; else it stays."""

    def chosen(own: Column) -> Column:
        b = risks["word_count"]
        use = (b > own["word_count"]) & ((b >= USABLE) | (b > 2 * own["word_count"]))
        renewed = risks.withField("warnings", F.array_distinct(F.concat(own["warnings"], risks["warnings"], F.array(F.lit("item1a_resliced")))))
        return F.when(F.coalesce(use, F.lit(False)), renewed).otherwise(own)

    has = F.exists(found, lambda x: x["section"] == RISKS)
    replaced = F.transform(found, lambda x: F.when(x["section"] == RISKS, chosen(x)).otherwise(x))
    return F.when(risks.isNull(), found).when(has, replaced).otherwise(F.array_append(found, risks))


def tagged_sections(found: Column, parse_warning: Column) -> Column:
    """In the order of their starts, with section_ord; a short Item 1A is suspect, the first section has the parser's warning."""
    by_start = F.array_sort(F.transform(found, lambda x: F.struct(x["start_offset"].alias("at"), x["section"].alias("name"), x.alias("x"))), _by_start)

    def tags(x: Column, i: Column) -> Column:
        more = F.array_compact(F.array(F.when((x["section"] == RISKS) & (x["word_count"] < USABLE), F.lit("extraction_suspect")), F.when(i == 0, parse_warning)))
        return x.withField("warnings", F.array_union(x["warnings"], more)).withField("section_ord", (i + 1).cast("int"))

    return F.transform(by_start, lambda o, i: tags(o["x"], i))


def _by_start(a: Column, b: Column) -> Column:
    left, right = F.struct(a["at"], a["name"]), F.struct(b["at"], b["name"])
    return F.when(left < right, F.lit(-1)).when(left > right, F.lit(1)).otherwise(F.lit(0))


def tagged(found: DataFrame, *, key: str = "filing_id", parse_warning: Column | None = None) -> DataFrame:
    """tagged_sections() of section rows, which are gathered by filing."""
    warning = F.lit(None).cast("string") if parse_warning is None else parse_warning
    rows = found.groupBy(key).agg(F.collect_list(F.struct(*block_columns(key)[1:])).alias("found"))
    return rows.select(key, F.inline(tagged_sections(F.col("found"), warning)))


def extract(filings: DataFrame, form_type: str, *, key: str = "filing_id", html: str = "html", errors: bool = False) -> DataFrame:
    """All sections of pages: blocks first, the plain heading search where they have none or far less, Item 1A by its best match.

    With errors, a page that can't be read is one row of its key and parse_error, which is null in all others; without,
    such pages have no rows. No page fails the query.
    """
    ready = primary_sections(with_blocks(filings.select(key, html), key=key, html=html), form_type).drop("marks", "blocks")
    ready = S.heading_sections(ready, form_type, text="clean_text", made=section_of).withColumnRenamed("headings", "fallback")
    ready = T.once(item_1a(ready, form_type, "clean_text"), {"found": merged_sections(form_type)})
    tags = tagged_sections(with_item_1a(F.col("found"), F.col("risks")), F.lit(None).cast("string"))
    source = lambda x: F.when(x["extraction_method"] == "block_sequence", F.col("full_text")).otherwise(F.col("clean_text"))
    final = ready.select(key, F.col("parse_warning").alias("parse_error"), "full_text", "clean_text", tags.alias("found"))
    cuts = F.transform("found", lambda x: cut_out(x, source(x)))
    if not errors:
        return with_texts(final.select(key, F.inline(cuts))).select(*block_columns(key), "section_ord")
    rows = final.select(key, "parse_error", F.when(F.col("parse_error").isNotNull(), F.array(F.lit(None))).otherwise(cuts).alias("found"))
    return with_texts(rows.select(key, "parse_error", F.inline("found"))).select(key, "parse_error", *block_columns(key)[1:], "section_ord")
