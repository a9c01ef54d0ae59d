"""Filing HTML to text and sections.

Cleaning and heading search are column expressions over the row that holds the text; nothing is shuffled. Headings are
found by one pattern a section; candidates that look like a table of contents are passed over where another is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingforge.functions import text as T
from filingforge.functions.text import let
from filingforge.functions.term_packs import FORM_PATTERNS, REQUIRED_SECTIONS, form_base

SHORT, FULL, LONG = 50, 200, 2000
#: Entities that are resolved; others stay.
ENTITIES = {"&nbsp;": " ", "&#160;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&rsquo;": "’", "&amp;": "&"}


def plain_lines(html: Column) -> Column:
    """Text lines of HTML: scripts, styles and comments dropped, tags are line ends, white space collapsed, blanks gone."""
    t = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>|<!--.*?-->", "\n")
    t = F.regexp_replace(t, r"(?s)<[!/?a-zA-Z][^>]*>", "\n")
    for name, char in ENTITIES.items():
        t = F.replace(t, F.lit(name), F.lit(char))
    lines = F.transform(F.split(t, r"\r?\n"), lambda s: F.trim(F.regexp_replace(s, r"[\s  - 　]+", " ")))
    return F.filter(lines, lambda s: s != "")


def normal_whitespace(text: Column) -> Column:
    """Every run of white space is one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def distinct_lines(lines: Column, least: int = 40) -> Column:
    """Lines without those shorter than `least` that came before.

    The distinct lines keep the order of first occurrence; longer ones may repeat.
    """
    keyed = F.transform(lines, lambda s, i: F.when(F.length(s) < least, s).otherwise(F.concat(s, F.lit("\x00"), i.cast("string"))))
    return F.transform(F.array_distinct(keyed), lambda s: F.substring_index(s, "\x00", 1))


def clean_html(html: Column) -> Column:
    """The text of a page, one blank line between lines."""
    return F.array_join(distinct_lines(plain_lines(F.coalesce(html, F.lit("")))), "\n\n")


def word_count(text: Column) -> Column:
    return F.size(T.word_runs(text))


def places(text: Column, pattern: str) -> Column:
    """array<struct<at, found>>: all matches of a pattern and their places (from 0)."""
    empty = F.array().cast("array<struct<at:int,found:string>>")

    def walked(found: Column) -> Column:
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("found")))
        # One pass: the matches so far and the place behind the last one.
        return F.when(F.size(found) > 0, F.aggregate(steps, F.struct(empty.alias("out"), F.lit(0).alias("at")), _walk)["out"]).otherwise(empty)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), walked)


def _walk(acc: Column, x: Column) -> Column:
    at = acc["at"] + x["gap"]
    return F.struct(F.array_append(acc["out"], F.struct(at.cast("int").alias("at"), x["found"].alias("found"))).alias("out"), (at + F.length(x["found"])).cast("int").alias("at"))


def toc_like(window: Column, heading: Column) -> Column:
    """Whether a heading stands in a table of contents: dots or a tab and a page number behind it, or just a number where it is short."""
    return window.rlike(r"\.\.\.|\t\d+\s*$") | ((F.length(heading) < 10) & window.rlike(r"\d+\s*$"))


def heading_places(filings: DataFrame, form_type: str, *, text: str) -> DataFrame:
    """Adds headings, an array of (at, section, score, toc, stop): where the sections of a text begin and end, in order.

    Of a section's headings that don't look like a table of contents (if all do, of its last one) that with the most words
    up to the next heading of any section counts, of equal ones the first. A section runs to the start of the next one.
    """
    body, low = F.col(text), F.col("_low")
    patterns = FORM_PATTERNS[form_base(form_type)]
    # One search for all sections: their headings end in words of their own behind no other letters, so no two of them overlap.
    # Headings begin with a number or "item", which is looked at first.
    heading = rf"(?=[i0-9])(?<![a-z0-9])(?:{'|'.join(patterns.values())})"
    section_at = lambda m: F.coalesce(*[F.when(m["found"].rlike(rf"\A(?:{p})\z"), F.lit(s)) for s, p in patterns.items()])
    spot = lambda m: F.struct(m["at"].alias("at"), section_at(m).alias("section"), toc_like(F.substring(body, m["at"] + 1, F.lit(200)), m["found"]).alias("toc"))
    df = T.once(filings, {"_low": F.lower(body)})
    df = T.once(df, {"_places": places(low, heading)})
    df = T.once(df.drop("_low"), {"_spots": F.transform("_places", spot), "_starts": F.transform("_places", lambda m: m["at"])})

    def words(at: Column) -> Column:
        following = F.get(F.filter("_starts", lambda x: x > at), F.lit(0))
        return word_count(F.substring(body, at + 1, F.coalesce(following, F.length(body)) - at))

    def best(s: str, viable: Column) -> Column:
        # A heading that is alone needs no count.
        ranked = F.array_sort(F.transform(viable, lambda x: F.struct(F.when(F.size(viable) == 1, F.lit(0)).otherwise(-words(x["at"])).alias("low"), x["at"].alias("at"), x["toc"].alias("toc"))))
        score = lambda x: F.when(x["toc"], F.lit(40)).when(F.size(viable) == 1, F.lit(90)).otherwise(F.lit(75))
        return let(F.get(ranked, F.lit(0)), lambda x: F.struct(x["at"].alias("at"), F.lit(s).alias("section"), score(x).alias("score"), x["toc"].alias("toc")))

    def chosen(s: str) -> Column:
        viable = lambda own: let(F.filter(own, lambda x: ~x["toc"]), lambda clean: F.when(F.size(clean) > 0, clean).otherwise(F.slice(own, F.size(own), F.lit(1))))
        return let(F.filter("_spots", lambda x: x["section"] == s), lambda own: F.when(F.size(own) > 0, let(viable(own), lambda v: best(s, v))))

    df = T.once(df, {"_chosen": F.array_sort(F.array_compact(F.array(*map(chosen, patterns))))})
    ends = F.transform("_chosen", lambda c, i: c.withField("stop", F.coalesce(F.get("_chosen", i + 1)["at"], F.length(body))))
    return T.once(df, {"headings": ends}).drop("_places", "_spots", "_starts", "_chosen")


def heading_warnings(toc: Column) -> Column:
    return F.when(toc, F.array(F.lit("toc_like"))).otherwise(F.array().cast("array<string>"))


def heading_sections(filings: DataFrame, form_type: str, *, text: str, made: Callable[..., Column]) -> DataFrame:
    """Adds headings, an array of sections by heading_places() in the text; made (see blocks.section_of) cuts one."""
    found = F.transform("headings", lambda c: made(c["section"], F.col(text), c["at"], c["stop"], c["score"], heading_warnings(c["toc"]), "heading_search", "end_of_document"))
    return T.once(heading_places(filings, form_type, text=text), {"headings": found})


def extract_sections(filings: DataFrame, form_type: str, *, key: str = "filing_id", text: str = "text") -> DataFrame:
    """key, section, section_ord, text, word_count, sentence_count, text_hash, extraction_confidence, warnings, start_offset, end_offset.

    Sections are rows before their texts are looked at, so what no later step reads of a section isn't computed.
    """
    from filingforge.operators.blocks import section_fields, with_texts

    found = heading_places(filings.select(key, text), form_type, text=text)
    cuts = F.transform("headings", lambda c: c.withField("_raw", F.substring(F.col(text), c["at"] + 1, c["stop"] - c["at"])).withField("eof", c["stop"] >= F.length(text)))
    rows = found.select(key, F.posexplode(cuts).alias("place", "x")).select(key, "place", "x.*").withColumn("word_count", word_count(F.col("_raw")))
    fields = section_fields(F.col("section"), F.col("word_count"), F.col("at"), F.col("stop"), F.col("eof"), F.col("score"), heading_warnings(F.col("toc")), "heading_search", "end_of_document")
    out = with_texts(rows.select(key, (F.col("place") + 1).alias("section_ord"), "_raw", *fields))
    return out.select(key, "section_ord", "section", "text", "word_count", "start_offset", "end_offset", "warnings", "extraction_confidence", "sentence_count", "text_hash")


def required_present(sections: DataFrame, form_type: str, *, key: str = "filing_id") -> DataFrame:
    """key, required_sections_present, missing."""
    need = F.array(*[F.lit(s) for s in REQUIRED_SECTIONS[form_base(form_type)]])
    return sections.groupBy(key).agg(F.array_except(need, F.collect_set("section")).alias("missing")).withColumn("required_sections_present", F.size("missing") == 0)
