"""Tokens, sentences, phrases and numbers of text, as column expressions.

All of them are built-in expressions; patterns are built on the driver once. Regular expressions avoid word boundaries,
whose meaning differs between regex engines: a token is a maximal run of letters, digits and underscores that consists
of a-z alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_RUN = r"([\p{L}\p{N}_]+)"
#: A run of word characters, taken whole: in the group if all are a-z. Runs follow one another, so nothing looks back.
PLAIN_WORD = r"([a-z]++)(?![\p{L}\p{N}_])|[\p{L}\p{N}_]++"
#: A run of letters and digits between which phrases begin and end.
PHRASE_RUN = "[a-z0-9]+"
SENTENCE_BREAK = r"[.!?]+\s+"
#: Money, counts and percentages, then written dates, then years: the order decides.
NUMBER = r"(?i)(?=[$\djfmasond])((?:\$)?\d[\d,]*(?:\.\d+)?%?|\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2},?\s+\d{4}\b|\b\d{4}\b)"


def _col(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def stripped(text: Column | str) -> Column:
    """Without white space at both ends; nothing between them is searched."""
    return F.btrim(_col(text), F.lit(" \t\n\x0b\f\r"))


def tokens(text: Column | str) -> Column:
    """Lower-cased ASCII words, found in one pass."""
    return tokens_of(F.lower(_col(text)))


def tokens_of(lower: Column | str) -> Column:
    """tokens() of a text that is in lower case already."""
    return F.array_remove(F.regexp_extract_all(_col(lower), F.lit(PLAIN_WORD), F.lit(1)), "")


def word_runs(text: Column | str) -> Column:
    """Maximal runs of word characters."""
    return F.regexp_extract_all(_col(text), F.lit(WORD_RUN), F.lit(1))


def capitalised(text: Column | str) -> Column:
    """How many of the word runs are a capital and small letters of ASCII."""
    return F.regexp_count(_col(text), F.lit(r"[A-Z](?<![\p{L}\p{N}_][A-Z])[a-z]++(?![\p{L}\p{N}_])"))


def sentences(text: Column | str) -> Column:
    """Parts between sentence ends that are followed by white space, without blank ones."""
    return F.filter(F.split(stripped(text), SENTENCE_BREAK), lambda s: s.rlike(r"\S"))


def phrase_pattern(phrase: str) -> str:
    """A phrase whose words may be joined by white space or hyphens, not inside a longer word.

    It begins with the first word, and then looks back: a search passes over other text by that word's letters.
    """
    first, *parts = [re.escape(p) for p in re.split(r"[\s-]+", phrase.lower()) if p]
    return r"[\s-]+".join([rf"{first}(?<![a-z0-9]{first})", *parts]) + r"(?![a-z0-9])"


def any_pattern(phrases: Iterable[str]) -> str:
    """One pattern that finds any of the phrases."""
    return "|".join(phrase_pattern(p) for p in phrases)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def anchor(phrase: str) -> str:
    """The longest run of letters and digits of a phrase: a text without this very run doesn't hold the phrase."""
    return max(re.findall(PHRASE_RUN, phrase.lower()), key=len, default="")


def runs_of(lower: Column | str, phrases: Iterable[str]) -> Column:
    """Which anchors of the phrases a text has as runs, found in one pass however many phrases there are."""
    wanted = sorted({anchor(p) for p in phrases})
    return F.array_distinct(F.filter(F.regexp_extract_all(_col(lower), F.lit(PHRASE_RUN), F.lit(0)), lambda w: w.isin(wanted)))


def holds(lower: Column | str, phrase: str, runs: Column | str | None = None) -> Column:
    """Whether a text holds the phrase; patterns run only where its anchor occurs. runs: runs_of(), else the text is searched."""
    word = anchor(phrase)
    found = _col(lower).rlike(phrase_pattern(phrase))
    if not word:
        return found
    if runs is None:
        return F.contains(_col(lower), F.lit(word)) & found
    near = F.array_contains(_col(runs), word)
    return near if word == phrase.lower().strip() else near & found


def holds_any(lower: Column | str, phrases: Iterable[str], runs: Column | str | None = None) -> Column:
    """Whether a text holds any of the phrases."""
    phrases = list(phrases)
    alone = [] if runs is None else sorted({anchor(p) for p in phrases if anchor(p) and anchor(p) == p.lower().strip()})
    out = F.arrays_overlap(_col(runs), F.lit(alone)) if alone else F.lit(False)
    for p in phrases:
        if p.lower().strip() not in alone:
            out = out | holds(lower, p, runs)
    return out


def phrase_hits(lower: Column | str, phrases: Iterable[str], runs: Column | str | None = None) -> Column:
    """Occurrences of all phrases, each counted by itself where its anchor occurs."""
    phrases = list(phrases)
    if runs is None:
        return let(runs_of(lower, phrases), lambda r: phrase_hits(lower, phrases, r))
    near = lambda p: F.array_contains(_col(runs), anchor(p)) if anchor(p) else F.lit(True)
    return sum((F.when(near(p), F.regexp_count(_col(lower), F.lit(phrase_pattern(p)))).otherwise(F.lit(0)) for p in phrases), F.lit(0))


def phrases_present(lower: Column | str, phrases: Iterable[str], runs: Column | str | None = None) -> Column:
    """How many of the phrases occur."""
    return sum((holds(lower, p, runs).cast("int") for p in phrases), F.lit(0))


def sentences_near(sentence_array: Column | str, phrases: Iterable[str], runs: Column | str) -> Column:
    """Lower-cased sentences with an anchor of the phrases; no other can hold one. runs: runs_of() of these phrases at least."""
    wanted = sorted({anchor(p) for p in phrases})
    lowered = F.transform(_col(sentence_array), F.lower)
    if "" in wanted:
        return lowered
    near = lambda own: F.filter(lowered, lambda s: F.exists(own, lambda r: F.contains(s, r)))
    return let(F.array_intersect(_col(runs), F.lit(wanted)), lambda own: F.when(F.size(own) > 0, near(own)).otherwise(F.array().cast("array<string>")))


def sentence_phrase_hits(sentence_array: Column | str, phrases: Iterable[str], runs: Column | str | None = None) -> Column:
    """Over all sentences, how many of the phrases each holds. runs: runs_of() of the text, else each sentence is searched."""
    phrases = list(phrases)
    lowered = F.transform(_col(sentence_array), F.lower) if runs is None else sentences_near(sentence_array, phrases, runs)
    return F.aggregate(lowered, F.lit(0), lambda acc, low: acc + phrases_present(low, phrases))


def tokens_in(token_array: Column | str, words: Iterable[str]) -> Column:
    """How many tokens are among the words (a hash look-up each)."""
    words = list(words)
    return F.size(F.filter(_col(token_array), lambda t: t.isin(words)))


def numeric_tokens(text: Column | str) -> Column:
    """Numbers without signs and separators; percentages carry a prefix."""
    raw = F.regexp_extract_all(_col(text), F.lit(NUMBER), F.lit(1))
    plain = F.transform(raw, lambda x: F.regexp_replace(F.replace(F.lower(x), F.lit(","), F.lit("")), r"^\$", ""))
    return F.transform(plain, lambda x: F.when(F.endswith(x, F.lit("%")), F.concat(F.lit("pct:"), F.regexp_replace(x, "%$", ""))).otherwise(x))


def keyword_positions(text: Column | str, token_array: Column | str, keyword: str) -> Column:
    """Token numbers (from 0) at which a keyword occurs; for a phrase, the number of tokens before it."""
    words = keyword.lower()
    if not re.search(r"[ -]", words):
        places = F.transform(_col(token_array), lambda t, i: F.when(t == words, i))
        return F.filter(places, lambda i: i.isNotNull())
    pieces = F.split(F.lower(_col(text)), phrase_pattern(words), -1)
    before = lambda i: F.array_join(F.slice(pieces, F.lit(1), i), f" {words} ")
    return F.when(F.size(pieces) > 1, F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: F.size(tokens(before(i))))).otherwise(F.array().cast("array<int>"))


def topic_intensity(text: Column | str, token_array: Column | str, keywords: Iterable[str], severity: Iterable[str], window: int = 10) -> Column:
    """Keyword hits, and half of those hits that have a severity word within `window` tokens."""
    severity = list(severity)
    keywords = list(keywords)
    arr = _col(token_array)
    hits = F.flatten(F.array(*[keyword_positions(text, token_array, k) for k in keywords]))
    near = lambda i: F.exists(F.slice(arr, F.greatest(i - window, F.lit(0)) + 1, F.least(i, F.lit(window)) + window + 1), lambda t: t.isin(severity))
    value = F.aggregate(hits, F.lit(0.0), lambda acc, i: acc + F.lit(1.0) + F.when(near(i), F.lit(0.5)).otherwise(F.lit(0.0)))
    return F.when(F.lower(_col(text)).rlike(any_pattern(keywords)), value).otherwise(F.lit(0.0))


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns (or replaces those of the same name) that are computed once a row, however often later steps read them.

    Projections are merged by the optimiser, which would copy these expressions to each place of use; the one-row
    generator between them isn't.
    """
    made = F.inline(F.array(F.struct(*[c.alias(f"_once_{name}") for name, c in columns.items()])))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select("*", made).select(*kept, *[F.col(f"_once_{name}").alias(name) for name in columns])


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """Null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def ratio(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """part / whole * scale, 0 where whole is 0."""
    return F.when(whole > 0, part / whole * scale).otherwise(F.lit(0.0))
