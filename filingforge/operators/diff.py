"""Comparison of sections with their prior-period counterparts.

Both texts of a pair stand in one row, so everything below the pairing join is narrow. Term-weight similarity and
sentence alignment are small sparse products inside a pair; they run as one Arrow kernel over batches of pairs instead
of exploding sentences and terms into a shuffle. All else is built from column expressions.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from filingforge.functions import text as T
from filingforge.functions.term_packs import TermPacks

TERM, RUN = re.compile(r"\w\w+"), re.compile(r"\w+")
MATCH, SAME = 0.55, 0.92
#: The squared weight of a term that is in one of two texts.
ALONE = (math.log(3 / 2) + 1) ** 2
DELTAS = {"negative_language_delta": "negative", "uncertainty_language_delta": "uncertainty", "legal_language_delta": "litigious", "constraining_language_delta": "constraining"}

KERNEL = StructType([
    StructField("lexical_similarity", DoubleType()),
    StructField("semantic_similarity", DoubleType()),
    StructField("matched", ArrayType(StructType([StructField("ci", IntegerType()), StructField("pi", IntegerType()), StructField("sim", DoubleType())]))),
])


def similarities(a: str, b: str, most: tuple[int, ...]) -> list[float]:
    """Cosines of two texts' smoothed term weights over so many of their most frequent terms (ties by term); 0 where either is blank.

    Texts are taken apart once. A term in one of two texts weighs ln(3/2) + 1, one in both 1.
    """
    if not a.strip() or not b.strip():
        return [0.0] * len(most)
    x, y = Counter(TERM.findall(a.lower())), Counter(TERM.findall(b.lower()))
    common = x.keys() & y.keys()
    terms, ordered = len(x) + len(y) - len(common), []
    if terms > min(most):
        totals = x.copy()
        totals.update(y)
        ordered = sorted(totals, key=lambda t: (-totals[t], t))
    out = []
    for limit in most:
        if terms <= limit:
            shared, own, other = common, x, y
        else:
            kept = ordered[:limit]
            own, other = {t: x[t] for t in kept if t in x}, {t: y[t] for t in kept if t in y}
            shared = own.keys() & other.keys()
        both = [(own[t], other[t]) for t in shared]
        p, q = sum(n * n for n, _ in both), sum(n * n for _, n in both)
        p, q = p + ALONE * (sum(n * n for n in own.values()) - p), q + ALONE * (sum(n * n for n in other.values()) - q)
        out.append(min(1.0, sum(m * n for m, n in both) / (p * q) ** 0.5) if p and q else 0.0)
    return out


def term_weights(documents: list[str], most: int) -> list[dict[str, float]]:
    """Unit vectors of smoothed term weights over the `most` most frequent terms (ties by term), by term."""
    row, term, weight, _ = sentence_weights(documents, most)
    names = sorted({w for d in documents for w in TERM.findall(d.lower())})
    out: list[dict[str, float]] = [{} for _ in documents]
    for i, t, v in zip(row.tolist(), term.tolist(), weight.tolist(), strict=True):
        out[i][names[t]] = v
    return out


def text_similarity(a: str, b: str, most: int) -> float:
    """similarities() over one number of terms."""
    return similarities(a, b, (most,))[0]


def sentence_weights(sentences: list[str], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Unit vectors of smoothed term weights over the `most` most frequent terms (ties by term): row, term, weight by row and term; terms."""
    words = [TERM.findall(s.lower()) for s in sentences]
    flat = [w for x in words for w in x]
    number = {w: i for i, w in enumerate(sorted(set(flat)))}
    width = max(1, len(number))
    term, row = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat)), np.repeat(np.arange(len(words)), [len(x) for x in words])
    if width > most:
        kept = np.zeros(width, bool)
        kept[np.argsort(-np.bincount(term, minlength=width), kind="stable")[:most]] = True
        row, term = row[kept[term]], term[kept[term]]
    cells, counts = np.unique(row * width + term, return_counts=True)
    row, term = cells // width, cells % width
    weight = counts * (np.log((1 + len(words)) / (1 + np.bincount(term, minlength=width))) + 1)[term]
    norm = np.sqrt(np.bincount(row, weight * weight, minlength=len(words)))
    return row, term, weight / norm[row], width


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all spans, one after another."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def align(current: list[str], prior: list[str], *, most: int = 2000, threshold: float = MATCH, cells: int = 2_000_000) -> list[tuple[int, int, float]]:
    """One-to-one matches (current, prior, similarity): each current sentence tries its best prior one, first come, first served.

    Only current sentences with a prior one that can reach the threshold are scored: a sentence's terms are taken from the rarest
    on, until those left weigh too little to reach it alone; who shares none of the terms taken is out. Where few are near, each
    is scored by itself; otherwise a block of sentences at a time meets all, in at most about `cells` cells.
    """
    if not current or not prior:
        return []
    n, m = len(current), len(prior)
    row, term, weight, width = sentence_weights(current + prior, most)
    cut = int(np.searchsorted(row, n))
    other, other_term, other_weight = row[cut:] - n, term[cut:], weight[cut:]
    other_at = np.searchsorted(other, np.arange(m + 1))
    # By term: the prior sentences that hold it, in order.
    listed = np.argsort(other_term, kind="stable")
    sizes = np.bincount(other_term, minlength=width)
    starts = np.cumsum(sizes) - sizes
    row, term, weight = row[:cut], term[:cut], weight[:cut]
    whole = np.bincount(row, weight * weight, minlength=n)
    known = sizes[term] > 0
    row, term, weight = row[known], term[known], weight[known]
    if not len(row):
        return []
    at = np.searchsorted(row, np.arange(n + 1))
    rarest = np.lexsort((sizes[term], row))
    squares = (weight * weight)[rarest]
    before = np.cumsum(squares) - squares
    taken = whole[row] - (before - before[np.minimum(at[row], len(row) - 1)]) >= (threshold - 1e-6) ** 2
    near = np.bincount(row, sizes[term[rarest]] * taken, minlength=n)
    every = np.bincount(row, sizes[term], minlength=n)
    few = (near > 0) & (every > 2000 + 4 * near * len(other) / m)
    best, top = np.zeros(n, np.int64), np.zeros(n)
    own = np.zeros(width)
    for i in np.flatnonzero(few).tolist():
        part = slice(at[i], at[i + 1])
        close = term[rarest[part]][taken[part]]
        found = np.unique(other[listed[spans(starts[close], sizes[close])]])
        lengths = other_at[found + 1] - other_at[found]
        places = spans(other_at[found], lengths)
        own[term[part]] = weight[part]
        sims = np.round(np.add.reduceat(own[other_term[places]] * other_weight[places], np.cumsum(lengths) - lengths), 9)
        own[term[part]] = 0
        k = int(sims.argmax())
        best[i], top[i] = found[k], sims[k]
    many = np.flatnonzero((near > 0) & ~few)
    filled = np.cumsum(np.maximum(every[many], m))
    for block in np.split(many, np.flatnonzero(np.diff(filled // cells)) + 1):
        if not len(block):
            continue
        entries = spans(at[block], at[block + 1] - at[block])
        counts = sizes[term[entries]]
        places = listed[spans(starts[term[entries]], counts)]
        line = np.repeat(np.arange(len(block)), at[block + 1] - at[block])
        sims = np.bincount(np.repeat(line * m, counts) + other[places], np.repeat(weight[entries], counts) * other_weight[places], len(block) * m)
        sims = np.round(sims.reshape(len(block), m), 9)
        best[block] = sims.argmax(axis=1)
        top[block] = sims[np.arange(len(block)), best[block]]
    used: set[int] = set()
    out = []
    for i in np.flatnonzero(top >= threshold).tolist():
        if (j := int(best[i])) not in used:
            used.add(j)
            out.append((i, j, float(top[i])))
    return out


def intensity(text: str, tokens: list[str], patterns: list[tuple[str, re.Pattern | None]], severity: frozenset[str], window: int = 10) -> float:
    """Keyword hits, and half of those that have a severity word within `window` tokens.

    patterns: keywords with None for single tokens; a phrase stands behind the tokens that end before it.
    """
    at: list[int] = []
    ends: list[int] | None = None
    low = text.lower()
    for keyword, pattern in patterns:
        if keyword.split(" ")[0].split("-")[0] not in low:
            continue
        if pattern is None:
            at += [i for i, t in enumerate(tokens) if t == keyword]
            continue
        for hit in pattern.finditer(low):
            if ends is None:
                ends = [m.end() for m in RUN.finditer(low) if m[0].isascii() and m[0].isalpha()]
            at.append(bisect_right(ends, hit.start()))
    return sum(1.0 + 0.5 * any(t in severity for t in tokens[max(0, i - window) : i + window + 1]) for i in at)


def with_alignment(pairs: DataFrame, current: str = "text", prior: str = "prior_text", *, lexical_terms: int = 2000, semantic_terms: int = 512, packs: TermPacks | None = None, factor: float = 1.2) -> DataFrame:
    """Adds lexical_similarity, semantic_similarity and matched; the sentences columns have to be there already.

    With packs, also intensified_topics: topics on both sides (columns topics and prior_topics) whose intensity has
    grown by more than the factor.
    """
    extra_fields = [StructField("intensified_topics", ArrayType(StringType()))] if packs else []
    schema = StructType([*pairs.schema.fields, *KERNEL.fields, *extra_fields])
    shape, width = to_arrow_schema(schema), len(pairs.columns)
    topics = {t: [(k.lower(), re.compile(T.phrase_pattern(k)) if re.search("[ -]", k) else None) for k in words] for t, words in packs.topics.items()} if packs else {}
    severity = frozenset(packs.severity) if packs else frozenset()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[], [], [], *([[]] if topics else [])]
            for a, b, cs, ps in zip(*(batch.column(c).to_pylist() for c in (current, prior, "sentences", "prior_sentences")), strict=True):
                if not b:
                    for r in rows[:3]:
                        r.append(None)
                    continue
                lexical, semantic = similarities(a or "", b, (lexical_terms, semantic_terms))
                rows[0].append(lexical)
                rows[1].append(semantic)
                rows[2].append([{"ci": i, "pi": j, "sim": s} for i, j, s in align(cs or [], ps or [])])
            if topics:
                columns = (batch.column(c).to_pylist() for c in (current, prior, "topics", "prior_topics"))
                tokens, prior_tokens = batch.column("tokens"), batch.column("prior_tokens")
                for i, (a, b, now, before) in enumerate(zip(*columns, strict=True)):
                    both = [t for t in now or () if t in (before or ())]
                    # Tokens leave Arrow only where a topic stands on both sides.
                    ta, tb = (tokens[i].values.to_pylist(), prior_tokens[i].values.to_pylist()) if b and both else ([], [])
                    rows[3].append(None if not b else [t for t in both if intensity(a or "", ta, topics[t], severity) > intensity(b, tb, topics[t], severity) * factor])
            extra = [pa.array(r, shape.field(width + k).type) for k, r in enumerate(rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], schema=shape)

    return pairs.mapInArrow(run, schema)


def prior_targets(filings: DataFrame) -> DataFrame:
    """Adds prior_year and prior_quarter: the period before, by form; a first quarter follows the third of the year before."""
    q = F.upper(F.coalesce(F.col("quarter"), F.lit("")))
    year, quarterly = F.col("fiscal_year"), F.col("form_type") == "10-Q"
    return filings.withColumns({
        "prior_year": F.when(quarterly & q.isin("Q2", "Q3"), year).otherwise(year - 1),
        "prior_quarter": F.when(quarterly, F.when(q == "Q2", F.lit("Q1")).when(q == "Q3", F.lit("Q2")).when(q == "Q1", F.lit("Q3"))),
    })


def pair_with_prior(sections: DataFrame, *, entity: str = "entity", columns: tuple[str, ...] = ("text", "tokens", "sentences", "lower")) -> DataFrame:
    """Sections left-joined with those of the prior filing; the first section of a name counts, a missing one gives nulls.

    sections: entity, form_type, fiscal_year, quarter, section, section_ord and the columns to bring along.
    """
    targets = prior_targets(sections)
    first = F.row_number().over(Window.partitionBy(entity, "form_type", "fiscal_year", "quarter", "section").orderBy("section_ord"))
    before = sections.withColumn("_n", first).where("_n = 1").select(
        F.col(entity).alias("_e"), F.col("form_type").alias("_f"), F.col("fiscal_year").alias("_y"), F.col("quarter").alias("_q"), F.col("section").alias("_s"), *[F.col(c).alias(f"prior_{c}") for c in columns]
    )
    on = (F.col(entity) == F.col("_e")) & (F.col("form_type") == F.col("_f")) & (F.col("prior_year") == F.col("_y")) & F.col("prior_quarter").eqNullSafe(F.col("_q")) & (F.col("section") == F.col("_s"))
    return targets.join(before, on, "left").drop("_e", "_f", "_y", "_q", "_s")


def topics_in(lower: str | Column, packs: TermPacks) -> Column:
    """The topics of which any keyword occurs, in alphabetic order."""
    low = F.col(lower) if isinstance(lower, str) else lower
    every = [w for words in packs.topics.values() for w in words]
    found = lambda low, runs: F.array_compact(F.array(*[F.when(T.holds_any(low, words, runs), F.lit(topic)) for topic, words in sorted(packs.topics.items())]))
    return T.let(low, lambda x: T.let(T.runs_of(x, every), lambda runs: found(x, runs)))


def share(tokens: str, words: tuple[str, ...]) -> Column:
    """Rounded share of the tokens that are among the words."""
    return F.round(T.ratio(T.tokens_in(tokens, words), F.size(tokens)), 6)


def unmatched(sentences: str, place: str) -> Column:
    """Sentences whose places no match names, in order; places are told apart by hash, not each with each."""
    places = F.transform(sentences, lambda s, i: i)
    free = F.array_except(places, F.transform("matched", lambda m: m[place]))
    return F.transform(free, lambda i: F.get(sentences, i))


def section_diffs(pairs: DataFrame, packs: TermPacks | None = None) -> DataFrame:
    """Adds the diff of each pair: similarities, topics, deltas, alignment counts, both change scores, confidence, summary.

    pairs: text, tokens, sentences, lower and the same with prior_ in front. Without a prior text all is null but the
    confidence and the summary. A column latent_similarity (see latent.with_similarity) counts as the semantic similarity.
    """
    packs = packs or TermPacks()
    some = F.coalesce(F.col("prior_text"), F.lit("")) != ""
    df = pairs.withColumns({"topics": F.when(some, topics_in("lower", packs)), "prior_topics": F.when(some, topics_in("prior_lower", packs))})
    df = with_alignment(df, packs=packs)
    if "latent_similarity" in pairs.columns:
        df = df.withColumn("semantic_similarity", F.when(some, F.col("latent_similarity")))
    runs, prior_runs = F.size(T.word_runs("text")), F.greatest(F.size(T.word_runs("prior_text")), F.lit(1))
    df = df.withColumns({
        "new_topics": F.array_except("topics", "prior_topics"),
        "removed_topics": F.array_except("prior_topics", "topics"),
        "length_change_pct": F.when(some, (runs - prior_runs) / prior_runs),
        **{name: F.when(some, F.round((share("tokens", getattr(packs, pack)) - share("prior_tokens", getattr(packs, pack))) * 100, 4)) for name, pack in DELTAS.items()},
        "added": F.when(some, unmatched("sentences", "ci")),
        "removed": F.when(some, unmatched("prior_sentences", "pi")),
    })
    sem, lex = F.col("semantic_similarity"), F.col("lexical_similarity")
    count = lambda c: F.size(c).cast("double")
    df = df.withColumn("change_v1_exact", F.when(some, T.clamp(
        40 * (1 - (0.6 * sem + 0.4 * lex)) + 20 * T.clamp(F.col("length_change_pct"), 0, 1)
        + 20 * F.least(F.lit(1.0), count("new_topics") / 3) + 20 * F.least(F.lit(1.0), count("intensified_topics") / 3)
    )))
    joined = F.array_join("added", " ")
    df = df.withColumns({"_added": joined, "_added_tokens": T.tokens(joined), "_all": T.numeric_tokens(F.array_join("sentences", " ")), "_before": T.numeric_tokens(F.array_join("prior_sentences", " "))})
    words = F.size("_added_tokens")
    tone = sum((share("_added_tokens", getattr(packs, p)) for p in ("negative", "uncertainty", "litigious", "constraining")), F.lit(0.0)) * 100
    severity = T.ratio(T.tokens_in("_added_tokens", packs.severity), words, 100)
    topical = F.least(F.lit(100.0), F.size(topics_in(F.lower("_added"), packs)) * 25.0)
    numbers = lambda s: F.array_distinct(T.numeric_tokens(s))
    moved = lambda m: F.size(F.array_except(numbers(F.get("sentences", m["ci"])), numbers(F.get("prior_sentences", m["pi"])))) + F.size(F.array_except(numbers(F.get("prior_sentences", m["pi"])), numbers(F.get("sentences", m["ci"]))))
    df = df.withColumns({
        "added_risk_language_score": F.when(some & (F.trim("_added") != ""), F.least(F.lit(100.0), 0.45 * tone + 0.35 * severity + 0.20 * topical)),
        "added_numeric": F.when(some, F.array_sort(F.array_except("_all", "_before"))),
        "removed_numeric": F.when(some, F.array_sort(F.array_except("_before", "_all"))),
        "_moved": F.aggregate("matched", F.lit(0), lambda acc, m: acc + F.when(m["sim"] >= SAME, F.lit(0)).otherwise(moved(m))),
    })
    df = df.withColumn("changed_numeric_count", F.when(some, F.col("_moved") + F.size("added_numeric") + F.size("removed_numeric")))
    aligned = (
        30 * F.least(F.lit(1.0), count("added") / F.greatest(F.size("prior_sentences"), F.lit(1)))
        + 35 * F.coalesce("added_risk_language_score", F.lit(0.0)) / 100
        + 20 * F.least(F.lit(1.0), F.col("changed_numeric_count") / 5)
        + 15 * F.least(F.lit(1.0), (count("new_topics") + count("intensified_topics")) / 3)
    )
    shift = F.abs(share("tokens", packs.uncertainty) - share("prior_tokens", packs.uncertainty))
    listed = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{label}: "), F.array_join(c, ", "), F.lit(".")))
    summary = F.concat_ws(
        " ", listed("New topics", "new_topics"), listed("Removed topics", "removed_topics"), listed("Intensified topics", "intensified_topics"),
        F.when(F.size("added") > 0, F.concat(F.lit("Added "), F.size("added").cast("string"), F.lit(" sentence(s)."))),
        F.when(F.col("changed_numeric_count") > 0, F.concat(F.lit("Numeric disclosure changes: "), F.col("changed_numeric_count").cast("string"), F.lit("."))),
    )
    return df.withColumns({
        "change_v1": F.round("change_v1_exact", 6),
        "change_v2": F.when(some, F.round(T.clamp(0.55 * aligned + 0.45 * F.col("change_v1_exact")), 6)),
        "diff_confidence": F.when(some, F.round(T.clamp(0.7 + 0.2 * sem - shift, 0.4, 0.95), 6)).otherwise(F.lit(0.2)),
        "added_sentence_count": F.size("added"), "removed_sentence_count": F.size("removed"), "matched_count": F.size("matched"),
        "diff_summary": F.when(~some, F.lit("No prior comparable filing section available.")).when(summary == "", F.lit("Minor wording changes detected.")).otherwise(summary),
    }).drop("_added", "_added_tokens", "_all", "_before", "_moved", "change_v1_exact")
