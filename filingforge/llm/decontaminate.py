"""Benchmark decontamination by winnowing.

Words are runs of digits, lower-cased letters and non-ASCII characters. A window is 13 consecutive words of a
benchmark item. Of the 6-gram hashes of a text, winnowing keeps those that are the minimum of some 8 in a row; 8
grams in a row are one window, so each window that a document shares with an item holds a gram kept on both sides.
Document fingerprints are looked up among the benchmark's, every hit is extended word by word to both sides, and spans
of 13 words and more count. Items of fewer words are one window each and are looked up by the gram of their own length.

The benchmark is read in blocks of bounded size; each block's index is broadcast and documents pass through it. With
more blocks than one, what a block found is written to the shared folder before the next one is read, and its broadcast
is released, so one index is alive at a time: memory doesn't grow with the corpus or the benchmark. A benchmark of one
block takes a single pass without a shuffle.

Places of an item whose surroundings are equal word by word give the same spans and are indexed once; spans of a text are
merged while they are found. So very long and monotonous texts need memory by their words, not by their hits.

Defined results: null and empty texts have no words and are clean; items without words take no part; an item of null id
hits words, but isn't listed or counted; repeated rows are judged each for itself; columns other than key and text pass
through untouched where asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, drop_staged, slices, staged
from .words import NOT_ALNUM, Words, expand, grams, joined, sliding_min, split_words, word_hashes

#: Words of a window, of a gram, and grams in which one is kept: GRAM + KEPT_IN - 1 = WINDOW.
WINDOW, GRAM, KEPT_IN = 13, 6, 8
#: Bytes of benchmark text in one block, about. The index of a block takes some ten times that.
BLOCK_BYTES = 16 << 20
#: Places of documents and items that are compared at once.
AT_ONCE = 1 << 20


def winnowed(hashes: np.ndarray, width: int) -> np.ndarray:
    """Which gram hashes are the minimum of some `width` in a row (all minima, where they tie)."""
    if len(hashes) < width:
        return np.zeros(len(hashes), dtype=bool)
    least = sliding_min(hashes, width)
    pad = np.zeros(width - 1, dtype=least.dtype)
    top = ~sliding_min(~np.concatenate([pad, least, pad]), width)
    return hashes == top


@dataclass
class Index:
    """Distinct item texts as one run of word hashes, and the fingerprints in it by gram length, sorted by hash."""

    words: np.ndarray
    first: np.ndarray
    ids: list[list[str]]
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def _inside(words: Words, n: int) -> np.ndarray:
    """Which of the n-grams at each word lie within one text."""
    total = len(words.starts)
    return np.arange(n, total + 1) <= words.ends()[: max(total - n + 1, 0)]


def first_of_equal(places: np.ndarray, owners: np.ndarray, hashes: np.ndarray, first: np.ndarray, before: int, after: int) -> np.ndarray:
    """Which places to keep so that, within an item, each surrounding (that many words before and after) stays once."""

    def around(at: np.ndarray, own: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
        there = (at + d >= first[own]) & (at + d < first[own + 1])
        return there, np.where(there, hashes[np.clip(at + d, 0, len(hashes) - 1)], np.uint64(0))

    digest = owners.astype(np.uint64)
    for d in range(-before, after):
        there, word = around(places, owners, d)
        digest = joined(digest + there.astype(np.uint64), word)
    order = np.argsort(digest, kind="stable")
    a, b = order[:-1], order[1:]
    same = owners[a] == owners[b]
    for d in range(-before, after):
        (x, u), (y, v) = around(places[a], owners[a], d), around(places[b], owners[b], d)
        same &= (x == y) & (u == v)
    keep = np.ones(len(places), bool)
    keep[b[same]] = False
    return keep


def build_index(items: list[tuple[str | None, str]], window: int = WINDOW, gram: int = GRAM) -> Index:
    """The index over (id, text) pairs; equal texts are indexed once."""
    by_text: dict[str, list[str]] = {}
    for item, text in items:
        by_text.setdefault(text, []).extend([] if item is None else [item])
    words = split_words(pa.array(list(by_text), pa.string()), NOT_ALNUM, lower=True)
    hashes, counts = word_hashes(words), words.counts()
    owner = np.repeat(np.arange(len(counts)), counts)
    tables = {}
    for n in sorted({min(int(c), window) for c in counts if c}):
        size = n if n < window else gram
        values = grams(hashes, size)
        at = np.arange(len(values))
        if n < window:
            keep = _inside(words, size) & (counts[owner[at]] == n)
        else:
            keep = np.zeros(len(values), dtype=bool)
            for i in np.flatnonzero(counts >= window):
                a, b = words.first[i], words.first[i + 1] - size + 1
                keep[a:b] = winnowed(values[a:b], window - size + 1)
        at = at[keep]
        if n == window:
            at = at[first_of_equal(at, owner[at], hashes, words.first, window - size, window)]
        order = np.argsort(values[at], kind="stable")
        tables[n] = (values[at][order], at[order], owner[at][order])
    return Index(hashes, words.first, [sorted(set(x)) for x in by_text.values()], tables)


def find_windows(words: Words, hashes: np.ndarray, index: Index, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words items' windows cover; and the texts and items of all pairs that share a window."""
    total, ends = len(hashes), words.ends()
    begins = np.repeat(words.first[:-1], words.counts())
    text_of = np.repeat(np.arange(len(words.first) - 1), words.counts())
    items = len(index.ids)
    steps, pairs = np.zeros(total + 1, np.int64), np.zeros(0, np.int64)
    for n, (keys, places, owners) in index.tables.items():
        size = n if n < window else gram
        values = grams(hashes, size)
        if not len(values) or not len(keys):
            continue
        at = np.flatnonzero(_inside(words, size) & (winnowed(values, window - size + 1) if n == window else True))
        low = np.searchsorted(keys, values[at], "left")
        hit = low < len(keys)
        hit[hit] = keys[low[hit]] == values[at[hit]]
        at, low = at[hit], low[hit]
        many = np.searchsorted(keys, values[at], "right") - low
        chunk = (np.cumsum(many) - 1) // AT_ONCE
        edges = np.searchsorted(chunk, np.arange(chunk[-1] + 2)) if len(chunk) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):  # bounded memory, however often a gram occurs in the items
            p = np.repeat(at[a:b], many[a:b])
            which = expand(low[a:b], many[a:b])
            q, item = places[which], owners[which]
            same = np.ones(len(p), dtype=bool)
            for d in range(size):
                same &= hashes[p + d] == index.words[q + d]
            left, right = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
            if n == window:
                go = same.copy()
                for d in range(1, window - size + 1):
                    go &= (p - d >= begins[p]) & (q - d >= index.first[item])
                    go &= hashes[np.maximum(p - d, 0)] == index.words[np.maximum(q - d, 0)]
                    left += go
                go = same.copy()
                for d in range(size, window):
                    go &= (p + d < ends[p]) & (q + d < index.first[item + 1])
                    go &= hashes[np.minimum(p + d, total - 1)] == index.words[np.minimum(q + d, len(index.words) - 1)]
                    right += go
            good = same & (left + size + right >= n)
            steps += np.bincount((p - left)[good], minlength=total + 1)
            steps -= np.bincount((p + size + right)[good], minlength=total + 1)
            pairs = np.union1d(pairs, text_of[p[good]] * items + item[good])
    return np.cumsum(steps[:total]) > 0, pairs // max(items, 1), pairs % max(items, 1)


def benchmark_blocks(benchmark: DataFrame, key: str, text: str, block_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items in blocks of about block_bytes of text (a single longer item is a block of its own)."""
    items = benchmark.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"))
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = -(-total // block_bytes) or 1
    for i in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == i)
        yield [(r["id"], r["text"]) for r in part.distinct().collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", carry: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document: key (or the columns to carry), n_words, n_hit, items and spans.

    items: ids of the items with windows in the document, sorted as strings. spans: starts and ends, alternating, of
    the hit runs of words.
    """
    spark = docs.sparkSession
    kept = carry if carry is not None else [key]
    state = docs.select(F.col(text).alias("__text"), F.struct(*kept).alias("__row"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.array().cast("array<long>").alias("spans"))
    shape = arrow_schema(state.schema)
    before = shared = None  # what the block before has left
    for block in benchmark_blocks(benchmark, item_key, item_text, block_bytes):
        if shared is not None:
            written = staged(spark, state, "decontamination")
            shared.destroy()
            if before is not None:
                drop_staged(spark, before)
            state = before = written
        shared = spark.sparkContext.broadcast(build_index(block))

        def judge(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for part in slices(batch, "__text"):
                    words = split_words(part.column("__text"), NOT_ALNUM, lower=True)
                    mask, docs, owners = find_windows(words, word_hashes(words), index)
                    old_items, old_spans = part.column("items").to_pylist(), part.column("spans").to_pylist()
                    n_hit = np.array(part.column("n_hit"), dtype=np.int64)
                    edges = np.searchsorted(docs, np.arange(part.num_rows + 1))
                    for i in np.unique(docs).tolist():
                        own = mask[words.first[i] : words.first[i + 1]]
                        for a, b in zip(old_spans[i][::2], old_spans[i][1::2], strict=True):
                            own[a:b] = True
                        turn = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
                        old_spans[i], n_hit[i] = turn.tolist(), int(own.sum())
                        old_items[i] = sorted({*old_items[i], *(x for k in owners[edges[i] : edges[i + 1]].tolist() for x in index.ids[k])})
                    yield pa.RecordBatch.from_arrays(
                        [part.column("__text"), part.column("__row"), pa.array(words.counts().astype(np.int64)), pa.array(n_hit), pa.array(old_items, pa.list_(pa.string())), pa.array(old_spans, pa.list_(pa.int64()))], schema=shape
                    )

        state = state.mapInArrow(judge, state.schema)
    return state.select("__row.*", "n_words", "n_hit", "items", "spans")


def is_contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """At least one word in twenty is hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the whole benchmark."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return contamination(read("documents"), read("benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated")
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, list_slice(w, i, i + least(len(w), 13) - 1) AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
),
lens AS (SELECT DISTINCT n FROM win),
dg AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
),
hit AS (SELECT dg.doc_id, dg.i, dg.n, win.item_id FROM dg JOIN win ON dg.n = win.n AND dg.g = win.g),
pos AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
