"""Entities of texts by a gazetteer: an automaton over all names goes through each text once, whole.

Names are given with their labels. They count as whole words, in their own case; of overlapping finds the leftmost counts, of
those that begin together the longest, and of equal ones the first label. A gazetteer is sent to where the texts are in blocks
of a bounded number of names; finds of several blocks meet by text, as places without the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from filingforge.functions import text as T
from filingforge.staging import staged

#: The labels that count as entities of a density.
LABELS = ("DATE", "GPE", "MONEY", "ORG", "PER")
#: Names of a block.
BLOCK = 200_000
SPANS = "array<struct<start:int,end:int,label:string>>"


def is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


def found_in(automaton: object, text: str) -> list[tuple[int, int, str]]:
    """All finds of whole words: (start, end, label), the first label of each."""
    out = []
    for last, (length, label) in automaton.iter(text):
        start, end = last + 1 - length, last + 1
        if not (start and is_word(text[start - 1]) and is_word(text[start])) and not (end < len(text) and is_word(text[end]) and is_word(text[last])):
            out.append((start, end, label))
    return out


def longest_first(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Finds that don't overlap: the leftmost, of these the longest, of these the first label."""
    out, free = [], 0
    for start, end, label in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
        if start >= free:
            out.append((start, end, label))
            free = end
    return out


def with_entities(texts: DataFrame, gazetteer: DataFrame, *, key: str, text: str = "text", block: int = BLOCK, kept: tuple[str, ...] = ()) -> DataFrame:
    """key and entities (start, end in code points, label) of each text; a null text has none. gazetteer: label, name.

    key names the rows; rows that share one are told apart. kept: narrow columns that stay with their rows.
    """
    names = gazetteer.where(F.length("name") > 0).groupBy("name").agg(F.min("label").alias("label"))
    names = staged(texts.sparkSession, names.withColumn("h", F.xxhash64("name")), "gazetteer")
    blocks = max(1, -(-names.count() // block))
    source = texts.select(F.struct(F.col(key), *kept).alias("key"), F.col(text).alias("text"))
    if blocks > 1:
        source = staged(texts.sparkSession, source.withColumn("row", F.monotonically_increasing_id()), "entity-texts")
    else:
        source = source.withColumn("row", F.monotonically_increasing_id())
    schema = source.select("key", "row", F.lit(None).cast(SPANS).alias("entities")).schema
    parts = [_scanned(source, names.where(F.pmod("h", F.lit(blocks)) == i), schema, alone=blocks == 1) for i in range(blocks)]
    if blocks == 1:
        return parts[0].select("key.*", "entities")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    met = every.groupBy("row").agg(F.first("key").alias("key"), F.flatten(F.collect_list("entities")).alias("entities"))
    return _resolved(met.select("key", "row", "entities"), schema).select("key.*", "entities")


def _scanned(source: DataFrame, names: DataFrame, schema: object, *, alone: bool) -> DataFrame:
    """Finds of one block of names; all of them, unless the block is alone, as what wins is known when all blocks meet."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for r in names.select("name", "label").collect():  # a block of names
        automaton.add_word(r["name"], (len(r["name"]), r["label"]))
    automaton.make_automaton()
    empty, shape = len(automaton) == 0, to_arrow_schema(schema)
    shared = source.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if empty else shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                spans = [found_in(own, t) if t and own is not None else [] for t in part.column("text").to_pylist()]
                yield _batch(part, map(longest_first, spans) if alone else spans, shape)

    return source.mapInArrow(run, schema)


def _resolved(met: DataFrame, schema: object) -> DataFrame:
    shape = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch(batch, (longest_first([(s["start"], s["end"], s["label"]) for s in x]) for x in batch.column("entities").to_pylist()), shape)

    return met.mapInArrow(run, schema)


def _batch(part: pa.RecordBatch, spans: Iterable[list[tuple[int, int, str]]], shape: pa.Schema) -> pa.RecordBatch:
    kept = [[{"start": a, "end": b, "label": c} for a, b, c in x] for x in spans]
    return pa.RecordBatch.from_arrays([part.column("key"), part.column("row"), pa.array(kept, shape.field("entities").type)], schema=shape)


def density(entities: Column, text: Column, labels: tuple[str, ...] = LABELS) -> Column:
    """Entities of the labels by words of the text; 0 without words."""
    return density_of(entities, F.size(T.tokens(text)), labels)


def density_of(entities: Column, words: Column, labels: tuple[str, ...] = LABELS) -> Column:
    """density() of a text of so many words."""
    return T.ratio(F.size(F.filter(entities, lambda e: e["label"].isin(*labels))).cast("double"), words)
