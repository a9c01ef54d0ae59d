"""Exact substring dedup by level-wise doubling.

A window is `length` consecutive words of one document; a word is removed where a window covers it whose words also
start anywhere else. Windows are judged on the input.

Levels are lengths that double up to `length`: 9, 18, 35. Each window has one anchor at the first level, its least
9-gram by hash (the first, where several tie), and one at the second, that 9-gram with the 9 words behind or before it. Equal windows have
equal anchors at the same places, so a window can only be repeated if its anchors are. Only anchors that are repeated
at one length are extended to the next, and only windows whose anchors survived are compared themselves.

Every level works alike. Tasks emit (hash, document, position) rows, at most one row a hash and task: a task sorts its
own rows, and where it holds a hash twice it knows already that all of them are repeated, keeps their answer, and
sends one row with that mark. Rows meet by hash; the answer (document, positions) goes back by document. So a passage
that stands in a third of all documents sends one row a task.

Rows are sorted by hash in the JVM, which spills, and answered as they stream by, so a task's memory doesn't depend on
its partition. Hashes of windows have 96 bits, those of anchors 64; anchors that collide only leave more to compare.
Documents are told apart by 80 bits of a hash of doc_id and text, which also spreads rows that share an id.

Defined results: a null or empty text has no words; a very long text is read whole; a document shorter than a window
keeps all its words; rows that repeat a document are documents of their own, whose windows therefore repeat; a null
doc_id is a value like any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, slices
from .words import WHITE_SPACE, Words, covered, expand, grams, joined, split_words, word_hashes

LENGTH = 35
#: Rows that a task gathers before it looks for repeats among them and sends them on.
GATHERED = 2_000_000
#: Answers that are ordered by document before they are sent on.
ANSWERED = 1 << 19
REPLY = "id long, mark int, at int"


def levels_of(length: int) -> list[int]:
    """Lengths that double up to `length`, from about a quarter of it."""
    return [-(-length // 4), -(-length // 2), length] if length >= 4 else [length]


def first_least(values: np.ndarray, width: int) -> np.ndarray:
    """For every `width` values in a row, the index of their least (the first of equals)."""
    best, size = np.arange(len(values)), 1

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[b] < values[a], b, a)

    while size * 2 <= width:
        best = merge(best[: max(len(best) - size, 0)], best[size:])
        size *= 2
    if size < width:
        best = merge(best[: max(len(best) - (width - size), 0)], best[width - size :])
    return best


def window_starts(words: Words, length: int) -> np.ndarray:
    """Word numbers at which a window of one document starts."""
    total = len(words.starts)
    if total < length:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.arange(length, total + 1) <= words.ends()[: total - length + 1])


class Level:
    """Anchors of windows: where the anchor of each window starts, at each level."""

    def __init__(self, words: Words, length: int):
        self.length, self.sizes = length, levels_of(length)
        self.hashes = word_hashes(words)
        self.windows = window_starts(words, length)
        if len(self.sizes) == 1 or not len(self.windows):
            self.anchor = self.windows
            return
        self.gram = grams(self.hashes, self.sizes[0])
        self.anchor = first_least(self.gram, length - self.sizes[0] + 1)[self.windows]

    def places(self, level: int) -> np.ndarray:
        """The start of each window's anchor at a level; at the last level it is the window's."""
        if level == len(self.sizes) - 1:
            return self.windows
        if level == 0:
            return self.anchor
        # The least gram with what follows it, or where that leaves the window, with what precedes it.
        size = self.sizes[level]
        return np.where(self.anchor <= self.windows + self.length - size, self.anchor, self.anchor + self.sizes[0] - size)

    def values(self, level: int) -> np.ndarray:
        """Hashes of all grams of a level's length."""
        return self.gram if level == 0 and len(self.sizes) > 1 else grams(self.hashes, self.sizes[level])


def _distinct_rows(hashes: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash, group starts and group sizes of equal (hash, more)."""
    order = np.lexsort((more, hashes))
    h, m = hashes[order], more[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (m[1:] != m[:-1])])) if len(h) else np.zeros(0, np.int64)
    return order, new, np.diff(np.concatenate([new, [len(h)]]))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a list column in a row, and how many each list has; null lists have none."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.array(column.flatten(), dtype=np.int64), sizes


def _packed(ids: np.ndarray, tails: np.ndarray) -> tuple[list, list, list]:
    """Positions by document: id, mark and packed positions."""
    mark, at = ((tails >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int32), (tails & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    order = np.lexsort((at, mark, ids))
    ids, mark, at = ids[order], mark[order], at[order]
    cut = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (mark[1:] != mark[:-1])])) if len(ids) else np.zeros(0, np.int64)
    ends = np.concatenate([cut[1:], [len(ids)]]).tolist() if len(cut) else []
    return ids[cut].tolist(), mark[cut].tolist(), [at[a:b].tobytes() for a, b in zip(cut.tolist(), ends, strict=True)]


_ROW = "hash long, tail long, more int, id long, twice boolean, at binary"


def _extra(tails: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The hash bits beyond the first 64: 16 of the tail and 16 more."""
    return (tails >> np.uint64(48) << np.uint64(16)) | more.astype(np.uint64)


def _question(shape: pa.Schema, hashes: np.ndarray, tails: np.ndarray, more: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows to send: one for each hash; and the answers known already, under random hashes, with positions packed."""
    order, new, count = _distinct_rows(hashes, _extra(tails, more))
    lead = np.sort(order[new])  # in the order of documents, whose ids then repeat and take little room in the shuffle
    repeated = np.zeros(len(hashes), bool)
    repeated[order[new]] = count > 1
    yield pa.RecordBatch.from_arrays(
        [pa.array(hashes[lead].view(np.int64)), pa.array(tails[lead].view(np.int64)), pa.array(more[lead]), pa.array(ids[lead]), pa.array(repeated[lead]), pa.nulls(len(lead), pa.binary())], schema=shape
    )
    rest = np.delete(order, new)
    if len(rest):
        who, mark, at = _packed(ids[rest], tails[rest])
        spread = joined(np.array(who, np.int64).view(np.uint64), np.array(mark, np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(np.array(mark, np.int64) << 32), pa.array(np.zeros(len(who), np.int32)), pa.array(who, pa.int64()), pa.array(np.ones(len(who), bool)), pa.array(at, pa.binary())], schema=shape)


def ask(docs: DataFrame, level: int, length: int) -> DataFrame:
    """(id, mark, at): the positions of each document at which a level's anchors, or at last windows, are repeated.

    docs: id, mark, text and, above the first level, `at`: the anchors that survived the level below.
    """
    row_shape, reply_shape = arrow_schema(_ROW), arrow_schema(REPLY)
    last = level == len(levels_of(length)) - 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[tuple[np.ndarray, ...]] = []
        held = 0
        for batch in batches:
            for part in slices(batch, "text"):
                words = split_words(part.column("text"), WHITE_SPACE)
                state = Level(words, length)
                if not len(state.windows):
                    continue
                use = np.ones(len(state.windows), bool)
                if level:
                    alive = np.zeros(len(words.starts), bool)
                    flat, sizes = _lists(part.column("at"))
                    alive[np.repeat(words.first[:-1], sizes) + flat] = True
                    use = alive[state.places(level - 1)]
                place = np.unique(state.places(level)[use])
                doc = np.searchsorted(words.first, place, "right") - 1
                ids = np.array(part.column("id"), dtype=np.int64)[doc]
                mark = np.array(part.column("mark"), dtype=np.int64)[doc].astype(np.uint64)
                value = state.values(level)[place]
                second = grams(word_hashes(words, 77), length)[place] if last else np.zeros(len(place), np.uint64)
                tail = (second >> np.uint64(48) << np.uint64(48)) | (mark << np.uint64(32)) | (place - words.first[doc]).astype(np.uint64)
                gathered.append((value, tail, (second & np.uint64(0xFFFF)).astype(np.int32), ids))
                held += len(place)
                if held >= GATHERED:
                    yield from _question(row_shape, *(np.concatenate(x) for x in zip(*gathered, strict=True)))
                    gathered, held = [], 0
        if held:
            yield from _question(row_shape, *(np.concatenate(x) for x in zip(*gathered, strict=True)))

    def reply(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        """A row a position: as many whatever the number of tasks. By document, so that the next step combines them well."""
        tails, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((tails & np.uint64(0xFFFFFFFFFFFF), ids))
        mark = ((tails[order] >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(ids[order]), pa.array(mark), pa.array((tails[order] & np.uint64(0xFFFFFFFF)).astype(np.int32))], schema=reply_shape)

    def repeated(rows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Tails and ids of the rows whose hash isn't alone."""
        hashes, tails, more, ids, twice = rows
        order, new, count = _distinct_rows(hashes, _extra(tails.view(np.uint64), more))
        if not len(order):
            return tails.view(np.uint64), ids
        again = (count > 1) | np.logical_or.reduceat(twice[order], new)
        found = order[np.repeat(again, count)]
        return tails[found].view(np.uint64), ids[found]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by hash; those of the last hash of a batch wait for the next one."""
        waiting: tuple[np.ndarray, ...] | None = None
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            known = batch.filter(batch.column("at").is_valid())
            if known.num_rows:
                sizes = pc.binary_length(known.column("at")).to_numpy(zero_copy_only=False) // 4
                mark = (np.array(known.column("tail"), dtype=np.int64) >> 32).astype(np.int32)
                at = np.frombuffer(b"".join(known.column("at").to_pylist()), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(known.column("id")), sizes)), pa.array(np.repeat(mark, sizes)), pa.array(at)], schema=reply_shape)
                batch = batch.filter(batch.column("at").is_null())
            if not batch.num_rows:
                continue
            rows = tuple(np.array(batch.column(c)) for c in ("hash", "tail", "more", "id", "twice"))
            if waiting is not None:
                rows = tuple(np.concatenate(x) for x in zip(waiting, rows, strict=True))
            cut = int(np.searchsorted(rows[0], rows[0][-1], "left"))
            waiting = tuple(x[cut:] for x in rows)
            found.append(repeated(tuple(x[:cut] for x in rows)))
            held += len(found[-1][1])
            if held >= ANSWERED:
                yield reply(found)
                found, held = [], 0
        if waiting is not None:
            found.append(repeated(waiting))
        if any(len(ids) for _, ids in found):
            yield reply(found)

    asked = docs.mapInArrow(emit, _ROW)
    return asked.repartition(F.col("hash")).sortWithinPartitions("hash").mapInArrow(answer, REPLY)


def gathered_by_document(replies: DataFrame) -> DataFrame:
    """One row a document, with its positions; they are combined before the shuffle too."""
    return replies.groupBy("id", "mark").agg(F.collect_list("at").alias("at"))


def with_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, id, mark, text; id and mark: 64 and 16 bits of hashes of key and text.

    id and mark can't be null, so inner and outer joins on them share one exchange of the texts.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    own = F.xxhash64(F.col(key), whole, F.col(text).isNull())
    return docs.select(F.col(key).alias("key"), own.alias("id"), F.xxhash64(whole, F.lit(78)).bitwiseAND(F.lit(65535)).cast("int").alias("mark"), F.col(text).alias("text"))


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """key, n_words, n_removed and kept, the words that stay, joined by one space (UTF-8 binary)."""
    rows = with_rows(docs, key, text)
    moved = rows.repartition("id", "mark")
    found = None
    for level in range(len(levels_of(length))):
        # All columns of `moved` are read each time, so that its one exchange serves every level.
        source = rows if found is None else moved.join(found, ["id", "mark"])
        found = gathered_by_document(ask(source, level, length))
    key_type = rows.schema["key"].dataType.simpleString()
    schema = f"key {key_type}, n_words long, n_removed long, kept binary"
    shape = arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts, removed, kept = [], [], []
                flat, sizes = _lists(part.column("at"))
                for content, at in zip(part.column("text").to_pylist(), np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
                    words = (content or "").encode().split()
                    if len(at):
                        starts = np.unique(at)
                        gone = covered(len(words), starts, starts + length)
                        stay = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    else:
                        stay = words
                    counts.append(len(words))
                    removed.append(len(words) - len(stay))
                    kept.append(b" ".join(stay))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], schema=shape)

    return moved.join(found, ["id", "mark"], "left").mapInArrow(cut, schema).withColumnRenamed("key", key)


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of 35 words and more removed from all documents."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT r, list(p) AS ps FROM (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM win JOIN rep USING (h)) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(ps, p)), lambda p: w[p]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (r)
"""
