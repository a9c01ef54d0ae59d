"""Near-duplicates by an exact rule: shingle sets of a Jaccard similarity of 0.8 or more, whatever their fingerprints.

Equal shingle sets are one class. Two similar sets of n and m shingles differ in at most (n + m) / 9 of them. Candidates
come from three places:

* SimHash links of operator 3 (pigeonring over the bits of fingerprints);
* the same principle over the sets themselves: a set is dealt to one more segment than may differ, by the hash of each
  shingle, and filed under the hash of each segment's content. One segment at least is untouched by the differences. Sizes
  are cut into classes, and similar sets are of one class or of neighbours, so a set is filed by its own class and, where
  a partner can be there, by the next. A passage that many texts share is spread over all segments, so these texts rarely
  meet;
* sets of fewer than 14 shingles, which differ in two at most, are filed under what is left without any two, one or none.

A segment can be empty, and is then no key. Sets of fewer than 64 shingles are dealt twice, so that some untouched segment
isn't; what remains is a chance of less than one in a thousand to miss a pair of 14 shingles just at the limit, and of
less than one in a million from 40 shingles on.

Candidates are pruned by the parities of 512 buckets of shingles, which differ at most as often as the sets do, then by
those of 8,192 (long texts fill the narrower ones), and then checked by their whole shingle sets, in two rounds. The first takes SimHash links and, in each bucket, neighbours by
size: a large group becomes one component with few pairs. The second searches each bucket whose classes are still in
different components for pairs of near parities; a bucket that many share is dealt out in blocks, each two of which meet
in one task, and only pairs that pass are sent on. Texts of candidates are found by a bitmap of fixed size.

Defined results: those of operator 3 (null texts and texts without words are one class; a text with fewer words than a
shingle is one shingle; rows that repeat a key are rows of their own; an empty table gives an empty result).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, drop_staged, slices, small_batches, staged
from .components import connected_components
from .simhash import near_links
from .words import M1, WHITE_SPACE, expand, grams, mixed, split_words, word_hashes

#: Bits of the bitmap of candidates' texts, and texts or classes that a task remembers so as to send them once.
BITMAP, REMEMBERED = 1 << 24, 1_000_000
#: Least size of sets that are filed by segments, and below which they are dealt twice.
RING, TWICE = 14, 64
#: 64-bit words of the parities, and of the wider ones that candidates get.
SKETCH, WIDE = 8, 128
#: Bytes of text worked on at once, and texts whose wide parities are counted at once (in 64 * WIDE numbers each).
SLICE, WIDE_TEXTS = 1 << 19, 100
#: Classes of one block of a bucket, and rows of buckets that one task searches, about.
BLOCK, TASK_ROWS = 2_000, 20_000


def _class_bounds() -> np.ndarray:
    bounds = [RING]
    while bounds[-1] < 1 << 40:
        bounds.append(bounds[-1] * 25 // 16 + 1)
    return np.array(bounds)


#: Least size of each size class.
BOUNDS = _class_bounds()


def similar(common: Column, n: Column, m: Column) -> Column:
    """Whether sets of n and m shingles with that many in common have a Jaccard similarity of 0.8 or more."""
    return common * 9 >= (n + m) * 4


def shingle_runs(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of every text in order, repeats included, and the number of each text's first one."""
    words = split_words(column, WHITE_SPACE, lower=True)
    hashes, counts = word_hashes(words), words.counts()
    sizes = np.where(counts >= width, counts - width + 1, counts > 0)
    first = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(first[-1]), np.uint64)
    long = np.flatnonzero(counts >= width)
    out[expand(first[long], sizes[long])] = grams(hashes, width)[expand(words.first[long], sizes[long])]
    for c in range(1, width):
        short = np.flatnonzero(counts == c)
        if len(short):
            out[first[short]] = mixed(grams(hashes, c)[words.first[short]] + np.uint64(c))
    return out, first


def distinct_runs(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each text, and the text of each."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, owner))
    hashes = hashes[order]  # owners stay as they were
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], owner[new]


def sums_of(values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2^64 of values by group; groups don't fall."""
    out = np.zeros(n, np.uint64)
    if len(values):
        starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        out[groups[starts]] = np.add.reduceat(values, starts)
    return out


def class_ids(hashes: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The class of each set: a hash of its content, 0 for the empty one."""
    return np.where(sizes > 0, mixed(sums_of(mixed(hashes * M1), owner, len(sizes)) + sizes.astype(np.uint64)), np.uint64(0))


def run_fingerprints(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Fingerprints of operator 3 over these hashes: a bit is 1 where it is in over half of a text's hashes."""
    out = np.zeros(len(first) - 1, np.uint64)
    filled = np.flatnonzero(np.diff(first))
    if len(filled):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, first[filled], axis=0, dtype=np.int32)
        out[filled] = np.packbits(ones * 2 > np.diff(first)[filled][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def parities(hashes: np.ndarray, owner: np.ndarray, n: int, words: int = SKETCH) -> np.ndarray:
    """For each set, the parities of its shingles in 64 * words buckets, as words; sets differ in no fewer shingles."""
    bits = 64 * words
    counts = np.bincount(owner * bits + (hashes >> np.uint64(40)).astype(np.int64) % bits, minlength=n * bits)
    return np.packbits((counts & 1).astype(np.uint8).reshape(n, bits), axis=1, bitorder="little").view("<u8")


def ring_keys(hashes: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the segments of each set, and the set of each key."""
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for step, seed in ((0, 0), (1, 0), (0, 1), (1, 1)):
        number = np.searchsorted(BOUNDS, sizes, "right") - 1 + step
        at = np.maximum(number, 0)
        use = (number >= 0) & (5 * sizes >= 4 * BOUNDS[at]) & ((seed == 0) | (BOUNDS[at] < TWICE))
        if not use.any():
            continue
        segments = np.where(use, 2 * (BOUNDS[at + 1] - 1) // 9 + 1, 0)
        base = np.cumsum(segments) - segments
        inside = use[owner]
        own, value = owner[inside], hashes[inside]
        salt = (2 * number + seed).astype(np.uint64)
        dealt = mixed(value ^ ((salt[own] + np.uint64(1)) * M1)) % segments[own].astype(np.uint64)
        slot = base[own] + dealt.astype(np.int64)
        order = np.argsort(slot, kind="stable")
        slot, own, value = slot[order], own[order], value[order]
        starts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        content = np.add.reduceat(mixed(value + M1), starts)
        place = (slot[starts] - base[own[starts]]).astype(np.uint64) * np.uint64(512) + salt[own[starts]]
        keys.append(mixed(content ^ mixed(place + np.uint64(1))))
        owners.append(own[starts])
    return np.concatenate(keys), np.concatenate(owners)


def small_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of a set of fewer than RING shingles: what is left without none, one or two of them, where that many may differ."""
    values = mixed(hashes + M1)
    whole, n = values.sum(dtype=np.uint64), len(values)
    keys = [np.array([whole])] if n >= 4 else []
    if n >= 5:
        keys.append(whole - values)
    if n >= 10:
        i, j = np.triu_indices(n, 1)
        keys.append(whole - values[i] - values[j])
    return mixed(np.concatenate(keys) ^ M1) if keys else np.zeros(0, np.uint64)


def described(docs: DataFrame, width: int) -> DataFrame:
    """A row for each row of docs (key, text): key, at (of the text), class, fp, n (shingles), sketch."""
    source = docs.select("key", F.xxhash64("text").alias("at"), "text")
    schema = f"key {source.schema['key'].dataType.simpleString()}, at long, class long, fp long, n long, sketch array<long>"
    shape = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                runs, first = shingle_runs(part.column("text"), width)
                hashes, owner = distinct_runs(runs, first)
                n = part.num_rows
                sizes = np.bincount(owner, minlength=n)
                signed = [pa.array(x.view(np.int64)) for x in (class_ids(hashes, owner, sizes), run_fingerprints(runs, first))]
                sketch = list_column(parities(hashes, owner, n).ravel(), np.arange(n + 1) * SKETCH, shape.field("sketch"))
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("at"), *signed, pa.array(sizes), sketch], schema=shape)

    return source.mapInArrow(run, schema)


def filed(docs: DataFrame, width: int) -> DataFrame:
    """(bucket, class, n) of each class. A task files a class once, so copies don't fill buckets."""
    schema = "bucket long, class long, n long"
    shape = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                hashes, owner = distinct_runs(*shingle_runs(part.column("text"), width))
                sizes = np.bincount(owner, minlength=part.num_rows)
                classes = class_ids(hashes, owner, sizes)
                fresh = np.zeros(len(sizes), bool)
                if len(seen) > REMEMBERED:
                    seen.clear()
                for i, c in enumerate(classes.tolist()):
                    if sizes[i] and c not in seen:
                        seen.add(c)
                        fresh[i] = True
                inside = fresh[owner]
                hashes, owner = hashes[inside], owner[inside]
                keys, owners = ring_keys(hashes, owner, np.where(fresh, sizes, 0))
                begins = np.searchsorted(owner, np.arange(len(sizes) + 1))
                small = np.flatnonzero(fresh & (sizes < RING))
                few = [small_keys(hashes[begins[i] : begins[i + 1]]) for i in small.tolist()]
                bucket = np.concatenate([keys, *few])
                who = np.concatenate([owners, np.repeat(small, [len(x) for x in few])])
                yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(classes[who].view(np.int64)), pa.array(sizes[who])], schema=shape)

    return docs.select("text").mapInArrow(run, schema)


def list_column(values: np.ndarray, ends: np.ndarray, field: pa.Field) -> pa.Array:
    """A list column of longs; ends: 0 and where each list ends."""
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.view(np.int64))).cast(field.type)


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """class, n, wide (parities) and shingles, the distinct hashes, of rows class and text."""
    schema = "class long, n long, wide array<long>, shingles array<long>"
    shape = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                for at in range(0, part.num_rows, WIDE_TEXTS):
                    piece = part.slice(at, WIDE_TEXTS)
                    hashes, owner = distinct_runs(*shingle_runs(piece.column("text"), width))
                    sizes = np.bincount(owner, minlength=piece.num_rows)
                    wide = list_column(parities(hashes, owner, piece.num_rows, WIDE).ravel(), np.arange(piece.num_rows + 1) * WIDE, shape.field("wide"))
                    sets = list_column(hashes, np.concatenate([[0], np.cumsum(sizes)]), shape.field("shingles"))
                    yield pa.RecordBatch.from_arrays([piece.column("class"), pa.array(sizes), wide, sets], schema=shape)

    return texts.select("class", "text").mapInArrow(run, schema)


def among(docs: DataFrame, ats: DataFrame) -> DataFrame:
    """Rows of docs (at, ...) whose `at` is in ats, and a few more: a bitmap of fixed size decides. A task sends an `at` once."""
    words = ats.select(F.pmod("at", F.lit(BITMAP)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(bit & 63 AS INT)))").alias("bits")).toArrow()
    bitmap = np.zeros(BITMAP >> 6, np.uint64)
    bitmap[np.array(words.column("word"), np.int64)] = np.array(words.column("bits"), np.int64).view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            at = np.array(batch.column("at"), np.int64)
            bit = at % BITMAP
            keep = (shared.value[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            if len(seen) > REMEMBERED:
                seen.clear()
            for i in np.flatnonzero(keep).tolist():
                keep[i] = int(at[i]) not in seen
                seen.add(int(at[i]))
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def checked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """Those of the distinct pairs (a, b) of classes whose shingle sets are similar."""
    spark = docs.sparkSession
    pairs = pairs.where("a <> b")

    def near(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
        """Pairs whose parities differ no more than similar sets may."""
        side = lambda name: table.select(F.col("class").alias(name), F.struct("n", F.col(column).alias("bits")).alias(f"of_{name}"))
        apart = F.expr("aggregate(zip_with(of_a.bits, of_b.bits, (x, y) -> bit_count(x ^ y)), 0, (sum, x) -> sum + x)")
        return pairs.join(side("a"), "a").join(side("b"), "b").where(apart * 9 <= F.col("of_a.n") + F.col("of_b.n")).select("a", "b")

    pairs = staged(spark, near(pairs, classes, "sketch"), "similar-pairs")
    involved = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    ats = staged(spark, classes.join(involved, "class").select("class", "at"), "similar-texts")
    texts = among(docs.select(F.xxhash64("text").alias("at"), "text"), ats).join(ats, "at").dropDuplicates(["class"])
    all_sets = staged(spark, shingle_sets(texts, width), "similar-sets")
    nearer = staged(spark, near(pairs, all_sets, "wide"), "similar-nearer")  # long texts fill the narrow parities; whole sets move for few
    sets = among(all_sets.select(F.col("class").alias("at"), "shingles"), nearer.select(F.col("a").alias("at")).union(nearer.select("b"))).withColumnRenamed("at", "class")
    both = nearer.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("y")), "b")
    links = staged(spark, both.where(similar(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))).select("a", "b"), "similar-links")
    for table in (pairs, ats, all_sets, nearer):  # the sets are about as large as the texts
        drop_staged(spark, table)
    return links


def near_pairs(placed: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of classes of one bucket and different parts whose parities are near. placed: bucket, class, part, n, sketch."""
    spark = placed.sparkSession
    counts = placed.groupBy("bucket").agg(F.count("*").alias("rows"), F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high")
    counts = staged(spark, counts.select("bucket", "rows", F.ceil(F.col("rows") / block).cast("int").alias("blocks")), "similar-mixed")
    tasks = max(1, -(-(counts.agg(F.sum(F.col("rows") * F.col("blocks"))).first()[0] or 0) // TASK_ROWS))
    own = F.pmod(F.xxhash64("class"), F.col("blocks").cast("long")).cast("int")
    met = placed.join(counts.drop("rows"), "bucket").withColumn("own", own).select(
        "bucket", "class", "part", "n", "sketch",
        F.explode(F.expr("CASE WHEN blocks = 1 THEN array(0) ELSE transform(sequence(0, blocks - 1), j -> least(own, j) * blocks + greatest(own, j)) END")).alias("pair"),
    )
    shape = arrow_schema("a long, b long")

    def pairs_of(group: np.ndarray, cls: np.ndarray, part: np.ndarray, n: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
        """Near pairs of rows that lie in the same group; rows are sorted by group and n. Each step compares rows farther apart."""
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at, step = np.arange(len(cls)), 0
        while len(at):
            step += 1
            at = at[at + step < len(cls)]
            at = at[(group[at] == group[at + step]) & (n[at] * 5 >= n[at + step] * 4)]
            two = at[part[at] != part[at + step]]
            apart = np.bitwise_count(sketch[two] ^ sketch[two + step]).sum(axis=1, dtype=np.int64)
            two = two[apart * 9 <= n[two] + n[two + step]]
            a.append(cls[two])
            b.append(cls[two + step])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=shape)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted; those of the last group of a batch wait for the next one."""
        waiting = None
        for batch in batches:
            if not batch.num_rows:
                continue
            sketch = np.array(batch.column("sketch").flatten(), dtype=np.int64).view(np.uint64).reshape(batch.num_rows, SKETCH)
            rows = [*(np.array(batch.column(c), dtype=np.int64) for c in ("bucket", "pair", "class", "part", "n")), sketch]
            if waiting is not None:
                rows = [np.concatenate(x) for x in zip(waiting, rows, strict=True)]
            new = np.concatenate([[True], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])])
            cut = int(np.flatnonzero(new)[-1])
            waiting = [x[cut:] for x in rows]
            if cut:
                yield pairs_of(np.cumsum(new)[:cut], *(x[:cut] for x in rows[2:]))
        if waiting is not None:
            yield pairs_of(np.zeros(len(waiting[0]), np.int64), *waiting[2:])

    return met.repartition(tasks, "bucket", "pair").sortWithinPartitions("bucket", "pair", "n", "class").mapInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, distance: int = 3) -> DataFrame:
    """A row for each row of docs: key, component: the least key reachable over pairs of a similarity of 0.8 or more."""
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = staged(spark, described(source, width), "similar-rows")
    classes = rows.groupBy("class").agg(F.min("key").alias("least"), F.min(F.struct("at", "fp", "n", "sketch")).alias("first"))
    classes = staged(spark, classes.select("class", "least", "first.*"), "similar-classes")

    by_size = Window.partitionBy("bucket").orderBy("n", "class")
    met = filed(source, width).withColumns({"before": F.lag("class").over(by_size), "before_n": F.lag("n").over(by_size), "after": F.lead("class").over(by_size)})
    shared = staged(spark, met.where("before <> class OR after <> class").drop("after"), "similar-buckets")
    pair = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    neighbours = shared.where("before <> class AND before_n * 5 >= n * 4").select(F.col("before").alias("a"), F.col("class").alias("b"))
    by_fp = staged(spark, classes.groupBy("fp").agg(F.min("class").alias("class")), "similar-fps")
    end = lambda name: by_fp.select(F.col("fp").alias(f"fp_{name}"), F.col("class").alias(name))
    near = near_links(by_fp, distance=distance).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b")).join(end("a"), "fp_a").join(end("b"), "fp_b").select("a", "b")
    same = classes.select("fp", F.col("class").alias("b")).join(end("a"), F.col("fp") == F.col("fp_a")).select("a", "b")
    links = checked(neighbours.union(near).union(same).select(*pair).distinct(), source, classes, width)

    parts = staged(spark, connected_components(links).withColumnsRenamed({"node": "class", "component": "part"}), "similar-parts")
    mixed_up = shared.select("bucket", "class").distinct().join(parts, "class", "left").withColumn("part", F.coalesce("part", "class"))
    open_buckets = mixed_up.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("bucket")
    placed = staged(spark, mixed_up.join(open_buckets, "bucket").join(classes.select("class", "n", "sketch"), "class"), "similar-placed")
    more = checked(near_pairs(placed).select(*pair).distinct(), source, classes, width)

    parts = connected_components(links.union(more)).withColumnRenamed("node", "class")
    named = staged(spark, classes.select("class", "least").join(parts, "class", "left").withColumn("component", F.coalesce("component", "class")), "similar-named")
    least = named.groupBy("component").agg(F.min("least").alias("first"))
    by_class = staged(spark, named.join(least, "component").select("class", F.col("first").alias("component")), "similar-components")
    return rows.select("key", "class").join(by_class, "class").select(F.col("key").alias(key), "component")
