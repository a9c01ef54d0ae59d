"""A Merkle manifest of a dataset: one root for all rows, a proof for each.

Rows are leaves, in the order of their ids within a group; pairs of neighbours are hashed to a subroot for each group, and
the subroots, in the order of the groups, likewise to one root. Digests are lowercase hex SHA-256 of inputs written one
behind the other, digests as hex text.

Leaves are numbered by one range sort of narrow rows. Aligned blocks of leaves are reduced in tasks of their own, and each
row leaves its block with its siblings there. What is left is a block's top, a table smaller than the rows by a block: the
driver builds the trees above, whose size has a bound, and broadcasts the siblings on the way up (the suffix of a proof);
tops beyond that bound are reduced by blocks once more. Groups of one block need no tree above, so the driver sees at most
two tops for each full block, however many groups there are. Subroots take the same way, as leaves of one group. Executors
finish the proofs, and fold each row's leaf along its own.

Defined results: any value may be null and is then `-`; a null group comes first, null ids are first in their group, rows of
one id are ordered by their leaves; repeated rows are leaves of their own; very long texts are hashed where they are and go
no further; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingforge.operators.validation import ranked

from .common import arrow_schema, staged

#: Leaves of a block: at least 2 to the first, and more for large tables, up to the second.
BLOCK_BITS = (10, 16)
#: Tops that the driver takes at once.
TOPS = 4096

#: A step on the way up: the side of the sibling, `<` or `>`, and its digest; or `=`, where a node is hashed alone.
SIDES, ALONE = ("<", ">"), "="


def field(value: Column, kind: T.DataType) -> Column:
    """A value as hashed: `-` if null, else its UTF-8 byte count, `:` and the value."""
    text = value if isinstance(kind, T.StringType) else value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(rows: DataFrame, columns: Sequence[str], **changed: Column) -> Column:
    """The leaf of a row: the hash of its columns, some with other values."""
    parts = [field(changed.get(c, F.col(f"`{c}`")), rows.schema[c].dataType) for c in columns]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def joined(nodes: Sequence[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def reduced(level: list[str], height: int | None = None) -> tuple[str, list[list[str]]]:
    """The top above a level of nodes and each one's steps to it; to a height, or else until one node is left."""
    paths: list[list[str]] = [[] for _ in level]
    step = 0
    while step < height if height is not None else len(level) > 1:
        for i, path in enumerate(paths):
            at = i >> step
            other = at ^ 1
            path.append(SIDES[other > at] + level[other] if other < len(level) else ALONE)
        level = [joined(level[i : i + 2]) for i in range(0, len(level), 2)]
        step += 1
    return level[0], paths


def bounded(table: DataFrame) -> DataFrame:
    """A small table for a join: broadcast where it has few rows, else left to the optimiser."""
    return F.broadcast(table) if table.count() <= 16 * TOPS else table


def trees(nodes: DataFrame, *, block_bits: tuple[int, int] = BLOCK_BITS, tops: int = TOPS) -> tuple[DataFrame, DataFrame]:
    """nodes: tree (string), place (its number in the tree, long), size (nodes of the tree, long), digest, and other columns.

    The nodes with path, the steps from the node to the top of its tree; and a row (tree, top) for each tree.
    Blocks are dealt out twice, for their tops and for the paths, so that no path has to be written.
    """
    rows = nodes.count()
    bits = block_bits[0]
    while bits < block_bits[1] and rows >> bits > tops:
        bits += 1
    blocks = nodes.withColumn("block", F.shiftright("place", bits)).groupBy("tree", "block")
    schema = T.StructType([*(f for f in nodes.schema.fields if f.name != "size"), T.StructField("block", T.LongType()), T.StructField("path", T.ArrayType(T.StringType()))])
    shape, top_shape = arrow_schema(schema), arrow_schema("tree string, block long, size long, digest string")

    def climbed(table: pa.Table) -> tuple[str, list[list[str]]]:
        # A tree of one block ends where one node is left; in others the last block climbs as high as the rest.
        return reduced(table.column("digest").to_pylist(), bits if table.column("size")[0].as_py() > 1 << bits else None)

    def top(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        first = table.slice(0, 1)
        return pa.Table.from_arrays([first.column("tree"), pa.array([first.column("place")[0].as_py() >> bits], pa.int64()), first.column("size"), pa.array([climbed(table)[0]], pa.string())], schema=top_shape)

    def paths(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        block = pa.array([table.column("place")[0].as_py() >> bits] * table.num_rows, pa.int64())
        found = table.select([n for n in shape.names if n not in ("block", "path")])
        return found.append_column("block", block).append_column("path", pa.array(climbed(table)[1], pa.list_(pa.string()))).cast(shape)

    each = staged(nodes.sparkSession, blocks.applyInArrow(top, "tree string, block long, size long, digest string"), "merkle-tops")
    single = F.col("size") <= 1 << bits
    several = each.where(~single).select("tree", F.col("block").alias("place"), F.shiftright(F.col("size") + (1 << bits) - 1, bits).alias("size"), "digest")
    if several.count() > tops:
        upper, crowns = trees(several, block_bits=block_bits, tops=tops)
        suffixes = upper.select("tree", F.col("place").alias("block"), F.col("path").alias("suffix"))
    else:
        suffixes, crowns = map(F.broadcast, driver_trees(several))
    found = blocks.applyInArrow(paths, schema).join(suffixes, ["tree", "block"], "left")
    found = found.withColumn("path", F.concat("path", F.coalesce("suffix", F.array().cast("array<string>")))).drop("block", "suffix")
    return found, each.where(single).select("tree", F.col("digest").alias("top")).union(crowns.select("tree", "top"))


def driver_trees(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees of few nodes in all, built here: a row (tree, block, suffix) for each node and a row (tree, top) for each tree."""
    spark, levels = nodes.sparkSession, {}
    for row in nodes.orderBy("tree", "place").collect():  # at most TOPS rows
        levels.setdefault(row["tree"], []).append(row["digest"])
    suffixes, crowns = [], []
    for tree, level in levels.items():
        top, paths = reduced(level)
        crowns.append((tree, top))
        suffixes.extend((tree, i, path) for i, path in enumerate(paths))
    return spark.createDataFrame(suffixes, "tree string, block long, suffix array<string>"), spark.createDataFrame(crowns, "tree string, top string")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf gives along a path."""

    def up(node: Column, sibling: Column) -> Column:
        other = F.substring(sibling, 2, 64)
        return F.sha2(F.when(sibling.startswith(SIDES[0]), F.concat(other, node)).otherwise(F.concat(node, other)).cast("binary"), 256)

    return F.aggregate(path, start, up)


def manifest(rows: DataFrame, *, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", group: str = "lang", changed: dict[str, Column] | None = None, block_bits: tuple[int, int] = BLOCK_BITS, tops: int = TOPS) -> DataFrame:
    """key, leaf, subroot, root, path (the steps from the leaf to the root), given (another leaf where the row changed).

    changed: columns by name as they are when rows are checked against the manifest; where one differs, given is the leaf of
    the row as it is then, else null.
    """
    spark = rows.sparkSession
    differs = [~F.col(f"`{c}`").eqNullSafe(value) for c, value in (changed or {}).items()]
    given = F.when(F.greatest(*differs, F.lit(False)), leaf(rows, columns, **(changed or {})))
    # Groups by name, the null one (-) before all others (=name), in the order of their bytes.
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("-"))
    narrow = staged(spark, rows.select(F.col(f"`{key}`").alias("key"), tree.alias("tree"), leaf(rows, columns).alias("digest"), given.alias("given")), "merkle-leaves")
    numbered = ranked(narrow, ["tree", "key", "digest"])
    sizes = staged(spark, numbered.groupBy("tree").agg(F.min("rank0").alias("first"), F.count("*").alias("size")), "merkle-groups")
    placed = numbered.join(bounded(sizes), "tree").select("tree", "key", "digest", "given", (F.col("rank0") - F.col("first")).alias("place"), "size")
    lower, subroots = trees(placed, block_bits=block_bits, tops=tops)
    subroots = ranked(subroots, "tree").select(F.lit("").alias("tree"), F.col("rank0").alias("place"), F.lit(sizes.count()).cast("long").alias("size"), F.col("top").alias("digest"), F.col("tree").alias("of"))
    upper, root = trees(subroots, block_bits=block_bits, tops=tops)
    upper = staged(spark, upper.join(F.broadcast(root), "tree").select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), F.col("path").alias("rest"), F.col("top").alias("root")), "merkle-subroots")
    found = lower.join(bounded(upper), "tree")
    return found.select("key", F.col("digest").alias("leaf"), "subroot", "root", F.concat("path", "rest").alias("path"), "given").withColumnRenamed("key", key)


def verified(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified of a manifest's rows."""
    siblings = F.array_join(F.transform("path", lambda s: F.substring(s, 2, 64)), "")
    folds = found.withColumn("folded_root", folded(F.coalesce("given", "leaf"), F.col("path")))
    return folds.select(key, "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, checked against a copy in which some rows were tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return verified(manifest(docs, changed={"n_chars": more}))


ORACLE_SQL = """
WITH RECURSIVE d AS (
  SELECT *, CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT) % 7 = 0 THEN 1 ELSE 0 END AS more
  FROM documents
),
f AS (
  SELECT doc_id, lang, more, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS chars, coalesce(strlen(CAST(n_chars + more AS VARCHAR)) || ':' || (n_chars + more), '-') AS given_chars, coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM d
),
l AS (SELECT doc_id, lang, sha256(head || chars || tail) AS leaf, sha256(head || given_chars || tail) AS given FROM f),
p AS (SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM l),
low(lang, level, place, n, h) AS (
  SELECT lang, 0, place, n, leaf FROM p
  UNION ALL
  SELECT lang, level + 1, place // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM low WHERE n > 1 GROUP BY lang, level, place // 2
),
s AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1),
up(level, place, n, h) AS (
  SELECT 0, place, n, h FROM s
  UNION ALL
  SELECT level + 1, place // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM up WHERE n > 1 GROUP BY level, place // 2
),
steps AS (
  SELECT p.id, own.level, other.place < own.place AS before, coalesce(other.h, '') AS h FROM p JOIN low own ON own.lang IS NOT DISTINCT FROM p.lang AND own.place = p.place >> own.level AND own.n > 1
    LEFT JOIN low other ON other.lang IS NOT DISTINCT FROM own.lang AND other.level = own.level AND other.place = xor(own.place, 1)
  UNION ALL
  SELECT p.id, 100 + own.level, other.place < own.place, coalesce(other.h, '') FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang JOIN up own ON own.place = s.place >> own.level AND own.n > 1
    LEFT JOIN up other ON other.level = own.level AND other.place = xor(own.place, 1)
),
path AS (SELECT id, list({'before': before, 'h': h} ORDER BY level) AS path, string_agg(h, '' ORDER BY level) AS joined FROM steps GROUP BY id),
r AS (SELECT h AS root FROM up WHERE n = 1),
done AS (
  SELECT p.doc_id, p.leaf, s.h AS subroot, r.root, sha256(coalesce(path.joined, '')) AS proof_sha256,
    list_reduce(list_prepend({'before': false, 'h': p.given}, coalesce(path.path, [])),
      lambda a, b: {'before': false, 'h': CASE WHEN b.before THEN sha256(b.h || a.h) ELSE sha256(a.h || b.h) END}).h AS folded_root
  FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang CROSS JOIN r LEFT JOIN path USING (id)
)
SELECT *, folded_root = root AS verified FROM done
"""
