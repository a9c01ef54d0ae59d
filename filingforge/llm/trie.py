"""A prefix trie of conversations, merged family first.

A conversation c belongs to the family of its base b = c - c % span. Turns shrink to a digest and a word count where they
are read, so no text is shuffled. They meet by family, the base's in front (the cogroup of a base with its conversations,
as a sorted stream): each conversation is rebuilt from the first turns of its base and its own turns behind them, and each
family's small trie is built in its task. A node's name is a chained digest of the turns up to it, so nodes of one prefix
have one name in all families, and only one combined row for each node of a family is shuffled for the global merge.

Sums over subtrees: below a node that just one family has, all nodes are that family's alone, so the family's own sums are
right. Nodes of several families are few; they take up the sums of the subtrees beside them, and pass them on by doubling:
with s the sum over the nodes less than 2^k below, s' = s + the sum of s over the nodes 2^k below. Each row brings the
names of its ancestors 1, 2, 4, ... above, so a round is an aggregation and a join of unique keys, whatever the
skew, and a trie of depth d takes log2(d) rounds. Members that end at a node are joined to strings by ranges of ids, then
hashed as one sorted stream of strings for each node.

A family whose nodes exceed a bound is sent in parts as it is read; its nodes then count as shared, which costs rounds but
changes nothing. A conversation's path is held while it is read: 16 bytes a turn.

Defined results: turns go by number, null first, equal ones by the digest of role and text; a null role or text is empty;
repeated rows are turns of their own; rows without a conversation id belong to none and are left out; very long texts count
whole; an empty table has no nodes; other columns are ignored, whatever their names. Ids below zero take the sign of
SQL's %, so the family of 0 holds those on both sides.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, drop_staged, staged

WORD = r"[^\x20\x09-\x0D]+"
#: Ids of a family.
SPAN = 20
#: Turns that a conversation can take from its base.
MOST_SHARED = 3
#: Nodes of a family that a task holds.
FAMILY_NODES = 200_000
#: Ids whose ending members form one string.
RANGE = 20_000
#: Children above which a node counts as hot, at least; and the share of all nodes. At most 1 / share nodes are hot.
HOT_CHILDREN, HOT_SHARE = 1000, 0.001
ROOT = b"\x00" * 16


def shared_turns(c: int) -> int:
    """How many turns of its base a conversation takes."""
    return zlib.crc32(str(c).encode()) % (MOST_SHARED + 1)


def family_rows(turns: DataFrame, *, span: int = SPAN, most: int = MOST_SHARED, shared: Callable[[int], int] = shared_turns, family_nodes: int = FAMILY_NODES) -> DataFrame:
    """turns: conv_id, turn, digest, words. The combined node rows of each family.

    node, parent, above (ancestors 1, 2, 4, ... up), depth, words, n_convs, first (least member), leaves and saved (sums over
    the family's own subtree), whole (the family came in one part), ends (members that end there, ascending).
    """
    base = F.col("conv_id") - F.col("conv_id") % span
    schema = "node binary, parent binary, above array<binary>, depth long, words long, n_convs long, first long, leaves long, saved long, whole boolean, ends array<long>"
    shape = arrow_schema(schema)
    dealt = turns.withColumn("family", base).repartition("family")
    stream = dealt.sortWithinPartitions("family", F.col("conv_id") != F.col("family"), "conv_id", F.col("turn").asc_nulls_first(), "digest").select("family", "conv_id", "digest", "words")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A node: parent, above, depth, words, n_convs, first, ends.
        trie: dict[bytes, list] = {}
        family = conv = None
        heads: list[tuple[bytes, int]] = []
        path: list[bytes] = []
        seen = skip = 0
        whole = True

        def visit(turn: tuple[bytes, int] | None) -> None:
            """The next node of this conversation's path: the root without a turn."""
            if turn is None:
                node, parent, words = ROOT, None, 0
            else:
                node, parent, words = hashlib.blake2b(path[-1] + turn[0], digest_size=16).digest(), path[-1], turn[1]
            depth = len(path)
            path.append(node)
            found = trie.get(node)
            if found is None:
                above, step = [], 1
                while step <= depth:
                    above.append(path[depth - step])
                    step *= 2
                trie[node] = [parent, above, depth, words, 1, conv, []]
            else:
                found[4] += 1
                found[5] = min(found[5], conv)

        def part() -> pa.RecordBatch:
            """The trie so far as rows, children summed up into parents."""
            leaves, saved, inner = dict.fromkeys(trie, 0), {}, {x[0] for x in trie.values()}
            for node in reversed(trie):
                parent, _, _, words, n, _, _ = trie[node]
                leaves[node] += node not in inner
                saved[node] = saved.get(node, 0) + (n - 1) * words
                if parent in trie:
                    leaves[parent] += leaves[node]
                    saved[parent] = saved.get(parent, 0) + saved[node]
            rows = [(k, x[0], x[1], x[2], x[3], x[4], x[5], leaves[k], saved[k], whole, sorted(x[6])) for k, x in trie.items()]
            trie.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), shape.types, strict=True)], schema=shape)

        def finish() -> None:
            """The end of a conversation: what it still owes of its base's turns isn't there."""
            if conv is not None:
                if path[-1] not in trie:  # sent with an earlier part: a row for the end alone
                    trie[path[-1]] = [path[-2] if len(path) > 1 else None, [path[len(path) - 1 - 2**k] for k in range((len(path) - 1).bit_length())], len(path) - 1, 0, 0, conv, []]
                trie[path[-1]][6].append(conv)

        for batch in batches:
            for f, c, digest, words in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if c != conv:
                    finish()
                    if f != family:
                        if trie:
                            yield part()
                        family, heads, whole = f, [], True
                    conv, seen, skip = c, 0, shared(c)
                    path = []
                    visit(None)
                    for head in heads[:skip] if c != f else []:
                        visit(head)
                if c == f and len(heads) < most:
                    heads.append((digest, words))
                if c == f or seen >= skip:  # a base is rebuilt to itself
                    visit((digest, words))
                seen += 1
                if len(trie) >= family_nodes:
                    whole = False
                    yield part()
        finish()
        if trie:
            yield part()

    return stream.mapInArrow(build, schema)


def endings(rows: DataFrame) -> DataFrame:
    """node and ends_sha256 for the nodes at which members end.

    Members of a node are joined by ranges of ids first; then a node's strings, each of bounded size, go through one
    task in order, where the hash is carried on: its state is all that is held.
    """
    ids = rows.where(F.size("ends") > 0).select("node", F.explode("ends").alias("id")).withColumn("at", F.expr(f"id div {RANGE}"))
    texts = ids.groupBy("node", "at").agg(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("text"))
    shape = arrow_schema("node binary, ends_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = state = None
        for batch in batches:
            nodes, done = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != node:
                    if node is not None:
                        nodes.append(node)
                        done.append(state.hexdigest())
                    node, state = name, hashlib.sha256()
                else:
                    text = "," + text
                state.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(done, pa.string())], schema=shape)
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], schema=shape)

    return texts.repartition("node").sortWithinPartitions("node", "at").select("node", "text").mapInArrow(run, "node binary, ends_sha256 string")


def summed(shared: DataFrame) -> DataFrame:
    """shared: node, above, leaves, saved of nodes with all their ancestors. node, leaves, saved as sums over subtrees."""
    spark = shared.sparkSession
    state = staged(spark, shared, "trie-sums")
    deepest = state.agg(F.max(F.size("above"))).first()[0] or 0
    for k in range(deepest):
        up = F.get("above", F.lit(k))
        below = state.select(up.alias("node"), "leaves", "saved").where("node IS NOT NULL").groupBy("node").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        more = [(F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0))).alias(c) for c in ("leaves", "saved")]
        after = staged(spark, state.join(below, "node", "left").select("node", "above", *more), "trie-sums")
        drop_staged(spark, state)
        state = after
    return state.select("node", "leaves", "saved")


def prefix_trie(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", span: int = SPAN, most: int = MOST_SHARED, shared: Callable[[int], int] = shared_turns, family_nodes: int = FAMILY_NODES) -> DataFrame:
    """A row for each node: node and parent (names), conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    role_of, text_of = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role_of).cast("string"), F.lit(":"), role_of, text_of).cast("binary"), 256), 1, 32))
    turns = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), digest.alias("digest"), F.regexp_count(text_of, F.lit(WORD)).cast("long").alias("words"))
    rows = staged(spark, family_rows(turns, span=span, most=most, shared=shared, family_nodes=family_nodes), "trie-families")
    alone = (F.count("*") == 1) & F.min("whole")
    nodes = staged(
        spark,
        rows.groupBy("node").agg(
            F.first("parent").alias("parent"), F.first("above").alias("above"), F.first("depth").alias("depth"), F.max("words").alias("words"),
            F.sum("n_convs").alias("n_convs"), F.min("first").alias("conv_id"), alone.alias("alone"), F.max("leaves").alias("leaves"), F.max("saved").alias("saved"),
        ),
        "trie-nodes",
    )
    beside = F.when(F.col("alone"), F.col("leaves")).otherwise(0), F.when(F.col("alone"), F.col("saved")).otherwise(0)
    children = staged(spark, nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.sum(beside[0]).alias("leaves_beside"), F.sum(beside[1]).alias("saved_beside")), "trie-children")
    known = with_parents(nodes, children).join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = [
        (F.coalesce("leaves_beside", F.lit(0)) + (F.col("n_children") == 0).cast("long")).alias("leaves"),
        (F.coalesce("saved_beside", F.lit(0)) + (F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    ]
    sums = summed(known.where(~F.col("alone")).select("node", "above", *own)).select("node", F.col("leaves").alias("all_leaves"), F.col("saved").alias("all_saved"))
    full = known.join(sums, "node", "left").join(endings(rows), "node", "left")
    return full.select(
        "node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("all_leaves", "leaves").alias("n_leaves"), F.coalesce("all_saved", "saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def with_parents(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """Adds parent_conv_id. Nodes with many children are few and are broadcast; other children meet their parent by its name."""
    limit = max(HOT_CHILDREN, int(nodes.count() * HOT_SHARE))
    names = nodes.select(F.col("node").alias("of"), F.col("conv_id").alias("parent_conv_id"))
    hot = F.broadcast(names.join(F.broadcast(children.where(F.col("n_children") > limit).select(F.col("node").alias("of"))), "of"))
    below: Column = F.col("parent") == F.col("of")
    named = nodes.where("parent IS NOT NULL")
    parts = [named.join(hot, below, "left_anti").join(names, below).drop("of"), named.join(hot, below).drop("of"), nodes.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt from the turns they share with their bases."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("node", "parent")


ORACLE_SQL = """
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM own)
),
turns AS (
  SELECT c.conv_id, 0 AS own, o.n, o.role, o.text FROM c JOIN own o ON o.conv_id = c.base AND o.n <= c.h
  UNION ALL
  SELECT c.conv_id, 1, o.n, o.role, o.text FROM c JOIN own o ON o.conv_id = c.conv_id AND o.n > c.h
),
rebuilt AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(sha256(role) || sha256(text), '') OVER w AS prefix, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY own, n)
),
members AS (SELECT conv_id, depth, prefix, words FROM rebuilt UNION ALL SELECT conv_id, 0, '', 0 FROM c),
last AS (SELECT conv_id, max(depth) AS depth FROM members GROUP BY conv_id),
nodes AS (
  SELECT prefix, m.depth, min(m.conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) FILTER (WHERE last.depth = m.depth), '')) AS ends_sha256
  FROM members m JOIN last USING (conv_id) GROUP BY prefix, m.depth
),
kids AS (SELECT p.prefix, count(k.prefix) AS n_children FROM nodes p LEFT JOIN nodes k ON k.depth = p.depth + 1 AND left(k.prefix, 128 * p.depth) = p.prefix GROUP BY p.prefix),
above AS (SELECT left(prefix, 128 * up) AS prefix, (n_convs - 1) * words AS saved, (n_children = 0)::INT AS leaf FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM nodes JOIN kids USING (prefix))),
sums AS (SELECT prefix, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY prefix)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN kids USING (prefix) JOIN sums USING (prefix) LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.prefix = left(n.prefix, 128 * (n.depth - 1))
"""
