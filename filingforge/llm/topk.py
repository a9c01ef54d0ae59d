"""Exact top-k inner products by dual cover trees.

Vectors are whole numbers, floor(scale * x) of each component. Queries, a stated set of rows, are handled in blocks of
bounded size, one after the other: a block's cover tree is broadcast, its answers are written to the shared folder, and
the broadcast is released, so memory and plan don't grow with the number of blocks. Each task builds cover trees over
batches of its own rows and walks query and data tree together: a pair of nodes is left out where

    c_q . c_r + R_q |c_r| + R_r |c_q| + R_q R_r

(c: centres, R: covering radii) is below the worst k-th score in the query node. In a pair of leaves the same bound is
taken for each data point, and what is left is scored by one integer-exact matrix product. Tasks
start from a bound: the k-th score of each query among a bounded sample of rows, which no answer can be below; so a
task's answer is short, and the shuffle carries at most k + 1 rows a query and task.

A tree's children have at most half of its covering radius and centres further apart than that, as many as it takes.
Where vectors have no clusters, as random directions in many dimensions, balls of half the radius hold a point or two,
trees are flat, and hardly a pair can be left out; answers are exact all the same.

Defined results: vectors that are null, or hold null or non-finite components, take no part; candidates are all rows but
the query's own, so rows that share its id are, and a row equal to it in id and vector is one as often as it repeats;
each query row is answered, so a repeated query id has several answers; a row of null id is a candidate behind all
others of its score, and no query; vectors of another length than the query's aren't candidates; components beyond the
range of a long, and scores beyond it, count as its least or greatest value; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_schema, scratch, staged
from .words import expand

#: Queries of one block, rows of the bounding sample, rows of one data tree, and points of a leaf of either tree.
QUERY_BLOCK, SAMPLE_ROWS, DATA_ROWS, LEAF = 4_096, 4_096, 1_024, 8
#: Sums of products up to this are exact in double precision.
EXACT = 2**53
LEAST, MOST = -(2**63), 2**63 - 1
#: Stands for a null id: behind all others.
NO_ID = MOST


@dataclass
class Node:
    """rows: numbers of the points below; centre: one of them; radius: the largest distance from it to another."""

    rows: np.ndarray
    centre: np.ndarray
    radius: float
    norm: float
    children: list["Node"] = field(default_factory=list)


def cover_tree(points: np.ndarray, rows: np.ndarray | None = None, *, leaf: int = LEAF) -> Node:
    """A tree whose nodes cover their points by balls round one of them.

    Children's centres are picked one after the other, each the point farthest from those there are, until all points
    lie within half the node's radius of one: centres are further apart than that. Points go to the nearest centre.
    """
    rows = np.arange(len(points)) if rows is None else rows
    own = points[rows]
    centre = own[0]
    squares = (own**2).sum(axis=1)
    gaps = np.sqrt(((own - centre) ** 2).sum(axis=1))
    node = Node(rows, centre, float(gaps.max(initial=0.0)), float(np.sqrt(squares[0])))
    if len(rows) <= leaf or node.radius == 0:
        return node
    nearest, owner, picked = gaps.copy(), np.zeros(len(rows), np.int64), [0]
    while nearest.max() > node.radius / 2:
        new = int(nearest.argmax())
        to_new = np.sqrt(np.maximum(squares + squares[new] - 2 * (own @ own[new]), 0))
        to_new[new] = 0.0
        closer = to_new < nearest
        owner[closer], nearest[closer] = len(picked), to_new[closer]
        picked.append(new)
    order = np.argsort(owner, kind="stable")
    edges = np.searchsorted(owner[order], np.arange(len(picked) + 1))
    for j, first in enumerate(picked):
        part = order[edges[j] : edges[j + 1]]
        part = np.concatenate([[first], part[part != first]])
        node.children.append(cover_tree(points, rows[part], leaf=leaf))
    return node


@dataclass
class Flat:
    """All nodes of a tree, the children of each in a row: centres, radii, norms, first child and number of children, and
    where the node's points begin in rows, and how many they are."""

    centres: np.ndarray
    radii: np.ndarray
    norms: np.ndarray
    first: np.ndarray
    children: np.ndarray
    begin: np.ndarray
    points: np.ndarray
    rows: np.ndarray


def flat(root: Node) -> Flat:
    """The tree as arrays, level by level."""
    nodes, first = [root], []
    for node in nodes:  # grows while it is read
        first.append(len(nodes))
        nodes += node.children
    sizes = np.array([len(n.rows) for n in nodes])
    return Flat(
        np.stack([n.centre for n in nodes]), np.array([n.radius for n in nodes]), np.array([n.norm for n in nodes]), np.array(first), np.array([len(n.children) for n in nodes]),
        np.cumsum(sizes) - sizes, sizes, np.concatenate([n.rows for n in nodes]),
    )


def _above(products: np.ndarray, q_norm: float, q_radius: float, r_norm: np.ndarray, r_radius: np.ndarray) -> np.ndarray:
    value = products + q_radius * r_norm + r_radius * q_norm + q_radius * r_radius
    return value + 1e-9 * (np.abs(value) + (q_norm + q_radius) * (r_norm + r_radius)) + 1e-6


def upper_bound(q: Node, r: Node) -> float:
    """No inner product between the nodes is above this (with a margin for rounding)."""
    return float(_above(q.centre @ r.centre, q.norm, q.radius, np.float64(r.norm), np.float64(r.radius)))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows of a and b, kept within the range of a long."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return np.clip(a.astype(object) @ b.astype(object).T, LEAST, MOST).astype(np.int64)


@dataclass
class Best:
    """The k best of each query so far: scores and ids, best first; floor: what the k-th score can't be below."""

    k: int
    scores: list[np.ndarray]
    ids: list[np.ndarray]
    floor: np.ndarray

    @classmethod
    def empty(cls, queries: int, k: int, floor: np.ndarray | None = None) -> "Best":
        none = np.zeros(0, np.int64)
        return cls(k, [none] * queries, [none] * queries, np.full(queries, -np.inf) if floor is None else floor.astype(float).copy())

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.floor[query]
        if not keep.any():
            return
        s, i = np.concatenate([self.scores[query], scores[keep]]), np.concatenate([self.ids[query], ids[keep]])
        order = np.lexsort((i, ~s))[: self.k]
        self.scores[query], self.ids[query] = s[order], i[order]
        if len(order) == self.k:
            self.floor[query] = max(self.floor[query], float(s[order[-1]]))


def dual_search(queries: np.ndarray, query_ids: np.ndarray, q_tree: Node, data: np.ndarray, data_ids: np.ndarray, r_tree: Node, best: Best) -> int:
    """Walks both trees; returns how many pairs of points were scored. Rows of a query's own id are left out where query_ids has it."""
    scored = 0
    tree, norms = flat(r_tree), np.sqrt((data.astype(float) ** 2).sum(axis=1))
    stack: list[tuple[Node, np.ndarray]] = [(q_tree, np.zeros(1, np.int64))]
    while stack:
        q, nodes = stack.pop()
        bounds = _above(tree.centres[nodes] @ q.centre, q.norm, q.radius, tree.norms[nodes], tree.radii[nodes])
        near = bounds >= best.floor[q.rows].min()
        nodes, bounds = nodes[near], bounds[near]
        inner = nodes[tree.children[nodes] > 0]
        if q.children and len(nodes) and (not len(inner) or q.radius >= tree.radii[inner].max()):
            stack += [(child, nodes) for child in q.children]
            continue
        if len(inner):
            stack.append((q, np.concatenate([nodes[tree.children[nodes] == 0], expand(tree.first[inner], tree.children[inner])])))
            continue
        # Leaves on both sides: the most promising first, so that the bound rises before the others are looked at.
        order = np.argsort(-bounds, kind="stable")
        nodes, bounds, at, many = nodes[order], bounds[order], 0, 16
        while at < len(nodes) and bounds[at] >= (floor := best.floor[q.rows].min()):
            these = nodes[at : at + many]
            at, many = at + many, 2 * many
            points = tree.rows[expand(tree.begin[these], tree.points[these])]
            points = points[_above(data[points].astype(float) @ q.centre, q.norm, q.radius, norms[points], np.zeros(len(points))) >= floor]
            scored += len(q.rows) * len(points)
            for row, scores in zip(q.rows.tolist(), products(queries[q.rows], data[points]), strict=True):
                other = data_ids[points] != query_ids[row]
                best.add(row, scores[other], data_ids[points][other])
    return scored


def whole_vectors(rows: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """key and v, the vectors that take part as whole numbers."""
    v = F.col(vector)
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(good).select(F.col(key).alias("key"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def by_length(ids: list, vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """ids and a matrix for each length of vector."""
    groups: dict[int, tuple[list, list]] = {}
    for i, v in zip(ids, vectors, strict=True):
        a, b = groups.setdefault(len(v), ([], []))
        a.append(NO_ID if i is None else i)
        b.append(v)
    return {n: (np.array(a, np.int64), np.array(b, np.int64).reshape(len(a), n)) for n, (a, b) in groups.items()}


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and vectors of a batch, DATA_ROWS at most together, by length of vector."""
    for at in range(0, batch.num_rows, DATA_ROWS):
        piece = batch.slice(at, DATA_ROWS)
        vectors, lengths = piece.column("v"), pc.list_value_length(piece.column("v")).to_numpy(zero_copy_only=False)
        keys, flat = np.array(pc.fill_null(piece.column("key"), NO_ID), dtype=np.int64), np.array(vectors.flatten(), dtype=np.int64)
        begins = np.cumsum(lengths) - lengths
        for n in sorted(set(lengths.tolist())):
            which = np.flatnonzero(lengths == n)
            yield keys[which], flat[(begins[which][:, None] + np.arange(n)[None, :]).astype(np.int64)]


def top_k(rows: DataFrame, is_query, *, key: str = "vec_id", vector: str = "embedding", k: int = 10, scale: int = 1024, query_block: int = QUERY_BLOCK, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, key, score: the k highest inner products of each query row (is_query: a condition on the key)."""
    spark = rows.sparkSession
    good = whole_vectors(rows, key, vector, scale).withColumn("key", F.col("key").cast("long"))
    queries = good.where(F.coalesce(is_query(F.col("key")), F.lit(False)) & F.col("key").isNotNull())
    n_queries, n_rows = queries.count(), good.count()
    blocks = max(1, -(-n_queries // query_block))
    if blocks > 1:  # numbered once, so that each query is in one block
        queries = staged(spark, queries.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))), "topk-queries")
    share = min(1.0, sample_rows / max(n_rows, 1))
    sample = good.where(F.pmod(F.xxhash64("key", "v"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * sample_rows).collect()
    sampled = by_length([r["key"] for r in sample], [r["v"] for r in sample])
    schema = "query int, query_id long, own boolean, vec_id long, score long"
    shape = arrow_schema(schema)
    paths = []
    for block in range(blocks):
        part = queries.where(F.col("block") == block) if blocks > 1 else queries
        mine = part.collect()  # about query_block rows
        prepared, number = {}, 0
        for n, (ids, matrix) in by_length([r["key"] for r in mine], [r["v"] for r in mine]).items():
            tree = cover_tree(matrix.astype(float))
            bound = Best.empty(len(ids), k)
            if n in sampled:  # without rows of the query's own id, which leaves the bound no higher
                s_ids, s_matrix = sampled[n]
                for at in range(0, len(s_ids), DATA_ROWS):
                    piece = s_matrix[at : at + DATA_ROWS]
                    dual_search(matrix, ids, tree, piece, s_ids[at : at + DATA_ROWS], cover_tree(piece.astype(float)), bound)
            prepared[n] = (ids, matrix, tree, bound.floor, number)
            number += len(ids)
        shared = spark.sparkContext.broadcast(prepared)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            # One more than k: the query's own row is taken out at the end.
            best = {n: Best.empty(len(x[0]), k + 1, x[3]) for n, x in shared.value.items()}
            for batch in batches:
                for ids, matrix in matrices(batch):
                    n = matrix.shape[1]
                    if n in shared.value and len(shared.value[n][0]):
                        q_ids, q_matrix, tree, _, _ = shared.value[n]
                        dual_search(q_matrix, np.full(len(q_ids), LEAST), tree, matrix, ids, cover_tree(matrix.astype(float)), best[n])
            for n, b in best.items():
                q_ids, q_matrix, _, _, first = shared.value[n]
                sizes = [len(s) for s in b.scores]
                if sum(sizes):
                    which = np.repeat(np.arange(len(q_ids)), sizes)
                    ids, scores = np.concatenate(b.ids), np.concatenate(b.scores)
                    # Of rows of the query's id with its own score, one is the query itself, whichever it is.
                    own = (ids == q_ids[which]) & (scores == np.array([products(v[None], v[None])[0, 0] for v in q_matrix], np.int64)[which])
                    columns = [pa.array((which + first).astype(np.int32)), pa.array(q_ids[which]), pa.array(own), pa.array(ids), pa.array(scores)]
                    yield pa.RecordBatch.from_arrays(columns, schema=shape)

        answers = good.mapInArrow(search, schema)
        mark = F.row_number().over(Window.partitionBy("query", "own").orderBy(F.desc("score"), "vec_id"))
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
        others = answers.withColumn("mark", mark).where(~F.col("own") | (F.col("mark") > 1))
        found = others.withColumn("rank", rank).where(F.col("rank") <= k)
        found = found.select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias(key), "score")
        if blocks == 1:
            return found
        paths.append(scratch(spark, "topk"))
        found.write.parquet(paths[-1])
        shared.destroy()
    return spark.read.schema(found.schema).parquet(*paths)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products of every hundredth vector among all others."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda key: key % 100 == 0)


ORACLE_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r AS q, q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * r.v[i])) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id % 100 = 0 AND q.r <> r.r AND len(q.v) = len(r.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id NULLS LAST) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 10
"""
