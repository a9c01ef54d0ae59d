import numpy as np
import pytest

from filingforge.llm import topk


def brute(rows, k, scale=1024):
    """Each query row against every row but itself, sorted."""
    good = [(i, [int(np.floor(x * scale)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(good):
        if q is not None and q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i is None, i or 0) for n, (i, w) in enumerate(good) if n != at and len(w) == len(v))[:k]
            out += [(q, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(scored)]
    return sorted(out, key=str)


@pytest.mark.parametrize("query_block", [4096, 7])
def test_like_brute_force(spark, query_block):
    r = np.random.default_rng(0)
    centres = r.normal(size=(6, 8)) * 3
    rows = [(i, (centres[i % 6] + r.normal(size=8) * 0.3).astype(np.float32).tolist()) for i in range(500)]
    rows += [(600, None), (620, [1.0, None, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (640, [float("nan")] * 8), (660, [float("inf")] * 8), (680, [1.0, 2.0]), (681, [2.0, 1.0]), (700, []), (None, [1.0] * 8), (20, rows[20][1]), (521, rows[20][1]), (522, rows[20][1]), (40, [3.0] * 8), (None, rows[60][1])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(4)
    got = topk.top_k(frame, lambda key: key % 20 == 0, query_block=query_block, sample_rows=50).collect()
    assert sorted([(x.query_id, x.rank, x.vec_id, x.score) for x in got], key=str) == brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 10)
    assert topk.top_k(frame.limit(0), lambda key: key % 20 == 0).count() == 0


def test_bounds_hold_and_prune():
    r = np.random.default_rng(1)
    data = np.concatenate([r.integers(-50, 50, (300, 6)) + c for c in (-2000, 0, 2000)])
    queries = r.integers(-50, 50, (40, 6)) + 2000
    q, d = topk.cover_tree(queries.astype(float)), topk.cover_tree(data.astype(float))

    def walk(node, points):
        gaps = np.sqrt(((points[node.rows] - node.centre) ** 2).sum(axis=1))
        assert (gaps <= node.radius + 1e-9).all()
        for child in node.children:
            walk(child, points)
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)

    walk(q, queries)
    walk(d, data)
    assert topk.upper_bound(q, d) >= topk.products(queries, data).max()
    best = topk.Best.empty(40, 10)
    scored = topk.dual_search(queries, np.arange(40), q, data, np.arange(1000, 1900), d, best)
    assert scored < 40 * 900 / 2
    for i in range(40):
        assert best.scores[i].tolist() == sorted(topk.products(queries[i : i + 1], data)[0].tolist(), reverse=True)[:10]


def test_large_components_are_exact():
    a = np.array([[2**30, -(2**30)]])
    assert topk.products(a, a + 1).tolist() == [[(2**30) * (2**30 + 1) + (-(2**30)) * (-(2**30) + 1)]]


def test_scores_beyond_a_long_are_kept_at_its_ends():
    a = np.array([[2**40, 2**40], [-(2**40), -(2**40)]])
    assert topk.products(a, a).tolist() == [[2**63 - 1, -(2**63)], [-(2**63), 2**63 - 1]]
    assert topk.products(a[:1], np.array([[2**20, 2**20]])).tolist() == [[2**61]]


def test_centres_of_children_are_apart_and_cover():
    points = np.random.default_rng(4).normal(size=(400, 3)) * 100

    def walk(node):
        if node.children:
            centres = np.stack([c.centre for c in node.children])
            gaps = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2)) + np.eye(len(centres)) * 1e9
            assert gaps.min() > node.radius / 2 and all(c.radius <= node.radius / 2 + 1e-6 for c in node.children)
        for child in node.children:
            walk(child)

    walk(topk.cover_tree(points))


def test_share_of_pairs_scored_on_the_given_vectors(spark):
    """The vectors of the tables are random directions: most pairs are scored (figures in README). Clusters prune."""
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").toPandas().sort_values("vec_id")
    vectors = np.floor(np.stack(table.embedding.to_numpy()).astype(float) * 1024).astype(np.int64)
    ids = table.vec_id.to_numpy()
    queries = ids % 100 == 0

    def share(data, q, floor=None):
        best = topk.Best.empty(len(q), 10, floor)
        return topk.dual_search(q, np.full(len(q), topk.LEAST), topk.cover_tree(q.astype(float)), data, np.arange(len(data)), topk.cover_tree(data.astype(float)), best) / (len(q) * len(data))

    r = np.random.default_rng(8)
    centres = r.normal(size=(40, 64)) * 1000
    clustered = np.floor(np.repeat(centres, 25, axis=0) + r.normal(size=(1000, 64)) * 20).astype(np.int64)
    given, clusters = share(vectors, vectors[queries]), share(clustered, clustered[::50])
    print("share of pairs scored", given, clusters)
    assert 0 < given <= 1 and clusters < 0.5
