"""Latent vectors against an exact decomposition."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from filingforge.operators import latent

TOPICS = ["court claim lawsuit judge appeal ruling", "market price demand inflation margin cost", "breach network malware password access attack"]


def corpus(n, seed=2):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = TOPICS[i % 3].split() + ["the", "of", "company", f"name{r.randrange(20)}"]
        out.append((i, "\n".join(" ".join(r.choice(words) for _ in range(12)) for _ in range(r.randrange(1, 5)))))
    return out


@pytest.fixture(scope="module")
def texts(spark):
    rows = [*corpus(120), (900, None), (901, ""), (902, " \n "), (903, "a b c"), (904, "Court " * 3000), (0, corpus(1)[0][1])]
    return spark.createDataFrame([(*r, "x", "x") for r in rows], "id long, text string, slots string, row string").repartition(3)


def exact(texts, slots, size, directions):
    """Vectors of texts by a dense matrix and its exact decomposition."""
    lists = {}
    for i, r in enumerate(texts.select("id", "text", latent.chunk_slots(F.col("text"), slots, size).alias("c")).collect()):
        lists[i] = (r.id, r.text, [c for c in r.c])
    rows = [c for _, _, cs in lists.values() for c in cs if c]
    counts = np.array([np.bincount(c, minlength=slots) for c in rows], float)
    idf = np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 1
    weigh = lambda c: c * idf / max(np.linalg.norm(c * idf), 1e-300)
    _, _, vt = np.linalg.svd(np.array([weigh(c) for c in counts]), full_matrices=False)
    kept = vt[:directions]
    return {i: (name, np.mean([kept @ weigh(np.bincount(c, minlength=slots)) if c else np.zeros(directions) for c in cs], axis=0)) for i, (name, _, cs) in lists.items()}


def test_cosines_are_those_of_the_exact_decomposition(spark, texts, tmp_path):
    slots, size, k = 512, 80, 12
    model = latent.fit(texts, slots=slots, size=size, directions=k, spare=30, rounds=12)
    latent.save_model(model, str(tmp_path / "model"))
    stored = latent.load_model(spark, str(tmp_path / "model"))
    assert sorted(map(tuple, stored.select("slot", "idf").collect())) == sorted(map(tuple, model.select("slot", "idf").collect()))
    got = {}
    for r in latent.with_vectors(texts, stored, {"text": "vector"}, slots=slots, size=size).collect():
        got.setdefault(r.id, []).append(None if r.vector is None else np.array(r.vector))
    want = {}
    for name, v in exact(texts, slots, size, k).values():
        want.setdefault(name, []).append(v)
    cos = lambda a, b: 0.0 if a is None or b is None or not a.any() or not b.any() else a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    for a in range(0, 120, 7):
        for b in range(0, 120, 5):
            assert cos(got[a][0], got[b][0]) == pytest.approx(cos(want[a][0], want[b][0]), abs=1e-6)
    assert got[900] == got[901] == got[902] == [None] and got[904][0] is not None


def test_pairs(spark, texts):
    model = latent.fit(texts, slots=512, size=200, directions=4)
    rows = [(1, "court lawsuit", "judge appeal ruling"), (2, "court lawsuit", "malware password"), (3, "court", ""), (4, None, "court"), (5, "zz", "zz"), (6, "court claim", "court claim")]
    got = {r.id: r.latent_similarity for r in latent.with_similarity(spark.createDataFrame(rows, "id int, text string, prior_text string"), model, slots=512, size=200).collect()}
    assert got[1] > 0.3 > 0.2 > got[2] and got[3] == got[4] == 0.0 and got[6] == pytest.approx(1.0)
    assert all(0 <= x <= 1 for x in got.values())


def test_terms_of_two_characters(spark):
    text = "A bc dé_1 x\n" + "y " * 10
    got = spark.range(1).select(latent.chunk_slots(F.lit(text), 97, 6)).first()[0]
    assert sum(map(len, got)) == len(re.findall(r"\w\w+", text))


def test_no_terms(spark):
    none = spark.createDataFrame([(1, None), (2, "a")], "id int, text string")
    model = latent.fit(none, slots=64)
    assert model.count() == 0
    assert [r.v for r in latent.with_vectors(none, model, {"text": "v"}, slots=64).collect()] == [None, None]


def test_slots_are_weighted_as_lists_or_as_arrow():
    import pyarrow as pa

    lists = [[1, 2, 1], [], [3], [0, 0, 2]]
    idf = np.array([1.0, 2.0, 1.5, 3.0])
    held = pa.array([[9], *lists], pa.list_(pa.int32())).slice(1)
    assert all(np.array_equal(a, b) for a, b in zip(latent.weighted(lists, idf), latent.weighted(held, idf)))
    slot, weight, row = latent.weighted(held, idf)
    assert row.tolist() == [0, 0, 2, 3, 3] and slot.tolist() == [1, 2, 3, 0, 2] and np.allclose(np.bincount(row, weight * weight), [1, 0, 1, 1])
