import numpy as np
import pytest
from pyspark.sql import functions as F

from filingforge.llm import language

from .fixtures import documents, mixed_rows, prose

PACKS = {
    "en": "the of and thing whether another through house light nothing".split(),
    "de": "der die und nicht heit keit schön über zwischen ung".split(),
    "fr": "le la les dans être où déjà leur tion eaux".split(),
}


def rows():
    return [(1000 + 3 * i + j, prose(1000 + i, 40, PACKS[lang]), lang) for i in range(60) for j, lang in enumerate(PACKS)]


@pytest.fixture(scope="module")
def model(spark):
    return language.train_on(documents(spark, rows()))


def test_forward_backward_is_that_of_one_chain():
    r = np.random.default_rng(3)
    first = np.array([0, 1, 1, 70, 75, 141])
    scores, moves, start = r.normal(size=(141, 3)) * 2, r.normal(size=(3, 3)), r.normal(size=3)
    got = language.expected_words(scores, first, moves, start, block=8)
    for k in range(5):
        x = scores[first[k] : first[k + 1]]
        if not len(x):
            assert (got[k] == 0).all()
            continue
        a, e = np.exp(moves), np.exp(x)
        forward = [np.exp(start) * e[0]]
        for t in range(1, len(x)):
            forward.append(forward[-1] @ a * e[t])
            forward[-1] /= forward[-1].sum()
        back = [np.ones(3)]
        for t in range(len(x) - 1, 0, -1):
            back.append(a @ (e[t] * back[-1]))
            back[-1] /= back[-1].sum()
        both = np.array(forward) * np.array(back[::-1])
        assert np.allclose(got[k], (both / both.sum(axis=1, keepdims=True)).sum(axis=0))


def test_held_out_accuracy(spark, model):
    docs = documents(spark, rows())
    got = language.predict(docs, model, carry=["doc_id", "lang"]).withColumn("h", language.held_out_column()).where("h").collect()
    assert len(got) > 30 and sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_words_of_a_text_that_switches(spark, model):
    text = prose(1, 50, PACKS["en"]) + " " + prose(2, 100, PACKS["de"])
    row = language.predict(documents(spark, [(1, text)]), model, carry=["doc_id"]).first()
    by = dict(zip(model.languages, row.words_by_language))
    assert row.lang_pred == "de" and abs(by["en"] - 50) < 8 and abs(by["de"] - 100) < 8


def test_odd_texts(spark, model):
    docs = documents(spark, mixed_rows() + [(30, "12 345 !!"), (31, "語"), (32, "😀 😀"), (31, "語")])
    got = {r.doc_id: r for r in language.predict(docs, model, carry=["doc_id"]).collect()}
    for doc in (4, 5, 6, 30, 32):
        assert (got[doc].lang_pred, got[doc].score) == ("und", 0.0)
    assert got[31].lang_pred in PACKS and got[12].lang_pred in PACKS


def test_without_labels_and_without_rows(spark):
    docs = documents(spark, [(1, "the", None)])
    assert language.train_on(docs) is None and language.train_on(docs.limit(0)) is None
    assert language.predict(docs, None, carry=["doc_id"]).first().lang_pred == "und"
    assert language.predict(docs.limit(0), None, carry=["doc_id"]).count() == 0


def test_the_held_out_rule(spark):
    import zlib

    got = spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", language.held_out_column().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def brute_expectations(x, real, a, s):
    """By all paths of a chain."""
    from itertools import product

    node, pair = np.zeros_like(x), np.zeros_like(a)
    for k, chain in enumerate(x):
        n, paths = int(real[k].sum()), {}
        for path in product(range(len(s)), repeat=n):
            paths[path] = s[path[0]] * np.prod([chain[t, j] for t, j in enumerate(path)]) * np.prod([a[i, j] for i, j in zip(path, path[1:])])
        z = sum(paths.values())
        for path, p in paths.items():
            for t, j in enumerate(path):
                node[k, t, j] += p / z
            for i, j in zip(path, path[1:]):
                pair[i, j] += p / z
    return node, pair


def test_training_expects_like_brute_force():
    r = np.random.default_rng(5)
    x, real = np.exp(r.normal(size=(6, 5, 3))), np.arange(5)[None, :] < np.array([5, 4, 3, 1, 2, 5])[:, None]
    a, s = np.exp(r.normal(size=(3, 3))), np.exp(r.normal(size=3))
    for got, want in zip(language.expectations(x, real, a, s), brute_expectations(x, real, a, s)):
        assert np.allclose(got, want)


def test_sums_of_groups(monkeypatch):
    r = np.random.default_rng(6)
    groups, values = np.concatenate([np.arange(40), r.integers(0, 40, 500)]), r.normal(size=(90, 4)).astype(np.float32)
    rows = r.integers(0, 90, len(groups))
    want = np.stack([values[rows[groups == g]].sum(axis=0) for g in range(40)])
    for cells in (1, 50, 1 << 20):
        monkeypatch.setattr(language, "TRAIN_CELLS", cells)
        assert np.allclose(language.Groups(groups, rows, 40).sums(values), want, atol=1e-4)


def many_languages(n, docs, seed=9):
    r = np.random.default_rng(seed)
    packs = ["".join(c) for c in r.choice(list("abcdefghijklmnopqrstuvwxyzäöüéñçøß"), size=(n * 40, 6))]
    return {f"l{i:02d}": [" ".join(r.choice(packs[40 * i : 40 * i + 40], 60)) for _ in range(docs)] for i in range(n)}


def test_sixty_languages_in_bounded_memory_and_time(spark):
    """Languages by the dozen, and one whose rows are copies of one text."""
    import time
    import tracemalloc

    texts = many_languages(60, 70)
    rows = [(10_000 + 100 * i + k, t, lang) for i, (lang, found) in enumerate(texts.items()) for k, t in enumerate(found)] + [(50_000 + k, "hot copy wörter immer gleich " * 5, "copies") for k in range(500)]
    docs = documents(spark, rows)
    tracemalloc.start()
    began = time.perf_counter()
    model = language.train_on(docs)
    took, peak = time.perf_counter() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.languages) == 61 and peak < 1 << 30 and took < 240  # traced, about twice as slow as untraced
    got = language.predict(docs, model, carry=["doc_id", "lang"]).where(language.held_out_column()).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) > 1000
