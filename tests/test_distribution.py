"""The stored distribution against exact ranks."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from filingforge.operators import distribution as D

COHORT = ["year", "form"]


def rows(seed, n, places=2):
    r = random.Random(seed)
    out = [(i, r.choice([2024, 2025, None]), r.choice(["10-K", "10-Q"]), round(r.gauss(40, 15), places)) for i in range(n)]
    return out + [(n, 2025, "10-K", None), (n + 1, 2025, "10-K", float("nan")), (n + 2, 2025, "10-K", float("inf")), (n + 3, 2025, "10-K", -12.345), (n + 4, 2025, "10-K", 0.0), (n + 5, 2025, "10-K", 0.0)]


def frame(spark, data):
    return spark.createDataFrame(data, "id int, year int, form string, score double").repartition(3)


def cohorts(data):
    out = {}
    for _, year, form, x in data:
        if x is not None and x == x and abs(x) != float("inf"):
            out.setdefault((year, form), []).append(x)
    return out


def test_ranks_are_exact_on_the_grid_and_bounded_elsewhere(spark):
    data = rows(1, 700)
    got = D.with_context(frame(spark, data), D.histogram(frame(spark, data), "score", COHORT), "score", COHORT).collect()
    assert len(got) == len(data)
    for r in got:
        own = cohorts(data)[r.year, r.form]
        assert r.cohort_n == len(own) and r.cohort_median == pytest.approx(round(statistics.median(own), 1), abs=0.1)
        if r.score is not None and r.score == r.score and abs(r.score) != float("inf") and r.score != -12.345:
            assert r.percentile == round(100 * sum(x < r.score for x in own) / len(own))
    coarse = D.cumulated(D.histogram(frame(spark, data), "score", COHORT, step=5.0), COHORT).collect()
    for c in coarse:  # the bound: a rank is off by less than the scores of its own cell
        own = cohorts(data)[c.year, c.form]
        inside = [x for x in own if round(x / 5.0 + 1e-9) == c.cell]
        for x in inside:
            assert c.below <= sum(y < x for y in own) <= c.below + c.n


def test_merge_equals_rebuild_in_any_order(spark, tmp_path):
    data = rows(2, 400)
    parts = [data[i::3] for i in range(3)]
    whole = sorted(map(str, D.histogram(frame(spark, data), "score", COHORT).collect()))
    hists = [D.histogram(frame(spark, p), "score", COHORT) for p in parts]
    for order in ((0, 1, 2), (2, 0, 1)):
        assert sorted(map(str, D.merged(*[hists[i] for i in order], cohort=COHORT).collect())) == whole
    path, into = str(tmp_path / "scores"), str(tmp_path / "compact")
    for i, h in enumerate(hists):
        D.extend(spark, h, path, f"b{i}")
    D.extend(spark, hists[1], path, "b1")  # sent twice, counted once
    assert sorted(map(str, D.load(spark, path, COHORT).collect())) == whole
    D.compact(spark, path, into, COHORT)
    assert sorted(map(str, D.load(spark, into, COHORT).collect())) == whole
    D.extend(spark, D.histogram(frame(spark, data[:5]), "score", COHORT), path, "b0")
    assert D.load(spark, path, COHORT).agg(F.sum("n")).first()[0] == sum(len([x for x in p if x[3] is not None and x[3] == x[3] and abs(x[3]) != float("inf")]) for p in (data[:5], parts[1], parts[2]))


def test_quantiles_are_within_half_a_step(spark):
    data = [(i, 2025, "10-K", x) for i, x in enumerate(random.Random(3).sample(range(10**6), 501))]
    data = [(i, y, f, x / 1e4) for i, y, f, x in data]
    ordered = sorted(x[3] for x in data)
    for r in D.quantiles(D.histogram(frame(spark, data), "score", COHORT, step=0.5), COHORT, [0.0, 0.1, 0.5, 0.9, 1.0], step=0.5).collect():
        exact = ordered[max(1, -(-int(r.share * 501 * 10) // 10)) - 1]
        assert abs(r.value - exact) <= 0.25 + 1e-9


def test_scores_outside_of_the_artifact(spark):
    data = [(i, 2025, "10-K", float(i)) for i in range(10)]
    asked = frame(spark, [(1, 2025, "10-K", 4.5), (2, 2025, "10-K", -5.0), (3, 2025, "10-K", 99.0), (4, 2019, "10-K", 4.0), (5, 2025, "10-K", None)])
    got = {r.id: (r.percentile, r.cohort_n) for r in D.with_context(asked, D.histogram(frame(spark, data), "score", COHORT), "score", COHORT).collect()}
    assert got == {1: (50, 10), 2: (0, 10), 3: (100, 10), 4: (None, None), 5: (None, 10)}
    empty = D.histogram(frame(spark, data).limit(0), "score", COHORT)
    assert all(r.percentile is None for r in D.with_context(asked, empty, "score", COHORT).collect())
