"""Entities by a gazetteer against a naive search."""

import random

import pytest

from filingforge.operators import entities, validation
from filingforge.plans import metric_queries

NAMES = [("GPE", "China"), ("GPE", "New York"), ("ORG", "New York Times"), ("ORG", "York"), ("PER", "Ann"), ("ORG", "Ann"), ("GPE", "Île"), ("ORG", "A.B."), ("MONEY", "$5"), ("OTHER", "x"), ("ORG", "New"), ("ORG", "")]


def naive(text, names):
    best = {}
    for label, name in names:
        for at in range(len(text or "") - len(name) + 1 if name else 0):
            end = at + len(name)
            inside = (at and entities.is_word(text[at - 1]) and entities.is_word(text[at])) or (end < len(text) and entities.is_word(text[end]) and entities.is_word(text[end - 1]))
            if text[at:end] == name and not inside:
                best[at, end] = min(label, best.get((at, end), label))
    out, free = [], 0
    for at, end in sorted(best, key=lambda s: (s[0], -s[1])):
        if at >= free:
            out.append((at, end, best[at, end]))
            free = end
    return out


@pytest.mark.parametrize("block", [100, 3, 1])
def test_like_a_naive_search(spark, block):
    r = random.Random(3)
    bits = [n for _, n in NAMES if n] + [" ", " ", ", ", "s", "日本", "Times", "new", "_", "\n"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randrange(0, 25))), "x", "x") for i in range(150)] + [(900, None, "x", "x"), (901, "", "x", "x"), (0, "Ann in China", "x", "x"), (902, "New York Times " * 4000, "x", "x")]
    texts = spark.createDataFrame(rows, "id int, text string, entities string, row string").repartition(3)
    got = [(x.id, [(e.start, e.end, e.label) for e in x.entities]) for x in entities.with_entities(texts, spark.createDataFrame(NAMES, "label string, name string"), key="id", block=block).collect()]
    assert sorted(got) == sorted((i, naive(t, NAMES)) for i, t, _, _ in rows)
    assert sum(len(x) for _, x in got) > 500


def test_density_and_its_correlation(spark):
    rows = [(1, "Ann met Ann in New York today"), (2, "x and x"), (3, None), (4, "no names at all"), (5, "China and China and China")]
    texts = spark.createDataFrame(rows, "id int, text string")
    found = entities.with_entities(texts, spark.createDataFrame(NAMES, "label string, name string"), key="id").join(texts, "id")
    out = found.select("id", entities.density(found.entities, found.text).alias("density"), (found.id * 1.0).alias("other"))
    assert {r.id: r.density for r in out.collect()} == {1: 3 / 7, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.6}
    assert -1 <= validation.spearman(out, "density", "other", "id").first().rho <= 1
    none = entities.with_entities(texts, spark.createDataFrame([], "label string, name string"), key="id")
    assert all(r.entities == [] for r in none.collect()) and none.count() == 5


def test_what_is_correlated_is_computed_once_and_texts_meet_nothing(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(40).selectExpr("id", "double(id) AS a", "double(id * 7 % 40) AS b").mapInArrow(counted, "id long, a double, b double")
    validation.spearman(rows, "a", "b", "id").collect()
    assert seen.value == 40
    plan = metric_queries.entity_counts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_kept_columns_stay_with_their_rows(spark):
    texts = spark.createDataFrame([(1, "Ann", 7), (1, "China and Ann", 8), (2, None, 9)], "id int, text string, n int")
    for block in (100, 2):
        found = entities.with_entities(texts, spark.createDataFrame(NAMES, "label string, name string"), key="id", block=block, kept=("n",))
        assert sorted((r.id, r.n, len(r.entities)) for r in found.collect()) == [(1, 7, 1), (1, 8, 2), (2, 9, 0)]
