"""Global ranks over many partitions, with adaptive execution and wide rows."""

import numpy as np
from pyspark.sql import functions as F

from filingforge.operators import products, validation


def test_ranks_over_many_partitions(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(1 << 20))
    try:
        n = 60_000
        rows = spark.range(n, numPartitions=7).select("id", F.pmod(F.xxhash64("id"), F.lit(9000)).cast("double").alias("v"), F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id") * 1.0).alias("hot"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 3).alias("wide"))
        got = validation.ranked(validation.ranked(rows, "v", "id", "rv"), "hot", "id", "rh")
        table = got.select("id", "v", "hot", "rv", "rh", F.length("wide").alias("w")).toPandas()
        assert len(table) == n and (table.w == 192).all()
        for value, rank in (("v", "rv"), ("hot", "rh")):
            order = table.sort_values([value, "id"])[rank].to_numpy()
            assert (order == np.arange(n)).all()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_cohorts_and_medians(spark):
    r = np.random.default_rng(3)
    rows = [(i, ["a", "b", None][i % 3], None if i % 11 == 0 else float(r.integers(0, 40))) for i in range(500)]
    frame = spark.createDataFrame(rows, "id long, g string, score double")
    cohort = {g: sorted(s for _, h, s in rows if h == g and s is not None) for g in "ab"}
    for x in products.corpus_context(frame, "score", ["g"]).collect():
        own = cohort[x.g]
        below = sum(s < x.score for s in own) * 100 / len(own)
        assert (x.cohort_n, x.cohort_median, x.percentile) == (len(own), round(float(np.median(own)), 1), round(below))
    got = {x.g: (x.n, x.median, x.upper_median) for x in validation.medians(frame, ["g"], "score").collect()}
    assert {g: got[g] for g in "ab"} == {g: (len(v), float(np.median(v)), v[len(v) // 2]) for g, v in cohort.items()}
    assert validation.medians(frame.limit(0), ["g"], "score").count() == 0


def test_best_weights_by_brute_force(spark):
    r = np.random.default_rng(5)
    rows = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(r.integers(0, 30, (200, 3)))]
    got = {x.weight: x.rho for x in validation.best_weights(spark.createDataFrame(rows, "k long, a double, b double, t double"), "a", "b", "t", "k").collect()}
    rank = lambda values: np.argsort(np.lexsort((np.arange(200), values)))
    for w, rho in got.items():
        want = np.corrcoef(rank([a * w + b * (1 - w) for _, a, b, _ in rows]), rank([t for *_, t in rows]))[0, 1]
        assert abs(rho - want) < 1e-9
