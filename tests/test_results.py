"""Results kept by content: what a second run computes."""

import os

from pyspark.sql import functions as F

from filingforge.sources import results

SCHEMA = "n_chars int, digest string"


def run(spark, rows, path, versions=None, fail=False):
    seen = spark.sparkContext.accumulator(0)

    def compute(missing):
        def each(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                if fail:
                    raise ValueError("a task dies")
                yield batch

        kept = missing.mapInArrow(each, missing.schema)
        return kept.select("cache_key", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))

    frame = spark.createDataFrame(rows, "id int, text string, lang string, digest_of string").repartition(2)
    out = results.cached(frame, compute, path, columns=["text", "lang"], versions=versions or {"metrics": "1"}, schema=SCHEMA)
    return {r.id: (r.n_chars, r.cache_new) for r in out.collect()}, seen.value


ROWS = [(1, "one", "en", "x"), (2, "two words", "en", "x"), (3, "one", "en", "x"), (4, "one", None, "x"), (5, None, "en", "x"), (6, "", "en", "x")]


def test_a_second_run_computes_nothing(spark, tmp_path):
    path = str(tmp_path / "results")
    got, computed = run(spark, ROWS, path)
    assert computed == 5 and got == {1: (3, True), 2: (9, True), 3: (3, True), 4: (3, True), 5: (None, True), 6: (0, True)}
    got, computed = run(spark, ROWS, path)
    assert computed == 0 and not any(new for _, new in got.values()) and got[2][0] == 9
    assert len(results.runs(spark, path)) == 1  # nothing new, no new run
    changed = [(2, "three short words", "en", "y") if r[0] == 2 else r for r in ROWS]
    got, computed = run(spark, changed, path)
    assert computed == 1 and [i for i, (_, new) in got.items() if new] == [2] and got[2][0] == 17
    got, computed = run(spark, ROWS, path, versions={"metrics": "2"})
    assert computed == 5 and all(new for _, new in got.values())
    got, computed = run(spark, ROWS, path)  # the old version's results are still there
    assert computed == 0


def test_a_run_that_dies_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "results")
    try:
        run(spark, ROWS, path, fail=True)
        raise AssertionError("it should have failed")
    except AssertionError:
        raise
    except Exception as error:
        assert "a task dies" in str(error)
    assert results.runs(spark, path) == []
    got, computed = run(spark, ROWS, path)
    assert computed == 5 and got[2] == (9, True) and len(results.runs(spark, path)) == 1


def test_two_writers_and_leftovers(spark, tmp_path):
    path = str(tmp_path / "results")
    run(spark, ROWS[:2], path)
    key = spark.createDataFrame(ROWS[:1], "id int, text string, lang string, d string").select(results.content_key(["lang", "text"], {"metrics": "1"}).alias("cache_key"))
    results.commit(spark, key.select("cache_key", F.lit(3).alias("n_chars"), F.md5(F.lit("one")).alias("digest")), path)  # by another writer
    os.makedirs(f"{path}/_halfway")
    got, computed = run(spark, ROWS, path)
    assert computed == 3 and len(got) == len(ROWS) and got[1] == (3, False)


def test_keys(spark):
    rows = spark.createDataFrame([("a", "b"), ("ab", ""), ("ab", None), (None, "ab"), ("a", "b")], "x string, y string")
    keys = [r[0] for r in rows.select(results.content_key(["x", "y"], {"v": "1"})).collect()]
    assert len(set(keys)) == 4 and keys[0] == keys[4]
    assert rows.select(results.content_key(["y", "x"], {"v": "1"})).first()[0] == keys[0] != rows.select(results.content_key(["x", "y"], {"v": "2"})).first()[0]
