import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from filingforge.llm import merkle

from .fixtures import SCHEMA, mixed_rows

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return hashed(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLUMNS))


def tree(level):
    """The top and each node's siblings as (digest, stands before)."""
    spots, paths = list(range(len(level))), [[] for _ in level]
    while len(level) > 1:
        for i, at in enumerate(spots):
            run = [k for k in (at // 2 * 2, at // 2 * 2 + 1) if k < len(level) and k != at]
            paths[i] += [(level[k], k < at) for k in run] or [("", False)]  # hashed alone
        spots = [at // 2 for at in spots]
        level = [hashed(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda x: b"" if x is None else b"=" + x.encode())
    for g in groups.values():
        g.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
    trees = [tree([leaf_of(r) for r in groups[n]]) for n in names]
    root, upper = tree([t[0] for t in trees])
    out = []
    for name, (subroot, paths), rest in zip(names, trees, upper, strict=True):
        for r, path in zip(groups[name], paths, strict=True):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
            node = leaf_of(r | {"n_chars": r["n_chars"] + 1} if hit else r)
            for digest, before in path + rest:
                node = hashed(digest, node) if before else hashed(node, digest)
            out.append((r["doc_id"], leaf_of(r), subroot, root, hashed(*(d for d, _ in path + rest)), node, node == root))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, s, n, *["x"] * 8) for d, t, lang, s, n in rows], SCHEMA).toDF(*SCHEMA.replace(" long", "").replace(" string", "").split(", ")).withColumnRenamed("at", "tree").withColumnRenamed("fp", "digest").withColumnRenamed("shard", "place").repartition(3)


def got(docs, **options):
    more = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return sorted((tuple(r) for r in merkle.verified(merkle.manifest(docs, changed={"n_chars": more}, **options)).collect()), key=str)


def sample(n, langs):
    r = [(i, f"text {i}", langs[i % len(langs)], "s", i if i % 5 else None) for i in range(n)]
    return r + [(d, t, None, "s", 3) for d, t in mixed_rows()] + [(3, None, "en", None, None), (3, "again", "en", "s", 1), (3, "again", "en", "s", 1), (None, "no id", "en", "s", 2), (None, None, None, None, None)]


@pytest.mark.parametrize(("n", "langs", "options"), [(150, ["en", "de", "en", "é", "-", ""], {"block_bits": (2, 2), "tops": 3}), (90, ["en"], {"block_bits": (3, 5), "tops": 4}), (70, ["en", None, "fr"], {})])
def test_like_brute_force(spark, n, langs, options):
    rows = sample(n, langs)
    named = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows]
    result = got(frame(spark, rows), **options)
    assert result == brute(named)
    untouched = [r for r in result if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7]
    assert all(r[-1] for r in untouched) and not all(r[-1] for r in result)


def test_many_groups_and_small_tables(spark):
    rows = [(i, "t", f"g{i % 40}", "s", 1) for i in range(120)]
    named = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows]
    assert got(frame(spark, rows), block_bits=(1, 1), tops=2) == brute(named)
    for few in (rows[:1], rows[:2], [rows[0], rows[40], rows[80]]):
        assert got(frame(spark, few)) == brute([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in few])
    assert got(frame(spark, rows).limit(0)) == []


def test_a_changed_value_is_found(spark):
    """A row that was changed in any column doesn't fold to the root; the others do."""
    docs = frame(spark, sample(40, ["en", "de"])).where("doc_id between 10 and 30 and lang is not null").dropDuplicates(["doc_id"])
    for column, value in (("text", F.lit("other")), ("source", F.lit(None).cast("string")), ("lang", F.lit("xx")), ("doc_id", F.lit(-1).cast("long"))):
        found = merkle.verified(merkle.manifest(docs, changed={column: F.when(F.col("doc_id") == 17, value).otherwise(F.col(column))}))
        assert [r.doc_id for r in found.where("not verified").collect()] == [17]
