import re

import corpus_pipeline
from filingforge.llm import packing

from .fixtures import prose
from .test_decontaminate import brute
from .test_language import PACKS

ITEMS = [(1, prose(900, 30)), (2, prose(901, 20))]


def test_the_pipeline_keeps_what_is_clean(spark, tmp_path):
    rows = [(1000 + 3 * i + j, prose(3000 + 3 * i + j, 80, PACKS[lang]), lang) for i in range(40) for j, lang in enumerate(PACKS)]
    clean = {r[0] for r in rows}
    copied = rows[5]
    rows += [(9001, copied[1], copied[2]), (9002, copied[1], copied[2]), (9003, None, "en"), (9004, "12 34", "en"), (9005, ITEMS[0][1] + " the of", "en"), (9006, prose(77, 100, PACKS["en"]) + " password = hunter2hunter2", "en"), (None, prose(78, 90, PACKS["fr"]), None), rows[7]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words string, lang_pred string, spans string"
    spark.createDataFrame([(*r, "s", len(r[1] or ""), "x", "y", "z") for r in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{i}"))
        docs = spark.read.parquet(str(tmp_path / f"out{i}"))
        seen[name] = docs
        if i < 4:
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
    ids = {name: [r.doc_id for r in df.select("doc_id").collect()] for name, df in seen.items()}
    assert {9003, 9004}.isdisjoint(ids["language_id"]) and len(ids["language_id"]) == len(rows) - 2
    near = ids["simhash_near_dedup"]
    assert len(near) == len(set(near)) and {9001, 9002}.isdisjoint(near) and clean | {9005, 9006, None} == set(near)
    texts = {r.doc_id: r.text for r in seen["simhash_near_dedup"].collect()}
    dirty = {d for d, t in texts.items() if (b := brute(t, ITEMS))[1] > 0 and 20 * b[1] >= b[0]}
    assert set(ids["benchmark_decontamination"]) == set(near) - dirty and dirty == {9005}
    after = {r.doc_id: (r.text, r.n_chars) for r in seen["secret_scans"].collect()}
    assert set(after) == set(ids["benchmark_decontamination"]) and after[9006][0].endswith(" [secret]") and not re.search("hunter2", after[9006][0])
    assert all(after[d] == (texts[d], len(texts[d])) for d in clean)
    own = packing.WordTokenizer(packing.default_vocabulary())
    tokens = {}
    for r in seen["packing"].collect():
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert tokens == {d: len(own.ids(t)) // 4 + 1 for d, (t, _) in after.items()}


def test_null_and_empty_tables_pass_every_stage(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in ([], [(None, None, None, None, None), (1, "", None, None, None), (1, "", None, None, None)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, str(tmp_path)).count() >= 0
