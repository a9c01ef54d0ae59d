import re

import pytest

from filingforge.llm import decontaminate

from .fixtures import documents, mixed_rows, prose

ITEMS = [("a", prose(9, 40)), ("b", prose(10, 13)), ("c", "One two"), ("d", "ONE"), ("e", None), ("f", " .. "), ("g", prose(9, 40)), (None, prose(11, 30)), ("h", prose(12, 20)), ("10", "zwölf élan"), ("9", prose(13, 12))]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    """Words hit by windows of any item; an item without an id hits words, but is not listed."""
    own, hit, found, places = words(text), set(), set(), {}
    for item, t in items:
        w = words(t)
        n = min(13, len(w))
        if n and n not in places:
            places[n] = {}
            for i in range(len(own) - n + 1):
                places[n].setdefault(tuple(own[i : i + n]), []).append(i)
        for g in {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else ():
            for i in places[n].get(g, ()):
                hit.update(range(i, i + n))
                if item is not None:
                    found.add(item)
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 120])
def test_like_brute_force(spark, block_bytes):
    rows = mixed_rows()
    rows += [(110, "before " + prose(11, 30) + " behind"), (111, prose(11, 30)[20:]), (112, "one " * 30_000), (113, (prose(9, 40) + " ") * 200), (114, "x" * 200_000 + " " + prose(10, 13)), (100, prose(20, 60) + " " + prose(9, 40) + " " + prose(21, 60)), (101, prose(10, 13)), (102, prose(9, 40)[10:]), (103, "x " + prose(9, 40).upper() + " y"), (104, prose(12, 12)), (105, "zwölf-ÉLAN zwölf élan"), (106, prose(9, 14) + " " + prose(9, 40)), (101, prose(10, 13)), (None, "one")]
    docs = documents(spark, rows)
    bench = spark.createDataFrame([(i, t, 1) for i, t in ITEMS] + [("a", prose(9, 40), 1)], "item_id string, text string, n_hit int")
    got = decontaminate.contamination(docs, bench, block_bytes=block_bytes).collect()
    assert len(got) == len(rows)
    texts = {}
    for d, t in rows:
        texts[d] = t
    for r in got:
        n, hit, items = brute(texts[r.doc_id], ITEMS)
        assert (r.n_words, r.n_hit, r.items) == (n, hit, items), r.doc_id
        assert sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2])) == hit


def test_no_benchmark_and_no_documents(spark):
    docs = documents(spark, [(1, "one two"), (2, None)])
    none = spark.createDataFrame([], "item_id long, text string")
    assert {(r.doc_id, r.n_words, r.n_hit) for r in decontaminate.contamination(docs, none).collect()} == {(1, 2, 0), (2, 0, 0)}
    assert decontaminate.contamination(docs.limit(0), none).count() == 0
