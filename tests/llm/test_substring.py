import re
from collections import Counter

import pytest

from filingforge.llm import substring

from .fixtures import documents, mixed_rows, prose


def brute(rows, length):
    split = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + length]) for w in split for i in range(len(w) - length + 1))
    out = []
    for (doc, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("length, gathered", [(35, 2_000_000), (8, 300)])
def test_like_brute_force(spark, length, gathered, monkeypatch):
    shared = prose(400, 90)
    rows = mixed_rows() + [(100 + i, prose(500 + i, 50) + " " + shared + " " + prose(600 + i, 50)) for i in range(6)]
    rows += [(200, " ".join(["la"] * 90)), (201, prose(700, 34)), (202, prose(700, 34)), (203, prose(701, 35)), (204, "x " + prose(701, 35)), (205, prose(702, 60) + " " + prose(702, 60)), (1, prose(1, 120)), (207, prose(703, 40)), (207, prose(703, 20) + " z"), (None, prose(704, 50)), (None, prose(704, 50) + " q")]
    monkeypatch.setattr(substring, "GATHERED", gathered)
    got = substring.remove_repeats(documents(spark, rows), length=length).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in got], key=str) == brute(rows, length)


def test_levels_double():
    assert substring.levels_of(35) == [9, 18, 35] and substring.levels_of(3) == [3]


def test_an_empty_table(spark):
    assert substring.remove_repeats(documents(spark, [(1, "a")]).limit(0)).count() == 0
