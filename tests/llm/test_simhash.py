import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from filingforge.llm import components, simhash

from .fixtures import documents, mixed_rows, prose


def fingerprint(text, width=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes: dict[int, int], distance=3) -> dict[int, int]:
    least = {k: k for k in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if (nodes[a] ^ nodes[b]).bit_count() <= distance and least[b] < least[a]:
                    least[a], changed = least[b], True
    return least


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("text", [r[1] for r in mixed_rows()[:11]] + ["a", "a b", "a b c", "A\tB\x0bC\x85d", "a\xa0b c d"])
def test_fingerprints(text):
    assert simhash.simhash((text or "").encode()) == fingerprint(text)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=3, unique=True))
def test_near_fingerprints_share_a_bucket_that_links_them(a, flips):
    b = a
    for f in flips:
        b ^= 1 << f
    keys = simhash.keys_of(np.array([a, b], np.uint64))
    shared = set(keys[0].tolist()) & set(keys[1].tolist())
    assert shared
    if a != b:
        assert any(simhash.bucket_links(np.array([a, b], np.uint64), (k >> 32) // 3, 3) for k in shared)


def test_links_are_never_too_far():
    r = np.random.default_rng(1)
    fps = np.unique(r.integers(0, 2**64, 400, dtype=np.uint64) & np.uint64(0xFFFFFFFF0000000F))
    for a, b in simhash.bucket_links(fps, 0, 3):
        assert (a ^ b).bit_count() <= 3


def test_components_are_those_of_all_pairs(spark):
    rows = mixed_rows() + [(50 + i, prose(77, 500) + f" tail{i}") for i in range(25)] + [(200 + i, prose(200 + i, 60)) for i in range(40)]
    docs = documents(spark, rows)
    got = {r.doc_id: (r.fp, r.component) for r in simhash.near_duplicates(docs).collect()}
    want = {d: fingerprint(t) for d, t in rows}
    assert {d: f for d, (f, _) in got.items()} == {d: signed(f) for d, f in want.items()}
    assert {d: c for d, (_, c) in got.items()} == brute_components(want)


@pytest.mark.parametrize("block", [3, 2000])
def test_a_dense_group_in_blocks(spark, block):
    r = np.random.default_rng(5)
    centre = 0x0123456789ABCDEF
    fps = {centre}
    for _ in range(60):
        x = centre
        for f in r.choice(64, size=int(r.integers(1, 6)), replace=False):
            x ^= 1 << int(f)
        fps.add(x)
    frame = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    links = simhash.near_links(frame, block=block)
    parts = {x.node: x.component for x in components.connected_components(links).collect()}
    want = brute_components({signed(f): f for f in fps})
    assert {n: parts.get(n, n) for n in want} == want


def test_chains_and_cycles(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = documents(spark, [(1, "a b c"), (1, "a b c"), (None, "x y z"), (2, "a b c")])
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == 4 and {(r.doc_id, r.component) for r in rows} == {(1, 1), (2, 1), (None, None)}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
