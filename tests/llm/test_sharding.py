import math
import re
import zlib

import numpy as np
import xxhash

from filingforge.llm import sharding

from .fixtures import documents, mixed_rows, prose


def test_shards_slots_and_balance(spark):
    rows = mixed_rows() + [(100 + i, prose(i % 700, 20 + i % 60)) for i in range(1500)] + [(5000 + i, "hot " * 10) for i in range(900)] + [(100, prose(0, 20)), (None, "no id"), (None, None)]
    docs = documents(spark, rows)
    got = sharding.shard_documents(docs, 6).collect()
    assert len(got) == len(rows)
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append((t or "").encode())
    for r in got:
        assert any(r.size == len(t) + 8 and r.text_crc32 == zlib.crc32(t) for t in texts[r.doc_id])
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 6
    sizes = np.bincount([r.shard for r in got], weights=[r.size for r in got], minlength=6)
    assert sizes.max() <= 1.06 * sizes.mean()
    for s in range(6):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    # Equal texts stay together unless their group is heavy.
    light = {}
    for r in got:
        if r.size != len("hot " * 10) + 8:
            light.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(x) == 1 for x in light.values())
    assert len({r.shard for r in got if r.size == len("hot " * 10) + 8}) > 1
    assert sharding.shard_documents(docs.limit(0), 6).count() == 0


def test_packing_balances_each_dimension():
    r = np.random.default_rng(0)
    units = np.stack([r.lognormal(3, 1, 3000), r.lognormal(2, 1, 3000), np.ones(3000)], axis=1)
    place = sharding.pack_vectors(units, 24)
    for d in range(3):
        sums = np.bincount(place, weights=units[:, d], minlength=24)
        assert sums.max() < 1.1 * sums.mean()
    assert len(sharding.pack_vectors(np.zeros((0, 3)), 24)) == 0


def brute(rows, shards):
    """The shard of every text whose group isn't cut, by plain loops: groups, bundles by hash, then one unit after the other."""
    groups = {}
    for _, text in rows:
        data = (text or "").encode()
        g = groups.setdefault(data, np.zeros(3))
        g += [len(data) + 8, len(re.findall(r"[^\x20\x09-\x0D]+", text or "")), 1]
    total = sum(groups.values())
    limit = np.maximum(total * sharding.HEAVY / shards, 1)
    assert not any(g[2] > 1 and (g > limit).any() for g in groups.values())
    hashed = lambda data: xxhash.xxh64_intdigest(data, 42) - (1 << 64 if xxhash.xxh64_intdigest(data, 42) >> 63 else 0)
    bundles = {}
    of = {d: hashed(hashed(d).to_bytes(8, "little", signed=True)) % (shards * sharding.BUNDLES_PER_SHARD) for d in groups}
    for d, g in groups.items():
        bundles[of[d]] = bundles.get(of[d], np.zeros(3)) + g
    names = sorted(bundles)
    share = [x / shards or 1 for x in total]
    scaled = {n: [v / s for v, s in zip(bundles[n], share)] for n in names}
    w = sharding.WEIGHTS.tolist()
    weight = lambda u: u[0] * w[0] + u[1] * w[1] + u[2] * w[2]
    dot = lambda a, u: a[0] * (u[0] * w[0]) + a[1] * (u[1] * w[1]) + a[2] * (u[2] * w[2])
    left, placed = [[1.0] * 3 for _ in range(shards)], {}
    for n in sorted(names, key=lambda n: -weight(scaled[n])):
        unit = scaled[n]
        fits = [k for k in range(shards) if all(a >= b for a, b in zip(left[k], unit))] or [k for k in range(shards) if left[k][0] >= unit[0]]
        best = max(fits, key=lambda k: (dot(left[k], unit), -k)) if fits else max(range(shards), key=lambda k: (left[k][0], -k))
        left[best] = [a - b for a, b in zip(left[best], unit)]
        placed[n] = best
    return {d: placed[of[d]] for d in groups}, [math.fsum(g[0] for d, g in groups.items() if placed[of[d]] == k) for k in range(shards)]


def test_like_brute_force(spark):
    rows = [(i, prose(i % 400, 5 + i % 90)) for i in range(900)] + [(5000, None), (5001, ""), (5002, "日本語" * 40)]
    place, sizes = brute(rows, 5)
    got = sharding.shard_documents(documents(spark, rows), 5).collect()
    texts = dict(rows)
    assert len(got) == len(rows) and all(r.shard == place[(texts[r.doc_id] or "").encode()] for r in got)
    assert all(r.tokens == len((texts[r.doc_id] or "").split()) for r in got)
    assert sizes == [sum(r.size for r in got if r.shard == k) for k in range(5)]


def test_a_key_that_repeats_thousands_of_times(spark):
    rows = [(7, f"text {i}") for i in range(4000)] + [(None, "same")] * 300
    got = sharding.shard_documents(documents(spark, rows), 4).collect()
    assert len(got) == 4300 and all(sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got))) for k in range(4))
