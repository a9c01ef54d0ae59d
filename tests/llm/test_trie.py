import hashlib
import random
import re
import zlib

import pytest

from filingforge.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth string, words string, family string, digest string, ends string"


def digest_of(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows, span=20, shared=trie.shared_turns):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn, role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(x, key=lambda y: (y[0] is not None, y[0] or 0, digest_of(*y[1:])))] for c, x in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        rest = c - int(c / span) * span  # the sign of c
        head = own.get(c - rest, [])[: shared(c)]
        rebuilt = tuple(head + turns[shared(c) :])
        for d in range(len(rebuilt) + 1):
            members.setdefault(rebuilt[:d], []).append(c)
        ends.setdefault(rebuilt, []).append(c)
    children = {n: [m for m in members if m and m[:-1] == n] for n in members}
    words = {n: len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0 for n in members}
    out = []

    def sums(node):
        below = [sums(k) for k in children[node]]
        leaves = sum(x[0] for x in below) or 1
        saved = (len(members[node]) - 1) * words[node] + sum(x[1] for x in below)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]), leaves, saved, sha))
        return leaves, saved

    if members:
        sums(())
    return sorted(out, key=str)


def got(spark, rows, **options):
    frame = spark.createDataFrame([(*r, *["x"] * 6) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in trie.prefix_trie(frame, **options).drop("node", "parent").collect()), key=str)


def sample(seed, convs, *, low=0):
    r = random.Random(seed)
    texts = ["", None, "one", "two words", " a\tb\nc ", "é 日本語", "x " * 2000]
    rows = []
    for c in range(low, low + convs):
        if r.random() < 0.9:  # some bases are absent
            rows += [(c, t if r.random() < 0.9 else None, r.choice(["user", "assistant", None]), r.choice(texts)) for t in range(r.randrange(1, 8))]
    return rows


@pytest.mark.parametrize("options", [{}, {"family_nodes": 5}, {"family_nodes": 1}, {"span": 7, "shared": lambda c: (c * 5) % 3}])
def test_like_brute_force(spark, options):
    """Families in one part and in many, ids on both sides of zero, turns without numbers, of equal numbers, repeated rows."""
    rows = sample(1, 90, low=-45)
    rows += [(c, t, "user", f"same {t}") for c in (200, 201, 217, 240, 260, 261, 300) for t in range(6)]  # copies in several families
    rows += rows[:3] + rows[-4:] + [(301, None, None, None), (302, 1, "a", "tie"), (302, 1, "b", "tie"), (None, 1, "user", "none")]
    plain = {k: v for k, v in options.items() if k != "family_nodes"}
    assert got(spark, rows, **options) == brute(rows, **plain)


def test_deep_conversations_and_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(trie, "HOT_CHILDREN", 3)
    monkeypatch.setattr(trie, "HOT_SHARE", 0.0)
    monkeypatch.setattr(trie, "RANGE", 16)
    rows = [(c, t, "user", f"turn {t}") for c in (0, 20, 41, 60) for t in range(70 if c != 60 else 40)]
    rows += [(c, 0, "user", "hot first turn") for c in range(400, 520)] + [(c, 1, "assistant", f"answer {c}") for c in range(400, 520, 2)]
    assert got(spark, rows) == brute(rows)
    assert zlib.crc32(b"0") % 4 == trie.shared_turns(0)


def test_small_tables(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "x")]) == []
    for rows in ([(40, 1, "u", "a b")], [(3, 1, "u", "x")], [(23, 0, "u", "only turn, and none of its base")]):
        assert got(spark, rows) == brute(rows)
