"""Sentence alignment against scoring every pair, and on large pairs."""

import random
import time

import numpy as np

from filingforge.operators import diff


def brute(current, prior, most=2000, threshold=diff.MATCH):
    vectors = diff.term_weights(current + prior, most)
    taken, out = set(), []
    for i, a in enumerate(vectors[: len(current)]):
        sims = np.round([sum(v * b[t] for t, v in sorted(a.items()) if t in b) for b in vectors[len(current) :]], 9).tolist()
        best = int(np.argmax(sims))
        if sims[best] >= threshold and best not in taken:
            taken.add(best)
            out.append((i, best, sims[best]))
    return out


def sentences(r, n, words):
    return [" ".join(r.choice(words) for _ in range(r.randrange(1, 9))) for _ in range(n)]


def test_like_scoring_all_pairs():
    r = random.Random(1)
    for case in range(60):
        words = ["the", "of", "risk", "x", ""] + [f"w{i}" for i in range(4 if case % 2 else 40)]
        prior = sentences(r, r.randrange(0, 30), words)
        current = [s if r.random() < 0.5 else s + " " + r.choice(words) for s in r.sample(prior, min(len(prior), 9))] + sentences(r, r.randrange(0, 20), words)
        for threshold in (0.2, diff.MATCH, 0.95):
            assert diff.align(current, prior, threshold=threshold) == (brute(current, prior, threshold=threshold) if current and prior else [])


def test_twenty_thousand_sentences():
    r = random.Random(2)
    common, rare = "the of and to in that is risk may our".split(), [f"word{i}" for i in range(4000)]
    prior = [" ".join([*r.choices(common, k=8), *r.choices(rare, k=6)]) for _ in range(20_000)]
    current = [p if i % 3 else p + " " + r.choice(rare) for i, p in enumerate(prior)]
    began = time.perf_counter()
    found = diff.align(current, prior)
    assert len(found) > 15_000 and time.perf_counter() - began < 60
