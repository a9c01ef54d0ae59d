"""Small tables with nulls, empty and long texts, ties, repeated rows and columns whose names clash."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size string, fp string, spans string, shard string, n_words string, at string, score string"
WORDS = "the of and to in that is was for with on are this be have from or had by but what all were when we there can an your which their said".split()


def prose(seed: int, n: int, words=WORDS) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(words) + r.choice(["", "", "", ",", "."]) for _ in range(n))


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", None if r[1] is None else len(r[1]), *["x"] * 8) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def mixed_rows() -> list[tuple]:
    base = prose(1, 120)
    return [
        (1, base), (2, base), (3, base + " more words here"), (4, None), (5, ""), (6, "   \n\t "), (7, "one"), (8, "one two"), (9, prose(2, 400) + " " + base), (10, "é ü 日本語 текст " * 20),
        (11, prose(3, 6000)), (12, "x" * 70_000), (13, base.upper()), (14, base.replace(" ", "\n", 3)), (15, "Ünïcode " + prose(5, 50)), (16, "one"), (17, prose(3, 300)),
    ]
