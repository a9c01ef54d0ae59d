import re

import pytest
from pyspark.sql import functions as F

from filingforge.functions import term_packs as P
from filingforge.functions import text as T

TEXTS = [
    "We may face material-weakness issues. It's 3m of über value! No?  Yes.", "", "   ", "One.Two. Three", "subject to change; remains uncertain... may", "e.g. this. And 5. that",
    "$1,200.50 and 12.5% on March 3, 2022 or 1999", "going  concern\nGOING-CONCERN goingconcern", "a_b c1 d", "Tail. ", "x" * 3000 + ". end",
]


def py_tokens(t):
    return [w for w in re.findall(r"\w+", t.lower()) if re.fullmatch("[a-z]+", w)]


def py_sentences(t):
    return [s for s in re.split(r"[.!?]+\s+", t.strip()) if s.strip()] if t.strip() else []


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").withColumns({"tokens": T.tokens("text"), "lower": F.lower("text"), "sentences": T.sentences("text")})


def test_tokens_and_sentences(frame):
    for r in frame.collect():
        assert r.tokens == py_tokens(TEXTS[r.id]) and r.sentences == py_sentences(TEXTS[r.id])


def test_phrases(frame):
    phrases = ["going concern", "may", "material weakness", "subject to", "subject to change", "uncertain", "remains uncertain"]
    for r in frame.select("id", T.phrase_hits("lower", phrases).alias("n"), T.phrases_present("lower", phrases).alias("p")).collect():
        low = TEXTS[r.id].lower()
        counts = [len(re.findall(T.phrase_pattern(p), low)) for p in phrases]
        assert (r.n, r.p) == (sum(counts), sum(c > 0 for c in counts))


def test_numbers(frame):
    got = {r.id: r.n for r in frame.select("id", T.numeric_tokens("text").alias("n")).collect()}
    assert got[6] == ["1200.50", "pct:12.5", "march 3 2022", "1999"] and got[0] == ["3"] and got[1] == []


def test_intensity(spark):
    words = ["filler"] * 30
    words[15] = "ransomware"
    near, far = words.copy(), words.copy()
    near[5], far[4] = "severe", "severe"
    rows = [(0, " ".join(words)), (1, " ".join(near)), (2, " ".join(far)), (3, "a data breach was severe. data-breach"), (4, "nothing")]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("tokens", T.tokens("text"))
    got = {r.id: r.v for r in df.select("id", T.topic_intensity("text", "tokens", ["ransomware", "data breach"], P.SEVERITY).alias("v")).collect()}
    assert got == {0: 1.0, 1: 1.5, 2: 1.0, 3: 3.0, 4: 0.0}


def test_packs_are_complete():
    assert (len(P.NEGATIVE), len(P.UNCERTAINTY), len(P.LITIGIOUS), len(P.CONSTRAINING), len(P.TermPacks().modal)) == (45, 33, 35, 33, 18)
    assert len(P.FLAG_PATTERNS) == len(P.FLAG_SCOPES) == 13 and len(P.TOPICS) == 23 and set(P.FLAG_SUPPRESSIONS) <= set(P.FLAG_PATTERNS)
    assert P.form_base("10-k/a") == "10-K" and P.form_base("10-Q/A") == "10-Q" and P.form_base("20-F") == "10-K"
