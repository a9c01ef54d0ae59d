import re

from pyspark.sql import functions as F

from filingforge.functions import term_packs as P
from filingforge.functions import text as T
from filingforge.operators import diff
from filingforge.plans import diff_queries

PLAIN = lambda p: r"(?<![a-z0-9])" + r"[\s-]+".join(re.escape(x) for x in re.split(r"[\s-]+", p.lower()) if x) + r"(?![a-z0-9])"
TEXTS = ["", "going concern", "ongoing concern", "going-concern_x", "a going\n concern2", "AI/data, ai data; fx", "xgoing concern going  concern", "tax", "taxes-tax", "the éfx fx", "cease-and-desist order"]


def test_phrase_patterns_begin_with_letters_and_find_the_same():
    for packs in (*P.TOPICS.values(), *P.FLAG_PATTERNS.values(), *P.DENSITIES.values(), P.LEGAL_REGULATORY):
        for p in packs:
            assert T.phrase_pattern(p).startswith(re.escape(re.split(r"[\s-]+", p.lower())[0]))
            for t in (*TEXTS, p, f"x{p}", f"{p}s {p.replace(' ', '-')}"):
                assert [m.span() for m in re.finditer(T.phrase_pattern(p), t.lower())] == [m.span() for m in re.finditer(PLAIN(p), t.lower())]


def test_runs_stand_for_phrases(spark):
    every = [w for words in P.TOPICS.values() for w in words]
    texts = [*TEXTS, *every, *[f"x{w} {w}y" for w in every], *[f"({w.upper()})" for w in every]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").withColumn("lower", F.lower("text"))
    got = df.select("id", diff.topics_in("lower", P.TermPacks()).alias("t"), T.phrase_hits("lower", every).alias("n")).collect()
    for r in got:
        low = texts[r.id].lower()
        assert r.t == sorted(t for t, words in P.TOPICS.items() if any(re.search(PLAIN(w), low) for w in words))
        assert r.n == sum(len(re.findall(PLAIN(w), low)) for w in every)


def test_tokens_are_whole_runs_of_letters(spark):
    texts = ["aé a_b ab 1a a1 été The END", "x-y z", "", "ß ab_ _ab ab"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.t for r in df.select(T.tokens("text").alias("t")).collect()] == [[w for w in re.findall(r"\w+", t.lower()) if re.fullmatch("[a-z]+", w)] for t in texts]


def test_sections_meet_priors_as_bare_texts(spark):
    out = diff_queries.scores_with_priors(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 1  # filings' diffs stand in the rows of their sections
    below = plan[plan.index(joins[0]) :]
    assert "regexp_extract_all" not in below  # texts are taken apart once they have met
