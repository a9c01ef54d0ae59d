import pytest

from filingforge.llm import url_filter

CASES = [
    ("https://www.Example.com/en/1?x=/es/", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("http://m.example.com/en/1", "m.example.com", "/en/1", "example.com/en/", "block"),
    ("http://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
    ("http://a.net/fr/x#y", "a.net", "/fr/x", "net/fr/", "block"),
    ("http://a.net/es", "a.net", "/es", None, "allow"),
    ("http://x.com", "x.com", "", None, "allow"),
    ("http://casino-win.example.org/de/1", "casino-win.example.org", "/de/1", None, "block"),
    ("http://a.org/CASINO_WIN?q", "a.org", "/CASINO_WIN", None, "block"),
    ("http://a.org/win-casino", "a.org", "/win-casino", None, "allow"),
    ("no scheme casino-win", "", "", None, "block"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("ftp://?q", "", "", None, "allow"),
    ("http://É.ORG/\n/x", "É.org", "/\n/x", None, "allow"),
    ("http://com/" + "a" * 9000, "com", "/" + "a" * 9000, "com/", "allow"),
]


def test_cases(spark):
    rows = [(i, c[0], "x", "y") for i, c in enumerate(CASES)] + [(0, CASES[0][0], "x", "y")]
    frame = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    got = url_filter.judge_urls(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == CASES[r.page_id][1:], CASES[r.page_id][0]
    assert url_filter.judge_urls(frame.limit(0)).count() == 0


@pytest.mark.parametrize("counts, want", [({"casino": 5, "win": 9}, "casino"), ({"casino": 5, "win": 2}, "win"), ({}, "casino")])
def test_rules_lie_under_their_rarest_token(counts, want):
    assert want in url_filter.index_rules(url_filter.PATTERN_RULES[:1], counts)
