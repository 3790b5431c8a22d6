import math
from collections import Counter

from pyspark.sql import functions as F

from barloom.llm import url_filter
from barloom.llm.url_filter import Rule

RULES = (Rule("org/", True), Rule("example.org/es/", False), Rule("example.org/en/1", False), Rule("com/fr/", True))
PAGES = "page_id long, url string, html string, host string, label string"
CASES = [
    ("http://A.Example.ORG/en/12?x=/es/", "a.example.org", "/en/12", "example.org/en/1", "block"),
    ("https://example.org/es/1", "example.org", "/es/1", "example.org/es/", "block"),
    ("https://example.org/ES/1", "example.org", "/ES/1", "org/", "allow"),
    ("https://badexample.org/es/1", "badexample.org", "/es/1", "org/", "allow"),
    ("https://x.com/fr/a#y", "x.com", "/fr/a", "com/fr/", "allow"),
    ("https://x.com/de/", "x.com", "/de/", None, None), ("https://x.org", "x.org", "", None, None),
    ("https://x.org?q=://y/z", "x.org", "", None, None), ("no url", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None),
    ("://x.org/a b", "x.org", "/a b", "org/", "allow"), ("http://É.org/", "É.org", "/", "org/", "allow"), ("http://x.org/" + "p/" * 20_000, "x.org", "/" + "p/" * 20_000, "org/", "allow"),
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, c[0], "", "x", "x") for i, c in enumerate(CASES)] + [(0, CASES[0][0], "", "x", "x")], PAGES)
    got = url_filter.judge(pages, RULES).collect()
    assert len(got) == len(CASES) + 1
    for row in got:
        _, host, path, rule, verdict = CASES[row.page_id]
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == verdict if verdict else row.verdict in ("allow", "block")


def test_entropy(spark):
    for text in ("", "a", "aaaa", "abcd", "http://x.org/éé"):
        want = -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values()) if text else 0.0
        got = spark.range(1).select(url_filter.entropy(F.lit(text))).first()[0]
        assert abs(got - want) < 1e-9


def test_trees_learn_from_labelled_urls(spark):
    rows = [(i, f"http://site{i % 7}.net/{'a/' * (i % 3)}p{i}" if i % 2 else f"http://site{i % 7}.net/x?a={i * 7919}&b={i}&c=1&d=2", "", "x", "x") for i in range(400)]
    pages = spark.createDataFrame(rows, PAGES)
    labels = pages.where("page_id < 200").select("url", (F.col("page_id") % 2 == 0).cast("int").alias("blocked"))
    got = url_filter.judge(pages, (), labels).where("page_id >= 200").collect()
    assert sum((r.verdict == "block") == (r.page_id % 2 == 0) for r in got) >= 190


def test_one_class_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://x.net/a", "", "x", "x")], PAGES)
    for value, verdict in ((1, "block"), (0, "allow")):
        labels = spark.createDataFrame([("http://y.net/b", value), (None, 1), ("http://z.net/", None)], "url string, blocked int")
        assert url_filter.judge(pages, (), labels).first().verdict == verdict
    assert url_filter.judge(pages, RULES).first().verdict == "allow"
    assert url_filter.judge(pages.limit(0), RULES).count() == 0
