import re
from itertools import combinations

import pytest

from probity.llm import url_filter

URLS = [
    ("https://a.Example.com/en/12", "a.example.com", "/en/12", "com/en/", "block"),
    ("https://a.example.com/en/71?x=1", "a.example.com", "/en/71", "example.com/en/7", "allow"),
    ("http://example.net/de/9#top", "example.net", "/de/9", "net/de/", "allow"),
    ("http://sub.example.net/de/80", "sub.example.net", "/de/80", "example.net/de/8", "block"),
    ("http://notexample.net/de/80", "notexample.net", "/de/80", "net/de/", "allow"),
    ("http://x.org/es/1", "x.org", "/es/1", "org/es/", "block"),
    ("http://xorg/es/1", "xorg", "/es/1", None, "allow"),
    ("http://x.org?q=/es/1", "x.org", "", None, "allow"),
    ("http://x.org", "x.org", "", None, "allow"),
    ("no scheme/en/", "", "", None, "allow"),
    ("a://b://c.com/en/1", "b:", "//c.com/en/1", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://ÀB.COM/en/1", "Àb.com", "/en/1", "com/en/", "block"),
]


def pages_of(spark, urls):
    return spark.createDataFrame([(i, u, "<html>", "v", i) for i, u in enumerate(urls)], "page_id long, url string, html string, verdict string, needed int")


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_hosts_paths_and_rules(spark):
    found = {r["page_id"]: r for r in url_filter.judge(pages_of(spark, [u[0] for u in URLS]), no_labels(spark)).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        r = found[i]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def brute(urls, labels, support, confidence, most):
    """Verdicts of the mined rules by listing all token sets."""
    def tokens(url):
        if url is None or "://" not in url:
            return set()
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0].lower()
        path = re.match("[^/?#]*([^?#]*)", rest)[1].lower()
        query = re.match("[^?#]*[?]([^#]*)", rest)
        parts = [("h:", re.split("[^a-z0-9-]+", host)), ("p:", re.split("[^a-z0-9_-]+", path)), ("q:", re.split("[^a-z0-9_-]+", query[1].lower() if query else ""))]
        return {k + x for k, xs in parts for x in xs if x and not x.isdigit()}

    rows = [(tokens(urls[i]), b) for i, b in labels]
    least = -(-support * len(rows) // 1)
    rules = set()
    for t, _ in rows:
        for n in range(1, most + 1):
            for s in combinations(sorted(t), n):
                having = [b for u, b in rows if set(s) <= u]
                if sum(having) >= max(url_filter.MIN_ROWS, least) and sum(having) >= confidence * len(having):
                    rules.add(s)
    return [any(set(s) <= tokens(u) for s in rules) for u in urls]


@pytest.mark.parametrize("limit", [20_000, 0])
def test_mined_rules_as_by_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "BROADCAST_INDEX_ROWS", limit)
    urls = [f"http://{'bad' if i % 3 == 0 else 'good'}.site{i % 4}.info/{'spam' if i % 5 == 0 else 'news'}/{i}?utm={i % 2}#x" for i in range(60)]
    labels = [(i, i % 3 == 0 and i % 5 == 0 or i % 7 == 0) for i in range(0, 60, 2)]
    table = spark.createDataFrame([(i, int(not b), 0, "extra") for i, b in labels] + [(999, 0, 1, ""), (None, 0, 1, "")], "doc_id long, quality int, toxic int, url string")
    out = url_filter.judge(pages_of(spark, [*urls, None, urls[0]]), table, min_support=0.05, min_confidence=0.6)
    found = {r["page_id"]: r["verdict"] for r in out.collect()}
    expected = brute(urls, labels, 0.05, 0.6, 9)
    assert any(expected) and not all(expected)
    assert [found[i] == "block" for i in range(60)] == expected
    assert found[60] == "allow" and (found[61] == "block") == expected[0]


def test_no_python_in_the_plan(spark):
    plan = url_filter.judge(pages_of(spark, [u[0] for u in URLS]), no_labels(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_tables(spark):
    assert url_filter.judge(pages_of(spark, []), no_labels(spark)).count() == 0


def test_long_urls_do_not_multiply(spark):
    """Forty tokens, fifty times, with labels of both kinds: one rule or none, not 2**40 sets."""
    long = "http://long.example/" + "/".join(f"part{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40))
    urls = [long] * 50 + [f"http://other.example/{'abcd'[i % 4]}" for i in range(50)]
    for share, blocked in ((2, True), (3, False)):
        table = spark.createDataFrame([(i, int(i % share > 0 or i >= 50), 0) for i in range(100)], "doc_id long, quality int, toxic int")
        verdicts = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages_of(spark, urls), table).collect()}
        assert all((verdicts[i] == "block") == (blocked and i < 50) for i in range(100))


def test_rules_of_many_tokens(spark):
    """Only five tokens together are blocked; any four of them are mostly allowed."""
    words = ["va", "vb", "vc", "vd", "ve"]
    urls = ["http://h.example/" + "/".join(words)] * 6
    for gone in words:
        urls += ["http://h.example/" + "/".join(w for w in words if w != gone)] * 3
    table = spark.createDataFrame([(i, int(i >= 6), 0) for i in range(len(urls))], "doc_id long, quality int, toxic int")
    out = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages_of(spark, urls), table).collect()}
    expected = brute(urls, [(i, i < 6) for i in range(len(urls))], url_filter.MIN_SUPPORT, url_filter.MIN_CONFIDENCE, 9)
    assert [out[i] == "block" for i in range(len(urls))] == expected
    assert expected == [i < 6 or e for i, e in enumerate(expected)]
