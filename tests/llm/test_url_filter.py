import re

from issuesift.llm import url_filter

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
         ("example.com", "/en/a", "allow"), ("example.com", "/en/a/b", "block"), ("example.com", "/en/c", "allow"),
         ("Shop.org", "", "block"), ("example.com", "/en/", "block"), ("x.y", "no-slash", "block"), (None, "/", "block"), ("q.com", None, "block")]


def judge(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url) if url is not None else None
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h), len(p), h.lower() + p, v) for h, p, v in rules if h and p is not None
            and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


URLS = ["https://WWW.Example.com/en/a/b/c?q=1#x", "http://a.example.com/en/ab", "http://example.com/en/a/b", "http://example.com/en/b",
        "http://example.com/en/cc", "http://example.com/e", "http://example.com", "http://notexample.com/en/", "ftp://a.b.net/es/1", "http://net/es/",
        "http://a.net/fr/", "http://shop.org", "http://eu.shop.org?x=/a", "no scheme", "", None, "://com/x", "http:///path", "http://ÄX.com/ü", "a://b://c.com/x"]


def test_verdicts_match_brute_force(spark):
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(0, URLS[0], "copy"), (None, URLS[1], "h"), (None, None, "h")]
    rows += [(100 + i, f"http://h{i % 7}.example.com/en/{'abc'[i % 3]}/{i}", "h") for i in range(900)]  # a hot host
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", url_filter.F.lit("clash")).withColumn(
        "rule", url_filter.F.lit(1)).withColumn("path", url_filter.F.lit("/"))
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted(map(str, (tuple(r) for r in url_filter.judge_urls(pages, rules).collect())))
    assert got == sorted(str((i, *judge(u, RULES))) for i, u, _ in rows)


def test_no_rules_and_no_pages(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.judge_urls(pages, rules, default="block").collect()] == [(1, "a.com", "/", None, "block")]
    full = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert url_filter.judge_urls(pages.where("page_id = 0"), full).count() == 0
