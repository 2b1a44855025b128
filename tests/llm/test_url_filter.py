from tessella.llm import url_filter
from tessella.llm.queries import URL_RULES

URLS = [
    "https://www.example.com/en/x", "http://EXAMPLE.com/en/", "http://example.com/en", "http://example.com", "http://a.b.net/es/?q", "http://net/fr/", "http://xnet/fr/", "http://a.net/FR/", "ftp://u@h.com:80/p", "http://h.com/p://q", "example.com/en/", "", None, "://", "://com/",
    "http:///path", "http://a.com#/x", "http://a.com?x=/en/", "http://.com/", "http://com./", "HTTP://WWW.EXAMPLE.COM/en/#f", "http://É.com/é/", "http://" + "a." * 500 + "com/" + "x/" * 500, "http://a.com/\n/en/", "http://a.org/en/",
]


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
        host, rest = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[cut:]
        path = rest[: min([i for c in "?#" if (i := rest.find(c)) >= 0], default=len(rest))]
    fit = [(len(h) + len(p), len(h), v, h + p) for v, h, p in rules if h and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return url, host, path, best[3] if best else None, best[2] if best else default


def test_against_plain_python(spark):
    urls = spark.createDataFrame([(i % 7, u, "clash") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    for rules in (URL_RULES, [*URL_RULES, ("block", "com", ""), ("block", "b.net", "/es"), ("allow", "", "/"), ("block", None, "/"), ("block", "org", None), ("block", "com", "/")]):
        got = sorted((tuple(r[c] for c in ("url", "host", "path", "rule", "verdict")) for r in url_filter.judge(urls, url_filter.rules_table(spark, rules)).collect()), key=repr)
        assert got == sorted((brute(u, rules) for u in URLS * 2), key=repr)


def test_empty(spark):
    urls = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(urls, url_filter.rules_table(spark, URL_RULES)).count() == 0
    some = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert url_filter.judge(some, url_filter.rules_table(spark, []), "block").first()["verdict"] == "block"
