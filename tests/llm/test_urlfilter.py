import random

from tessera.llm import urlfilter

RULES = "host string, path string, verdict string"


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        cut = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
        path = rest[:cut]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


def check(spark, urls, rules, **more):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = urlfilter.judge(pages, spark.createDataFrame(rules, RULES), **more).collect()
    assert len(got) == len(urls)
    assert all((r.host, r.path, r.rule, r.verdict) == brute(r.url, rules) for r in got)


def test_random_urls_and_nested_rules(spark):
    rng = random.Random(5)
    hosts = ["com", "a.com", "b.a.com", "xa.com", "net", "a.net", "", "A.com", "é.net"]
    paths = ["/", "/e", "/en/", "/en/x", "/en/xy/", "/enz", "", "/é/", "/en/x\n"]
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h in hosts[:6] for p in paths if rng.random() < 0.6}.values())
    urls = [
        rng.choice(["http", "", "ftp"]) + rng.choice(["://", "://", "://", ":/"]) + rng.choice(["", "www.", "M."])
        + rng.choice(hosts) + rng.choice(paths) + rng.choice(["", "z", "?q=/en/", "#a://b.com/", "/more/"])
        for _ in range(800)
    ] + [None, "", "://", "x://a.com", "http://a.com//en/"]
    check(spark, urls + urls[:50], rules)
    check(spark, urls, rules[:3], salts=1)


def test_no_rules_no_pages_hot_url(spark):
    check(spark, ["http://a.com/x"] * 500 + [None], [])
    check(spark, ["http://a.com/x"] * 500 + ["http://b.com/"], [("a.com", "/", "block")])
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.judge(empty, spark.createDataFrame([("a", "/", "block")], RULES)).count() == 0
