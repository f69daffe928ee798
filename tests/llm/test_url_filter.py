import random

import pytest

from linkfold.llm.url_filter import RULES, boundaries, judge_urls


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:end], rest[end:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h) + len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else default


URLS = [None, "", "no scheme", "http://", "http://net", "http://net/", "http://A.NET/x?y#z", "https://example.net/en/", "https://m.example.net/en", "x://example.com/de/1", "x://sexample.com/de/1", "x://a.org/fr/?q", "x://a.org#/fr/", "x://a..net/", "x://.net/", "x://net./", "x://example.net:80/en/", "http://é.net/é", "http://a.net/\nb", "ftp://x?://y.net/"]


def check(spark, urls, rules):
    rows = [(i, u) for i, u in enumerate(urls)]
    df = spark.createDataFrame([(i, u, "p", "k") for i, u in rows], "page_id long, url string, path string, key string").repartition(3)
    got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(df, rules).collect()}
    assert got == {i: brute(u, rules) for i, u in rows}


def test_production_rules(spark):
    check(spark, URLS, RULES)


@pytest.mark.parametrize("seed", range(3))
def test_random_nested_rules(spark, seed):
    r = random.Random(seed)
    host = lambda n: ".".join(r.choice("ab-") for _ in range(r.randint(1, n)))
    path = lambda: "/" + "".join(r.choice("xy/") for _ in range(r.randint(0, 3)))
    rules = list({(h, p): (r.choice(["allow", "block"]), h, p) for h, p in ((host(3), path()) for _ in range(25))}.values())
    check(spark, [f"http://{host(5)}{path()}" for _ in range(300)] + ["http://a.b/"] * 200, rules)


def test_no_rules_and_no_rows(spark):
    check(spark, URLS, [])
    assert judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_sweep_restores_the_outer_rules():
    stacks = {k: [x[1] for x in s] for k, s in boundaries(RULES)}
    assert stacks["net.example."] == ["net/", "example.net/en/"] and stacks["net.example/"] == ["net/"] and stacks["net/"] == []
