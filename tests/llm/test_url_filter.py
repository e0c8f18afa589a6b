import random

import pytest

from sitesieve.llm import url_filter as U

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("Com", "/fr/", "allow"), ("com", "/de/", "block"), ("a.example.org", "/es/x", "allow"),
         ("a.example.org", "/es/x", "block"), ("", "/", "block"), (None, "/", "block"), ("net", None, "block"), ("x.net", "", None), ("b", "/p", "allow"), ("a.b", "/", "block")]
PAGES = "page_id long, url string, host int, rule string, verdict int, key string, range int, kind string, path array<int>"


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = next((rest[:i] for i, c in enumerate(rest) if c in "/?#"), rest)
    tail = rest[len(host) :]
    path = next((tail[:i] for i, c in enumerate(tail) if c in "?#"), tail)
    return "".join(c.lower() if c.isascii() else c for c in host), path


def judged(url, rules=RULES):
    host, path = split(url)
    fits = []
    for h, p, v in rules:
        h, p = (h or "").lower(), p or ""
        if h and v and host and (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), len(h), h + p, v))
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def urls():
    rng = random.Random(2)
    out = ["http://example.org/es/x", "HTTP://WWW.Example.ORG/es/xy?q=/en/1#a", "ftp://example.org", "http://example.org?x=/es/", "http://org/", "//example.org/es/", "", None, "://", "http://", "http:///es/", "x://é.Org/ü",
           "http://a.example.org/es/x/1", "http://notexample.org/es/", "http://example.org./es/", "http://u@example.org:80/es/", "a://b://c.org/", "http://q.a.b/p", "http://x.com/de/" + "y" * 5000, "http://x..org/\n/z"]
    for _ in range(400):
        host = ".".join(rng.choice(["a", "b", "www", "example"]) for _ in range(rng.randrange(3))) + rng.choice([".org", ".com", ".net", "example.org", "b"])
        out.append(f"http://{host}/" + rng.choice(["es/", "es/x", "en/1", "en/12/3", "fr/", "de/", "p", ""]) + rng.choice(["", "?a", "#b", "z"]))
    return out + ["http://example.org/es/x"] * 50


@pytest.mark.parametrize("partitions", ["1", "8", "50"])
def test_verdicts_equal_brute_force(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = [(i, u, 1, "r", 2, "k", 3, "x", [1]) for i, u in enumerate(urls())]
        rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
        out = U.filter_urls(spark.createDataFrame(rows, PAGES).repartition(4), rules)
        assert out.columns.count("host") == 1 and {"key", "range", "kind"} <= set(out.columns)
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {i: judged(u) for i, u in enumerate(urls())}


def test_empty_tables(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert U.filter_urls(spark.createDataFrame([], PAGES), rules).collect() == []
    none = spark.createDataFrame([], "host string, path string, verdict string")
    got = U.filter_urls(spark.createDataFrame([(1, "http://a.org/x"), (None, None)], "page_id long, url string"), none, default="block").collect()
    assert {(r.page_id, r.rule, r.verdict) for r in got} == {(1, None, "block"), (None, None, "block")}
