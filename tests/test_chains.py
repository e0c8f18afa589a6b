"""J6 and J14 on long chains and cycles, against a walk of one row at a time; the Bloom reduction of L2 and J14."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sitesieve.operators import bloom
from sitesieve.operators.enrich import enrich_status, latest_fetch
from sitesieve.plans import loops as L
from sitesieve.plans import pointers as P

T0 = datetime(2024, 1, 1)


def random_log(seed, n=120):
    """url -> (status, location): tails, trees, cycles of several lengths, self-loops, answers without location."""
    rng = random.Random(seed)
    log = {}
    for i in range(n):
        status = rng.choice([301, 302, 302, 301, 307, 300, 200, 404, None, 302])
        target = rng.choice([i + 1, i + 1, i + 1, rng.randrange(n), i, n + 5])
        log[f"http://s/{i}"] = (status, rng.choice([f"http://s/{target}", f"/{target}", None if i % 11 == 0 else f"{target}"]) if status and 300 <= status < 400 else None)
    for a, b in ((0, 7), (20, 21), (40, 49)):  # cycles
        for i in range(a, b + 1):
            log[f"http://s/{i}"] = (302, f"/{a if i == b else i + 1}")
    return log


def walk(url, status, log):
    """The rule of J6, hop by hop."""
    if not (status is not None and 300 < status < 400):
        return url, status, None
    seen = {(url, status)}
    while True:
        if url not in log:
            return url, status, "unfetched"
        answer, location = log[url]
        if not (answer is not None and 300 <= answer < 400 and location):
            return url, answer, "resolved"
        to = location if "://" in location else "http://s/" + location.lstrip("/")
        after = log[to][0] if to in log else None
        if (to, after) in seen:
            return url, status, "loop"
        seen.add((to, after))
        url, status = to, after
        if status is None or not 300 < status < 400:
            return url, status, "resolved"


def tables(spark, log, rows):
    fetches = spark.createDataFrame([(u, T0, s, loc) for u, (s, loc) in log.items()], "url string, fetched_at timestamp, http_status int, location string")
    return spark.createDataFrame(rows, "row_id long, url string, http_status int"), fetches


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chains_equal_a_walk(spark, seed):
    log = random_log(seed)
    rng = random.Random(seed)
    rows = [(i, u, s) for i, (u, s) in enumerate([*((u, s) for u, (s, _) in log.items()), *((rng.choice(list(log)), rng.choice([301, 302])) for _ in range(60)), ("http://never/", 301), ("rel", 301), (None, 301)])]
    urls, fetches = tables(spark, log, rows)
    out = L.resolve_redirect_chain(urls, fetches, dedup=False)
    expected = [(i, *(walk(u, s, log) if u and "://" in u else (u, s, None))) for i, u, s in rows]
    assert sorted(map(tuple, out.collect())) == sorted(expected)
    assert {e[3] for e in expected} == {None, "loop", "resolved", "unfetched"}


def test_capped_chains(spark):
    """At most so many hops; rows still pending say so."""
    log = {f"http://s/{i}": (301, f"/{i + 1}") for i in range(6)} | {"http://s/6": (200, None), "http://s/c": (302, "/c")}
    urls, fetches = tables(spark, log, [(1, "http://s/0", 301), (2, "http://s/4", 301), (3, "http://s/c", 302), (4, "http://s/6", 200)])
    out = {tuple(r) for r in L.resolve_redirect_chain(urls, fetches, dedup=False, max_rounds=3).collect()}
    assert out == {(1, "http://s/3", 301, "cap"), (2, "http://s/6", 200, "resolved"), (3, "http://s/c", 302, "loop"), (4, "http://s/6", 200, None)}


def counted(monkeypatch, module):
    names = []
    inner = module.written
    monkeypatch.setattr(module, "written", lambda df, name: names.append(name) or inner(df, name))
    return names


def test_long_chain_and_cycle_take_few_rounds(spark, monkeypatch):
    n = 1000
    log = {f"http://s/{i}": (301, f"/{i + 1}") for i in range(n)} | {f"http://s/{n}": (200, None)}
    log |= {f"http://s/c{i}": (302, f"/c{(i + 1) % n}") for i in range(n)} | {f"http://s/t{i}": (302, f"/t{i + 1}" if i < 99 else "/c500") for i in range(100)}
    rows = [(1, "http://s/0", 301), (2, "http://s/c3", 302), (3, "http://s/c3", 301), (4, "http://s/t0", 302)]
    urls, fetches = tables(spark, log, rows)
    names = counted(monkeypatch, P)
    out = {r.row_id: tuple(r)[1:] for r in L.resolve_redirect_chain(urls, fetches, dedup=False).collect()}
    assert names.count("pointers") <= 2 + 11 + 12 + 9
    assert out == {i: walk(u, s, log) for i, u, s in rows}
    assert out[1] == (f"http://s/{n}", 200, "resolved") and out[4] == ("http://s/c499", 302, "loop")


def test_500_page_chain(spark, monkeypatch):
    from sitesieve.operators import elements as EL

    n = 500
    pages = [(i, f"http://s/{i}", f'<h1>t{i}</h1><a class="next" href="/{i + 1}">n</a>') for i in range(n)]
    pages += [(1000 + i, f"http://c/{i}", f'<h1>c{i}</h1><a class="next" href="/{(i + 1) % 7}">n</a>') for i in range(7)]
    pages += [(2000, "http://s/3", "<h1>a later copy</h1>")]  # the copy of the smallest page_id counts
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    seeds = spark.createDataFrame([(1, "http://s/0"), (2, "http://c/5"), (3, "http://s/498"), (4, "http://gone/"), (1, "http://s/0")], "seed_id long, url string")
    names = counted(monkeypatch, P)
    out = L.follow_pagination(seeds, df, [EL.Rule("h1", "h1")], EL.Rule("next", "a", (EL.Test("class", "=", "next"),), "@href"))
    found = sorted((r.seed_id, r.hop, r.page_url, r.h1) for r in out.collect())
    expected = [(1, i, f"http://s/{i}", [f"t{i}"]) for i in range(n)] + [(2, i, f"http://c/{(5 + i) % 7}", [f"c{(5 + i) % 7}"]) for i in range(7)]
    assert found == expected + [(3, 0, "http://s/498", ["t498"]), (3, 1, "http://s/499", ["t499"])]
    assert names.count("walks") <= 11
    capped = L.follow_pagination(seeds, df, [EL.Rule("h1", "h1")], EL.Rule("next", "a", (EL.Test("class", "=", "next"),), "@href"), max_pages=3)
    assert sorted((r.seed_id, r.hop) for r in capped.collect()) == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (3, 0), (3, 1)]


def test_walks_without_edges(spark):
    starts = spark.createDataFrame([(1, "a")], "seed_id long, node string")
    edges = spark.createDataFrame([], "node string, to string")
    assert [tuple(r) for r in P.walks(starts, edges).collect()] == [(1, "a", 0)]
    assert P.walks(starts.limit(0), edges).collect() == [] and P.path_ends(edges).collect() == []
    assert P.walks(starts, edges, 0).collect() == []


@pytest.mark.parametrize("partitions", [1, 4, 50])
def test_fetches_at_the_same_time(spark, partitions):
    """The latest fetch does not depend on how the log is dealt out."""
    rows = [(f"http://s/{i}", T0 + timedelta(seconds=i % 3), s, f"/{s}") for i in range(30) for s in (301, 302, 404, 200, 302)]
    fetches = spark.createDataFrame(rows, "url string, fetched_at timestamp, http_status int, location string").repartition(partitions)
    assert {(r.http_status, r.location) for r in latest_fetch(fetches).collect()} == {(404, "/404")}
    urls = spark.createDataFrame([(i, f"http://s/{i}", None) for i in range(30)], "row_id long, url string, http_status int")
    assert {r.http_status for r in enrich_status(urls, fetches).collect()} == {404}


def test_bloom_filter_holds_all_and_little_else(spark):
    df = spark.range(20_000).select(F.concat(F.lit("http://s/"), F.col("id").cast("string")).alias("url"), "id")
    keys = df.where("id % 100 = 0").select("url").unionAll(spark.createDataFrame([(None,)], "url string"))
    f = bloom.BloomFilter(keys, "url")
    kept = [r.id for r in f.keep(df, "url").collect()]
    assert set(range(0, 20_000, 100)) <= set(kept) and len(kept) == len(set(kept)) < 200 + 20_000 * 0.02
    may, surely_not = f.split(df, "url")
    assert sorted(r.id for r in may.collect()) == sorted(kept) and may.count() + surely_not.count() == 20_000
    # a filter that is too small lets more through, never less
    small = bloom.BloomFilter(keys, "url", max_words=2)
    assert {r.id for r in small.keep(df, "url").collect()} >= set(range(0, 20_000, 100))
    empty = bloom.BloomFilter(keys.limit(0), "url")
    assert empty.keep(df, "url").count() == 0 and empty.split(df, "url")[1].count() == 20_000


def test_only_reached_pages_are_parsed(spark, monkeypatch):
    """With 1 % of the pages in the frontier about 1 % of the bodies go to the parser."""
    from sitesieve.operators import elements as EL
    from sitesieve.plans import jobs

    n = 5000
    pages = spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("http://s/"), F.col("id").cast("string")).alias("url"), F.concat(F.lit("<h1>t"), F.col("id").cast("string"), F.lit("</h1>")).alias("html"))
    parsed = []
    inner = EL.extract_items

    def watched(df, rules, *args, **kw):
        parsed.append(df.count())
        return inner(df, rules, *args, **kw)

    monkeypatch.setattr(EL, "extract_items", watched)
    frontier = pages.where("page_id % 100 = 7").select("url")
    out = jobs.scrape_snapshot(spark, "{%custom1%}", frontier, None, pages, EL.Rule("h1", "h1"))
    assert sorted(int(r.item[1:]) for r in out.collect()) == list(range(7, n, 100))
    assert len(parsed) == 1 and 50 <= parsed[0] <= 50 + n * 0.02
