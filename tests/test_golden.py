"""Golden rows of FIXTURES.md §6 (one per branch)."""

from pyspark.sql import functions as F

from sitesieve.functions import url as U
from sitesieve.operators import dedup as D
from sitesieve.operators import enrich as E
from sitesieve.operators import filters as FL
from sitesieve.operators import frontier as G
from sitesieve.operators import sets as S
from sitesieve.operators import urls as P
from sitesieve.plans.fixtures import FX_SUFFIXES


def suffixes(spark):
    return spark.createDataFrame([(s,) for s in FX_SUFFIXES], "suffix string")


def urls_df(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "row_id long, url string")


def col(df, name="url"):
    return [r[name] for r in df.orderBy("row_id").collect()]


def test_registered_domain(spark):
    df = urls_df(spark, ["http://blog.a.co.uk/x", "http://www.co.uk/", "", "https://blog.x.example.com/p"])
    out = col(P.registered_domain(df, suffixes(spark)), "domain")
    assert out == ["http://a.co.uk", "co.uk", "", "https://example.com"]
    host = col(P.registered_domain(urls_df(spark, ["https://blog.a.com/x"]), None, domain_only=False, scheme=False), "domain")
    assert host == ["blog.a.com"]


def test_trim_to_root(spark):
    out = P.trim_to_root(urls_df(spark, ["https://u@a.com:81/x?y", " https://A.com/z "]))
    assert col(out) == ["https://a.com"]


def test_trim_to_last_folder(spark):
    cases = {
        "http://a.com/b/c.html": "http://a.com/b/",
        "http://a.com/b/": "http://a.com/",
        "http://a.com/": "http://a.com/",
        "http://a.com/x?u=/y/z": "http://a.com/x?u=/y/",
        "http://a.com:8080/": "http://a.com:8080/",
    }
    for src, want in cases.items():
        assert col(P.trim_to_last_folder(urls_df(spark, [src]))) == [want], src


def test_remove_subdomains(spark):
    df = urls_df(spark, ["http://a.com/", "http://www.a.com/", "http://blog.a.com/", "http://www.blog.a.com/"])
    assert col(FL.remove_subdomains(df, suffixes(spark))) == ["http://a.com/", "http://www.a.com/"]


def test_remove_bad_urls_and_redirects(spark):
    st = [200, 301, 399, None, 0, 199, 400, 503, 300]
    df = spark.createDataFrame([(i, f"http://a.com/{i}", s) for i, s in enumerate(st)], "row_id long, url string, http_status int")
    kept = [r.http_status for r in FL.remove_bad_urls(df).orderBy("row_id").collect()]
    assert kept == [200, 301, 399, None, 300]
    red = [r.http_status for r in FL.redirect_candidates(df).orderBy("row_id").collect()]
    assert red == [301, 399]


def test_dedup_urls(spark):
    df = spark.createDataFrame([(1, "u", "a"), (2, "v", "b"), (3, "u", "c")], "row_id long, url string, x string")
    assert sorted(tuple(r) for r in D.dedup_urls(df).collect()) == [(2, "v", "b"), (3, "u", "c")]


def test_dedup_domains(spark):
    df = spark.createDataFrame([(1, "http://h/1", 5), (2, "http://h/2", 9), (3, "http://h/0", 9)], "row_id long, url string, tf int")
    assert [r.url for r in D.dedup_domains(df, "tf").collect()] == ["http://h/0"]


def test_replace_text_keep_scheme(spark):
    out = P.replace_text_keep_scheme(urls_df(spark, ["http://a.com/http"]), "http", "x")
    assert col(out) == ["http://a.com/x"]


def test_resolve_url(spark):
    base = "http://a.com/d/p?x=1"
    cases = {"/q": "http://a.com/q", "q": "http://a.com/d/q", "?page=2": "http://a.com/d/p?x=1?page=2",
             "https://b.com/": "https://b.com/", "a&amp;b": "http://a.com/d/a&b",
             "../up?x=/a/../b": "http://a.com/up?x=/a/../b", "./here/": "http://a.com/d/here/", "/a/b/../../c": "http://a.com/c",
             "x/..": "http://a.com/d/", "//cdn.example.com/j.js": "http://cdn.example.com/j.js", "../../..": "http://a.com/"}
    df = spark.createDataFrame([(base, r) for r in cases], "base string, ref string")
    got = {r.ref: r.res for r in df.select("ref", U.resolve_url("base", "ref").alias("res")).collect()}
    assert got == cases


def test_dofollow_pct(spark):
    def page(links):
        return "<html><body>" + "".join(f'<a href="{h}"{r}>x</a>' for h, r in links) + "</body></html>"

    ext = [("http://e.com/1", ""), ("https://f.com/", ' rel="nofollow"'), ("http://g.com/", ""), ("http://h.com/", "")]
    rows = [(1, "http://a.com/", page(ext + [("http://a.com/in", ' rel="nofollow"'), ("/rel", "")])),
            (2, "http://a.com/", page([("/only", "")])), (3, "http://a.com/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    from sitesieve.operators import content as C

    got = {r.page_id: r.dofollow_pct for r in C.dofollow_pct(df).collect()}
    assert got == {1: 75.0, 2: 0.0, 3: -2.0}
    obl = {r.page_id: r.obl for r in C.outbound_links(df).collect()}
    assert obl == {1: 4, 2: 0, 3: -1}


def test_unquoted_attributes(spark):
    from sitesieve.operators import content as C

    df = spark.createDataFrame([(1, "http://a.com/", "<a href=http://b.com/x rel=nofollow>t</a><A HREF='https://c.com/'>u</A>")],
                               "page_id long, url string, html string")
    links = [(r.href, r.rel) for r in C.extract_links(df).orderBy("pos").collect()]
    assert links == [("http://b.com/x", "nofollow"), ("https://c.com/", None)]


def test_first_of_macro(spark):
    df = spark.createDataFrame([("get_first(http://a.com~~b)",), ("http://a.com/?q=get_first(x~~y)&z=1",), ("http://plain/",)], "u string")
    assert [r.v for r in df.select(G.first_of_macro(F.col("u")).alias("v")).collect()] == ["http://a.com", "http://a.com/?q=x&z=1", "http://plain/"]


def test_int_loop(spark):
    df = spark.createDataFrame([("{%intloop:1:10:3%}",)], "spec string")
    assert [r.value for r in G.int_loop(df).collect()] == [1, 4, 7, 10]


def test_int_loop_step_zero_raises(spark):
    import pytest

    df = spark.createDataFrame([("{%intloop:1:10:0%}",)], "spec string")
    with pytest.raises(Exception):
        G.int_loop(df).collect()


def test_suggest_wildcard(spark):
    u = "https://suggestqueries.google.com/c?q=ab*c"
    df = spark.createDataFrame([(u,), ("https://other.com/c?q=ab*c",)], "u string")
    assert [r.v for r in df.select(G.suggest_wildcard(F.col("u")).alias("v")).collect()] == [u + "&cp=2", "https://other.com/c?q=ab*c"]


def test_split_platform(spark):
    df = spark.createDataFrame([("CMS / Blogs | WordPress",), ("Not Found",)], "platform_raw string")
    got = [(r.platform_category, r.platform) for r in P.with_split_platform(df).collect()]
    assert got == [("CMS / Blogs ", " WordPress"), ("Not found", "Not found")]


def test_crawl_concurrency(spark):
    def level(counts):
        h = spark.createDataFrame([(f"d{i}", c) for i, c in enumerate(counts)], "domain string, urls long")
        return E.crawl_concurrency(h).first().concurrency

    assert [level([3]), level([31, 1]), level([11, 1]), level([10, 1])] == [1, 1, 2, 5]


def test_merge_and_diff(spark):
    df = spark.createDataFrame([("a",), ("b",)], "c string")
    lst = spark.createDataFrame([("b",), ("c",)], "v string")
    assert sorted(r.value for r in S.merge_into_list(df, "c", lst).collect()) == ["a", "b", "c"]
    assert sorted(r.value for r in S.diff_with_list(df, "c", lst).collect()) == ["a"]


def test_null_rules_of_value_filters(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 10)], "row_id long, v int")
    ids = lambda d: sorted(r.row_id for r in d.collect())
    assert ids(FL.drop_equal(df, "v", 5)) == [2, 3]
    assert ids(FL.drop_not_equal(df, "v", 5)) == [1]
    assert ids(FL.drop_lower(df, "v", 6)) == [2, 3]
    assert ids(FL.drop_higher(df, "v", 6)) == [1, 2]


def test_absent_column_raises(spark):
    import pytest

    with pytest.raises(ValueError):
        FL.drop_equal(urls_df(spark, ["x"]), "nope", 1)
    with pytest.raises(ValueError):
        FL.delete_with_filter(urls_df(spark, ["x"]), "bogus", "url", "x")


def test_percent_encoding(spark):
    df = spark.createDataFrame([("a b*c~d/e",)], "v string")
    assert df.select(U.percent_encode("v").alias("e")).first().e == "a%20b%2Ac~d%2Fe"


def test_public_suffix_wildcards_and_exceptions(spark):
    rules = spark.createDataFrame([("com",), ("ck",), ("*.ck",), ("!www.ck",), ("uk",), ("co.uk",)], "suffix string")
    df = urls_df(spark, ["http://a.b.ck/", "http://www.ck/x", "http://shop.www.ck/", "http://a.co.uk/", "http://x.y.com/"])
    out = col(P.registered_domain(df, rules), "domain")
    # b.ck is a suffix by the wildcard; www.ck is excepted, so its suffix is ck,
    # and a host that is exactly www.<suffix> gives the bare suffix (P2 rule)
    assert out == ["http://a.b.ck", "ck", "http://www.ck", "http://a.co.uk", "http://y.com"]


def test_item_engines_agree(spark):
    """Attribute and count rules give the same items with the regex and parser engines."""
    from sitesieve.operators import elements as EL
    from sitesieve.plans.fixtures import Fixtures

    pages = Fixtures(spark, "/root/testdata/sf0.01").html(extras=True)
    rules = [EL.Rule("nav", "a", (EL.Test("href", "starts-with", "/"),), "@href"),
             EL.Rule("next", "a", (EL.Test("class", "=", "next"),), "@href"),
             EL.Rule("nofollow", "a", (EL.Test("rel", "exists"), EL.Test("href", "contains", "example.org")), "@href"),
             EL.Rule("plain", "a", (EL.Test("rel", "exists", negate=True),), "@href"),
             EL.Rule("n_a", "a", output="count"), EL.Rule("metas", "meta", (EL.Test("name", "exists"),), "@content")]
    names = [r.name for r in rules]
    a = {r.page_id: tuple(tuple(r[n]) for n in names) for r in EL.extract_items(pages, rules, engine="regex").collect()}
    b = {r.page_id: tuple(tuple(r[n]) for n in names) for r in EL.extract_items(pages, rules, engine="parser").collect()}
    assert a == b and len(a) == 250


def test_remove_subdomains_bare_suffix_host(spark):
    df = urls_df(spark, ["http://co.uk/", "http://a.co.uk/", "http://www.a.co.uk/"])
    assert col(FL.remove_subdomains(df, suffixes(spark))) == ["http://a.co.uk/", "http://www.a.co.uk/"]


def test_dedup_domains_whole_number_metric(spark):
    df = spark.createDataFrame([(1, "http://h/b", 4.4), (2, "http://h/a", 4.2), (3, "http://g/x", 1.0)], "row_id long, url string, moz_rank double")
    assert sorted(r.url for r in D.dedup_domains(df, "moz_rank", provider="moz").collect()) == ["http://g/x", "http://h/a"]
    # TF is not a Moz metric: dedup without metric (smallest URL per host)
    df2 = spark.createDataFrame([(1, "http://h/b", 9), (2, "http://h/a", 1)], "row_id long, url string, trust_flow int")
    assert [r.url for r in D.dedup_domains(df2, "trust_flow", provider="moz").collect()] == ["http://h/a"]


def test_charset(spark):
    from sitesieve.operators import content as C

    df = spark.createDataFrame([('<meta charset="iso-8859-1">',), ("<meta http-equiv='x' content='text/html; charset=windows-1252'>",),
                                ('<meta charset="foo">',), ("<p>none</p>",)], "html string")
    assert [r.charset for r in C.with_charset(df).collect()] == ["ISO-8859-1", "WINDOWS-1252", "UTF-8", "UTF-8"]


def test_decorate_items_footprint_encoded(spark):
    from sitesieve.operators import elements as EL

    df = spark.createDataFrame([("x", "a b", "u"), ("", "a b", "u")], "item string, fp string, c1 string")
    out = [r.item for r in EL.decorate_items(df, "item", "[{%footprint%}] ", " {%custom1%}{%custom1::encoded%}", {"footprint": "fp", "custom1": "c1"}).collect()]
    assert out == ["[a%20b] x u{%custom1::encoded%}", ""]


def test_frontier_customs_forms(spark):
    c1 = spark.createDataFrame([("a b",)], "v string")
    out = G.frontier_customs(spark, "http://s/?q={%custom1::encoded%}&r={%custom1%}&f={%footprint%}", c1, None, footprint="x y").first()
    assert out.url == "http://s/?q=a%20b&r=a%20b&f=x%20y"
    out2 = G.frontier_customs(spark, "http://s/?r={%custom1%}&q={%custom1::encoded%}", c1, None).first()
    assert out2.url == "http://s/?r=a b&q=a b"


def test_custom_scrap_columns():
    from sitesieve import schemas as S

    assert S.custom_scrap_columns(["Title", "Price"]) == ["title", "price"]
    cols = S.custom_scrap_columns(["URL", "Title"])
    assert cols[:2] == ["url", "title"] and "http_status" in cols and "domain_available" in cols
    assert len(S.custom_scrap_columns([f"h{i}" for i in range(50)])) == 50  # no header is cut


def test_pagination_rules_agree(spark):
    """A next-page rule that reads an attribute and one that reads text give the same chains."""
    from pyspark.sql import functions as F

    from sitesieve.operators import elements as EL
    from sitesieve.plans import loops as L
    from sitesieve.plans.fixtures import Fixtures

    paged = Fixtures(spark, "/root/testdata/sf0.001").paged_html()
    nxt = F.regexp_extract("html", 'class="next" href="([^"]*)"', 1)
    paged = paged.withColumn("html", F.when(nxt != "", F.concat("html", F.lit("<i>"), nxt, F.lit("</i>"))).otherwise(F.col("html")))
    seeds = paged.where(F.col("page_id") % 4 == 0).select(F.col("page_id").alias("seed_id"), "url")
    h1 = EL.Rule("h1", "h1")
    by = [EL.Rule("next", "a", (EL.Test("class", "=", "next"),), "@href"), EL.Rule("next", "i")]
    a, b = (sorted((r.seed_id, r.hop, r.page_url, tuple(r.h1)) for r in L.follow_pagination(seeds, paged, [h1], rule).collect()) for rule in by)
    assert a == b and len(a) == 50
    capped = L.follow_pagination(seeds, paged, [h1], by[0], max_pages=2)
    assert max(r.hop for r in capped.collect()) == 1


def test_fill_timeouts_sentinels(spark):
    df = spark.createDataFrame([("timeout",), ("ok",)], "outcome string")
    expect = {"status": ("http_status", 503), "redirect": ("http_status", 503), "dofollow": ("dofollow_pct", -2.0),
              "obl": ("obl", -1), "availability": ("domain_available", "API timeout"), "platform": ("platform", "Server timeout")}
    for op, (col_name, value) in expect.items():
        got = [r[col_name] for r in P.fill_timeouts(df, op).collect()]
        assert got == [value, None], op


def test_remove_regex_mask_invalid_and_count(spark):
    df = urls_df(spark, ["http://a.com/x?q=1", "http://b.com/"])
    same = P.remove_regex_mask(df, "([unclosed", changed_col="changed")
    assert col(same) == ["http://a.com/x?q=1", "http://b.com/"]
    masked = P.remove_regex_mask(df, r"\?q=1$", changed_col="changed")
    assert col(masked) == ["http://a.com/x", "http://b.com/"] and P.changed_rows(masked, "changed") == 1


def test_replace_or_append_modes(spark):
    import pytest

    base = spark.createDataFrame([(0, "http://a.com/")], "row_id long, url string")
    new = spark.createDataFrame([(0, "http://b.com/", 200)], "row_id long, url string, http_status int")
    assert [r.url for r in S.replace_or_append(base, new, "replace").collect()] == ["http://b.com/"]
    appended = sorted((r.row_id, r.url, r.http_status) for r in S.replace_or_append(base, new, "append").collect())
    assert appended == [(0, "http://a.com/", None), (1, "http://b.com/", 200)]
    with pytest.raises(ValueError):
        S.replace_or_append(base, new, "merge")


def test_coerce_metric_types(spark):
    df = spark.createDataFrame([(" 12 ", "31.6", "4.25", "n/a", ""), ("x", "45.2", "", "900", None)],
                               "trust_flow string, page_authority string, moz_rank string, backlinks string, obl string")
    rows = [tuple(r) for r in P.coerce_metric_types(df).collect()]
    assert rows == [(12, 32, 4.25, None, None), (None, 45, None, 900, None)]


def test_diff_with_empty_list(spark):
    df = spark.createDataFrame([("a",), ("a",), ("",), (None,)], "c string")
    empty = spark.createDataFrame([], "v string")
    assert [r.value for r in S.diff_with_list(df, "c", empty).collect()] == ["a"]


def test_json_pick_values(spark):
    from sitesieve.functions import jsonpick as J

    body = '{"a": {"b": [10, 2.5, true, "x", {"c": 1}], "0": "key0"}, "n": 3.0}'
    df = spark.createDataFrame([(body,), ("not json",), ('[["p", "q"], 7]',)], "body string")
    got = [r.v for r in df.select(J.json_pick(F.col("body"), "a,b,0 a,b,1 a,b,2 a,b,3 a,b,4 n a,0 zz").alias("v")).collect()]
    assert got[0] == '10","2.50","true","x","","3","key0","'
    assert got[1] == '","","","","","","","'
    arr = df.select(J.json_pick(F.col("body"), "0,1 1").alias("v")).collect()[2].v
    assert arr == 'q","7'


def test_split_custom_columns_pad_and_drop(spark):
    from sitesieve.operators import elements as EL

    df = spark.createDataFrame([('"a","b","c"',), ('"only"',)], "item string")
    rows = [(r.h1, r.h2) for r in EL.split_custom_columns(df, "item", ["h1", "h2"]).collect()]
    assert rows == [("a", "b"), ("only", None)]


def test_render_line_escapes_pipes(spark):
    df = spark.createDataFrame([("http://a.com/x|y", None, 3)], "url string, tf int, cf int")
    assert P.with_rendered_line(df, ["url", "tf", "cf"]).first().line == "http://a.com/x%7Cy||3"


def test_sort_and_windows_keep_order(spark):
    """O1 sorts by value with row_id as tie-break and NULLs at the low end; O2 and O3 follow row order."""
    from sitesieve.operators.dedup import frontier_slice, page_of, sort_by

    rows = [(i, None if i % 7 == 0 else f"http://h/{(i * 37) % 11}") for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, url string").repartition(5)
    up = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]))
    down = sorted(sorted(rows), key=lambda r: (r[1] is not None, r[1] or ""), reverse=True)
    assert [tuple(r) for r in sort_by(df, "url").collect()] == up
    got = [tuple(r) for r in sort_by(df, "url", ascending=False).collect()]
    assert [u for _, u in got] == [u for _, u in down] and all(a[1] != b[1] or a[0] < b[0] for a, b in zip(got, got[1:]))
    assert [r.row_id for r in page_of(df, 10, 20).collect()] == list(range(10, 30))
    assert [r.row_id for r in frontier_slice(df, 7).collect()] == list(range(7))


def test_product_of_long_lists(spark, monkeypatch):
    """J11 in many blocks, with repeated and missing values: each pair as often as its values occur."""
    from collections import Counter

    from pyspark.sql import functions as F

    from sitesieve.operators import frontier as G

    monkeypatch.setattr(G, "PRODUCT_BLOCK", 3)
    a, b = [f"a{i % 9}" for i in range(20)], [f"b{i}" for i in range(13)] + ["b0"]
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "v string")
    for x, y in ((a, b), (b, a)):
        got = Counter((r.custom1, r.custom2) for r in G.expand_customs(F.lit("{%custom1%}|{%custom2%}"), one(x), one(y)).collect())
        assert got == Counter((p, q) for p in x for q in y)
    plan = G.expand_customs(F.lit("u"), one(a), one(b))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
