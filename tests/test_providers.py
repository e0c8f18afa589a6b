"""Provider replies of FIXTURES.md §4 and platform-rule cases of §5."""

import json

from sitesieve.operators import platform as PL
from sitesieve.sources import providers as PR

RAW = "provider string, method int, target string, http_status int, body string, urls array<string>"


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW)


def test_majestic_links(spark):
    body = json.dumps({"Code": "OK", "DataTables": {"BackLinks": {"Data": [{
        "SourceURL": "http://a.com/1", "TargetURL": "http://t.com/", "LinkType": "TextLink", "AnchorText": "x",
        "SourceCitationFlow": 12, "SourceTrustFlow": 7, "SourceTopicalTrustFlow_Topic_0": "Arts",
        "SourceTopicalTrustFlow_Value_0": "5", "FlagNoFollow": 0, "FlagDeleted": 1,
        "FirstIndexedDate": "2019-01-02", "LastSeenDate": "2019-03-04"}]}}})
    bad = json.dumps({"Code": "Fail", "ErrorMessage": "nope"})
    out = PR.parse_majestic_links(raw(spark, [("majestic", 0, "t.com", 200, body, []), ("majestic", 0, "u.com", 200, bad, [])])).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.url, r.citation_flow, r.trust_flow, r.ttf_topic, r.ttf_value, r.nofollow, r.deleted) == ("http://a.com/1", 12, 7, "Arts", 5, False, True)


def test_majestic_metrics_not_found(spark):
    body = json.dumps({"Code": "OK", "DataTables": {"Results": {"Data": [
        {"ItemNum": 0, "Status": "Found", "ExtBackLinks": 900, "RefDomains": 30, "CitationFlow": 20, "TrustFlow": 10,
         "TopicalTrustFlow_Topic_0": "Arts", "TopicalTrustFlow_Value_0": 8, "CrawledFlag": True,
         "LastCrawlDate": "2019-05-01", "LastCrawlResult": "DownloadedSuccessfully"},
        {"ItemNum": 1, "Status": "NotFound"}]}}})
    rows = {r.url: r for r in PR.parse_majestic_metrics(raw(spark, [("majestic", 10, "b", 200, body, ["http://a/", "http://b/"])])).collect()}
    a, b = rows["http://a/"], rows["http://b/"]
    assert (a.backlinks, a.ref_domains, a.citation_flow, a.trust_flow, a.ttf_topic, a.ttf_value, a.last_crawl) == (900, 30, 20, 10, "Arts", 8, "2019-05-01")
    assert (b.backlinks, b.ref_domains, b.citation_flow, b.trust_flow, b.ttf_topic, b.ttf_value, b.last_crawl) == (0, 0, -1, -1, "", -1, "-")


def test_moz_links_and_errors(spark):
    arr = json.dumps([{"uu": "a.com/1", "lt": "x", "ueid": 120, "umrp": 4.25, "upa": 31.6, "pda": 45.2, "us": 200}])
    err = json.dumps({"status": "429", "error_message": "slow down"})
    out = PR.parse_moz_links(raw(spark, [("moz", 0, "t", 200, arr, []), ("moz", 0, "u", 200, err, [])])).collect()
    good = [r for r in out if r.error is None][0]
    assert (good.url, good.backlinks, good.moz_rank, good.page_authority, good.domain_authority, good.http_status) == ("http://a.com/1", 120, 4.25, 32, 45, 200)
    assert [r.error for r in out if r.error] == ["slow down"]


def test_ahrefs(spark):
    body = json.dumps({"refpages": [{"url_from": "http://a.com/1", "url_to": "http://t.com/", "anchor": "x", "link_type": "href",
                                     "nofollow": True, "ahrefs_rank": 9, "domain_rating": 40, "links_external": 17, "ip_from": "10.0.0.1"}]})
    out = PR.parse_ahrefs_links(raw(spark, [("ahrefs", 0, "t", 200, body, []), ("ahrefs", 0, "u", 200, '{"error":"x"}', []),
                                            ("ahrefs", 0, "v", 200, "{}", [])])).collect()
    good = [r for r in out if r.error is None][0]
    assert (good.url, good.nofollow, good.url_rank, good.domain_rank, good.obl, good.ip) == ("http://a.com/1", True, 9, 40, 17, "10.0.0.1")
    assert sorted(r.error for r in out if r.error) == ["no refpages", "x"]
    m = PR.parse_ahrefs_metrics(raw(spark, [("ahrefs", 10, "http://a/", 200, '{"metrics":{"backlinks":120}}', []),
                                            ("ahrefs", 10, "http://b/", 200, '{"metrics":{"backlinks":7.9}}', [])])).collect()
    assert {r.url: r.backlinks for r in m} == {"http://a/": 120, "http://b/": 7}


def test_availability_json(spark):
    rows = [("d", 20, "a.com", 200, '{"status":[{"domain":"a.com","summary":"inactive"}]}', []),
            ("d", 20, "b.com", 200, '{"status":[{"domain":"b.com","summary":"active"}]}', []),
            ("d", 20, "c.com", 200, "{}", []), ("d", 20, "e.com", 500, "oops", [])]
    got = {r.domain: r.domain_available for r in PR.parse_availability_json(raw(spark, rows)).collect()}
    assert got == {"a.com": "true", "b.com": "false", "c.com": "API error", "e.com": "API Server error 500"}


def test_availability_lines(spark):
    body = "ok,\ndomain0,a.com,en,yes,\ndomain1,b.org,en,no"
    got = {(r.domain, r.domain_available) for r in PR.parse_availability_lines(raw(spark, [("dynadot", 21, "x", 200, body, ["a.com", "b.org"])])).collect()}
    assert got == {("a.com", "yes"), ("b.org", "no")}


RULES = {
    "apps": {
        "Alpha": {"cats": [1], "headers": {"X-Powered-By": "alpha"}},
        "Beta": {"cats": [1], "meta": {"generator": r"Beta( [\d.]+)?\;version:\1"}},
        "Gamma": {"cats": [2], "script": ["gamma\\.js"]},
        "Delta": {"cats": [11], "html": "<div id=\"delta\">"},
        "Aardvark": {"cats": [1], "html": ["<b>shared</b>"]},
        "Zebra": {"cats": [1], "html": "<b>shared</b>"},
        "Later": {"cats": [18, 99], "html": "later-only"},
        "Never": {"cats": [99], "html": "<html"},
    },
    "categories": {"1": {"name": "CMS"}, "2": {"name": "Boards"}, "11": {"name": "Blogs"}, "18": {"name": "Wiki"}, "99": {"name": "X"}},
}


def test_platform_rules(spark):
    rules = PL.rules_from_json(spark, json.dumps(RULES))
    pages = [
        (1, '<html><meta name="generator" content="Beta 2.1"></html>', None, {}),
        (2, '<html><script type="a" src="/x/gamma.js?v=1"></script></html>', None, {}),
        (3, '<html><div id="delta"></div></html>', None, {}),
        (4, "<html><b>shared</b></html>", None, {}),
        (5, "<html>later-only</html>", None, {}),
        (6, "<html>nothing</html>", None, {}),
        (7, "<html>x</html>", 404, {}),
        (8, "", 200, {}),
        (9, "<html></html>", None, {"X-Powered-By": "Alpha 1"}),
    ]
    df = spark.createDataFrame(pages, "page_id long, html string, http_status int, headers map<string,string>")
    got = {r.page_id: r.platform_raw for r in PL.detect_platform(df, rules, status_col="http_status", headers_col="headers").collect()}
    assert got == {1: "CMS | Beta", 2: "Boards | Gamma", 3: "Blogs | Delta", 4: "CMS | Aardvark", 5: "Wiki / X | Later",
                   6: "Not Found", 7: "error : HTTP Status [404]", 8: "error : HTTP Status [200]", 9: "CMS | Alpha"}
    hits = {(r.page_id, r.app) for r in PL.match_platform_rules(df, rules, headers_col="headers").collect()}
    assert (4, "Zebra") in hits and (4, "Aardvark") in hits


def test_platform_answers_do_not_depend_on_the_prefilter(spark, monkeypatch):
    """Patterns run behind their literals, or all of them: the same labels and hits; one dialect for every rule."""
    from pyspark.sql import functions as F

    from sitesieve.plans.fixtures import Fixtures

    fx = Fixtures(spark, "/root/testdata/sf0.001")
    pages = fx.html(extras=True).join(fx.crawl().select("page_id", F.col("http_status").cast("int")), "page_id")
    rules = fx.platform_rules()
    found = []
    for n in (3, 10**6):
        monkeypatch.setattr(PL, "LEAST_LITERAL", n)
        labels = {r.page_id: r.platform_raw for r in PL.detect_platform(pages, rules, status_col="http_status").collect()}
        hits = sorted((r.page_id, r.app, r.kind) for r in PL.match_platform_rules(pages, rules).collect())
        found.append((labels, hits))
    assert found[0] == found[1] and len(found[0][0]) == 50
    odd = {"apps": {"X": {"cats": [1], "html": "foo bar"}, "Y": {"cats": [1], "html": "Été"}, "Z": {"cats": [1], "html": "(?<v>ab)c"}}, "categories": {"1": {"name": "CMS"}}}
    df = spark.createDataFrame([(1, "foo\u00a0bar"), (2, "éTÉ"), (3, "ABC"), (4, "foo bar")], "page_id long, html string")
    got = {r.page_id: r.platform_raw for r in PL.detect_platform(df, PL.rules_from_json(spark, json.dumps(odd))).collect()}
    assert got == {1: "Not Found", 2: "CMS | Y", 3: "CMS | Z", 4: "CMS | X"}
