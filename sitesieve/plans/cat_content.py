"""Registered queries for page-content, platform, JSON and frontier operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonpick as J
from ..functions import url as U
from ..operators import content as C
from ..operators import elements as EL
from ..operators import frontier as G
from ..operators import platform as PL
from .catalog import q, register, sql_host
from .fixtures import MANY_RULES, Fixtures, with_ctes
from ..streaming.streams import item_rows
from .loops import follow_pagination

def fx(spark, sf_dir):
    return Fixtures(spark, sf_dir)


H1 = EL.Rule("h1", "h1")
NAV = EL.Rule("nav", "a", (EL.Test("href", "starts-with", "/"),), "@href")
N_A = EL.Rule("n_a", "a", output="count")
NEXT = EL.Rule("next", "a", (EL.Test("class", "=", "next"),), "@href")


@register("extract_elements", """
SELECT page_id, tag, count(*) AS n FROM (
  SELECT page_id, lower(unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9]*)[\\s/>]', 1))) AS tag FROM pages) t
GROUP BY page_id, tag""")
def q_extract_elements(spark, sf_dir):
    """Elements per page and tag, for every tag of every page."""
    el = EL.extract_elements(fx(spark, sf_dir).pages())
    return el.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@register("extract_items", """
SELECT page_id, 'h1' AS rule, 0 AS idx, replace(replace(replace(replace(replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '&amp', '&') AS item FROM pages
UNION ALL
SELECT page_id, 'nav', CAST(generate_subscripts(regexp_extract_all(html, '<a href="(/[^"]*)"', 1), 1) - 1 AS INTEGER),
       unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) FROM pages
UNION ALL
SELECT page_id, 'n_a', 0, CAST(len(regexp_extract_all(html, '<a[\\s>]')) AS VARCHAR) FROM pages""")
def q_extract_items(spark, sf_dir):
    """Three rules (h1 text, site-relative link hrefs, anchor count), one row per item."""
    rules = [H1, NAV, N_A]
    return item_rows(EL.extract_items(fx(spark, sf_dir).pages(), rules), rules)


@register("next_page", "SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN url || '?page=2' END AS next_url FROM pages")
def q_next_page(spark, sf_dir):
    """C4 on ``fx_html`` with the next-page markers."""
    return EL.next_page(fx(spark, sf_dir).html(extras=True), NEXT)


@register("follow_pagination", """
SELECT s.page_id AS seed_id, CAST(p.page_id - s.page_id AS INTEGER) AS hop, p.url AS page_url,
       replace(replace(replace(replace(replace(replace(regexp_extract(p.html, '<h1>(.*?)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '&amp', '&') AS item
FROM pages s JOIN pages p ON p.page_id BETWEEN s.page_id AND s.page_id + 3 WHERE s.page_id % 4 = 0""")
def q_follow_pagination(spark, sf_dir):
    """Chains of four pages linked by next-page anchors, h1 of each page."""
    f = fx(spark, sf_dir)
    paged = f.paged_html()
    seeds = paged.where(F.col("page_id") % 4 == 0).select(F.col("page_id").alias("seed_id"), "url")
    res = follow_pagination(seeds, paged, [H1], NEXT)
    return res.select("seed_id", "hop", "page_url", F.explode("h1").alias("item"))


@register("robots_nofollow", "SELECT page_id, page_id % 5 = 0 AS robots_nofollow FROM pages")
def q_robots_nofollow(spark, sf_dir):
    """C5 on ``fx_html`` with robots metas."""
    return C.robots_nofollow(fx(spark, sf_dir).html(extras=True)).select("page_id", "robots_nofollow")


def _markup(spark, sf_dir):
    """``pages`` with anchors that only careful reading gets right appended to every page."""
    p = fx(spark, sf_dir).pages()
    pid = F.col("page_id").cast("string")
    more = F.concat(
        F.lit('<!-- <a href="http://z.com/"> --><a title="a > b" href="http://y.com/?a=1&amp;b='), pid,
        F.lit("""" rel="nofollow">t</a><a data-x="1 href=q" HREF='http://x.com/'>u</a><script>var s='<a href="http://s.com/">';</script><a\nname=n>v</a>"""),
        F.when(F.col("page_id") % 5 == 0, F.lit('<META content="NoIndex,nofollow" name="robots">')).otherwise(F.lit('<meta content="nofollow" name="author">')))
    return p.select("page_id", "url", F.concat("html", more).alias("html"))


@register("extract_links_markup", """
SELECT page_id, url AS page_url, CAST(generate_subscripts(own, 1) - 1 AS INTEGER) AS pos, unnest(own) AS href, CAST(NULL AS VARCHAR) AS rel
FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="(/[^"]*)">', 1) AS own FROM pages) b
UNION ALL
SELECT page_id, url, CAST(len(regexp_extract_all(html, '<a href="(/[^"]*)">', 1)) + k AS INTEGER),
       CASE k WHEN 0 THEN 'http://y.com/?a=1&b=' || CAST(page_id AS VARCHAR) WHEN 1 THEN 'http://x.com/' END, CASE k WHEN 0 THEN 'nofollow' END
FROM pages, (VALUES (0), (1), (2)) v(k)""")
def q_extract_links_markup(spark, sf_dir):
    """C1 past comments, scripts, quoted ``>``, entities, look-alikes in other attributes and anchors without href."""
    return C.extract_links(_markup(spark, sf_dir))


@register("outbound_links_markup", "SELECT page_id, url, 2 AS obl FROM pages")
def q_outbound_links_markup(spark, sf_dir):
    return C.outbound_links(_markup(spark, sf_dir))


@register("dofollow_pct_markup", "SELECT page_id, url, CAST(50 AS DOUBLE) AS dofollow_pct FROM pages")
def q_dofollow_pct_markup(spark, sf_dir):
    return C.dofollow_pct(_markup(spark, sf_dir))


@register("link_alive_markup", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'yes' ELSE 'no' END AS link_alive FROM pages")
def q_link_alive_markup(spark, sf_dir):
    """J10 with a target whose ``&`` is written as an entity; the other target only stands in a comment."""
    m = _markup(spark, sf_dir)
    target = F.when(F.col("page_id") % 2 == 0, F.lit("y.com/?a=1&b=")).otherwise(F.lit("z.com"))
    return C.link_alive(m.select("page_id", "url", target.alias("backlink_for")), m).select("page_id", "link_alive")


@register("robots_nofollow_markup", "SELECT page_id, page_id % 5 = 0 AS robots_nofollow FROM pages")
def q_robots_nofollow_markup(spark, sf_dir):
    """C5 with ``content`` before ``name``."""
    return C.robots_nofollow(_markup(spark, sf_dir)).select("page_id", "robots_nofollow")


@register("extract_items_engines", """
SELECT page_id, engine, 'y' AS rule, 0 AS idx, 'http://y.com/?a=1&b=' || CAST(page_id AS VARCHAR) AS item FROM pages, (VALUES ('regex'), ('parser')) e(engine)
UNION ALL
SELECT page_id, engine, 'n', 0, CAST(len(regexp_extract_all(html, '<a[\\s>]')) + 3 AS VARCHAR) FROM pages, (VALUES ('regex'), ('parser')) e(engine)""")
def q_extract_items_engines(spark, sf_dir):
    """One answer from either engine."""
    m = _markup(spark, sf_dir)
    rules = [EL.Rule("y", "a", (EL.Test("href", "starts-with", "http://y"),), "@href"), EL.Rule("n", "a", output="count")]
    both = [item_rows(EL.extract_items(m, rules, engine=e), rules).withColumn("engine", F.lit(e)) for e in ("regex", "parser")]
    return both[0].unionByName(both[1])


@register("detect_charset", """
SELECT upper(c) AS charset, count(*) AS pages FROM (
  SELECT regexp_extract(html, '<meta charset="([^"]+)"', 1) AS c FROM pages) t GROUP BY 1""")
def q_detect_charset(spark, sf_dir):
    return C.detect_charset(fx(spark, sf_dir).pages())


@register("detect_charset_mixed", """
SELECT CASE page_id % 4 WHEN 0 THEN 'ISO-8859-1' WHEN 1 THEN 'WINDOWS-1252' ELSE 'UTF-8' END AS charset, count(*) AS pages FROM pages GROUP BY 1""")
def q_detect_charset_mixed(spark, sf_dir):
    """C9 over known names in several spellings, an unknown name, and none."""
    k = F.col("page_id") % 4
    meta = (F.when(k == 0, F.lit("<META http-equiv='Content-Type' content='text/html; charset=iso-8859-1'>"))
            .when(k == 1, F.lit('<meta charset="windows-1252">')).when(k == 2, F.lit("<meta charset='no-such-set'>")).otherwise(F.lit("")))
    pages = fx(spark, sf_dir).pages()
    return C.detect_charset(pages.select(F.regexp_replace("html", '<meta charset="[^"]+">', "").alias("html"), "page_id").select(F.concat(meta, "html").alias("html")))


@register("strip_item_html", """
SELECT page_id, replace(replace(replace(regexp_replace(regexp_extract(html, '<footer>(.*?)</footer>', 1), '<[^>]*>', '', 'g'),
       '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS item FROM pages""")
def q_strip_item_html(spark, sf_dir):
    """P21 on the footer block of each page (kept as HTML by the extraction)."""
    p = fx(spark, sf_dir).pages().select("page_id", F.regexp_extract("html", "<footer>(.*?)</footer>", 1).alias("item"))
    return C.strip_item_html(p, "item")


PLATFORM_ORACLE = """
SELECT page_id, url, CASE
  WHEN http_status > 400 THEN 'error : HTTP Status [' || CAST(http_status AS VARCHAR) || ']'
  WHEN regexp_matches(html, '(?i)<meta.+name=["'']generator["''][^>]+>') AND
       regexp_matches(regexp_extract(html, '(?i)<meta.+name=["'']generator["''][^>]+>', 0), '(?i).+\\s+content=["'']([^"]*WordPress(\\s[\\d.]+)?[^"]*)["'']')
       THEN 'CMS / Blogs | WordPress'
  WHEN regexp_matches(html, '(?i)<script.+\\s+src=["'']([^"]*jquery-3\\.[0-9][^"]*)["'']') THEN 'Ecommerce | ShopJS'
  WHEN regexp_matches(html, '(?i)<!--\\sad\\s1[0-9]*\\s-->') THEN 'Advertising | AdNet'
  WHEN regexp_matches(html, '(?i)<footer>&copy;\\sblog\\.') THEN 'Blogs | BlogHost'
  ELSE 'Not Found' END AS platform_raw
FROM (SELECT p.page_id, p.url, c.http_status, p.html || l.a ||
        CASE WHEN p.page_id % 4 = 0 THEN '<meta name="generator" content="WordPress 5.2">' ELSE '' END ||
        CASE WHEN p.page_id % 4 = 1 THEN '<script type="text/javascript" src="/js/jquery-3.1.js"></script>' ELSE '' END ||
        CASE WHEN p.page_id % 5 = 0 THEN '<meta name="robots" content="noindex,nofollow">' ELSE '' END ||
        CASE WHEN p.page_id % 3 = 0 THEN '<a class="next" href="?page=2">' ELSE '' END AS html
      FROM pages p JOIN fx_crawl c USING (page_id)
      JOIN (SELECT page_id, string_agg('<a href="' || href || '"' || CASE WHEN rel IS NULL THEN '' ELSE ' rel="' || rel || '"' END || '>t</a>', '' ORDER BY k) AS a
            FROM fx_links GROUP BY page_id) l USING (page_id)) t"""


@register("detect_platform", with_ctes(PLATFORM_ORACLE, "fx_crawl", "fx_links"))
def q_detect_platform(spark, sf_dir):
    """C6 over ``fx_html`` with markers, statuses of ``fx_crawl`` (404/500 give the error label)."""
    f = fx(spark, sf_dir)
    pages = f.html(extras=True).join(f.crawl().select("page_id", F.col("http_status").cast("int")), "page_id")
    return PL.detect_platform(pages, f.platform_rules(), status_col="http_status").select("page_id", "url", "platform_raw")


@register("detect_platform_split", with_ctes(
    "SELECT page_id, CASE WHEN len(string_split(platform_raw, '|')) = 2 THEN string_split(platform_raw, '|')[1] ELSE 'Not found' END AS platform_category, "
    "CASE WHEN len(string_split(platform_raw, '|')) = 2 THEN string_split(platform_raw, '|')[2] ELSE 'Not found' END AS platform FROM (" + PLATFORM_ORACLE + ") d",
    "fx_crawl", "fx_links"))
def q_detect_platform_split(spark, sf_dir):
    """C6 then P19."""
    from ..operators.urls import with_split_platform

    f = fx(spark, sf_dir)
    pages = f.html(extras=True).join(f.crawl().select("page_id", F.col("http_status").cast("int")), "page_id")
    d = PL.detect_platform(pages, f.platform_rules(), status_col="http_status")
    return with_split_platform(d, "platform_raw").select("page_id", "platform_category", "platform")


@register("match_platform_rules", with_ctes("""
SELECT page_id, app, kind FROM (
  SELECT page_id, 'WordPress' AS app, 'meta' AS kind, page_id % 4 = 0 AS hit FROM pages
  UNION ALL SELECT page_id, 'ShopJS', 'script', page_id % 4 = 1 FROM pages
  UNION ALL SELECT page_id, 'AdNet', 'html', regexp_matches(html, '(?i)<!--\\sad\\s1[0-9]*\\s-->') FROM pages
  UNION ALL SELECT page_id, 'BlogHost', 'html', regexp_matches(html, '(?i)<footer>&copy;\\sblog\\.') FROM pages) t WHERE hit""", "fx_crawl"))
def q_match_platform_rules(spark, sf_dir):
    """Every (page, app, kind) hit."""
    f = fx(spark, sf_dir)
    return PL.match_platform_rules(f.html(extras=True), f.platform_rules())


@register("detect_platform_many", f"""
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'CMS | Gen' || lpad(CAST(page_id % {MANY_RULES} AS VARCHAR), 4, '0')
                     WHEN regexp_matches(html, '(?i)<footer>&copy; blog[.]') THEN 'Blogs | BlogHost' ELSE 'Not Found' END AS platform_raw FROM pages""")
def q_detect_platform_many(spark, sf_dir):
    """C6 with 1 200 more rules: letters beyond ASCII match whatever their case, a no-break space is no ``\\s``."""
    f = fx(spark, sf_dir)
    return PL.detect_platform(f.many_rules_html(), f.many_rules()).select("page_id", "platform_raw")


@register("match_platform_rules_many", f"""
SELECT page_id, 'Gen' || lpad(CAST(page_id % {MANY_RULES} AS VARCHAR), 4, '0') AS app, 'html' AS kind FROM pages WHERE page_id % 2 = 0
UNION ALL SELECT page_id, 'BlogHost', 'html' FROM pages WHERE regexp_matches(html, '(?i)<footer>&copy; blog[.]')""")
def q_match_platform_rules_many(spark, sf_dir):
    """J12 with 1 200 more rules."""
    f = fx(spark, sf_dir)
    return PL.match_platform_rules(f.many_rules_html(), f.many_rules())


def _order_bodies(f):
    o = f.base("orders")
    body = F.to_json(F.struct(
        "o_orderkey",
        F.array(F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_custkey").cast("string")).alias("arr"),
        F.struct("o_custkey", "o_totalprice").alias("c")))
    return o.select("o_orderkey", body.alias("body"))


@register("json_pick", """
SELECT o_orderkey, CASE WHEN o_totalprice - floor(o_totalprice) > 0 THEN printf('%.2f', o_totalprice)
                        ELSE CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) END
       || '","' || o_orderpriority || '","' || CAST(o_orderkey AS VARCHAR) || '","' || CAST(o_custkey AS VARCHAR) || '","' AS picked
FROM orders""")
def q_json_pick(spark, sf_dir):
    """Four paths (object, array index, top key) and one bad path over order JSON bodies."""
    b = _order_bodies(fx(spark, sf_dir))
    return J.with_json_pick(b, "body", "c,o_totalprice arr,1 o_orderkey c,o_custkey nope,x").select("o_orderkey", "picked")


@register("json_pick_events", "SELECT event_id, CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) AS k FROM events")
def q_json_pick_events(spark, sf_dir):
    """C7 on ``events.props``."""
    return fx(spark, sf_dir).base("events").select("event_id", J.json_pick(F.col("props"), "k").alias("k"))


@register("json_items", """
SELECT o_orderkey, 0 AS pos, o_orderstatus AS item FROM orders
UNION ALL SELECT o_orderkey, 1, o_orderpriority FROM orders
UNION ALL SELECT o_orderkey, 2, CAST(o_custkey AS VARCHAR) FROM orders""")
def q_json_items(spark, sf_dir):
    """The ``arr`` array of each order body, one row per element."""
    return J.json_items(_order_bodies(fx(spark, sf_dir)), "body", "arr", keep=["o_orderkey"])


# --- frontier ------------------------------------------------------------------

@register("frontier_footprint", "SELECT 'https://www.bing.com/search?q=' || url_encode(p_name) AS url, p_name AS footprint FROM part")
def q_frontier_footprint(spark, sf_dir):
    footprints = fx(spark, sf_dir).base("part").select(F.col("p_name").alias("footprint"))
    return G.frontier_footprint(footprints, "https://www.bing.com/search?q={%footprint%}")


@register("frontier_customs", """
SELECT 'https://example.com/s?q=' || url_encode(p_name) || '&r=' || r_name AS url, p_name AS custom1, r_name AS custom2
FROM part, region""")
def q_frontier_customs(spark, sf_dir):
    """G2 + J11: part names × region names."""
    f = fx(spark, sf_dir)
    return G.frontier_customs(spark, "https://example.com/s?q={%custom1::encoded%}&r={%custom2%}",
                              f.base("part").select("p_name"), f.base("region").select("r_name"))


@register("drop_unused_lists", "SELECT 'https://example.com/s?q=' || url_encode(p_name) AS url, p_name AS custom1, '' AS custom2 FROM part")
def q_drop_unused_lists(spark, sf_dir):
    """The region list is unused by the template and rules, so no product is built."""
    f = fx(spark, sf_dir)
    return G.frontier_customs(spark, "https://example.com/s?q={%custom1::encoded%}",
                              f.base("part").select("p_name"), f.base("region").select("r_name"), rule_texts=["//h1", ""])


@register("int_loop", """
SELECT o_orderkey, spec, unnest(generate_series(a, b, s)) AS value FROM (
  SELECT o_orderkey, '{%intloop:' || CAST(o_orderkey % 7 AS VARCHAR) || ':' || CAST(o_orderkey % 7 + o_custkey % 20 AS VARCHAR) || ':' ||
         CAST(1 + o_orderkey % 3 AS VARCHAR) || '%}' AS spec,
         o_orderkey % 7 AS a, o_orderkey % 7 + o_custkey % 20 AS b, 1 + o_orderkey % 3 AS s FROM orders) t""")
def q_int_loop(spark, sf_dir):
    o = fx(spark, sf_dir).base("orders")
    spec = F.concat(F.lit("{%intloop:"), (F.col("o_orderkey") % 7).cast("string"), F.lit(":"),
                    (F.col("o_orderkey") % 7 + F.col("o_custkey") % 20).cast("string"), F.lit(":"),
                    (F.lit(1) + F.col("o_orderkey") % 3).cast("string"), F.lit("%}"))
    return G.int_loop(o.select("o_orderkey", spec.alias("spec")))


@register("first_of_macro", with_ctes(f"""
SELECT row_id, CASE WHEN row_id % 3 = 0 THEN url
                    WHEN row_id % 3 = 1 THEN 'http://h.com/?q=' || {sql_host('url')} || '&z=1'
                    ELSE url END AS url
FROM fx_urls""", "fx_urls"))
def q_first_of_macro(spark, sf_dir):
    """G5 over macro URLs built from ``fx_urls``."""
    u = fx(spark, sf_dir).urls()
    r = F.col("row_id") % 3
    macro = (F.when(r == 0, F.concat(F.lit("get_first("), F.col("url"), F.lit("~~x~~y)")))
             .when(r == 1, F.concat(F.lit("http://h.com/?q=get_first("), U.url_host("url"), F.lit("~~z)&z=1")))
             .otherwise(F.col("url")))
    return u.select("row_id", G.first_of_macro(macro).alias("url"))


@register("suggest_wildcard", """
SELECT p_partkey, u || CASE WHEN strpos(p_name, ' ') > 0 THEN '&cp=' || CAST(strpos(p_name, ' ') - 1 AS VARCHAR) ELSE '' END AS url
FROM (SELECT p_partkey, p_name, 'https://suggestqueries.google.com/complete/search?q=' || replace(p_name, ' ', '*') || '&hl=en' AS u FROM part) t""")
def q_suggest_wildcard(spark, sf_dir):
    p = fx(spark, sf_dir).base("part")
    u = F.concat(F.lit("https://suggestqueries.google.com/complete/search?q="), F.replace(F.col("p_name"), F.lit(" "), F.lit("*")), F.lit("&hl=en"))
    return p.select("p_partkey", G.suggest_wildcard(u).alias("url"))


@register("decorate_items", with_ctes(
    "SELECT row_id, CASE WHEN url = '' THEN url ELSE 'site:' || url || ' [' || CAST(cf AS VARCHAR) || '/' || CAST(tf AS VARCHAR) || ' x/{%custom1::encoded%}]' END AS item FROM fx_urls",
    "fx_urls"))
def q_decorate_items(spark, sf_dir):
    """prefix/suffix with {%custom1%} and {%custom2%} from the row (the
    ``::encoded`` form stays as written)."""
    u = fx(spark, sf_dir).urls().select("row_id", F.col("url").alias("item"), F.col("cf").alias("c1"),
                                        F.concat(F.col("tf").cast("string"), F.lit(" x")).alias("c2"))
    d = EL.decorate_items(u, "item", "site:", " [{%custom1%}/{%custom2%}/{%custom1::encoded%}]", {"custom1": "c1", "custom2": "c2"})
    return d.select("row_id", "item")


@register("split_custom_columns", with_ctes(
    "SELECT row_id, url AS h_url, CAST(tf AS VARCHAR) AS h_tf, coalesce(CAST(http_status AS VARCHAR), '') AS h_status, CAST(NULL AS VARCHAR) AS h_more FROM fx_urls",
    "fx_urls"))
def q_split_custom_columns(spark, sf_dir):
    """Items of the form "a","b","c" split into four header columns (last padded)."""
    u = fx(spark, sf_dir).urls()
    item = F.concat(F.lit('"'), F.col("url"), F.lit('","'), F.col("tf").cast("string"), F.lit('","'),
                    F.coalesce(F.col("http_status").cast("string"), F.lit("")), F.lit('"'))
    s = EL.split_custom_columns(u.select("row_id", item.alias("item")), "item", ["h_url", "h_tf", "h_status", "h_more"])
    return s.select("row_id", "h_url", "h_tf", "h_status", "h_more")


@register("items_per_page", """
SELECT page_id, CAST(len(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS BIGINT) AS items FROM pages""")
def q_items_per_page(spark, sf_dir):
    """Items of the site-relative link rule per page."""
    from ..operators.enrich import items_per_page

    return items_per_page(EL.extract_items(fx(spark, sf_dir).pages(), [NAV]), "nav")


@register("items_total", """SELECT CAST(sum(len(regexp_extract_all(html, '<a href="(/[^"]*)"', 1))) AS BIGINT) AS items FROM pages""")
def q_items_total(spark, sf_dir):
    """A11 total over all pages."""
    from ..operators.enrich import items_total

    return items_total(EL.extract_items(fx(spark, sf_dir).pages(), [NAV]), "nav")


@register("expand_customs", """
SELECT 'https://example.com/s?q=' || url_encode(p_name) || '&r=' || r_name AS url, p_name AS custom1, r_name AS custom2
FROM part, region""")
def q_expand_customs(spark, sf_dir):
    """The product of two parameter lists, the smaller attached as an array."""
    f = fx(spark, sf_dir)
    one = lambda df, c: df.select(F.col(c).cast("string").alias("v"))
    return G.expand_customs(F.lit("https://example.com/s?q={%custom1::encoded%}&r={%custom2%}"),
                            one(f.base("part"), "p_name"), one(f.base("region"), "r_name"))


@register("extract_items_placeholders", """
SELECT page_id, CAST(generate_subscripts(xs, 1) - 1 AS INTEGER) AS idx, unnest(xs) AS item FROM (
  SELECT page_id, list_filter(regexp_extract_all(html, '<a href="(/[^"]*)"', 1),
                              lambda x: starts_with(x, CASE WHEN page_id % 2 = 0 THEN '/t' ELSE '/a' END)) AS xs FROM pages) t""")
def q_extract_items_placeholders(spark, sf_dir):
    """C3 with ``{%custom1%}`` in a rule test, filled from each page row's ``c1``."""
    p = fx(spark, sf_dir).pages().withColumn("c1", F.when(F.col("page_id") % 2 == 0, F.lit("/t")).otherwise(F.lit("/a")))
    rule = EL.Rule("nav", "a", (EL.Test("href", "starts-with", "{%custom1%}"),), "@href")
    it = EL.extract_items(p, [rule], placeholders={"custom1": "c1"})
    return it.select("page_id", F.posexplode("nav").alias("idx", "item"))


@register("detect_platform_headers", with_ctes(
    "SELECT page_id, CASE WHEN page_id % 6 = 0 AND NOT (http_status > 400) IS TRUE THEN 'CMS | Drupal' ELSE platform_raw END AS platform_raw FROM ("
    + PLATFORM_ORACLE.replace("SELECT page_id, url, CASE", "SELECT page_id, url, http_status, CASE") + ") d",
    "fx_crawl", "fx_links"))
def q_detect_platform_headers(spark, sf_dir):
    """C6 with response headers (a fetch-log ``headers`` map): ``X-Generator:
    Drupal`` on every sixth page; Drupal (category 1) is tried before the
    other apps, so the header rule wins where it hits."""
    f = fx(spark, sf_dir)
    hdr = F.when(F.col("page_id") % 6 == 0, F.create_map(F.lit("X-Generator"), F.lit("Drupal 9 (https://www.drupal.org)"))) \
        .otherwise(F.create_map(F.lit("Server"), F.lit("nginx")))
    pages = f.html(extras=True).join(f.crawl().select("page_id", F.col("http_status").cast("int")), "page_id").withColumn("headers", hdr)
    d = PL.detect_platform(pages, f.platform_rules(), status_col="http_status", headers_col="headers")
    return d.select("page_id", "platform_raw")
