"""Stand-in inputs derived from the driver tables.

The reference reads crawl answers from the network; here they are input
tables.  These builders only give rows in the schema each operator expects
(SQL texts identical to the ones in the oracle, see ``FIXTURE_SQL``); they do
none of the operators' work.  Every builder reads the driver tables, so the
volume of each query grows with the scale factor.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- SQL texts shared by Spark and the DuckDB oracle (fixed values) ---------
FX_CRAWL = """
SELECT page_id, url,
  CASE page_id % 10 WHEN 0 THEN 404 WHEN 1 THEN 301 WHEN 2 THEN 302
       WHEN 3 THEN 500 WHEN 4 THEN NULL ELSE 200 END AS http_status,
  (page_id * 37) % 101 AS tf, (page_id * 53) % 101 AS cf,
  (page_id * page_id * 7) % 100003 AS backlinks
FROM pages
"""

FX_REDIRECTS = """
SELECT a.url, a.http_status, b.url AS location
FROM fx_crawl a JOIN fx_crawl b ON b.page_id =
  CASE WHEN a.page_id % 10 = 1 THEN a.page_id + 1
       WHEN a.page_id % 20 = 2 THEN a.page_id + 3 ELSE a.page_id - 1 END
WHERE a.http_status IN (301, 302)
"""

FX_LINKS = """
SELECT a.page_id, a.url AS page_url, a.k, b.url AS href,
  CASE WHEN (a.page_id + a.k) % 3 = 0 THEN 'nofollow' END AS rel
FROM (SELECT page_id, url, 0 AS k FROM fx_crawl UNION ALL SELECT page_id, url, 1 FROM fx_crawl UNION ALL SELECT page_id, url, 2 FROM fx_crawl
      UNION ALL SELECT page_id, url, 3 FROM fx_crawl UNION ALL SELECT page_id, url, 4 FROM fx_crawl) a
JOIN fx_crawl b ON b.page_id = (a.page_id * 7 + a.k * 13 + 1) % (SELECT count(*) FROM pages)
"""

FX_URLS = """
SELECT row_id, concat(CASE WHEN ln % 2 = 0 THEN 'http' ELSE 'https' END, '://',
  CASE sk % 4 WHEN 0 THEN '' WHEN 1 THEN 'www.' WHEN 2 THEN 'blog.' ELSE 'a.b.' END, 'site', CAST(sk AS STRING),
  CASE pk % 5 WHEN 0 THEN '.com' WHEN 1 THEN '.co.uk' WHEN 2 THEN '.fr' WHEN 3 THEN '.org' ELSE '.com.au' END,
  CASE ok % 4 WHEN 0 THEN '' WHEN 1 THEN '/' WHEN 2 THEN concat('/p', CAST(pk % 50 AS STRING), '/')
       ELSE concat('/p', CAST(pk % 50 AS STRING), '/i', CAST(ln AS STRING), '.html?q=1') END) AS url,
  qty AS tf, pk % 101 AS cf,
  CASE ok % 7 WHEN 0 THEN 404 WHEN 1 THEN 301 WHEN 2 THEN 503 WHEN 3 THEN NULL ELSE 200 END AS http_status
FROM (SELECT l_orderkey * 10 + l_linenumber AS row_id, min(l_orderkey) AS ok, min(l_linenumber) AS ln,
        min(l_suppkey) AS sk, min(l_partkey) AS pk, CAST(min(l_quantity) AS INT) AS qty
      FROM lineitem GROUP BY l_orderkey * 10 + l_linenumber) t
"""

# Public-suffix stand-in (fixed values from FIXTURES.md).
FX_SUFFIXES = ["com", "org", "net", "fr", "uk", "co.uk", "au", "com.au"]
FX_SUFFIX = "SELECT * FROM (VALUES " + ", ".join(f"('{s}')" for s in FX_SUFFIXES) + ") t(suffix)"

# Supported TLDs per availability API (fixed values from FIXTURES.md).
FX_TLD_SUPPORT = (
    "SELECT * FROM (VALUES ('dynadot', 'com'), ('dynadot', 'org'), ('domainr', 'com'), ('domainr', 'fr')) t(api, tld)"
)

FIXTURE_SQL = {
    "fx_crawl": FX_CRAWL,
    "fx_redirects": FX_REDIRECTS,
    "fx_links": FX_LINKS,
    "fx_urls": FX_URLS,
    "fx_suffix": FX_SUFFIX,
    "fx_tld_support": FX_TLD_SUPPORT,
}

# Which fixture views each fixture needs, in definition order.
_DEPENDS = {
    "fx_crawl": [],
    "fx_redirects": ["fx_crawl"],
    "fx_links": ["fx_crawl"],
    "fx_urls": [],
    "fx_suffix": [],
    "fx_tld_support": [],
}


def with_ctes(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the fixture CTEs it reads (for the DuckDB oracle)."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in _DEPENDS[n]:
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({FIXTURE_SQL[n]})" for n in order)
    return f"WITH {ctes}\n{sql}"


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def anchor_for(x):
    return F.concat(
        F.lit('<a href="'), x["href"], F.lit('"'),
        F.when(x["rel"].isNull(), F.lit("")).otherwise(F.concat(F.lit(' rel="'), x["rel"], F.lit('"'))),
        F.lit(">t</a>"),
    )


class Fixtures:
    """Builds the fixture views over one scale-factor folder.

    The fixture SQL texts run with their tables passed as DataFrames, so no
    session view is created or replaced.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def _sql(self, name: str) -> DataFrame:
        """Run a fixture SQL text with its tables passed as DataFrames
        (``spark.sql`` substitution), so no session view name is taken."""
        import re

        text = FIXTURE_SQL[name]
        used = {}
        # only the tables the text reads are built (each once)
        for t in ["pages", "lineitem", *_DEPENDS[name]]:
            if re.search(rf"\b{t}\b", text):
                text = re.sub(rf"\b{t}\b", "{" + t + "}", text)
                used[t] = self._sql(t) if t in _DEPENDS[name] else self.base(t)
        return self.spark.sql(text, **used)

    def crawl(self) -> DataFrame:
        return self._sql("fx_crawl")

    def redirects(self) -> DataFrame:
        return self._sql("fx_redirects")

    def links(self) -> DataFrame:
        return self._sql("fx_links")

    def urls(self) -> DataFrame:
        return self._sql("fx_urls")

    def suffixes(self) -> DataFrame:
        return self._sql("fx_suffix")

    def tld_support(self) -> DataFrame:
        return self._sql("fx_tld_support")

    def pages(self) -> DataFrame:
        return self.base("pages")

    def url_table(self) -> DataFrame:
        """The crawl's page URLs as a result table with empty metric cells."""
        return self.crawl().select(
            F.col("page_id").alias("row_id"), "url",
            F.lit(None).cast("int").alias("http_status"),
        )

    def fetch_log(self) -> DataFrame:
        """Two fetches per page URL: an older failed one and the current answer
        (status of ``fx_crawl``, location of ``fx_redirects``)."""
        crawl = self.crawl()
        redirects = self.redirects().select("url", "location")
        current = crawl.join(redirects, "url", "left").select(
            "url",
            F.timestamp_seconds(F.lit(1704067200) + F.col("page_id")).alias("fetched_at"),
            F.col("http_status").cast("int").alias("http_status"),
            "location",
            F.lit("ok").alias("outcome"),
        )
        older = crawl.select(
            "url",
            F.timestamp_seconds(F.lit(1704067200 - 86400) + F.col("page_id")).alias("fetched_at"),
            F.lit(503).cast("int").alias("http_status"),
            F.lit(None).cast("string").alias("location"),
            F.lit("timeout").alias("outcome"),
        )
        return current.unionByName(older)

    def html(self, extras: bool = False) -> DataFrame:
        """``pages.html`` with the anchors of ``fx_links`` appended at the end.

        With ``extras`` the markers of FIXTURES.md §2 are appended as well: a
        generator meta (page_id % 4 = 0), a script tag (page_id % 4 = 1), a
        robots meta (page_id % 5 = 0) and a next-page anchor (page_id % 3 = 0).
        """
        links = self.links()
        per_page = (
            links.groupBy("page_id")
            .agg(F.array_sort(F.collect_list(F.struct("k", "href", "rel"))).alias("xs"))
            .select("page_id", F.array_join(F.transform("xs", lambda x: anchor_for(x)), "").alias("a"))
        )
        pages = self.pages()
        html = F.concat(F.col("html"), F.col("a"))
        if extras:
            pid = F.col("page_id")
            html = F.concat(
                html,
                F.when(pid % 4 == 0, F.lit('<meta name="generator" content="WordPress 5.2">')).otherwise(F.lit("")),
                F.when(pid % 4 == 1, F.lit('<script type="text/javascript" src="/js/jquery-3.1.js"></script>')).otherwise(F.lit("")),
                F.when(pid % 5 == 0, F.lit('<meta name="robots" content="noindex,nofollow">')).otherwise(F.lit("")),
                F.when(pid % 3 == 0, F.lit('<a class="next" href="?page=2">')).otherwise(F.lit("")),
            )
        return pages.join(per_page, "page_id").select("page_id", "url", html.alias("html"))

    def dns(self) -> DataFrame:
        """Two addresses per distinct host of ``fx_urls`` (``ord`` 0 and 1);
        hosts whose site number is a multiple of 7 have none."""
        hosts = self.urls().select(F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#:]*)", 1)).alias("host")).distinct()
        n = F.regexp_extract("host", r"site([0-9]+)", 1).cast("long")
        hosts = hosts.where(n % 7 != 0)
        ip = lambda a: F.concat_ws(".", F.lit("10"), F.lit(a), (n / 256).cast("long").cast("string"), (n % 256).cast("string"))
        return hosts.select("host", ip("0").alias("ip"), F.lit(0).alias("ord")).unionByName(
            hosts.select("host", ip("1").alias("ip"), F.lit(1).alias("ord")))

    def supplier_domains(self, fmt: str) -> DataFrame:
        """One row per supplier and public suffix: ``domain`` = fmt with {k} and {s}."""
        sup = self.base("supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
        sfx = [x for x in FX_SUFFIXES if x not in ("uk", "au")]
        sup = sup.withColumn("suffix", F.explode(F.array(*[F.lit(x) for x in sfx])))
        dom = F.replace(F.replace(F.lit(fmt), F.lit("{k}"), F.col("s_suppkey").cast("string")), F.lit("{s}"), F.col("suffix"))
        return sup.select(dom.alias("domain"), "s_suppkey", "s_nationkey", "s_acctbal", "suffix")

    def avail(self) -> DataFrame:
        """Availability replies per registered domain: ``true``/``false``."""
        d = self.supplier_domains("site{k}.{s}")
        return d.select("domain", F.when(F.col("s_suppkey") % 2 == 0, F.lit("true")).otherwise(F.lit("false")).alias("value"))

    def paged_html(self) -> DataFrame:
        """``pages`` with a next-page anchor to page ``page_id + 1`` on every page
        whose ``page_id % 4 != 3`` (chains of four pages)."""
        p = self.pages()
        nxt = p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next_href"))
        j = p.join(nxt, "page_id", "left")
        anchor = F.when((F.col("page_id") % 4 != 3) & F.col("next_href").isNotNull(),
                        F.concat(F.lit('<a class="next" href="'), F.col("next_href"), F.lit('">next</a>'))).otherwise(F.lit(""))
        return j.select("page_id", "url", F.concat(F.col("html"), anchor).alias("html"))

    def platform_rules(self) -> DataFrame:
        from ..operators.platform import rules_from_json

        return rules_from_json(self.spark, PLATFORM_RULES_JSON)

    def many_rules(self) -> DataFrame:
        from ..operators.platform import rules_from_json

        return rules_from_json(self.spark, many_rules_json())

    def many_rules_html(self) -> DataFrame:
        """``pages`` whose body ends with the text of one generated rule, after a space (even page_id) or a no-break space."""
        n = F.lpad((F.col("page_id") % MANY_RULES).cast("string"), 4, "0")
        space = F.when(F.col("page_id") % 2 == 0, F.lit(" ")).otherwise(F.lit("\u00a0"))
        return self.pages().select("page_id", "url", F.concat(F.regexp_replace("html", "(?i)<!-- ad 1", "<!-- "), F.lit("GEN"), space, n, F.lit(" Été")).alias("html"))


# Our own small platform rule file (shape of FIXTURES.md §5; fixed test values).
PLATFORM_RULES_JSON = r"""
{"apps": {
  "WordPress": {"cats": [1, 11], "meta": {"generator": "WordPress( [\\d.]+)?\\;version:\\1"},
                "html": ["<link rel=[\"']stylesheet[\"'] [^>]+wp-content"], "script": "/wp-includes/"},
  "Drupal": {"cats": [1], "headers": {"X-Generator": "Drupal"}, "meta": {"generator": "Drupal"}},
  "PhpBB": {"cats": [2], "headers": {"Set-Cookie": "phpbb"}, "html": "powered by <a[^>]+phpbb"},
  "ShopJS": {"cats": [6], "script": ["jquery-3\\.[0-9]", "shop\\.js"]},
  "AdNet": {"cats": [7], "html": ["<!-- ad 1[0-9]* -->"]},
  "BlogHost": {"cats": [11], "html": "<footer>&copy; blog\\."},
  "LibOnly": {"cats": [12], "script": "jquery"}
 },
 "categories": {"1": {"name": "CMS"}, "2": {"name": "Message Boards"}, "6": {"name": "Ecommerce"},
                "7": {"name": "Advertising"}, "11": {"name": "Blogs"}, "12": {"name": "JavaScript Libraries"}}}
"""

# A rule file of this many generated patterns (with named groups and letters beyond ASCII) besides our own.
MANY_RULES = 1200


def many_rules_json() -> str:
    doc = json.loads(PLATFORM_RULES_JSON)
    for i in range(MANY_RULES):
        doc["apps"][f"Gen{i:04d}"] = {"cats": [1], "html": f"gen {i:04d} (?<v>[eé]t)É"}
    return json.dumps(doc)


Inputs = Fixtures
