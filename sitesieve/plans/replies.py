"""Stand-in provider replies (``api_raw`` rows) built from the driver tables.

Each builder only writes reply bodies in the providers' JSON / text shapes
(FIXTURES.md §4) from table columns; the parsers do all the work.  Every
reply groups a bounded number of entries (five links of one page, ten
suppliers, one order line block), like a provider's result page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixtures import Fixtures


def _raw(df: DataFrame, provider: str, method: int, target: Column, body: Column, status: Column | None = None,
         urls: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(provider).alias("provider"), F.lit(method).alias("method"), target.alias("target"),
        (status if status is not None else F.lit(200)).cast("int").alias("http_status"),
        body.alias("body"),
        (urls if urls is not None else F.array().cast("array<string>")).alias("urls"),
    )


def _per_page(fx: Fixtures, entry: Column) -> DataFrame:
    links = fx.links()
    return links.groupBy("page_id", "page_url").agg(F.array_sort(F.collect_list(F.struct(F.col("k"), entry.alias("e")))).alias("xs")) \
        .select("page_id", "page_url", F.transform("xs", lambda x: x["e"]).alias("entries"))


def majestic_links(fx: Fixtures) -> DataFrame:
    """One Majestic link-list reply per page (its five links); every 17th page an error."""
    k = F.col("k")
    entry = F.struct(
        F.col("href").alias("SourceURL"), F.col("page_url").alias("TargetURL"), F.lit("TextLink").alias("LinkType"),
        F.concat(F.lit("anchor "), k.cast("string")).alias("AnchorText"),
        ((F.col("page_id") + k) % 50).alias("SourceCitationFlow"), ((F.col("page_id") * k) % 40).alias("SourceTrustFlow"),
        F.concat(F.lit("Topic"), k.cast("string")).alias("SourceTopicalTrustFlow_Topic_0"),
        (k * 3).cast("string").alias("SourceTopicalTrustFlow_Value_0"),
        F.when(F.col("rel") == "nofollow", 1).otherwise(0).alias("FlagNoFollow"),
        F.when(k == 4, 1).otherwise(0).alias("FlagDeleted"),
        F.concat(F.lit("2019-01-0"), (k + 1).cast("string")).alias("FirstIndexedDate"),
        F.concat(F.lit("2019-03-0"), (k + 1).cast("string")).alias("LastSeenDate"),
    )
    pages = _per_page(fx, entry)
    err = F.col("page_id") % 17 == 0
    body = F.when(err, F.to_json(F.struct(F.lit("ERROR").alias("Code"), F.lit("quota exceeded").alias("ErrorMessage")))).otherwise(
        F.to_json(F.struct(F.lit("OK").alias("Code"),
                           F.struct(F.struct(F.col("entries").alias("Data")).alias("BackLinks")).alias("DataTables"))))
    return _raw(pages, "majestic", 0, F.col("page_url"), body)


def majestic_ref_domains(fx: Fixtures) -> DataFrame:
    """One reply per block of ten suppliers: their registered domains."""
    d = fx.supplier_domains("site{k}.{s}").withColumn("_blk", (F.col("s_suppkey") / 10).cast("long"))
    entry = F.struct(
        F.col("domain").alias("Domain"), F.col("s_nationkey").alias("CitationFlow"), (F.col("s_suppkey") % 50).alias("TrustFlow"),
        F.concat(F.lit("T"), F.col("s_nationkey").cast("string")).alias("TopicalTrustFlow_Topic_0"),
        F.col("s_nationkey").cast("string").alias("TopicalTrustFlow_Value_0"),
        F.concat(F.lit("10.9."), (F.col("s_suppkey") % 256).cast("string"), F.lit(".1")).alias("IP"),
    )
    g = d.groupBy("_blk").agg(F.array_sort(F.collect_list(F.struct(F.col("domain").alias("o"), entry.alias("e")))).alias("xs"))
    body = F.to_json(F.struct(F.lit("OK").alias("Code"), F.struct(F.struct(
        F.transform("xs", lambda x: x["e"]).alias("Data")).alias("Results")).alias("DataTables")))
    return _raw(g, "majestic", 2, F.concat(F.lit("block"), F.col("_blk").cast("string")), body)


def ahrefs_links(fx: Fixtures) -> DataFrame:
    """One Ahrefs ``refpages`` reply per page; every 13th page an error object."""
    k = F.col("k")
    entry = F.struct(
        F.col("href").alias("url_from"), F.col("page_url").alias("url_to"), F.concat(F.lit("a"), k.cast("string")).alias("anchor"),
        F.lit("href").alias("link_type"), F.coalesce(F.col("rel") == "nofollow", F.lit(False)).alias("nofollow"),
        ((F.col("page_id") + k) % 100).alias("ahrefs_rank"), (k * 10).alias("domain_rating"), (k + 1).alias("links_external"),
        F.concat(F.lit("10.1.0."), k.cast("string")).alias("ip_from"),
    )
    pages = _per_page(fx, entry)
    body = F.when(F.col("page_id") % 13 == 0, F.lit('{"error":"quota"}')).otherwise(
        F.to_json(F.struct(F.col("entries").alias("refpages"))))
    return _raw(pages, "ahrefs", 0, F.col("page_url"), body)


def moz_links(fx: Fixtures) -> DataFrame:
    """One Moz array reply per page; every 19th page an error object."""
    k = F.col("k")
    entry = F.struct(
        F.regexp_replace(F.col("href"), "^[a-z]+://", "").alias("uu"), F.concat(F.lit("a"), k.cast("string")).alias("lt"),
        (F.col("page_id") * 10 + k).alias("ueid"), (k + F.lit(0.25)).alias("umrp"), (k * 10 + F.lit(0.6)).alias("upa"),
        (F.col("page_id") % 90 + F.lit(0.4)).alias("pda"), F.lit(200).alias("us"),
    )
    pages = _per_page(fx, entry)
    body = F.when(F.col("page_id") % 19 == 0, F.lit('{"status":"429","error_message":"too many requests"}')).otherwise(
        F.to_json(F.col("entries")))
    return _raw(pages, "moz", 0, F.col("page_url"), body)


def _url_batches(fx: Fixtures, entry_fn) -> DataFrame:
    """Bulk requests: ``fx_urls`` rows in blocks of 500 row ids, URLs in row order."""
    u = fx.urls().withColumn("_blk", (F.col("row_id") / 500).cast("long"))
    g = u.groupBy("_blk").agg(F.array_sort(F.collect_list(F.struct("row_id", "url", "tf", "cf"))).alias("xs"))
    return g.select("_blk", F.transform("xs", lambda x: x["url"]).alias("urls"),
                    F.transform("xs", lambda x, i: entry_fn(x, i)).alias("entries"))


def majestic_metrics(fx: Fixtures) -> DataFrame:
    """Bulk metric replies; items with ``tf % 5 == 0`` are not found."""
    def entry(x, i):
        return F.struct(
            i.alias("ItemNum"), F.when(x["tf"] % 5 == 0, F.lit("NotFound")).otherwise(F.lit("Found")).alias("Status"),
            (x["cf"] * 100).alias("ExtBackLinks"), x["cf"].alias("RefDomains"), x["cf"].alias("CitationFlow"),
            x["tf"].alias("TrustFlow"), F.concat(F.lit("T"), (x["cf"] % 7).cast("string")).alias("TopicalTrustFlow_Topic_0"),
            x["tf"].alias("TopicalTrustFlow_Value_0"), (x["row_id"] % 2 == 0).alias("CrawledFlag"),
            F.lit("2019-05-01").alias("LastCrawlDate"), F.lit("DownloadedSuccessfully").alias("LastCrawlResult"))
    b = _url_batches(fx, entry)
    body = F.to_json(F.struct(F.lit("OK").alias("Code"), F.struct(F.struct(F.col("entries").alias("Data")).alias("Results")).alias("DataTables")))
    return _raw(b, "majestic", 10, F.concat(F.lit("batch"), F.col("_blk").cast("string")), body, urls=F.col("urls"))


def moz_metrics(fx: Fixtures) -> DataFrame:
    """Bulk Moz replies aligned by position; every 9th batch an error object."""
    def entry(x, i):
        return F.struct((x["cf"] * 10).alias("ueid"), (x["tf"] + F.lit(0.4)).alias("upa"), (x["cf"] + F.lit(0.5)).alias("pda"),
                        (x["tf"] / 10.0).alias("umrp"))
    b = _url_batches(fx, entry)
    body = F.when(F.col("_blk") % 9 == 0, F.lit('{"status":"401","error_message":"bad key"}')).otherwise(F.to_json(F.col("entries")))
    return _raw(b, "moz", 10, F.concat(F.lit("batch"), F.col("_blk").cast("string")), body, urls=F.col("urls"))


def ahrefs_metrics(fx: Fixtures) -> DataFrame:
    """One reply per crawled URL; every 23rd an empty object."""
    c = fx.crawl()
    body = F.when(F.col("page_id") % 23 == 0, F.lit("{}")).otherwise(
        F.to_json(F.struct(F.struct(F.col("backlinks").alias("backlinks")).alias("metrics"))))
    return _raw(c, "ahrefs", 10, F.col("url"), body)


def availability_json(fx: Fixtures) -> DataFrame:
    """One JSON availability reply per supplier domain."""
    d = fx.supplier_domains("site{k}.{s}")
    k = F.col("s_suppkey")
    body = F.when(k % 7 == 0, F.lit("{}")).otherwise(F.to_json(F.struct(F.array(F.struct(
        F.col("domain").alias("domain"), F.when(k % 2 == 0, F.lit("inactive")).otherwise(F.lit("active")).alias("summary"))).alias("status"))))
    status = F.when(k % 11 == 0, F.lit(500)).otherwise(F.lit(200))
    return _raw(d, "domainr", 20, F.col("domain"), body, status=status)


def availability_lines(fx: Fixtures) -> DataFrame:
    """Text availability replies, one per pair of suppliers (12 domains)."""
    d = fx.supplier_domains("site{k}.{s}").withColumn("_blk", (F.col("s_suppkey") / 2).cast("long"))
    g = d.groupBy("_blk").agg(F.array_sort(F.collect_list(F.struct("domain", "s_suppkey"))).alias("xs"))
    line = lambda x, i: F.concat(
        F.lit("domain"), i.cast("string"), F.lit(","), x["domain"], F.lit(",en,"),
        F.when(x["s_suppkey"] % 3 == 0, F.lit("yes")).otherwise(F.lit("no")),
        F.when(i % 2 == 0, F.lit(",")).otherwise(F.lit("")))
    blk = F.col("_blk")
    body = F.when(blk % 13 == 0, F.lit("error,banned")).otherwise(
        F.concat(F.lit("ok,\n"), F.array_join(F.transform("xs", line), "\n")))
    status = F.when(blk % 17 == 5, F.lit(503)).otherwise(F.lit(200))
    return _raw(g, "dynadot", 21, F.concat(F.lit("batch"), blk.cast("string")), body, status=status,
                urls=F.transform("xs", lambda x: x["domain"]))
