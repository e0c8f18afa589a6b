"""Provider replies → rows.

Replies are rows of an ``api_raw`` table: ``provider``, ``method``, ``target``
(the URL or domain asked about), ``http_status``, ``body`` (the reply text)
and ``urls`` (the request's URL list, in order, for bulk requests).
Bodies are parsed with ``from_json`` against explicit schemas (fields read as
text and cast with ``try_cast``, so a number sent as a string, or the
reverse, still lands in its column) and exploded; everything stays in the
reply's partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.urls import _require

S = T.StringType()


def _struct(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, S) for n in names])


MAJESTIC_LINK = _struct("SourceURL", "TargetURL", "LinkType", "AnchorText", "SourceCitationFlow", "SourceTrustFlow",
                        "SourceTopicalTrustFlow_Topic_0", "SourceTopicalTrustFlow_Value_0", "FlagNoFollow", "FlagDeleted",
                        "FirstIndexedDate", "LastSeenDate")
MAJESTIC_DOMAIN = _struct("Domain", "CitationFlow", "TrustFlow", "TopicalTrustFlow_Topic_0", "TopicalTrustFlow_Value_0", "IP")
MAJESTIC_METRIC = _struct("ItemNum", "Status", "ExtBackLinks", "RefDomains", "CitationFlow", "TrustFlow",
                          "TopicalTrustFlow_Topic_0", "TopicalTrustFlow_Value_0", "CrawledFlag", "LastCrawlDate", "LastCrawlResult")


def _majestic(table: str, row: T.StructType) -> T.StructType:
    return T.StructType([
        T.StructField("Code", S), T.StructField("ErrorMessage", S), T.StructField("FullError", S),
        T.StructField("DataTables", T.StructType([T.StructField(table, T.StructType([T.StructField("Data", T.ArrayType(row))]))])),
    ])


AHREFS_LINK = _struct("url_from", "url_to", "anchor", "link_type", "nofollow", "ahrefs_rank", "domain_rating", "links_external", "ip_from")
AHREFS_LINKS = T.StructType([T.StructField("refpages", T.ArrayType(AHREFS_LINK)), T.StructField("error", S)])
MOZ_ROW = _struct("uu", "lt", "ueid", "umrp", "upa", "pda", "us")
MOZ_ERROR = _struct("status", "error_message")


def _int(c: Column) -> Column:
    return F.round(c.try_cast("double")).try_cast("int")


def _long(c: Column) -> Column:
    return F.round(c.try_cast("double")).try_cast("long")


def _flag(c: Column) -> Column:
    return F.lower(c).isin("1", "true")


def parse_majestic_links(api_raw: DataFrame) -> DataFrame:
    """``Code == "OK"`` replies: one row per ``DataTables.BackLinks.Data`` entry.

    Same mapping for "all" (method 0) and "new" (method 1) lists; a reply
    whose code is not OK gives no rows (see :func:`provider_errors`).
    """
    _require(api_raw, "target", "body")
    j = F.from_json(F.col("body"), _majestic("BackLinks", MAJESTIC_LINK))
    ok = api_raw.select("target", j.alias("j")).where(F.col("j.Code") == "OK")
    rows = ok.select("target", F.explode("j.DataTables.BackLinks.Data").alias("d"))
    d = lambda n: F.col(f"d.{n}")
    return rows.select(
        F.col("target").alias("backlink_for"),
        d("SourceURL").alias("url"),
        d("AnchorText").alias("anchor"),
        d("LinkType").alias("link_type"),
        d("TargetURL").alias("target_url"),
        _flag(d("FlagDeleted")).alias("deleted"),
        _flag(d("FlagNoFollow")).alias("nofollow"),
        _int(d("SourceCitationFlow")).alias("citation_flow"),
        _int(d("SourceTrustFlow")).alias("trust_flow"),
        d("SourceTopicalTrustFlow_Topic_0").alias("ttf_topic"),
        _int(d("SourceTopicalTrustFlow_Value_0")).alias("ttf_value"),
        d("FirstIndexedDate").alias("first_indexed"),
        d("LastSeenDate").alias("last_seen"),
    )


def parse_majestic_ref_domains(api_raw: DataFrame, www: bool = False) -> DataFrame:
    """``DataTables.Results.Data`` → url ``http://`` (or ``http://www.``) + Domain,
    CF, TF, topic, value, IP."""
    _require(api_raw, "target", "body")
    j = F.from_json(F.col("body"), _majestic("Results", MAJESTIC_DOMAIN))
    ok = api_raw.select("target", j.alias("j")).where(F.col("j.Code") == "OK")
    rows = ok.select("target", F.explode("j.DataTables.Results.Data").alias("d"))
    prefix = "http://www." if www else "http://"
    return rows.select(
        F.col("target").alias("backlink_for"),
        F.concat(F.lit(prefix), F.col("d.Domain")).alias("url"),
        _int(F.col("d.CitationFlow")).alias("citation_flow"),
        _int(F.col("d.TrustFlow")).alias("trust_flow"),
        F.col("d.TopicalTrustFlow_Topic_0").alias("ttf_topic"),
        _int(F.col("d.TopicalTrustFlow_Value_0")).alias("ttf_value"),
        F.col("d.IP").alias("ip"),
    )


def parse_ahrefs_links(api_raw: DataFrame) -> DataFrame:
    """``refpages`` entries; a reply without ``refpages`` gives one error row
    (``error`` = the reply's error text, or ``no refpages``)."""
    _require(api_raw, "target", "body")
    j = F.from_json(F.col("body"), AHREFS_LINKS)
    x = api_raw.select("target", j.alias("j"))
    good = x.where(F.col("j.refpages").isNotNull()).select("target", F.explode("j.refpages").alias("d"))
    d = lambda n: F.col(f"d.{n}")
    rows = good.select(
        F.col("target").alias("backlink_for"), d("url_from").alias("url"), d("url_to").alias("target_url"),
        d("anchor").alias("anchor"), d("link_type").alias("link_type"), _flag(d("nofollow")).alias("nofollow"),
        _int(d("ahrefs_rank")).alias("url_rank"), _int(d("domain_rating")).alias("domain_rank"),
        _int(d("links_external")).alias("obl"), d("ip_from").alias("ip"), F.lit(None).cast("string").alias("error"),
    )
    bad = x.where(F.col("j.refpages").isNull()).select(
        F.col("target").alias("backlink_for"), F.coalesce(F.col("j.error"), F.lit("no refpages")).alias("error"))
    return rows.unionByName(bad, allowMissingColumns=True)


def _is_array(body: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(body)).startswith("ARRAY"), F.lit(False))


def parse_moz_links(api_raw: DataFrame) -> DataFrame:
    """An array reply → url ``http://`` + ``uu``, anchor ``lt``, backlinks ``ueid``,
    moz_rank ``umrp``, PA ``upa`` and DA ``pda`` (rounded), status ``us``; an
    object reply is one error row."""
    _require(api_raw, "target", "body")
    arr = api_raw.where(_is_array(F.col("body")))
    rows = arr.select("target", F.explode(F.from_json("body", T.ArrayType(MOZ_ROW))).alias("d"))
    d = lambda n: F.col(f"d.{n}")
    out = rows.select(
        F.col("target").alias("backlink_for"), F.concat(F.lit("http://"), d("uu")).alias("url"), d("lt").alias("anchor"),
        _long(d("ueid")).alias("backlinks"), d("umrp").try_cast("double").alias("moz_rank"),
        _int(d("upa")).alias("page_authority"), _int(d("pda")).alias("domain_authority"),
        _int(d("us")).alias("http_status"), F.lit(None).cast("string").alias("error"),
    )
    err = api_raw.where(~_is_array(F.col("body"))).select(
        F.col("target").alias("backlink_for"),
        F.coalesce(F.from_json("body", MOZ_ERROR)["error_message"], F.lit("error")).alias("error"))
    return out.unionByName(err, allowMissingColumns=True)


def parse_majestic_metrics(api_raw: DataFrame) -> DataFrame:
    """Bulk metrics; the URL of an entry is the request's item ``ItemNum``.

    ``Status != "Found"`` → backlinks 0, ref_domains 0, CF/TF/value -1, topic
    ``""``, last_crawl ``-``; else the values, last_crawl = ``LastCrawlDate``
    when ``CrawledFlag`` else ``LastCrawlResult``.
    """
    _require(api_raw, "urls", "body")
    j = F.from_json(F.col("body"), _majestic("Results", MAJESTIC_METRIC))
    ok = api_raw.select("urls", j.alias("j")).where(F.col("j.Code") == "OK")
    rows = ok.select("urls", F.explode("j.DataTables.Results.Data").alias("d"))
    d = lambda n: F.col(f"d.{n}")
    found = d("Status") == "Found"
    idx = d("ItemNum").try_cast("int")
    return rows.select(
        F.try_element_at(F.col("urls"), idx + 1).alias("url"),
        F.when(found, _long(d("ExtBackLinks"))).otherwise(F.lit(0).cast("long")).alias("backlinks"),
        F.when(found, _long(d("RefDomains"))).otherwise(F.lit(0).cast("long")).alias("ref_domains"),
        F.when(found, _int(d("CitationFlow"))).otherwise(F.lit(-1)).alias("citation_flow"),
        F.when(found, _int(d("TrustFlow"))).otherwise(F.lit(-1)).alias("trust_flow"),
        F.when(found, F.coalesce(d("TopicalTrustFlow_Topic_0"), F.lit(""))).otherwise(F.lit("")).alias("ttf_topic"),
        F.when(found, _int(d("TopicalTrustFlow_Value_0"))).otherwise(F.lit(-1)).alias("ttf_value"),
        d("Status").alias("index_status"),
        F.when(found, F.when(_flag(d("CrawledFlag")), d("LastCrawlDate")).otherwise(d("LastCrawlResult"))).otherwise(F.lit("-")).alias("last_crawl"),
    )


def parse_moz_metrics(api_raw: DataFrame) -> DataFrame:
    """Reply entries align by position with the request's URL list; PA/DA
    rounded; an ``error_message`` reply gives one error row per requested URL."""
    _require(api_raw, "urls", "body")
    arr = api_raw.where(_is_array(F.col("body")))
    zipped = arr.select(F.posexplode(F.arrays_zip(F.col("urls").alias("u"), F.from_json("body", T.ArrayType(MOZ_ROW)).alias("m"))).alias("pos", "z"))
    good = zipped.where(F.col("z.u").isNotNull()).select(
        F.col("z.u").alias("url"), _long(F.col("z.m.ueid")).alias("backlinks"),
        _int(F.col("z.m.upa")).alias("page_authority"), _int(F.col("z.m.pda")).alias("domain_authority"),
        F.col("z.m.umrp").try_cast("double").alias("moz_rank"), F.lit(None).cast("string").alias("error"))
    err = api_raw.where(~_is_array(F.col("body"))).select(
        F.explode("urls").alias("url"), F.coalesce(F.from_json("body", MOZ_ERROR)["error_message"], F.lit("error")).alias("error"))
    return good.unionByName(err, allowMissingColumns=True)


def parse_ahrefs_metrics(api_raw: DataFrame) -> DataFrame:
    """``metrics.backlinks`` for the one URL asked about (a fraction is cut
    off, not rounded, as the reference's integer cast does)."""
    _require(api_raw, "target", "body")
    b = F.get_json_object(F.col("body"), "$.metrics.backlinks")
    return api_raw.select(F.col("target").alias("url"), b.try_cast("double").try_cast("long").alias("backlinks"))


def parse_availability_json(api_raw: DataFrame) -> DataFrame:
    """HTTP status other than 200 → ``API Server error N``; no ``status`` key →
    ``API error``; ``status[0].summary == "inactive"`` → ``true``, else ``false``."""
    _require(api_raw, "target", "http_status", "body")
    v = F.try_parse_json(F.col("body"))
    has_status = F.coalesce(F.try_variant_get(v, "$.status", "variant").isNotNull(), F.lit(False))
    summary = F.try_variant_get(v, "$.status[0].summary", "string")
    value = (
        F.when(F.col("http_status") != 200, F.concat(F.lit("API Server error "), F.col("http_status").cast("string")))
        .when(~has_status, F.lit("API error"))
        .when(summary == "inactive", F.lit("true"))
        .otherwise(F.lit("false"))
    )
    return api_raw.select(F.col("target").alias("domain"), value.alias("domain_available"))


def parse_availability_lines(api_raw: DataFrame) -> DataFrame:
    """A text reply whose line 1 is ``ok,``; every other non-empty line gives
    (field 1, field 3) with a trailing comma dropped.  A reply whose line 1 is
    not ``ok,`` gives one row per requested domain with that line as error;
    an HTTP status other than 200 gives ``API Server error N`` for each."""
    _require(api_raw, "body", "urls", "http_status")
    lines = F.split(F.coalesce(F.col("body"), F.lit("")), "\n")
    x = api_raw.select("urls", "http_status", lines.alias("lines"))
    ok = (F.col("http_status") == 200) & (F.element_at("lines", 1) == "ok,")
    good = x.where(ok).select(F.posexplode("lines").alias("pos", "line")).where((F.col("pos") > 0) & (F.col("line") != ""))
    fields = F.split(F.col("line"), ",")
    rest = F.array_join(F.slice(fields, F.lit(4), F.greatest(F.size(fields), F.lit(0))), ",")
    value = F.when(rest.endswith(","), F.try_element_at(fields, F.lit(4))).otherwise(rest)
    good = good.select(F.try_element_at(fields, F.lit(2)).alias("domain"), value.alias("domain_available"), F.lit(None).cast("string").alias("error"))
    bad = x.where(~ok).select(
        F.explode("urls").alias("domain"),
        F.when(F.col("http_status") != 200, F.concat(F.lit("API Server error "), F.col("http_status").cast("string"))).alias("domain_available"),
        F.when(F.col("http_status") == 200, F.element_at("lines", 1)).alias("error"))
    return good.unionByName(bad)


def provider_errors(api_raw: DataFrame) -> DataFrame:
    """Replies of Majestic whose ``Code`` is not ``OK``: target and error text."""
    j = F.from_json(F.col("body"), _struct("Code", "ErrorMessage", "FullError"))
    x = api_raw.select("target", j.alias("j")).where(F.col("j.Code") != "OK")
    return x.select("target", F.col("j.Code").alias("code"), F.coalesce(F.col("j.ErrorMessage"), F.col("j.FullError")).alias("error"))
