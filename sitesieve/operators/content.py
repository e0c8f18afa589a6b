"""Page-content operators.

Links are found with built-in regular expressions (``regexp_extract_all`` +
``posexplode``), so link extraction runs inside whole-stage codegen and needs
no Python.  The ``html`` column is dropped right after extraction: no shuffle
ever carries page bodies.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U
from .urls import _require

# Attributes between the name of a start tag and its ``>``: a ``>`` inside a quoted value does not end the tag.
# All repetitions are possessive, so every pattern runs in linear time without recursion.
_QUOTED = r"""(?:"[^"]*+"|'[^']*+')"""
_REST_OF_TAG = rf"(?=[\s/>])(?:[^>=]++|=\s*+{_QUOTED}?+)*+>"
# Comments, and what stands inside scripts and styles, hold no elements.
HIDDEN_RE = rf"(?is)<!--.*?-->|(<(script|style){_REST_OF_TAG}).*?(?=</\2[\s/>])"


def tag_re(name: str) -> str:
    """Pattern of a start tag."""
    return rf"(?is)<{name}{_REST_OF_TAG}"


def attr_re(name: str) -> str:
    """Pattern over a start tag whose group 1 is the raw value of its first attribute ``name``.

    The attributes before it are walked one by one, so a look-alike inside another value is no hit.
    """
    n = re.escape(name)
    value = rf"\s*+=\s*+({_QUOTED}|[^\s>]*+)"
    other = rf"(?!{n}[\s=/>])[^\s=>/]++(?:{value.replace('(' + _QUOTED, '(?:' + _QUOTED, 1)})?+"
    return rf"(?is)^<[a-z][a-z0-9]*+(?:[\s/=]++|{other})*+{n}(?:{value})?+"


# Fixed pattern, in the form the reference uses.
CHARSET_RE = r"""(?i)<meta.*?charset=["']?([^"']+)["']?"""


# Entities decoded in attribute values (fixed values).
ATTR_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&#38;", "&"), ("&amp;", "&")]


def start_tags(html: Column, name: str) -> Column:
    """The start tags ``name`` of a page in order, outside comments, scripts and styles."""
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), F.lit(HIDDEN_RE), F.lit("$1"))
    return F.regexp_extract_all(shown, F.lit(tag_re(name)), 0)


def attr_value(tag: Column, name: str) -> Column:
    """Value of one attribute of a start tag, entities decoded; ``""`` without a value, NULL when absent."""
    raw = F.get(F.regexp_extract_all(tag, F.lit(attr_re(name)), F.lit(1)), F.lit(0))
    quoted = raw.startswith('"') | raw.startswith("'")
    v = F.when(quoted, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    decoded = v
    for ent, ch in ATTR_ENTITIES:
        decoded = F.replace(decoded, F.lit(ent), F.lit(ch))
    return F.when(v.contains("&"), decoded).otherwise(v)


def _links(html: Column) -> Column:
    """(href, rel) of every anchor."""
    return F.transform(start_tags(html, "a"), lambda t: F.struct(attr_value(t, "href").alias("href"), attr_value(t, "rel").alias("rel")))


def extract_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per ``<a>`` tag: page_id, page_url, pos (0-based), href, rel.

    Pages without anchors give no rows (use :func:`page_link_stats` for
    per-page totals, which keeps them).
    """
    _require(pages, id_col, url_col, html_col)
    links = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("page_url"), F.posexplode(_links(F.col(html_col))).alias("pos", "l"))
    return links.select("page_id", "page_url", "pos", "l.href", "l.rel")


def page_link_stats(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: external link count and external nofollow count, plus an empty-body flag.

    One pass over ``html`` per page: the links and the page's ``scheme://host`` are
    columns of their own, and the counts are taken inside the row, so there is no shuffle at all.
    """
    _require(pages, id_col, url_col, html_col)
    html = F.col(html_col)
    out = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), (html.isNull() | (html == "")).alias("empty_page"),
        U.site_root(F.col(url_col)).alias("_site"), _links(html).alias("_links"))

    def outbound(link: Column) -> Column:
        href = link["href"]
        return F.coalesce((href.startswith("http://") | href.startswith("https://")) & ~href.startswith(F.col("_site")), F.lit(False))

    out = out.withColumn("_ext", F.filter("_links", outbound))
    nof = F.size(F.filter("_ext", lambda x: F.coalesce(x["rel"] == "nofollow", F.lit(False))))
    return out.select("page_id", "url", "empty_page", F.size("_ext").cast("long").alias("external"), nof.cast("long").alias("external_nofollow"))


def outbound_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page, anchors whose href starts ``http://``/``https://`` and not with
    the page's ``scheme://host``; -1 when the page body is empty."""
    s = page_link_stats(pages, id_col, url_col, html_col)
    obl = F.when(F.col("empty_page"), F.lit(-1)).otherwise(F.col("external")).cast("int")
    return s.select("page_id", "url", obl.alias("obl"))


def dofollow_pct(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(ext - nofollow) * 100 / ext over external links; 0 when there are none;
    -2 for an empty page.  ``rel`` must be exactly ``nofollow``."""
    s = page_link_stats(pages, id_col, url_col, html_col)
    ext = F.col("external").cast("double")
    nof = F.col("external_nofollow").cast("double")
    pct = (
        F.when(F.col("empty_page"), F.lit(-2.0))
        .when(ext == 0, F.lit(0.0))
        .otherwise((ext - nof) * 100.0 / ext)
    )
    return s.select("page_id", "url", pct.alias("dofollow_pct"))


def link_alive(
    urls: DataFrame,
    pages: DataFrame,
    target: str | None = None,
    target_col: str = "backlink_for",
    url_col: str = "url",
    status_col: str | None = None,
    out: str = "link_alive",
) -> DataFrame:
    """``yes`` when an anchor on the row's page has an href containing the target.

    The target is one string for all rows, or each row's ``target_col``.  An
    empty page gives ``error : <status>``; a row without a fetched page stays
    NULL (not checked).  Links are joined to the rows' URLs (equi-join) with
    the substring test as the join's extra condition; hits are made distinct
    per (url, target), so a page with many links gives one answer per row.
    A page fetched several times is empty only if all its copies are; links of all copies count.
    """
    _require(urls, url_col)
    if target is None:
        _require(urls, target_col)
    page = pages.select(
        F.col("url").alias("_purl"),
        (F.col("html").isNull() | (F.col("html") == "")).alias("_empty"),
        *([F.col(status_col).alias("_status")] if status_col else [F.lit(None).cast("int").alias("_status")]),
    )
    # of copies of a page one with a body counts, then the one of smallest status: the same in any partitioning
    page = page.groupBy("_purl").agg(F.min(F.struct("_empty", "_status")).alias("_p")).select("_purl", "_p.*")
    links = extract_links(pages).select(F.col("page_url").alias("_lurl"), F.col("href").alias("_href"))
    keyed = urls.withColumn("_tgt", F.lit(target) if target is not None else F.col(target_col))
    keys = keyed.select(F.col(url_col).alias("_k"), "_tgt").distinct()
    # links on the left of an inner join: AQE may split a page with a large
    # share of all links (it cannot split the right side of a semi join);
    # the distinct after it is aggregated partially before its shuffle
    hits = links.join(keys, (F.col("_lurl") == F.col("_k")) & F.col("_href").contains(F.col("_tgt")), "inner")
    hits = hits.select(F.col("_k").alias("_hk"), F.col("_tgt").alias("_ht")).distinct().withColumn("_hit", F.lit(True))
    out_df = (
        keyed.join(page, F.col(url_col) == F.col("_purl"), "left")
        .join(hits, (F.col(url_col) == F.col("_hk")) & F.col("_tgt").eqNullSafe(F.col("_ht")), "left")
    )
    value = (
        F.when(F.col("_purl").isNull(), F.lit(None).cast("string"))
        .when(F.col("_empty"), F.concat(F.lit("error : "), F.coalesce(F.col("_status").cast("string"), F.lit(""))))
        .when(F.col("_hit"), F.lit("yes"))
        .otherwise(F.lit("no"))
    )
    keep = [F.col(c) for c in urls.columns if c != out]
    return out_df.select(*keep, value.alias(out))


def robots_nofollow(pages: DataFrame, html_col: str = "html", out: str = "robots_nofollow") -> DataFrame:
    """The page carries a robots meta whose content contains ``nofollow``."""
    _require(pages, html_col)
    robots = lambda t: (F.lower(attr_value(t, "name")) == "robots") & F.lower(attr_value(t, "content")).contains("nofollow")
    return pages.withColumn(out, F.coalesce(F.exists(start_tags(F.col(html_col), "meta"), robots), F.lit(False)))


# Charset names a decoder is known for (fixed values, common IANA names and aliases).
KNOWN_CHARSETS = [
    "UTF-8", "UTF8", "UTF-16", "UTF-16LE", "UTF-16BE", "UTF-32", "US-ASCII", "ASCII",
    "ISO-8859-1", "ISO-8859-2", "ISO-8859-3", "ISO-8859-4", "ISO-8859-5", "ISO-8859-6", "ISO-8859-7",
    "ISO-8859-8", "ISO-8859-9", "ISO-8859-10", "ISO-8859-13", "ISO-8859-14", "ISO-8859-15", "ISO-8859-16",
    "LATIN1", "LATIN-1", "WINDOWS-1250", "WINDOWS-1251", "WINDOWS-1252", "WINDOWS-1253", "WINDOWS-1254",
    "WINDOWS-1255", "WINDOWS-1256", "WINDOWS-1257", "WINDOWS-1258", "CP1250", "CP1251", "CP1252",
    "KOI8-R", "KOI8-U", "SHIFT_JIS", "SJIS", "EUC-JP", "ISO-2022-JP", "EUC-KR", "GB2312", "GBK", "GB18030",
    "BIG5", "BIG5-HKSCS", "TIS-620", "MACINTOSH",
]


def with_charset(pages: DataFrame, html_col: str = "html", out: str = "charset", force_latin1: bool = False) -> DataFrame:
    """Charset declared in a ``<meta ...charset=...>``, upper-cased; none, or
    a name no decoder is known for, → ``UTF-8``; the ``latin1`` override gives
    ``ISO-8859-15``."""
    _require(pages, html_col)
    if force_latin1:
        return pages.withColumn(out, F.lit("ISO-8859-15"))
    raw = F.upper(F.trim(F.regexp_extract(F.coalesce(F.col(html_col), F.lit("")), CHARSET_RE, 1)))
    return pages.withColumn(out, F.when(raw.isin(*KNOWN_CHARSETS), raw).otherwise(F.lit("UTF-8")))


def detect_charset(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """C9 census: pages per detected charset."""
    return with_charset(pages.select(html_col), html_col).groupBy("charset").agg(F.count("*").alias("pages"))


# Named entities decoded in plain text (fixed values).
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def html_to_text(c: Column) -> Column:
    """P21 core: drop tags, decode the common named entities, ``&amp;`` last."""
    x = F.regexp_replace(c, r"(?s)<[^>]*>", "")
    for ent, ch in ENTITIES:
        x = F.replace(x, F.lit(ent), F.lit(ch))
    return x


def strip_item_html(df: DataFrame, col: str = "items", keep_html: bool = False) -> DataFrame:
    """Extracted items → plain text (then P16), unless the rule keeps HTML.

    Works on an ``ARRAY<STRING>`` column (``transform``) or a string column.
    """
    _require(df, col)
    if keep_html:
        return df
    dtype = df.schema[col].dataType.simpleString()
    if dtype.startswith("array"):
        return df.withColumn(col, F.transform(col, lambda x: U.decode_if_absolute(html_to_text(x))))
    return df.withColumn(col, U.decode_if_absolute(html_to_text(F.col(col))))
