"""Registered queries for URL-table operators (P, F, A, O, U families) on ``fx_urls``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import url as U
from ..operators import dedup as D
from ..operators import enrich as E
from ..operators import filters as FL
from ..operators import sets as S
from ..operators import urls as P
from ..session import written
from .catalog import q, register, sql_abs, sql_host, sql_scheme
from .fixtures import Fixtures, with_ctes

URLS = ("fx_urls",)
COLS = "row_id, url, tf, cf, http_status"
LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY row_id DESC) AS rn FROM fx_urls) t0 WHERE rn = 1"


def fx(spark: SparkSession, sf_dir: str) -> Fixtures:
    return Fixtures(spark, sf_dir)


def urls_sql(select: str, *extra: str) -> str:
    return with_ctes(select, "fx_urls", *extra)


# Registered domain computed independently in SQL: suffix matched by a theta
# join (host = suffix or ends with '.' || suffix), longest wins.
def sql_domain_cte(src: str = "fx_urls", scheme: bool = True) -> str:
    prefix = f"{sql_scheme('url')} || '://' || " if scheme else ""
    return f"""
    rd_h AS (SELECT row_id, url, {sql_host('url')} AS host, {sql_scheme('url')} AS sch FROM {src}),
    rd_m AS (SELECT h.row_id, max(length(s.suffix)) AS l FROM rd_h h JOIN fx_suffix s
             ON h.host = s.suffix OR h.host LIKE ('%.' || s.suffix) GROUP BY h.row_id),
    rd_p AS (SELECT h.row_id, h.url, h.host, h.sch, m.l,
                    CASE WHEN m.l IS NULL THEN h.host WHEN length(h.host) = m.l THEN ''
                         ELSE left(h.host, length(h.host) - m.l - 1) END AS pre,
                    CASE WHEN m.l IS NULL THEN '' ELSE right(h.host, m.l) END AS sfx
             FROM rd_h h LEFT JOIN rd_m m USING (row_id)),
    rd AS (SELECT row_id, url, sfx,
                  CASE WHEN url IS NULL OR host = '' THEN ''
                       WHEN pre = 'www' THEN sfx
                       ELSE {prefix}regexp_extract(pre, '[^.]*$') || CASE WHEN sfx = '' THEN '' ELSE '.' || sfx END
                  END AS domain
           FROM rd_p)"""


def with_domain_sql(body: str, src_cte: str | None = None, scheme: bool = True, extra=("fx_suffix",)) -> str:
    base = with_ctes("SELECT 1", "fx_urls", *extra)
    head = base[: base.rindex("\nSELECT 1")]
    src = src_cte or "fx_urls"
    return head + "," + sql_domain_cte(src, scheme) + "\n" + body


# --- P1-P21 -------------------------------------------------------------------

@register("with_url_parts", urls_sql(
    f"SELECT row_id, url, {sql_scheme('url')} AS scheme, {sql_host('url')} AS host, "
    f"regexp_extract(url, {q(U.URL_RE)}, 5) AS path, {sql_abs('url')} AS is_absolute FROM fx_urls"))
def q_with_url_parts(spark, sf_dir):
    return P.with_url_parts(fx(spark, sf_dir).urls().select("row_id", "url"))


@register("registered_domain", with_domain_sql("SELECT row_id, url, domain FROM rd"))
def q_registered_domain(spark, sf_dir):
    f = fx(spark, sf_dir)
    return P.registered_domain(f.urls().select("row_id", "url"), f.suffixes())


@register("registered_domain_no_scheme", with_domain_sql("SELECT row_id, url, domain FROM rd", scheme=False))
def q_registered_domain_no_scheme(spark, sf_dir):
    f = fx(spark, sf_dir)
    return P.registered_domain(f.urls().select("row_id", "url"), f.suffixes(), scheme=False)


@register("registered_host", urls_sql(f"SELECT row_id, url, {sql_host('url')} AS domain FROM fx_urls"))
def q_registered_host(spark, sf_dir):
    return P.registered_domain(fx(spark, sf_dir).urls().select("row_id", "url"), None, domain_only=False, scheme=False)


@register("trim_to_root", urls_sql(
    f"SELECT min(row_id) AS row_id, r AS url FROM (SELECT row_id, {sql_scheme('url')} || '://' || {sql_host('url')} AS r FROM fx_urls) t GROUP BY r"))
def q_trim_to_root(spark, sf_dir):
    return P.trim_to_root(fx(spark, sf_dir).urls().select("row_id", "url"))


@register("trim_to_last_folder", urls_sql(
    f"""SELECT min(row_id) AS row_id, v AS url FROM (
          SELECT row_id,
                 CASE WHEN NOT contains(split_part(regexp_replace(url, '/$', ''), '://', 2), '/') THEN url
                      WHEN regexp_extract(url, '[^/]+/?$') = '' THEN NULL
                      WHEN regexp_replace(regexp_extract(url, '[^/]+/?$'), '/$', '') = {sql_host('url')} THEN NULL
                      ELSE regexp_replace(url, '[^/]+/?$', '') END AS v
          FROM fx_urls) t WHERE v IS NOT NULL GROUP BY v"""))
def q_trim_to_last_folder(spark, sf_dir):
    return P.trim_to_last_folder(fx(spark, sf_dir).urls().select("row_id", "url"))


@register("keep_only_domain", with_domain_sql("SELECT min(row_id) AS row_id, domain AS url FROM rd GROUP BY domain"))
def q_keep_only_domain(spark, sf_dir):
    f = fx(spark, sf_dir)
    return P.keep_only_domain(f.urls().select("row_id", "url"), f.suffixes())


@register("replace_text", urls_sql(f"SELECT {COLS.replace('url', 'replace(url, ' + q('site') + ', ' + q('host') + ') AS url')} FROM fx_urls"))
def q_replace_text(spark, sf_dir):
    return P.replace_text(fx(spark, sf_dir).urls(), "site", "host")


@register("replace_regex", urls_sql(
    "SELECT row_id, regexp_replace(url, '/p([0-9]+)/', '/page\\1/', 'g') AS url, tf, cf, http_status FROM fx_urls"))
def q_replace_regex(spark, sf_dir):
    return P.replace_regex(fx(spark, sf_dir).urls(), "/p([0-9]+)/", "/page\\1/")


@register("replace_text_keep_scheme", urls_sql(
    "SELECT row_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, 1, strpos(url, '://') + 2) || "
    "replace(substr(url, strpos(url, '://') + 3), 's', 'z') ELSE replace(url, 's', 'z') END AS url, tf, cf, http_status FROM fx_urls"))
def q_replace_text_keep_scheme(spark, sf_dir):
    return P.replace_text_keep_scheme(fx(spark, sf_dir).urls(), "s", "z")


@register("remove_regex_mask", urls_sql(
    "SELECT row_id, regexp_replace(url, '\\?q=1$', '', 'g') AS url, regexp_replace(url, '\\?q=1$', '', 'g') <> url AS changed FROM fx_urls"))
def q_remove_regex_mask(spark, sf_dir):
    return P.remove_regex_mask(fx(spark, sf_dir).urls().select("row_id", "url"), r"\?q=1$", changed_col="changed")


@register("clear_column", urls_sql("SELECT row_id, url, CAST(NULL AS INTEGER) AS tf, cf, http_status FROM fx_urls"))
def q_clear_column(spark, sf_dir):
    return P.clear_column(fx(spark, sf_dir).urls(), "tf")


def _raw_metrics(df: DataFrame) -> DataFrame:
    """Metric cells as text, the way an imported file carries them."""
    return df.select(
        "row_id", "url",
        F.when(F.col("row_id") % 13 == 0, F.lit("n/a")).otherwise(F.col("tf").cast("string")).alias("trust_flow"),
        F.concat(F.lit(" "), F.col("cf").cast("string")).alias("domain_rank"),
        F.when(F.col("row_id") % 11 == 0, F.lit("")).otherwise(F.concat(F.col("cf").cast("string"), F.lit(".6"))).alias("page_authority"),
        F.concat(F.col("cf").cast("string"), F.lit(".25")).alias("moz_rank"),
    )


@register("coerce_metric_types", urls_sql(
    """SELECT row_id, url,
              CASE WHEN row_id % 13 = 0 THEN NULL ELSE tf END AS trust_flow, CAST(cf AS INTEGER) AS domain_rank,
              CASE WHEN row_id % 11 = 0 THEN NULL ELSE CAST(round(cf + 0.6) AS INTEGER) END AS page_authority,
              CAST(cf AS DOUBLE) + 0.25 AS moz_rank
       FROM fx_urls"""))
def q_coerce_metric_types(spark, sf_dir):
    return P.coerce_metric_types(_raw_metrics(fx(spark, sf_dir).urls()))


@register("status_class", urls_sql(
    "SELECT row_id, http_status, CASE WHEN http_status BETWEEN 200 AND 299 THEN 'ok' WHEN http_status BETWEEN 300 AND 399 THEN 'redirect' "
    "WHEN http_status >= 400 THEN 'error' ELSE 'none' END AS status_class FROM fx_urls"))
def q_status_class(spark, sf_dir):
    return P.with_status_class(fx(spark, sf_dir).urls().select("row_id", "http_status"))


@register("display_round", urls_sql(
    "SELECT row_id, round(tf / 7.0, 2) AS ratio, CAST(cf AS DOUBLE) / 3.0 * 1000 AS backlinks FROM fx_urls"))
def q_display_round(spark, sf_dir):
    df = fx(spark, sf_dir).urls().select("row_id", (F.col("tf") / 7.0).alias("ratio"), (F.col("cf").cast("double") / 3.0 * 1000).alias("backlinks"))
    return P.display_round(df)


def _encoded(df: DataFrame) -> DataFrame:
    r = F.col("row_id")
    return df.select(
        "row_id",
        F.when(r % 5 == 0, F.concat(F.lit("p%20"), F.col("row_id").cast("string")))
        .when(r % 3 == 0, F.concat(F.col("url"), F.lit("#%7Esec%20one%2Fx")))
        .otherwise(F.col("url")).alias("url"),
    )


@register("decode_absolute_urls", urls_sql(
    """SELECT row_id, CASE WHEN row_id % 5 = 0 THEN 'p%20' || CAST(row_id AS VARCHAR)
                          WHEN row_id % 3 = 0 THEN url || '#~sec one/x' ELSE url END AS url FROM fx_urls"""))
def q_decode_absolute_urls(spark, sf_dir):
    return P.decode_absolute_urls(_encoded(fx(spark, sf_dir).urls()))


def _refs(df: DataFrame) -> DataFrame:
    r = F.col("row_id") % 5
    ref = (
        F.when(r == 0, F.lit("/q"))
        .when(r == 1, F.lit("q&amp;x=1"))
        .when(r == 2, F.lit("?page=2"))
        .when(r == 3, F.lit("https://b.com/"))
        .otherwise(F.lit("#top"))
    )
    return df.select("row_id", F.col("url").alias("base"), ref.alias("ref"))


@register("resolve_url", urls_sql(
    f"""SELECT row_id, base, ref,
          CASE WHEN ref LIKE 'https://%' THEN ref
               WHEN ref LIKE '?%' OR ref LIKE '#%' THEN base || ref
               WHEN ref LIKE '/%' THEN {sql_scheme('base')} || '://' || {sql_host('base')} || ref
               ELSE {sql_scheme('base')} || '://' || {sql_host('base')} ||
                    regexp_replace(regexp_extract(base, {q(U.URL_RE)}, 5), '/[^/]*$', '') || '/' || replace(ref, '&amp;', '&')
          END AS resolved
        FROM (SELECT row_id, url AS base,
                     CASE row_id % 5 WHEN 0 THEN '/q' WHEN 1 THEN 'q&amp;x=1' WHEN 2 THEN '?page=2'
                          WHEN 3 THEN 'https://b.com/' ELSE '#top' END AS ref FROM fx_urls) t"""))
def q_resolve_url(spark, sf_dir):
    df = _refs(fx(spark, sf_dir).urls())
    return df.withColumn("resolved", U.resolve_url("base", "ref"))


@register("render_lines", urls_sql(
    "SELECT row_id, concat_ws('|', replace(url, '|', '%7C'), coalesce(CAST(tf AS VARCHAR), ''), coalesce(CAST(http_status AS VARCHAR), '')) AS line FROM fx_urls"))
def q_render_lines(spark, sf_dir):
    return P.with_rendered_line(fx(spark, sf_dir).urls(), ["url", "tf", "http_status"]).select("row_id", "line")


def _platform_raw(df: DataFrame) -> DataFrame:
    r = F.col("row_id") % 3
    raw = F.when(r == 0, F.lit("CMS / Blogs | WordPress")).when(r == 1, F.lit("Not Found")).otherwise(
        F.concat(F.lit("Shop | "), U.url_host("url"), F.lit(" | x")))
    return df.select("row_id", raw.alias("platform_raw"))


@register("split_platform", urls_sql(
    f"""SELECT row_id, platform_raw,
          CASE WHEN len(string_split(platform_raw, '|')) = 2 THEN string_split(platform_raw, '|')[1] ELSE 'Not found' END AS platform_category,
          CASE WHEN len(string_split(platform_raw, '|')) = 2 THEN string_split(platform_raw, '|')[2] ELSE 'Not found' END AS platform
        FROM (SELECT row_id, CASE row_id % 3 WHEN 0 THEN 'CMS / Blogs | WordPress' WHEN 1 THEN 'Not Found'
                     ELSE 'Shop | ' || {sql_host('url')} || ' | x' END AS platform_raw FROM fx_urls) t"""))
def q_split_platform(spark, sf_dir):
    return P.with_split_platform(_platform_raw(fx(spark, sf_dir).urls()))


@register("fill_timeouts", with_ctes(
    """SELECT url, CAST(CASE WHEN k = 1 THEN 503 ELSE http_status END AS INTEGER) AS http_status, outcome FROM (
         SELECT url, http_status, 'ok' AS outcome, 0 AS k FROM fx_crawl
         UNION ALL SELECT url, 503, 'timeout', 1 FROM fx_crawl) t""", "fx_crawl"))
def q_fill_timeouts(spark, sf_dir):
    log = fx(spark, sf_dir).fetch_log().select("url", "http_status", "outcome")
    log = log.withColumn("http_status", F.when(F.col("outcome") == "timeout", F.lit(None).cast("int")).otherwise(F.col("http_status")))
    return P.fill_timeouts(log, "status")


# --- F1-F16 ------------------------------------------------------------------

def _filter_query(name: str, where: str, fn):
    register(name, urls_sql(f"SELECT {COLS} FROM fx_urls WHERE {where}"))(lambda spark, sf_dir: fn(fx(spark, sf_dir).urls()))


_filter_query("remove_bad_urls", "http_status IS NULL OR (http_status >= 200 AND http_status < 400)", FL.remove_bad_urls)
_filter_query("drop_containing", "NOT contains(url, 'blog.')", lambda d: FL.drop_containing(d, "url", "blog."))
_filter_query("drop_not_containing", "contains(url, '.fr')", lambda d: FL.drop_not_containing(d, "url", ".fr"))
_filter_query("drop_matching", "NOT regexp_matches(url, '/p[0-9]+/')", lambda d: FL.drop_matching(d, "url", "/p[0-9]+/"))
_filter_query("drop_not_matching", "regexp_matches(url, '^https://')", lambda d: FL.drop_not_matching(d, "url", "^https://"))
_filter_query("drop_equal", "http_status IS NULL OR http_status <> 404", lambda d: FL.drop_equal(d, "http_status", 404))
_filter_query("drop_not_equal", "http_status = 200", lambda d: FL.drop_not_equal(d, "http_status", 200))
_filter_query("drop_lower", "tf IS NULL OR tf >= 25", lambda d: FL.drop_lower(d, "tf", 25))
_filter_query("drop_higher", "cf IS NULL OR cf <= 50", lambda d: FL.drop_higher(d, "cf", 50))
_filter_query("pending", f"http_status IS NULL AND {sql_abs('url')}", lambda d: FL.pending(d, "http_status"))
_filter_query("redirect_candidates", f"http_status > 300 AND http_status < 400 AND {sql_abs('url')}", FL.redirect_candidates)


@register("remove_subdomains", with_domain_sql(
    """SELECT f.row_id, f.url, f.tf, f.cf, f.http_status FROM fx_urls f JOIN (
         SELECT row_id, CASE WHEN sfx = '' THEN host ELSE replace(host, '.' || sfx, '') END AS rest FROM rd_p) r USING (row_id)
       WHERE f.url IS NOT NULL AND f.url <> '' AND
             (length(rest) - length(replace(rest, '.', '')) < 1 OR
              (length(rest) - length(replace(rest, '.', '')) = 1 AND starts_with(rest, 'www.')))"""))
def q_remove_subdomains(spark, sf_dir):
    f = fx(spark, sf_dir)
    return FL.remove_subdomains(f.urls(), f.suffixes())


@register("drop_selected", urls_sql(f"SELECT {COLS} FROM fx_urls WHERE row_id NOT IN (SELECT row_id FROM fx_urls WHERE tf > 40)"))
def q_drop_selected(spark, sf_dir):
    urls = fx(spark, sf_dir).urls()
    return FL.drop_selected(urls, urls.where("tf > 40").select("row_id"))


@register("apply_http_guard", urls_sql(
    """SELECT row_id, http_status, CASE WHEN http_status = 404 THEN 'skip' WHEN http_status > 499 THEN 'retry'
              WHEN http_status <> 200 THEN 'log' ELSE 'process' END AS disposition FROM fx_urls"""))
def q_apply_http_guard(spark, sf_dir):
    df = fx(spark, sf_dir).urls().select("row_id", "http_status")
    return FL.apply_http_guard(df, [("equal", 404, "skip"), ("higher", 499, "retry"), ("different", 200, "log")])


@register("apply_content_guard",
          "SELECT page_id, CASE WHEN contains(html, 'cheap-pills') THEN 'skip' WHEN NOT contains(html, '</body>') THEN 'retry' "
          "ELSE 'process' END AS content_disposition FROM pages")
def q_apply_content_guard(spark, sf_dir):
    pages = fx(spark, sf_dir).pages()
    out = FL.apply_content_guard(pages, [("contains", "cheap-pills", "skip"), ("notcontains", "</body>", "retry")])
    return out.select("page_id", "content_disposition")


@register("drop_empty_items", urls_sql(
    "SELECT row_id, CAST(pos AS INTEGER) AS pos, item FROM (SELECT row_id, unnest(generate_series(1, len(string_split(url, '/')))) AS pos, "
    "unnest(string_split(url, '/')) AS item FROM fx_urls) t WHERE item <> ''"))
def q_drop_empty_items(spark, sf_dir):
    items = fx(spark, sf_dir).urls().select("row_id", F.posexplode(F.split("url", "/")).alias("pos", "item"))
    return FL.drop_empty_items(items.withColumn("pos", F.col("pos") + 1))


# --- A1-A13, O1-O3 -------------------------------------------------------------

@register("dedup_urls", urls_sql(
    f"SELECT {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY row_id DESC) AS rn FROM fx_urls) t WHERE rn = 1"))
def q_dedup_urls(spark, sf_dir):
    return D.dedup_urls(fx(spark, sf_dir).urls())


@register("dedup_domains", urls_sql(
    f"""SELECT {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY {sql_host('url')}
                             ORDER BY coalesce(CAST(tf AS DOUBLE), 0) DESC, url) AS rk FROM ({LAST}) last) t WHERE rk = 1"""))
def q_dedup_domains(spark, sf_dir):
    return D.dedup_domains(fx(spark, sf_dir).urls(), "tf")


@register("dedup_domains_by_url", urls_sql(
    f"""SELECT {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY {sql_host('url')} ORDER BY url) AS rk FROM ({LAST}) last) t WHERE rk = 1"""))
def q_dedup_domains_by_url(spark, sf_dir):
    return D.dedup_domains(fx(spark, sf_dir).urls())


@register("distinct_first", urls_sql("SELECT min(row_id) AS row_id, url FROM fx_urls GROUP BY url"))
def q_distinct_first(spark, sf_dir):
    return D.distinct_first(fx(spark, sf_dir).urls(), "url")


@register("sort_by", urls_sql("SELECT row_id, url, tf FROM fx_urls"))
def q_sort_by(spark, sf_dir):
    return D.sort_by(fx(spark, sf_dir).urls().select("row_id", "url", "tf"), "tf", ascending=False)


@register("page_of", urls_sql(f"SELECT {COLS} FROM fx_urls ORDER BY row_id LIMIT 100 OFFSET 200"))
def q_page_of(spark, sf_dir):
    return D.page_of(fx(spark, sf_dir).urls(), offset=200, n=100)


@register("frontier_slice", urls_sql(f"SELECT {COLS} FROM fx_urls ORDER BY row_id LIMIT 10000"))
def q_frontier_slice(spark, sf_dir):
    return D.frontier_slice(fx(spark, sf_dir).urls(), 10000)


@register("count_filled", urls_sql("SELECT count(http_status) AS filled FROM fx_urls"))
def q_count_filled(spark, sf_dir):
    return E.count_filled(fx(spark, sf_dir).urls(), "http_status")


@register("count_redirects", urls_sql("SELECT count(*) FILTER (WHERE http_status > 300 AND http_status < 400) AS redirects FROM fx_urls"))
def q_count_redirects(spark, sf_dir):
    return E.count_redirects(fx(spark, sf_dir).urls())


@register("domain_histogram", with_domain_sql("SELECT domain, count(*) AS urls FROM rd GROUP BY domain"))
def q_domain_histogram(spark, sf_dir):
    f = fx(spark, sf_dir)
    return E.domain_histogram(f.urls(), f.suffixes())


@register("crawl_concurrency", with_domain_sql(
    """SELECT count(*) AS domains, max(urls) AS max_urls,
              CASE WHEN max(urls) > 30 OR count(*) = 1 THEN 1 WHEN max(urls) > 10 THEN 2 ELSE 5 END AS concurrency
       FROM (SELECT domain, count(*) AS urls FROM rd GROUP BY domain) h"""))
def q_crawl_concurrency(spark, sf_dir):
    f = fx(spark, sf_dir)
    return E.crawl_concurrency(E.domain_histogram(f.urls(), f.suffixes()))


@register("bulk_batches", urls_sql(
    """SELECT batch, count(*) AS size, arg_min(url, row_id) AS first_url, arg_max(url, row_id) AS last_url FROM (
         SELECT url, row_id, CAST(floor((row_number() OVER (ORDER BY row_id) - 1) / 50) AS BIGINT) AS batch FROM fx_urls) t
       GROUP BY batch"""))
def q_bulk_batches(spark, sf_dir):
    b = E.bulk_batches(fx(spark, sf_dir).urls(), 50)
    return b.select("batch", F.col("size").cast("long").alias("size"), F.element_at("urls", 1).alias("first_url"), F.element_at("urls", -1).alias("last_url"))


@register("enrichment_progress", urls_sql("SELECT count(http_status) AS done, count(*) AS total FROM fx_urls"))
def q_enrichment_progress(spark, sf_dir):
    return E.enrichment_progress(fx(spark, sf_dir).urls(), "http_status")


@register("frontier_remaining", urls_sql(
    "SELECT (SELECT count(*) FROM fx_urls WHERE url NOT IN (SELECT url FROM fx_urls WHERE http_status IS NOT NULL)) AS remaining, "
    "(SELECT count(*) FROM fx_urls) AS total"))
def q_frontier_remaining(spark, sf_dir):
    urls = fx(spark, sf_dir).urls()
    return E.frontier_remaining(urls, urls.where("http_status IS NOT NULL"))


# --- U1-U4 ---------------------------------------------------------------------

@register("merge_into_list", urls_sql(
    "SELECT DISTINCT value FROM (SELECT url AS value FROM fx_urls UNION ALL SELECT url FROM fx_crawl) t WHERE value IS NOT NULL AND value <> ''",
    "fx_crawl"))
def q_merge_into_list(spark, sf_dir):
    f = fx(spark, sf_dir)
    return S.merge_into_list(f.urls(), "url", f.crawl().select("url"))


@register("diff_with_list", urls_sql(
    "SELECT DISTINCT url AS value FROM fx_urls WHERE url <> '' AND url NOT IN (SELECT url FROM fx_urls WHERE tf > 25)"))
def q_diff_with_list(spark, sf_dir):
    urls = fx(spark, sf_dir).urls()
    return S.diff_with_list(urls, "url", urls.where("tf > 25").select("url"))


@register("append_rows", urls_sql(
    """SELECT row_id, url, tf, cf, http_status, CAST(NULL AS BIGINT) AS backlinks FROM fx_urls
       UNION ALL SELECT page_id + (SELECT max(row_id) FROM fx_urls) + 1, url, NULL, NULL, http_status, backlinks FROM fx_crawl""",
    "fx_crawl"))
def q_append_rows(spark, sf_dir):
    f = fx(spark, sf_dir)
    new = f.crawl().select(F.col("page_id").alias("row_id"), "url", F.col("http_status").cast("int"), "backlinks")
    return S.append_rows(f.urls(), new)


@register("replace_or_append", urls_sql(
    """SELECT row_id, url, tf, cf, http_status FROM fx_urls
       UNION ALL SELECT (SELECT max(row_id) FROM fx_urls) + row_number() OVER (ORDER BY page_id), url, NULL, NULL, http_status FROM fx_crawl""", "fx_crawl"))
def q_replace_or_append(spark, sf_dir):
    """U4: rows without ids are appended in their order, numbered after the table's last row."""
    f = fx(spark, sf_dir)
    new = f.crawl().orderBy("page_id").select("url", F.col("http_status").cast("int"))
    return S.replace_or_append(f.urls(), new, "append")


@register("removed_counts", urls_sql("""
SELECT 'remove_bad_urls' AS filter, count(*) FILTER (WHERE NOT (http_status IS NULL OR (http_status >= 200 AND http_status < 400))) AS removed FROM fx_urls
UNION ALL SELECT 'drop_containing', count(*) FILTER (WHERE contains(url, 'blog.')) FROM fx_urls
UNION ALL SELECT 'drop_lower', count(*) FILTER (WHERE tf < 25) FROM fx_urls"""))
def q_removed_counts(spark, sf_dir):
    """§2.3: the number of rows each filter removes, as one lazy report."""
    u = fx(spark, sf_dir).urls()
    return FL.removed_counts(u, {"remove_bad_urls": FL.remove_bad_urls(u), "drop_containing": FL.drop_containing(u, "url", "blog."),
                                 "drop_lower": FL.drop_lower(u, "tf", 25)})


@register("filter_chain", urls_sql("""
SELECT s.step, s.filter,
       count(*) FILTER (WHERE CASE s.step WHEN 1 THEN NOT a WHEN 2 THEN a AND NOT b ELSE a AND b AND NOT c END) AS removed,
       count(*) FILTER (WHERE CASE s.step WHEN 1 THEN a WHEN 2 THEN a AND b ELSE a AND b AND c END) AS kept
FROM (SELECT http_status IS NULL OR (http_status >= 200 AND http_status < 400) AS a, NOT contains(url, 'blog.') AS b, tf >= 25 AS c FROM fx_urls) u,
     (VALUES (1, 'remove_bad_urls'), (2, 'drop_containing'), (3, 'drop_lower')) s(step, filter)
GROUP BY s.step, s.filter"""))
def q_filter_chain(spark, sf_dir):
    """§2.3: rows removed by each filter of a chain, counted while its result is written."""
    chain = FL.FilterChain(fx(spark, sf_dir).urls(), [
        ("remove_bad_urls", FL.remove_bad_urls), ("drop_containing", lambda d: FL.drop_containing(d, "url", "blog.")),
        ("drop_lower", lambda d: FL.drop_lower(d, "tf", 25))])
    written(chain.result, "filtered")
    return spark.createDataFrame(chain.report(), "step int, filter string, removed long, kept long")


@register("observed_statistics", urls_sql(
    """SELECT count(*) AS total, count(*) FILTER (WHERE url <> '') AS filled_url, count(http_status) AS done_http_status,
              count(*) FILTER (WHERE http_status > 300 AND http_status < 400) AS redirects FROM fx_urls"""))
def q_observed_statistics(spark, sf_dir):
    """A4, A5 and A12 in the pass that writes the table."""
    table, seen = E.observe_statistics(fx(spark, sf_dir).urls(), ["url"], "http_status", ["http_status"])
    written(table, "table")
    return spark.createDataFrame([seen.get], "total long, filled_url long, done_http_status long, redirects long")


@register("page_of_deep", urls_sql(f"SELECT {COLS} FROM fx_urls ORDER BY row_id LIMIT 100 OFFSET 40000"))
def q_page_of_deep(spark, sf_dir):
    """O2 for a deep window."""
    return D.page_of(fx(spark, sf_dir).urls(), offset=40000, n=100)


@register("frontier_slice_large", urls_sql(f"SELECT {COLS} FROM fx_urls ORDER BY row_id LIMIT 20000"))
def q_frontier_slice_large(spark, sf_dir):
    """O3 for a slice larger than the top-k bound (global row positions)."""
    return D.frontier_slice(fx(spark, sf_dir).urls(), 20000)
