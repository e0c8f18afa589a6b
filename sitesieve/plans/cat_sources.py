"""Registered queries for sources/sinks (S1-S19), streams (T1-T3) and jobs L2, L3, J13.

File queries write their stand-in input, or the operator's output, into a
fresh folder under the session's checkpoint folder (the shared folder of the
cluster) and read it back with the library's readers.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..operators import elements as EL
from ..operators.rules import list_rules
from ..sources import files as SF
from ..sources import providers as PR
from ..sources import sinks as SK
from ..streaming import streams as ST
from . import jobs, replies
from .catalog import ALL_LINKS_SQL, register, sql_ext
from .fixtures import FX_SUFFIXES, Fixtures, with_ctes

SUFFIX_LIST = "[" + ", ".join(f"'{s}'" for s in FX_SUFFIXES if s not in ("uk", "au")) + "]"
SUPPLIER_DOMAINS = f"(SELECT s_suppkey, s_nationkey, s_acctbal, unnest({SUFFIX_LIST}) AS sx FROM supplier)"


def fx(spark, sf_dir):
    return Fixtures(spark, sf_dir)


def write_parts(write, df, folder, least):
    """``write(df, folder)`` in part files of the size that Spark advises for a partition, whatever the table's size.

    A table too small for ``least`` such files is written over as ``least`` files.
    """
    write(df.hint("rebalance"), folder)
    if len(df.sparkSession.read.text(folder).inputFiles()) < least:
        write(df.repartition(least), folder)


def _as_text(df, folder):
    df.write.mode("overwrite").text(folder)


def _as_parquet(df, folder):
    df.write.mode("overwrite").parquet(folder)


# --- provider replies (S11-S19) -----------------------------------------------

@register("parse_majestic_links", with_ctes("""
SELECT page_url AS backlink_for, href AS url, 'anchor ' || CAST(k AS VARCHAR) AS anchor, 'TextLink' AS link_type,
       page_url AS target_url, k = 4 AS deleted, coalesce(rel = 'nofollow', false) AS nofollow,
       CAST((page_id + k) % 50 AS INTEGER) AS citation_flow, CAST((page_id * k) % 40 AS INTEGER) AS trust_flow,
       'Topic' || CAST(k AS VARCHAR) AS ttf_topic, CAST(k * 3 AS INTEGER) AS ttf_value,
       '2019-01-0' || CAST(k + 1 AS VARCHAR) AS first_indexed, '2019-03-0' || CAST(k + 1 AS VARCHAR) AS last_seen
FROM fx_links WHERE page_id % 17 <> 0""", "fx_links"))
def q_parse_majestic_links(spark, sf_dir):
    return PR.parse_majestic_links(replies.majestic_links(fx(spark, sf_dir)))


@register("parse_majestic_ref_domains", f"""
SELECT 'block' || CAST(s_suppkey // 10 AS VARCHAR) AS backlink_for, 'http://site' || CAST(s_suppkey AS VARCHAR) || '.' || sx AS url,
       CAST(s_nationkey AS INTEGER) AS citation_flow, CAST(s_suppkey % 50 AS INTEGER) AS trust_flow,
       'T' || CAST(s_nationkey AS VARCHAR) AS ttf_topic, CAST(s_nationkey AS INTEGER) AS ttf_value,
       '10.9.' || CAST(s_suppkey % 256 AS VARCHAR) || '.1' AS ip
FROM {SUPPLIER_DOMAINS} d""")
def q_parse_majestic_ref_domains(spark, sf_dir):
    return PR.parse_majestic_ref_domains(replies.majestic_ref_domains(fx(spark, sf_dir)))


@register("parse_ahrefs_links", with_ctes("""
SELECT page_url AS backlink_for, href AS url, page_url AS target_url, 'a' || CAST(k AS VARCHAR) AS anchor, 'href' AS link_type,
       coalesce(rel = 'nofollow', false) AS nofollow, CAST((page_id + k) % 100 AS INTEGER) AS url_rank,
       CAST(k * 10 AS INTEGER) AS domain_rank, CAST(k + 1 AS INTEGER) AS obl, '10.1.0.' || CAST(k AS VARCHAR) AS ip,
       CAST(NULL AS VARCHAR) AS error
FROM fx_links WHERE page_id % 13 <> 0
UNION ALL
SELECT DISTINCT page_url, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'quota' FROM fx_links WHERE page_id % 13 = 0""", "fx_links"))
def q_parse_ahrefs_links(spark, sf_dir):
    return PR.parse_ahrefs_links(replies.ahrefs_links(fx(spark, sf_dir)))


@register("parse_moz_links", with_ctes("""
SELECT page_url AS backlink_for, 'http://' || regexp_replace(href, '^[a-z]+://', '') AS url, 'a' || CAST(k AS VARCHAR) AS anchor,
       CAST(page_id * 10 + k AS BIGINT) AS backlinks, CAST(k AS DOUBLE) + 0.25 AS moz_rank,
       CAST(round(k * 10 + 0.6) AS INTEGER) AS page_authority, CAST(round(page_id % 90 + 0.4) AS INTEGER) AS domain_authority,
       200 AS http_status, CAST(NULL AS VARCHAR) AS error
FROM fx_links WHERE page_id % 19 <> 0
UNION ALL
SELECT DISTINCT page_url, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'too many requests' FROM fx_links WHERE page_id % 19 = 0""", "fx_links"))
def q_parse_moz_links(spark, sf_dir):
    return PR.parse_moz_links(replies.moz_links(fx(spark, sf_dir)))


@register("parse_majestic_metrics", with_ctes("""
SELECT url,
       CAST(CASE WHEN tf % 5 = 0 THEN 0 ELSE cf * 100 END AS BIGINT) AS backlinks,
       CAST(CASE WHEN tf % 5 = 0 THEN 0 ELSE cf END AS BIGINT) AS ref_domains,
       CAST(CASE WHEN tf % 5 = 0 THEN -1 ELSE cf END AS INTEGER) AS citation_flow,
       CAST(CASE WHEN tf % 5 = 0 THEN -1 ELSE tf END AS INTEGER) AS trust_flow,
       CASE WHEN tf % 5 = 0 THEN '' ELSE 'T' || CAST(cf % 7 AS VARCHAR) END AS ttf_topic,
       CAST(CASE WHEN tf % 5 = 0 THEN -1 ELSE tf END AS INTEGER) AS ttf_value,
       CASE WHEN tf % 5 = 0 THEN 'NotFound' ELSE 'Found' END AS index_status,
       CASE WHEN tf % 5 = 0 THEN '-' WHEN row_id % 2 = 0 THEN '2019-05-01' ELSE 'DownloadedSuccessfully' END AS last_crawl
FROM fx_urls""", "fx_urls"))
def q_parse_majestic_metrics(spark, sf_dir):
    return PR.parse_majestic_metrics(replies.majestic_metrics(fx(spark, sf_dir)))


@register("parse_moz_metrics", with_ctes("""
SELECT url,
       CASE WHEN (row_id // 500) % 9 = 0 THEN NULL ELSE CAST(cf * 10 AS BIGINT) END AS backlinks,
       CASE WHEN (row_id // 500) % 9 = 0 THEN NULL ELSE CAST(round(tf + 0.4) AS INTEGER) END AS page_authority,
       CASE WHEN (row_id // 500) % 9 = 0 THEN NULL ELSE CAST(round(cf + 0.5) AS INTEGER) END AS domain_authority,
       CASE WHEN (row_id // 500) % 9 = 0 THEN NULL ELSE CAST(tf AS DOUBLE) / 10.0 END AS moz_rank,
       CASE WHEN (row_id // 500) % 9 = 0 THEN 'bad key' END AS error
FROM fx_urls""", "fx_urls"))
def q_parse_moz_metrics(spark, sf_dir):
    return PR.parse_moz_metrics(replies.moz_metrics(fx(spark, sf_dir)))


@register("parse_ahrefs_metrics", with_ctes(
    "SELECT url, CASE WHEN page_id % 23 = 0 THEN NULL ELSE CAST(backlinks AS BIGINT) END AS backlinks FROM fx_crawl", "fx_crawl"))
def q_parse_ahrefs_metrics(spark, sf_dir):
    return PR.parse_ahrefs_metrics(replies.ahrefs_metrics(fx(spark, sf_dir)))


@register("parse_availability_json", f"""
SELECT 'site' || CAST(s_suppkey AS VARCHAR) || '.' || sx AS domain,
       CASE WHEN s_suppkey % 11 = 0 THEN 'API Server error 500' WHEN s_suppkey % 7 = 0 THEN 'API error'
            WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'false' END AS domain_available
FROM {SUPPLIER_DOMAINS} d""")
def q_parse_availability_json(spark, sf_dir):
    return PR.parse_availability_json(replies.availability_json(fx(spark, sf_dir)))


@register("parse_availability_lines", f"""
SELECT 'site' || CAST(s_suppkey AS VARCHAR) || '.' || sx AS domain,
       CASE WHEN (s_suppkey // 2) % 17 = 5 THEN 'API Server error 503' WHEN (s_suppkey // 2) % 13 = 0 THEN NULL
            WHEN s_suppkey % 3 = 0 THEN 'yes' ELSE 'no' END AS domain_available,
       CASE WHEN (s_suppkey // 2) % 17 <> 5 AND (s_suppkey // 2) % 13 = 0 THEN 'error,banned' END AS error
FROM {SUPPLIER_DOMAINS} d""")
def q_parse_availability_lines(spark, sf_dir):
    return PR.parse_availability_lines(replies.availability_lines(fx(spark, sf_dir)))


# --- files (S1-S10) -----------------------------------------------------------

@register("read_url_list", with_ctes("SELECT url FROM fx_urls", "fx_urls"))
def q_read_url_list(spark, sf_dir):
    """URL lines with comment, quoted-comment and blank lines, several files."""
    u = fx(spark, sf_dir).urls()
    lines = (u.select(F.col("url").alias("value"))
             .unionAll(u.where(F.col("row_id") % 97 == 0).select(F.concat(F.lit("# note "), F.col("row_id").cast("string"))))
             .unionAll(u.where(F.col("row_id") % 89 == 0).select(F.lit("")))
             .unionAll(u.where(F.col("row_id") % 83 == 0).select(F.concat(F.lit('"# '), F.col("url")))))
    folder = ST.shared_folder(spark, "urllist")
    write_parts(_as_text, lines, folder, 4)
    return SF.read_url_list(spark, [folder]).select("url")


def _metric_table(spark, sf_dir):
    """``fx_urls`` under the schema's metric names."""
    return fx(spark, sf_dir).urls().withColumnsRenamed({"tf": "trust_flow", "cf": "citation_flow"})


def _write_txt(spark, sf_dir, columns):
    folder = ST.shared_folder(spark, "resulttxt")
    write_parts(partial(SK.write_result_txt, columns=columns), _metric_table(spark, sf_dir), folder, 3)
    return folder


@register("write_read_result_txt", with_ctes("SELECT url, http_status, tf AS trust_flow, CAST(cf AS INTEGER) AS citation_flow FROM fx_urls", "fx_urls"))
def q_write_read_result_txt(spark, sf_dir):
    """S8 then S2: ``#`` header + ``|`` rows, read back into typed columns."""
    folder = _write_txt(spark, sf_dir, ["url", "http_status", "trust_flow", "citation_flow"])
    return SF.read_result_txt(spark, folder).select("url", "http_status", "trust_flow", "citation_flow")


@register("read_result_txt_ragged", with_ctes(
    "SELECT url, CASE WHEN row_id % 5 <> 0 THEN coalesce(CAST(http_status AS VARCHAR), '') END AS pr FROM fx_urls",
    "fx_urls"))
def q_read_result_txt_ragged(spark, sf_dir):
    """S2 under the default header: short rows are padded, long ones cut."""
    u = fx(spark, sf_dir).urls()
    more = F.concat(F.lit("|"), F.coalesce(F.col("http_status").cast("string"), F.lit("")),
                    F.when(F.col("row_id") % 7 == 3, F.lit("|extra")).otherwise(F.lit("")))
    line = F.concat(F.col("url"), F.when(F.col("row_id") % 5 != 0, more).otherwise(F.lit("")))
    folder = ST.shared_folder(spark, "ragged")
    write_parts(_as_text, u.select(line.alias("value")), folder, 2)
    return SF.read_result_txt(spark, folder).select("url", "pr")


CSV_ORACLE = with_ctes("SELECT url, http_status, tf AS trust_flow, 'a\"' || CAST(row_id % 10 AS VARCHAR) || '\"b' AS anchor FROM fx_urls", "fx_urls")


def _write_csv(spark, sf_dir):
    u = _metric_table(spark, sf_dir).withColumn("anchor", F.concat(F.lit('a"'), (F.col("row_id") % 10).cast("string"), F.lit('"b')))
    folder = ST.shared_folder(spark, "resultcsv")
    write_parts(partial(SK.write_result_csv, columns=["url", "http_status", "trust_flow", "anchor"]), u, folder, 3)
    return folder


@register("write_read_result_csv", CSV_ORACLE)
def q_write_read_result_csv(spark, sf_dir):
    """S7 then S3: all cells quoted, quotes escaped with a backslash."""
    return SF.read_result_csv(spark, _write_csv(spark, sf_dir)).select("url", "http_status", "trust_flow", "anchor")


def _lines(spark, folder: str, header_start: str):
    """The text lines of a folder with their numbers; the header, which each part file carries, counts once."""
    found = spark.read.text(folder).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))
    return found.withColumn("n", F.when(F.col("line").startswith(header_start), F.lit(1)).otherwise(F.col("n")).cast("long"))


@register("write_result_csv", with_ctes("""
SELECT line, count(*) AS n FROM (
  SELECT concat('"', url, '","', CAST(http_status AS VARCHAR), '","', CAST(tf AS VARCHAR), '","a\\"', CAST(row_id % 10 AS VARCHAR), '\\"b"') AS line FROM fx_urls
  UNION ALL SELECT '"URL","HTTP Status","TF","Anchor"') t GROUP BY line""", "fx_urls"))
def q_write_result_csv(spark, sf_dir):
    """The written lines themselves, read as plain text."""
    return _lines(spark, _write_csv(spark, sf_dir), '"URL"')


@register("write_result_txt", with_ctes("""
SELECT line, count(*) AS n FROM (
  SELECT concat(url, '|', CAST(http_status AS VARCHAR), '|', CAST(tf AS VARCHAR), '|', CAST(cf AS VARCHAR)) AS line FROM fx_urls
  UNION ALL SELECT '#URL|HTTP Status|TF|CF') t GROUP BY line""", "fx_urls"))
def q_write_result_txt(spark, sf_dir):
    """The written lines themselves, read as plain text."""
    return _lines(spark, _write_txt(spark, sf_dir, ["url", "http_status", "trust_flow", "citation_flow"]), "#URL")


@register("read_results", CSV_ORACLE)
def q_read_results(spark, sf_dir):
    """Format detected (CSV here) and read with the matching reader."""
    return SF.read_results(spark, _write_csv(spark, sf_dir)).select("url", "http_status", "trust_flow", "anchor")


@register("read_results_urls", with_ctes("SELECT url FROM fx_urls WHERE row_id % 2 = 0 UNION ALL SELECT url FROM fx_urls WHERE row_id % 2 = 1", "fx_urls"))
def q_read_results_urls(spark, sf_dir):
    """S4 on files without any separator: URL lists."""
    u = fx(spark, sf_dir).urls()
    folders = []
    for k in (0, 1):
        folders.append(ST.shared_folder(spark, f"plain{k}"))
        write_parts(_as_text, u.where(F.col("row_id") % 2 == k).select("url"), folders[-1], 2)
    return SF.read_results(spark, folders).select("url")


@register("read_results_txt", with_ctes("SELECT url, http_status, tf AS trust_flow FROM fx_urls", "fx_urls"))
def q_read_results_txt(spark, sf_dir):
    """S4 on delimited text."""
    folder = _write_txt(spark, sf_dir, ["url", "http_status", "trust_flow"])
    return SF.read_results(spark, folder).select("url", "http_status", "trust_flow")


REPORT_ORACLE = with_ctes(
    "SELECT page_url AS backlink_for, href AS url, 'anchor ' || CAST(k AS VARCHAR) AS anchor, 'TextLink' AS link_type, page_url AS target_url FROM fx_links",
    "fx_links")


def _reports(spark, sf_dir):
    """Two Majestic reports, each a marker and header file followed by files of rows."""
    links = fx(spark, sf_dir).links()
    row = F.concat_ws("|", F.col("page_url"), F.col("href"), F.concat(F.lit("anchor "), F.col("k").cast("string")),
                      F.lit("TextLink"), F.col("page_url"))
    folders = []
    for k in (0, 1):
        head = ST.shared_folder(spark, f"report-head{k}")
        spark.createDataFrame([("# API : Majestic\n#Backlinks for|URL|Anchor|Link type|Target URL",)], "value string").coalesce(1).write.text(head)
        body = ST.shared_folder(spark, f"report{k}")
        links.where(F.col("page_id") % 2 == k).select(row.alias("value")).write.text(body)
        folders += [head, body]
    return folders


@register("read_provider_report", REPORT_ORACLE)
def q_read_provider_report(spark, sf_dir):
    """Two reports (``# API : Majestic``, header line, ``|`` rows) → backlinks/majestic schema."""
    rep = SF.read_provider_report(spark, _reports(spark, sf_dir))
    return rep.select("backlink_for", "url", "anchor", "link_type", "target_url")


@register("read_results_provider", REPORT_ORACLE)
def q_read_results_provider(spark, sf_dir):
    """S4 on provider reports: the marker decides."""
    rep = SF.read_results(spark, _reports(spark, sf_dir))
    return rep.select("backlink_for", "url", "anchor", "link_type", "target_url")


@register("align_to_schema", with_ctes("""
SELECT row_id, url, http_status, CAST(NULL AS DOUBLE) AS dofollow_pct, CAST(NULL AS BIGINT) AS backlinks,
       CAST(NULL AS BIGINT) AS ref_domains, CAST(cf AS INTEGER) AS citation_flow, tf AS trust_flow, CAST(NULL AS VARCHAR) AS ttf_topic,
       CAST(NULL AS INTEGER) AS ttf_value, CAST(NULL AS VARCHAR) AS index_status, CAST(NULL AS VARCHAR) AS last_crawl,
       CAST(NULL AS INTEGER) AS obl, CAST(NULL AS VARCHAR) AS platform_category, CAST(NULL AS VARCHAR) AS platform,
       CAST(NULL AS VARCHAR) AS ip, CAST(NULL AS VARCHAR) AS link_alive, CAST(NULL AS VARCHAR) AS domain_available
FROM fx_urls""", "fx_urls"))
def q_align_to_schema(spark, sf_dir):
    """``fx_urls`` placed in the Majestic scrap schema."""
    u = fx(spark, sf_dir).urls().withColumnRenamed("tf", "trust_flow").withColumnRenamed("cf", "citation_flow")
    return SF.align_to_schema(u, "scrap/majestic")


@register("write_status_log", with_ctes("""
SELECT CASE WHEN c.http_status IN (301, 302, 307, 308)
            THEN c.url || chr(9) || CAST(c.http_status AS VARCHAR) || chr(9) || coalesce(r.location, '')
            ELSE c.url || chr(9) || CAST(c.http_status AS VARCHAR) END AS value
FROM fx_crawl c LEFT JOIN fx_redirects r USING (url) WHERE c.http_status <> 200""", "fx_crawl", "fx_redirects"))
def q_write_status_log(spark, sf_dir):
    """Rows whose guard action is ``log`` (status different from 200) appended to the log."""
    f = fx(spark, sf_dir)
    df = f.crawl().join(f.redirects().select("url", "location"), "url", "left").withColumn("http_status", F.col("http_status").cast("int"))
    folder = ST.shared_folder(spark, "statuslog")
    SK.write_status_log(df, folder, [("different", 200, "log")])
    return spark.read.text(folder)


@register("append_session_results", with_ctes(
    "SELECT url AS value FROM fx_urls WHERE row_id % 9 <> 0 UNION ALL SELECT url FROM fx_urls WHERE row_id % 9 <> 0", "fx_urls"))
def q_append_session_results(spark, sf_dir):
    """Two runs append their non-empty items to one session folder."""
    u = fx(spark, sf_dir).urls().select(F.when(F.col("row_id") % 9 == 0, F.lit("")).otherwise(F.col("url")).alias("item"))
    folder = ST.shared_folder(spark, "session")
    SK.append_session_results(u, folder)
    SK.append_session_results(u, folder)
    return spark.read.text(folder)


# --- streaming (T1-T3) --------------------------------------------------------

def _stage(df, spark, name, batches=4):
    """The stream of ``df``'s rows, which arrive as files, in at most ``batches`` micro-batches."""
    folder = ST.shared_folder(spark, name)
    write_parts(_as_parquet, df, folder, batches)
    staged = spark.read.parquet(folder)
    return ST.read_stream(spark, folder, staged.schema, files_per_trigger=-(-len(staged.inputFiles()) // batches))


@register("stream_links", with_ctes(ALL_LINKS_SQL, "fx_links"))
def q_stream_links(spark, sf_dir):
    """Pages arrive as files; links appended per micro-batch (= batch C1)."""
    arriving = _stage(fx(spark, sf_dir).html(), spark, "pages-in")
    sink, ckpt = ST.shared_folder(spark, "links-out"), ST.shared_folder(spark, "links-ckpt")
    ST.run_append(ST.stream_links(arriving), sink, ckpt)
    return spark.read.parquet(sink).select("page_id", "page_url", "pos", "href", "rel")


@register("stream_items", """
SELECT page_id, 'nav' AS rule, CAST(generate_subscripts(xs, 1) - 1 AS INTEGER) AS idx, unnest(xs) AS item
FROM (SELECT page_id, regexp_extract_all(html, '<a href="(/[^"]*)"', 1) AS xs FROM pages) t""")
def q_stream_items(spark, sf_dir):
    """T1 with S10: pages arrive as files; link-rule items are appended per
    micro-batch to a sink and to the session folder."""
    from ..operators import elements as EL

    arriving = _stage(fx(spark, sf_dir).pages(), spark, "pages-items-in")
    sink, session, ckpt = ST.shared_folder(spark, "items-out"), ST.shared_folder(spark, "items-session"), ST.shared_folder(spark, "items-ckpt")
    rule = EL.Rule("nav", "a", (EL.Test("href", "starts-with", "/"),), "@href")
    ST.run_append_with_session(ST.stream_items(arriving, [rule]), sink, session, ckpt)
    out = spark.read.parquet(sink)
    return out.select("page_id", "rule", "idx", "item")


@register("stream_items_text", """
SELECT page_id, 'h1' AS rule, 0 AS idx,
       replace(replace(replace(replace(replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&lt;', '<'), '&gt;', '>'),
               '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '&amp', '&') AS item FROM pages""")
def q_stream_items_text(spark, sf_dir):
    """T1 with a text rule: each micro-batch runs C3's parser engine inside foreachBatch."""
    from ..operators import elements as EL

    arriving = _stage(fx(spark, sf_dir).pages(), spark, "pages-text-in")
    sink, session, ckpt = ST.shared_folder(spark, "text-out"), ST.shared_folder(spark, "text-session"), ST.shared_folder(spark, "text-ckpt")
    ST.run_items_per_batch(arriving, [EL.Rule("h1", "h1")], sink, session, ckpt)
    return spark.read.parquet(sink).select("page_id", "rule", "idx", "item")


@register("stream_session_items", """SELECT unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS value FROM pages""")
def q_stream_session_items(spark, sf_dir):
    """S10 fed by T1: the session folder holds every non-empty item once."""
    from ..operators import elements as EL

    arriving = _stage(fx(spark, sf_dir).pages(), spark, "pages-sess-in")
    sink, session, ckpt = ST.shared_folder(spark, "sess-out"), ST.shared_folder(spark, "sess-session"), ST.shared_folder(spark, "sess-ckpt")
    rule = EL.Rule("nav", "a", (EL.Test("href", "starts-with", "/"),), "@href")
    ST.run_append_with_session(ST.stream_items(arriving, [rule]), sink, session, ckpt)
    return spark.read.text(session).select("value")


@register("stream_dedup", with_ctes("SELECT DISTINCT url FROM fx_urls", "fx_urls"))
def q_stream_dedup(spark, sf_dir):
    """URL key set after streaming de-duplication (= key set of A1)."""
    u = fx(spark, sf_dir).urls().withColumn("ts", F.timestamp_seconds(F.col("row_id")))
    arriving = _stage(u, spark, "urls-in")
    sink, ckpt = ST.shared_folder(spark, "dedup-out"), ST.shared_folder(spark, "dedup-ckpt")
    # one file holds any time of the table: a URL may come again after the whole span
    span = u.agg((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("s")).first()
    ST.run_append(ST.stream_dedup(arriving, delay=f"{(span.s or 0) + 1} seconds"), sink, ckpt)
    return spark.read.parquet(sink).select("url")


@register("stream_counts", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end, count(*) AS events
FROM events GROUP BY 1, 2""")
def q_stream_counts(spark, sf_dir):
    """Events per day window with a watermark, update mode, last value per window."""
    ev = fx(spark, sf_dir).base("events").select("event_id", "ts")
    # the files arrive in any order, so events may be later than the newest one by the table's whole span
    arriving = _stage(ev, spark, "events-in")
    span = ev.agg(F.datediff(F.max("ts"), F.min("ts")).alias("d")).first()
    sink, ckpt = ST.shared_folder(spark, "counts-out"), ST.shared_folder(spark, "counts-ckpt")
    ST.run_updates(ST.stream_counts(arriving, delay=f"{(span.d or 0) + 1} days"), sink, ckpt)
    c = ST.latest_counts(spark, sink)
    fmt = "yyyy-MM-dd HH:mm:ss"
    return c.select(F.date_format("window_start", fmt).alias("window_start"), F.date_format("window_end", fmt).alias("window_end"), "events")


# --- jobs ---------------------------------------------------------------------

# The links by page number: page a's k-th link is to page (7 a + 13 k + 1) mod n.  Hosts are compared once per link, every join
# is by page number.
_L3 = """WITH n AS (SELECT count(*) AS n FROM pages),
site AS (SELECT page_id, url, split_part(url, '://', 1) || '://' || split_part(split_part(url, '://', 2), '/', 1) AS site, page_id % 10 AS r FROM pages),
src AS (SELECT page_id, url, site, CASE r WHEN 0 THEN 404 WHEN 1 THEN 301 WHEN 2 THEN 302 WHEN 3 THEN 500 WHEN 4 THEN NULL ELSE 200 END AS http_status FROM site),
link AS (SELECT page_id, k, (page_id * 7 + k * 13 + 1) % n.n AS target, (page_id + k) % 3 = 0 AS nofollow FROM pages, n, range(5) z(k)),
stat AS (SELECT l.page_id, CAST(count(*) FILTER (WHERE NOT starts_with(t.url, s.site)) AS DOUBLE) AS ext,
                CAST(count(*) FILTER (WHERE NOT starts_with(t.url, s.site) AND l.nofollow) AS DOUBLE) AS nof
         FROM link l JOIN src s ON s.page_id = l.page_id JOIN src t ON t.page_id = l.target GROUP BY l.page_id),
pct AS (SELECT page_id, CASE WHEN ext = 0 THEN 0.0 ELSE (ext - nof) * 100.0 / ext END AS dofollow_pct FROM stat),
row AS (SELECT l.page_id, l.k, a.url AS page_url, b.url AS href, b.http_status, p.dofollow_pct
        FROM link l JOIN src a ON a.page_id = l.page_id JOIN src b ON b.page_id = l.target JOIN pct p ON p.page_id = l.target)
"""


@register("ingest_backlinks", _L3 + """SELECT page_url AS backlink_for, href AS url, 'anchor ' || CAST(k AS VARCHAR) AS anchor, http_status, dofollow_pct
FROM row WHERE page_id % 17 <> 0""")
def q_ingest_backlinks(spark, sf_dir):
    """L3: Majestic link lists → backlinks schema → status and dofollow of each linking page."""
    f = fx(spark, sf_dir)
    out = jobs.ingest_backlinks(replies.majestic_links(f), "majestic", fetch_log=f.fetch_log(), pages=f.html())
    return out.select("backlink_for", "url", "anchor", "http_status", "dofollow_pct")


@register("list_rules", "SELECT p_partkey AS rule_id, p_name AS name, r_name AS group_name FROM part LEFT JOIN region ON r_regionkey = p_partkey % 7")
def q_list_rules(spark, sf_dir):
    """Rules with their group (rules from ``part``, groups from ``region``)."""
    f = fx(spark, sf_dir)
    rules = f.base("part").select(F.col("p_partkey").alias("rule_id"), F.col("p_name").alias("name"), (F.col("p_partkey") % 7).alias("group_id"))
    groups = f.base("region").select(F.col("r_regionkey").alias("group_id"), F.col("r_name").alias("group_name"))
    return list_rules(rules, groups).select("rule_id", "name", "group_name")


@register("scrape_snapshot", with_ctes("""
SELECT item, url FROM (
  SELECT item, url, row_number() OVER (PARTITION BY item ORDER BY page_id DESC) AS rn FROM (
    SELECT p.page_id, p.url,
           replace(replace(replace(replace(replace(replace(regexp_extract(p.html, '<h1>(.*?)</h1>', 1), '&lt;', '<'), '&gt;', '>'),
                   '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '&amp', '&') || ' (' || p.url || ')' AS item
    FROM pages p JOIN fx_crawl c USING (page_id)
    WHERE (c.http_status IS NULL OR c.http_status <= 399) AND NOT contains(p.html, 'cheap-pills')) t) d
WHERE rn = 1""", "fx_crawl"))
def q_scrape_snapshot(spark, sf_dir):
    """L2: frontier (G2, G5) → pages → guards (F12, F13) → h1 items (C3, P21) → P11 → A1."""
    f = fx(spark, sf_dir)
    fetched = f.pages().join(f.crawl().select("page_id", F.col("http_status").cast("int")), "page_id")
    out = jobs.scrape_snapshot(
        spark, "{%custom1%}", f.crawl().select("url"), None, fetched,
        EL.Rule("h1", "h1", keep_html=False, suffix=" ({%custom1%})"),
        http_rules=[("higher", 399, "skip")], content_rules=[("contains", "cheap-pills", "skip")])
    return out.select("item", "url")


@register("ingest_backlinks_ahrefs", _L3 + """SELECT page_url AS backlink_for, href AS url, 'a' || CAST(k AS VARCHAR) AS anchor, http_status, dofollow_pct
FROM row WHERE page_id % 13 <> 0""")
def q_ingest_backlinks_ahrefs(spark, sf_dir):
    """L3 over Ahrefs link lists (error replies give no rows)."""
    f = fx(spark, sf_dir)
    out = jobs.ingest_backlinks(replies.ahrefs_links(f), "ahrefs", fetch_log=f.fetch_log(), pages=f.html())
    return out.select("backlink_for", "url", "anchor", "http_status", "dofollow_pct")


@register("ingest_backlinks_moz", _L3 + """SELECT page_url AS backlink_for, 'http://' || split_part(href, '://', 2) AS url, 'a' || CAST(k AS VARCHAR) AS anchor,
       200 AS http_status, CASE WHEN starts_with(href, 'http://') THEN dofollow_pct END AS dofollow_pct
FROM row WHERE page_id % 19 <> 0""")
def q_ingest_backlinks_moz(spark, sf_dir):
    """L3 over Moz link lists: the reply carries each link's status (kept, as the
    status step fills empty cells only); URLs come back as http://..., so
    https sources find no page for dofollow."""
    f = fx(spark, sf_dir)
    out = jobs.ingest_backlinks(replies.moz_links(f), "moz", fetch_log=f.fetch_log(), pages=f.html())
    return out.select("backlink_for", "url", "anchor", "http_status", "dofollow_pct")


@register("ingest_backlinks_ref_domains", f"""
SELECT 'block' || CAST(s_suppkey // 10 AS VARCHAR) AS backlink_for, 'http://site' || CAST(s_suppkey AS VARCHAR) || '.' || sx AS url,
       CAST(s_nationkey AS INTEGER) AS citation_flow, CAST(s_suppkey % 50 AS INTEGER) AS trust_flow,
       'T' || CAST(s_nationkey AS VARCHAR) AS ttf_topic, CAST(s_nationkey AS INTEGER) AS ttf_value,
       '10.9.' || CAST(s_suppkey % 256 AS VARCHAR) || '.1' AS ip, CAST(NULL AS INTEGER) AS http_status
FROM {SUPPLIER_DOMAINS} d""")
def q_ingest_backlinks_ref_domains(spark, sf_dir):
    """L3 over Majestic referring domains (S12): the same table as link lists."""
    f = fx(spark, sf_dir)
    out = jobs.ingest_backlinks(replies.majestic_ref_domains(f), "majestic_ref_domains", fetch_log=f.fetch_log(), pages=f.html())
    return out.select("backlink_for", "url", "citation_flow", "trust_flow", "ttf_topic", "ttf_value", "ip", "http_status")


@register("ingest_errors", with_ctes("""
SELECT DISTINCT 'majestic' AS provider, page_url AS backlink_for, 'quota exceeded' AS error FROM fx_links WHERE page_id % 17 = 0
UNION ALL SELECT DISTINCT 'ahrefs', page_url, 'quota' FROM fx_links WHERE page_id % 13 = 0
UNION ALL SELECT DISTINCT 'moz', page_url, 'too many requests' FROM fx_links WHERE page_id % 19 = 0""", "fx_links"))
def q_ingest_errors(spark, sf_dir):
    """L3: the replies of each provider that gave no rows."""
    f = fx(spark, sf_dir)
    parts = [jobs.ingest_errors(raw(f), p).select(F.lit(p).alias("provider"), "backlink_for", "error").distinct()
             for p, raw in (("majestic", replies.majestic_links), ("ahrefs", replies.ahrefs_links), ("moz", replies.moz_links))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("scrape_snapshot_placeholders", """
SELECT url || '#me' AS item, url, url AS custom1, max(page_id) AS page_id FROM pages GROUP BY url""")
def q_scrape_snapshot_placeholders(spark, sf_dir):
    """L2 with ``{%custom1%}`` in the rule: of all anchors the one that begins with the row's own URL."""
    f = fx(spark, sf_dir)
    pages = f.pages().withColumn("html", F.concat("html", F.lit('<a href="http://other/#me">o</a><a class="s" href="'), F.col("url"), F.lit('#me">s</a>')))
    rule = EL.Rule("me", "a", (EL.Test("href", "starts-with", "{%custom1%}"),), "@href")
    out = jobs.scrape_snapshot(spark, "{%custom1%}", pages.select("url").distinct(), None, pages, rule)
    return out.select("item", "url", "custom1", "page_id")


@register("scrape_snapshot_encoded", """
SELECT '#' || CAST(page_id AS VARCHAR) AS item, url || '?a=1&b=' || CAST(page_id AS VARCHAR) AS url FROM pages""")
def q_scrape_snapshot_encoded(spark, sf_dir):
    """L2 with ``{%scrapurl::encoded%}`` in the rule: the page's URL as markup writes it, ``&`` as ``&amp;``."""
    f = fx(spark, sf_dir)
    p = f.pages().select("page_id", F.concat("url", F.lit("?a=1&b="), F.col("page_id").cast("string")).alias("url"), F.col("page_id").cast("string").alias("n"))
    link = lambda form: F.concat(F.lit('<a href="'), form, F.lit('">x</a>'))
    own, other = F.regexp_replace("url", "&", "&amp;amp;"), F.regexp_replace(F.col("url"), "&", "%26")
    pages = p.withColumn("html", F.concat(link(F.concat(other, F.lit("#no"))), link(F.concat(own, F.lit("#"), F.col("n")))))
    rule = EL.Rule("own", "a", (EL.Test("href", "starts-with", "{%scrapurl::encoded%}"),), "@href")
    out = jobs.scrape_snapshot(spark, "{%custom1%}", pages.select("url"), None, pages, rule)
    return out.select(F.regexp_extract("item", "#[0-9]+$", 0).alias("item"), "url")


H1_TEXT = """replace(replace(replace(replace(replace(replace(regexp_extract(p.html, '<h1>(.*?)</h1>', 1), '&lt;', '<'), '&gt;', '>'),
                   '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '&amp', '&')"""


@register("scrape_snapshot_paged", f"""
WITH skipped AS (
  SELECT a.page_id FROM pages a LEFT JOIN pages n ON n.page_id = a.page_id + 1
  WHERE contains(a.html, 'cheap-pills') OR (a.page_id % 4 <> 3 AND contains(n.url, 'cheap-pills')))
SELECT {H1_TEXT} || ' (' || s.url || ' ' || p.url || ')' AS item, s.url, p.url AS page_url
FROM pages s JOIN pages p ON p.page_id BETWEEN s.page_id AND s.page_id + 3
WHERE s.page_id % 4 = 0 AND NOT EXISTS (SELECT 1 FROM skipped k WHERE k.page_id BETWEEN s.page_id AND p.page_id)""")
def q_scrape_snapshot_paged(spark, sf_dir):
    """L2 with pagination: every page of the chain behind each frontier URL; a page that the guard skips ends its chain."""
    f = fx(spark, sf_dir)
    paged = f.paged_html()
    rule = EL.Rule("h1", "h1", suffix=" ({%custom1%} {%scrapurl%})")
    out = jobs.scrape_snapshot(spark, "{%custom1%}", paged.where(F.col("page_id") % 4 == 0).select("url"), None, paged, rule,
                               content_rules=[("contains", "cheap-pills", "skip")], pagination=EL.Rule("next", "a", (EL.Test("class", "=", "next"),), "@href"))
    return out.select("item", "url", "page_url")


@register("scrape_snapshot_json", """
SELECT v || ' (http://o/' || CAST(o_orderkey AS VARCHAR) || ')' AS item, 'http://o/' || CAST(o_orderkey AS VARCHAR) AS url, o_orderkey AS page_id FROM (
  SELECT o_orderkey, o_orderstatus AS v FROM orders UNION ALL SELECT o_orderkey, o_orderpriority FROM orders
  UNION ALL SELECT o_orderkey, 'c' || CAST(o_custkey AS VARCHAR) FROM orders) t""")
def q_scrape_snapshot_json(spark, sf_dir):
    """L2 over JSON bodies: the items of one path."""
    o = fx(spark, sf_dir).base("orders")
    body = F.to_json(F.struct(F.array(F.col("o_orderstatus"), F.col("o_orderpriority"), F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("arr")))
    pages = o.select(F.col("o_orderkey").alias("page_id"), F.concat(F.lit("http://o/"), F.col("o_orderkey").cast("string")).alias("url"), body.alias("html"))
    out = jobs.scrape_snapshot(spark, "{%custom1%}", pages.select("url"), None, pages, EL.Rule("v", "*", suffix=" ({%custom1%})"), json_path="arr")
    return out.select("item", "url", "page_id")


N_HEADERS = 40


@register("scrape_snapshot_headers", "SELECT page_id, " + ", ".join(f"'{k}-' || CAST(page_id AS VARCHAR) AS h{k}" for k in range(N_HEADERS)) + " FROM pages")
def q_scrape_snapshot_headers(spark, sf_dir):
    """L2 split into 40 header columns."""
    f = fx(spark, sf_dir)
    cells = F.concat_ws('","', *[F.concat(F.lit(f"{k}-"), F.col("page_id").cast("string")) for k in range(N_HEADERS)])
    pages = f.pages().withColumn("html", F.concat("html", F.lit("<b data-row='\""), cells, F.lit("\"'>r</b>")))
    out = jobs.scrape_snapshot(spark, "{%custom1%}", pages.select("url").distinct(), None, pages, EL.Rule("row", "b", (EL.Test("data-row", "exists"),), "@data-row"),
                               headers=[f"H{k}" for k in range(N_HEADERS)])
    return out.select(F.col("h0").substr(3, 20).cast("long").alias("page_id"), *[f"h{k}" for k in range(N_HEADERS)])
