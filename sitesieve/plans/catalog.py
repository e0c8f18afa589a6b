"""Registered queries (one per operator of SURVEY §2) and their DuckDB oracles.

Each query takes ``(spark, sf_dir)``, builds its stand-in input from the
driver tables (``fixtures``) and runs the library operator on the whole
input.  Each oracle is an independent SQL text over the raw tables: the
fixture definition is inlined as CTEs and the expected answer is computed
without going through our operators (for page operators it comes from
``fx_links``, which never parses HTML).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import content as C
from .fixtures import Fixtures, with_ctes

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


# --- SQL helpers for the oracle: plain string functions, none of the library's patterns --------

def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_host(u: str) -> str:
    authority = f"split_part(split_part(split_part(split_part({u}, '://', 2), '/', 1), '?', 1), '#', 1)"
    after_user = f"list_extract(string_split({authority}, '@'), -1)"
    return f"lower(split_part({after_user}, ':', 1))"


def sql_scheme(u: str) -> str:
    return f"(CASE WHEN contains({u}, '://') THEN lower(split_part({u}, '://', 1)) ELSE '' END)"


def sql_abs(u: str) -> str:
    return f"coalesce(strpos({u}, '://') > 1 AND split_part({u}, '://', 2) <> '', false)"


def sql_site(u: str) -> str:
    return f"(CASE WHEN {sql_abs(u)} THEN {sql_scheme(u)} || '://' || {sql_host(u)} ELSE '' END)"


def sql_ext(href: str, page_url: str) -> str:
    return f"(({href} LIKE 'http://%' OR {href} LIKE 'https://%') AND NOT starts_with({href}, {sql_site(page_url)}))"


# --- minimum slice: links, outbound links, dofollow % ------------------------

# All anchors of fx_html: the pages' own ones (all of the form <a href="/...">
# in the driver data) in order, then the five appended ones of fx_links.
ALL_LINKS_SQL = """
SELECT page_id, url AS page_url, CAST(generate_subscripts(own, 1) - 1 AS INTEGER) AS pos, unnest(own) AS href,
       CAST(NULL AS VARCHAR) AS rel
FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="(/[^"]*)">', 1) AS own FROM pages) b
UNION ALL
SELECT l.page_id, l.page_url, CAST(len(regexp_extract_all(p.html, '<a href="(/[^"]*)">', 1)) + l.k AS INTEGER) AS pos, l.href, l.rel
FROM fx_links l JOIN pages p USING (page_id)"""


@register("extract_links", with_ctes(ALL_LINKS_SQL, "fx_links"))
def q_extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 on ``fx_html``: every anchor of every page, with its position."""
    return C.extract_links(Fixtures(spark, sf_dir).html())


@register(
    "outbound_links",
    with_ctes(
        f"""SELECT c.page_id, c.url,
                   CAST(count(l.href) FILTER (WHERE {sql_ext('l.href', 'c.url')}) AS INTEGER) AS obl
            FROM fx_crawl c LEFT JOIN fx_links l ON l.page_id = c.page_id
            GROUP BY c.page_id, c.url""",
        "fx_crawl", "fx_links",
    ),
)
def q_outbound_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 on ``fx_html``."""
    return C.outbound_links(Fixtures(spark, sf_dir).html())


@register(
    "dofollow_pct",
    with_ctes(
        f"""SELECT page_id, url,
                   CAST(CASE WHEN ext = 0 THEN 0.0 ELSE (ext - nof) * 100.0 / ext END AS DOUBLE) AS dofollow_pct
            FROM (SELECT c.page_id, c.url,
                         CAST(count(l.href) FILTER (WHERE {sql_ext('l.href', 'c.url')}) AS DOUBLE) AS ext,
                         CAST(count(l.href) FILTER (WHERE {sql_ext('l.href', 'c.url')} AND l.rel = 'nofollow') AS DOUBLE) AS nof
                  FROM fx_crawl c LEFT JOIN fx_links l ON l.page_id = c.page_id
                  GROUP BY c.page_id, c.url) t""",
        "fx_crawl", "fx_links",
    ),
)
def q_dofollow_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 on ``fx_html``."""
    return C.dofollow_pct(Fixtures(spark, sf_dir).html())


# Query groups register themselves on import (kept after the helpers above).
from . import cat_urls  # noqa: E402,F401
from . import cat_enrich  # noqa: E402,F401
from . import cat_content  # noqa: E402,F401
from . import cat_sources  # noqa: E402,F401

# SURVEY §2 operator names served by a query registered under a combined name.
ALIASES = {
    "read_result_txt": "write_read_result_txt",
    "read_result_csv": "write_read_result_csv",
    "stream_append": "stream_links",
}
for _alias, _name in ALIASES.items():
    QUERIES[_alias] = QUERIES[_name]
    if _name in ORACLE:
        ORACLE[_alias] = ORACLE[_name]
