"""The scalar URL functions as SQL functions (Spark SQL user-defined functions
written in SQL: they are inlined by Catalyst, no Python runs).

``register_sql_functions(spark)`` creates temporary functions named
``ss_<name>``, so a SQL user can write, e.g.::

    SELECT ss_url_host(url), ss_resolve_url(url, href) FROM links

The bodies use the same fixed patterns as :mod:`sitesieve.functions.url`; a
test checks each one against its Column function on the driver tables.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import url as U


def _q(s: str) -> str:
    """SQL string literal (Spark's default string escapes: backslash and quote)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


URL_RE = _q(U.URL_RE)
ABS_RE = _q(U.ABSOLUTE_RE)

FUNCTIONS = {
    "ss_url_scheme": ("u STRING", "STRING", f"lower(regexp_extract(u, {URL_RE}, 1))"),
    "ss_url_host": ("u STRING", "STRING", f"lower(regexp_extract(u, {URL_RE}, 3))"),
    "ss_url_path": ("u STRING", "STRING", f"regexp_extract(u, {URL_RE}, 5)"),
    "ss_is_absolute": ("u STRING", "BOOLEAN", f"coalesce(u RLIKE {ABS_RE}, false)"),
    "ss_site_root": ("u STRING", "STRING",
                     f"CASE WHEN u RLIKE {ABS_RE} THEN concat(ss_url_scheme(u), '://', ss_url_host(u)) ELSE '' END"),
    "ss_simplified": ("u STRING", "STRING", r"regexp_replace(regexp_replace(u, '^\\s+|\\s+$', ''), '\\s+', ' ')"),
    "ss_status_class": ("s INT", "STRING",
                        "CASE WHEN s BETWEEN 200 AND 299 THEN 'ok' WHEN s BETWEEN 300 AND 399 THEN 'redirect' "
                        "WHEN s >= 400 THEN 'error' ELSE 'none' END"),
    "ss_percent_encode": ("v STRING", "STRING",
                          "replace(replace(replace(url_encode(v), '+', '%20'), '*', '%2A'), '%7E', '~')"),
    "ss_percent_decode": ("v STRING", "STRING", "coalesce(try_url_decode(replace(v, '+', '%2B')), v)"),
    "ss_decode_if_absolute": ("v STRING", "STRING", "CASE WHEN ss_is_absolute(v) THEN ss_percent_decode(v) ELSE v END"),
    "ss_remove_dot_segments": ("p STRING", "STRING",
                               "concat('/', array_join(CASE WHEN element_at(split(p, '/'), -1) IN ('.', '..') "
                               "THEN array_append(ss_dot_stack(p), '') ELSE ss_dot_stack(p) END, '/'))"),
    "ss_dot_stack": ("p STRING", "ARRAY<STRING>",
                     "aggregate(slice(split(p, '/'), 2, greatest(size(split(p, '/')) - 1, 1)), CAST(array() AS ARRAY<STRING>), "
                     "(acc, seg) -> CASE WHEN seg = '..' THEN slice(acc, 1, greatest(size(acc) - 1, 0)) "
                     "WHEN seg = '.' THEN acc ELSE array_append(acc, seg) END)"),
    "ss_resolve_url": ("b STRING, r0 STRING", "STRING",
                       "CASE WHEN r0 IS NULL THEN NULL "
                       f"WHEN replace(r0, '&amp;', '&') RLIKE {_q(U.SCHEME_RE)} THEN replace(r0, '&amp;', '&') "
                       "WHEN startswith(r0, '?') OR startswith(r0, '#') THEN concat(b, replace(r0, '&amp;', '&')) "
                       "WHEN startswith(r0, '//') THEN concat(ss_url_scheme(b), ':', replace(r0, '&amp;', '&')) "
                       "WHEN startswith(r0, '/') THEN ss_join_path(concat(ss_url_scheme(b), '://', ss_url_host(b)), replace(r0, '&amp;', '&')) "
                       "ELSE ss_join_path(concat(ss_url_scheme(b), '://', ss_url_host(b)), "
                       "concat(regexp_replace(ss_url_path(b), '/[^/]*$', ''), '/', replace(r0, '&amp;', '&'))) END"),
    "ss_join_path": ("root STRING, merged STRING", "STRING",
                     "concat(root, ss_remove_dot_segments(regexp_extract(merged, '^[^?#]*', 0)), "
                     "substring(merged, length(regexp_extract(merged, '^[^?#]*', 0)) + 1))"),
}

# definition order: a function is created after the ones its body calls
ORDER = ["ss_url_scheme", "ss_url_host", "ss_url_path", "ss_is_absolute", "ss_site_root", "ss_simplified",
         "ss_status_class", "ss_percent_encode", "ss_percent_decode", "ss_decode_if_absolute", "ss_dot_stack",
         "ss_remove_dot_segments", "ss_join_path", "ss_resolve_url"]


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create the ``ss_*`` temporary SQL functions in ``spark``; returns their names."""
    for name in ORDER:
        params, ret, body = FUNCTIONS[name]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {ret} RETURN {body}")
    return list(ORDER)
