"""Row filters (F1-F16).

All filters are lazy ``DataFrame -> DataFrame`` transforms whose predicates
reach the Parquet scan when the input is a scan (Catalyst pushes simple
comparisons down).  The reference reports the number of removed rows; here
that is the action :func:`removed_count`, so filters never run eagerly.

Null rule (Decision, SURVEY §2.3): a NULL cell is never "equal", "lower" or
"higher", so ``drop_equal``, ``drop_lower`` and ``drop_higher`` keep NULL rows
and ``drop_not_equal`` drops them.  An empty search value is a no-op; an
unknown filter name raises.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import url as U
from .urls import SuffixTable, _require, with_public_suffix


def removed_count(before: DataFrame, after: DataFrame) -> int:
    """Action: rows removed by a filter chain."""
    return before.count() - after.count()


def removed_counts(before: DataFrame, results: dict[str, DataFrame]) -> DataFrame:
    """The reference's "N rows removed" report as a lazy DataFrame: one row per
    named filter result with ``removed = count(before) - count(result)``."""
    total = before.select(F.count("*").cast("long")).scalar()
    parts = [df.agg(F.count("*").cast("long").alias("_n")).select(F.lit(name).alias("filter"), (total - F.col("_n")).alias("removed"))
             for name, df in results.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class FilterChain:
    """Named filters one after the other; the rows each removes are counted while the result is written.

    ``chain.result`` is the filtered frame.  Once an action has run on it, ``chain.report()`` gives
    (step, filter, removed, kept) in the order of the steps, without reading the input again: each
    frame between two filters is observed (``DataFrame.observe``).  Predicates are not pushed below
    an observed frame, as the rows before them are counted; unused columns are still pruned.
    """

    def __init__(self, df: DataFrame, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]]):
        self.names = [name for name, _ in steps]
        self._seen: list[Observation] = []
        self.result = self._observed(df)
        for _, step in steps:
            self.result = self._observed(step(self.result))

    def _observed(self, df: DataFrame) -> DataFrame:
        self._seen.append(Observation())
        return df.observe(self._seen[-1], F.count(F.lit(1)).alias("rows"))

    def report(self) -> list[tuple[int, str, int, int]]:
        """Waits for the first action on ``result``; call it after one."""
        rows = [seen.get["rows"] for seen in self._seen]
        return [(i + 1, name, rows[i] - rows[i + 1], rows[i + 1]) for i, name in enumerate(self.names)]


def remove_bad_urls(df: DataFrame, status_col: str = "http_status") -> DataFrame:
    """keep 200 <= status < 400, or an empty status."""
    _require(df, status_col)
    s = F.col(status_col)
    return df.where(s.isNull() | ((s >= 200) & (s < 400)))


def remove_subdomains(df: DataFrame, suffixes: SuffixTable | DataFrame, col: str = "url") -> DataFrame:
    """keep URLs whose host, once ``.<public suffix>`` is removed from it, has
    no dot, or exactly one dot and starts with ``www.``.  Empty URLs are dropped
    (invalid); a relative URL has an empty host and is kept, as in the reference.
    """
    _require(df, col)
    h = U.url_host(col)
    cur = with_public_suffix(df, suffixes, h, "_sfx")
    # every occurrence of ".<suffix>" removed from the host (so a host that is
    # itself a suffix keeps its dot and is removed, as in the reference)
    rest = F.when(F.col("_sfx") == "", h).otherwise(F.replace(h, F.concat(F.lit("."), F.col("_sfx")), F.lit("")))
    dots = F.length(rest) - F.length(F.replace(rest, F.lit("."), F.lit("")))
    keep = F.col(col).isNotNull() & (F.col(col) != "") & ((dots < 1) | ((dots == 1) & rest.startswith("www.")))
    return cur.where(keep).drop("_sfx")


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def drop_containing(df: DataFrame, col: str, s: str) -> DataFrame:
    """keep rows whose cell does not contain ``s`` (case-sensitive); NULL kept."""
    _require(df, col)
    if s == "":
        return df
    return df.where(~F.coalesce(_text(col).contains(s), F.lit(False)))


def drop_not_containing(df: DataFrame, col: str, s: str) -> DataFrame:
    """keep rows whose cell contains ``s``."""
    _require(df, col)
    if s == "":
        return df
    return df.where(F.coalesce(_text(col).contains(s), F.lit(False)))


def drop_matching(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """keep rows where ``pattern`` is found nowhere in the cell; NULL kept."""
    _require(df, col)
    if pattern == "":
        return df
    return df.where(~F.coalesce(_text(col).rlike(pattern), F.lit(False)))


def drop_not_matching(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """keep rows where ``pattern`` is found."""
    _require(df, col)
    if pattern == "":
        return df
    return df.where(F.coalesce(_text(col).rlike(pattern), F.lit(False)))


def drop_equal(df: DataFrame, col: str, v) -> DataFrame:
    """keep value != v (NULL kept)."""
    _require(df, col)
    c = F.col(col)
    return df.where(c.isNull() | (c != F.lit(v)))


def drop_not_equal(df: DataFrame, col: str, v) -> DataFrame:
    """F8: keep value = v (NULL dropped)."""
    _require(df, col)
    return df.where(F.col(col) == F.lit(v))


def drop_lower(df: DataFrame, col: str, v) -> DataFrame:
    """keep value >= v (NULL kept)."""
    _require(df, col)
    c = F.col(col)
    return df.where(c.isNull() | (c >= F.lit(v)))


def drop_higher(df: DataFrame, col: str, v) -> DataFrame:
    """keep value <= v (NULL kept)."""
    _require(df, col)
    c = F.col(col)
    return df.where(c.isNull() | (c <= F.lit(v)))


FILTERS = {
    "contains": drop_containing,
    "notcontains": drop_not_containing,
    "regex": drop_matching,
    "notregex": drop_not_matching,
    "equal": drop_equal,
    "notequal": drop_not_equal,
    "lower": drop_lower,
    "higher": drop_higher,
}


def delete_with_filter(df: DataFrame, name: str, col: str, value) -> DataFrame:
    """The delete dialog: one of F3-F10 by name; an unknown name raises."""
    if name not in FILTERS:
        raise ValueError(f"unknown filter {name!r}; expected one of {sorted(FILTERS)}")
    return FILTERS[name](df, col, value)


def drop_selected(df: DataFrame, selected: DataFrame, key: str = "row_id") -> DataFrame:
    """remove the selected rows (``selected`` holds their keys).

    A left-anti join: AQE turns it into a broadcast join when the selection is
    small and keeps a shuffle join otherwise.  Row ids keep their values; the
    order they carry is unchanged.
    """
    _require(df, key)
    return df.join(selected.select(key).distinct(), key, "left_anti")


# --- request guards ---------------------------------------------------------

_CONDITIONS = {
    "equal": lambda s, code: s == code,
    "different": lambda s, code: s != code,
    "higher": lambda s, code: s > code,
    "lower": lambda s, code: s < code,
}
_ACTIONS = ("retry", "skip", "log")


def apply_http_guard(df: DataFrame, rules: list[tuple[str, int, str]], status_col: str = "http_status", out: str = "disposition") -> DataFrame:
    """``disposition`` from (condition, code, action) rules tried in order.

    Conditions: equal / different / higher / lower against ``code``; actions:
    retry / skip / log; no rule applies → ``process``.  A NULL status matches
    no rule.
    """
    _require(df, status_col)
    s = F.col(status_col)
    expr = None
    for cond, code, action in rules:
        if cond not in _CONDITIONS or action not in _ACTIONS:
            raise ValueError(f"bad guard rule {(cond, code, action)!r}")
        test = F.coalesce(_CONDITIONS[cond](s, F.lit(code)), F.lit(False))
        expr = F.when(test, F.lit(action)) if expr is None else expr.when(test, F.lit(action))
    value = F.lit("process") if expr is None else expr.otherwise(F.lit("process"))
    return df.withColumn(out, value)


def apply_content_guard(df: DataFrame, rules: list[tuple[str, str, str]], body_col: str = "html", out: str = "content_disposition") -> DataFrame:
    """(``contains`` | ``notcontains``, text, ``retry`` | ``skip``) rules in order → action, else ``process``.

    Decision: applied always (the reference only with rotating proxies).
    """
    _require(df, body_col)
    b = F.coalesce(F.col(body_col), F.lit(""))
    expr = None
    for cond, text, action in rules:
        if cond == "contains":
            test = b.contains(text)
        elif cond == "notcontains":
            test = ~b.contains(text)
        else:
            raise ValueError(f"bad content rule {cond!r}")
        if action not in ("retry", "skip"):
            raise ValueError(f"bad content action {action!r}")
        expr = F.when(test, F.lit(action)) if expr is None else expr.when(test, F.lit(action))
    value = F.lit("process") if expr is None else expr.otherwise(F.lit("process"))
    return df.withColumn(out, value)


def pending(df: DataFrame, metric: str, col: str = "url") -> DataFrame:
    """rows whose metric is still empty and whose URL is absolute."""
    _require(df, metric, col)
    return df.where(F.col(metric).isNull() & U.is_absolute(col))


def redirect_candidates(df: DataFrame, status_col: str = "http_status", col: str = "url") -> DataFrame:
    """300 < status < 400 (300 itself excluded) and an absolute URL."""
    _require(df, status_col, col)
    s = F.col(status_col)
    return df.where((s > 300) & (s < 400) & U.is_absolute(col))


def drop_empty_items(df: DataFrame, col: str = "item") -> DataFrame:
    """F16: keep non-empty extracted items."""
    _require(df, col)
    return df.where(F.col(col).isNotNull() & (F.col(col) != ""))
