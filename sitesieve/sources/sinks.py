"""File writers.

Writers are Spark file sinks: a folder of part files per write, produced by
the executors in parallel.  Headers use the display names of the schema
registry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import url as U
from ..operators.filters import apply_http_guard


def _columns(df: DataFrame, columns: list[str] | None) -> list[str]:
    return list(columns) if columns else [c for c in df.columns if c != "row_id"]


def write_result_csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "overwrite") -> None:
    """Header + rows, every cell quoted, a quote inside a cell escaped with
    ``\\``, UTF-8.  Decision: no byte-order mark."""
    cols = _columns(df, columns)
    out = df.select(*[F.col(c).cast("string").alias(S.display_name(c)) for c in cols])
    (out.write.mode(mode).option("header", True).option("quoteAll", True).option("escape", "\\")
     .option("emptyValue", "").option("nullValue", "").csv(path))


def write_result_txt(df: DataFrame, path: str, sep: str = "|", columns: list[str] | None = None, mode: str = "overwrite") -> None:
    """``#`` + header, then rows joined by the separator, unquoted.

    Decision: the header line starts with ``#`` so that S2 reads it back as
    the header (FIXTURES §3).  Each part file carries the header.
    """
    cols = _columns(df, columns)
    header = "#" + sep.join(S.display_name(c) for c in cols)
    line = F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    out = df.select(line.alias(header))
    # one column, quoting off, and a comment character other than '#' so the
    # header line is written as is
    (out.write.mode(mode).option("header", True).option("sep", "\u0001").option("quote", "")
     .option("comment", "\u0002").option("escape", "").option("quoteAll", False).option("escapeQuotes", False).csv(path))


def status_log_lines(df: DataFrame, rules: list[tuple[str, int, str]], col: str = "url", status_col: str = "http_status",
                     location_col: str = "location") -> DataFrame:
    """S9 lines: rows whose guard action (F12) is ``log``: ``url TAB status``, plus
    ``TAB location`` when the status is 301, 302, 307 or 308."""
    g = apply_http_guard(df, rules, status_col, "_disp").where(F.col("_disp") == "log")
    loc = F.col(location_col) if location_col in df.columns else F.lit(None).cast("string")
    base = F.concat_ws("\t", F.col(col), F.col(status_col).cast("string"))
    line = F.when(F.col(status_col).isin(*U.REDIRECT_CODES), F.concat_ws("\t", base, F.coalesce(loc, F.lit("")))).otherwise(base)
    return g.select(line.alias("value"))


def write_status_log(df: DataFrame, path: str, rules: list[tuple[str, int, str]], **kw) -> None:
    """Append the log lines to the log folder."""
    status_log_lines(df, rules, **kw).write.mode("append").text(path)


def append_session_results(df: DataFrame, path: str, items_col: str = "item", mode: str = "append") -> None:
    """Non-empty items of a run appended to the session folder (one per line)."""
    items = df.where(F.col(items_col).isNotNull() & (F.col(items_col) != "")).select(F.col(items_col).cast("string").alias("value"))
    items.write.mode(mode).text(path)
