"""De-duplication, sort and paging (A1-A3, O1-O3).

Dedups are aggregations with ``max_by``/``min_by`` over a struct of the row:
Spark computes them partially on the map side, so a URL or host that holds a
third of the table reaches the shuffle as one row per map task and never
becomes one giant task.  ``row_id`` is the order column everywhere (the
reference's map key); it is unique, so every pick is deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import url as U
from .urls import _require

SKETCH = 10_000  #: accuracy of the quantile sketch: ranks are off by at most a 10 000th of the rows
SLACK = 3 / SKETCH
RANGE_ROWS = 100_000  #: rows that a window's range may hold besides it


def _unpack(df: DataFrame, packed: str, names: list[str]) -> DataFrame:
    return df.select(*[F.col(f"{packed}.{n}").alias(n) for n in names])


def dedup_urls(df: DataFrame, col: str = "url", order_col: str = "row_id") -> DataFrame:
    """A1: one row per exact URL (case-sensitive); the last row (largest row id) wins.

    A row without an order value is an error: no pick would be the last.
    """
    _require(df, col, order_col)
    names = df.columns
    kind = df.schema[order_col].dataType
    order = F.coalesce(F.col(order_col), F.raise_error(F.lit(f"{order_col} must not be null")).cast(kind))
    picked = df.groupBy(col).agg(F.max_by(F.struct(*names), order).alias("_r"))
    return _unpack(picked, "_r", names)


# Metrics a provider's table offers for A2 (fixed values).
DEDUP_METRICS = {
    "majestic": ("citation_flow", "trust_flow", "ttf_value"),
    "ahrefs": ("domain_rank", "url_rank"),
    "moz": ("moz_rank", "page_authority", "domain_authority"),
}


def dedup_domains(df: DataFrame, metric: str | None = None, col: str = "url", order_col: str = "row_id",
                  provider: str | None = None) -> DataFrame:
    """A2: one URL per host after A1.

    The greatest metric wins, compared as a whole number (rounded; empty or
    unparsable = 0), ties go to the smallest URL; without a metric the
    smallest URL wins.  Decision (SURVEY §2.5): grouped
    globally by lower-case host, so ``http`` and ``https`` of a host give one
    row.  Rows without a host (relative URLs) pass through unchanged.
    With ``provider``, a metric that provider does not offer is ignored
    (dedup without metric), as in the reference.
    """
    _require(df, col, order_col)
    if metric is not None:
        _require(df, metric)
        if provider is not None and metric not in DEDUP_METRICS.get(provider, ()):
            metric = None  # a metric the provider does not offer: dedup without metric
    names = df.columns
    last = dedup_urls(df, col, order_col).withColumn("_host", U.url_host(col))
    # a row without a host is a group of its own
    key = [F.col("_host"), F.when(F.coalesce(F.col("_host"), F.lit("")) == "", F.col(col)).alias("_loose")]
    if metric is None:
        rank = F.struct(F.col(col))
    else:
        # the metric is compared as a whole number (rounded), empty or unparsable = 0
        m = F.coalesce(F.round(F.col(metric).cast("string").try_cast("double")).cast("long"), F.lit(0).cast("long"))
        rank = F.struct((-m).alias("m"), F.col(col))
    picked = last.groupBy(*key).agg(F.min_by(F.struct(*names), rank).alias("_r"))
    return _unpack(picked, "_r", names)


def distinct_first(df: DataFrame, col: str, order_col: str = "row_id") -> DataFrame:
    """A3: order-preserving distinct: each value once, with its first row id."""
    _require(df, col, order_col)
    return df.groupBy(col).agg(F.min(order_col).alias(order_col)).select(order_col, col)


def sort_by(df: DataFrame, col: str, ascending: bool = True, order_col: str = "row_id") -> DataFrame:
    """O1: whole-table sort by one column, ``row_id`` as tie-break.

    Decision: the normal direction (the reference's flag is inverted); NULLs
    first when ascending, last when descending.  A range-partitioned global
    sort; row ids keep their values.
    """
    _require(df, col, order_col)
    key = F.col(col).asc_nulls_first() if ascending else F.col(col).desc_nulls_last()
    return df.orderBy(key, F.col(order_col).asc())


def page_of(df: DataFrame, offset: int = 0, n: int = 100, order_col: str = "row_id") -> DataFrame:
    """O2: the visible window of rows ``offset .. offset+n`` in row order (the limit is the feature).

    Rows whose order value is NULL come first.  See :func:`ranked` for how the window is found.
    """
    _require(df, order_col)
    return ranked(df, offset, n, order_col)


def frontier_slice(df: DataFrame, n: int = 10000, order_col: str = "row_id") -> DataFrame:
    """O3: the first ``n`` frontier items by order column."""
    _require(df, order_col)
    return ranked(df, 0, n, order_col)


def ranked(df: DataFrame, offset: int, n: int, order_col: str, most: int = RANGE_ROWS) -> DataFrame:
    """Rows ``offset .. offset+n`` by ``order_col`` (whole numbers), by distributed rank selection.

    A quantile sketch of the order column gives values a little below and above the window, one aggregation
    counts the rows below and between them, and so on inside that range until it holds at most
    ``most`` rows besides the window.  Only that range, a filter on the scan, is sorted: no task holds
    the rows before the window, however deep it is.  Equal values are never cut apart, so a value of very many
    rows stays one range.  A column that is not of whole numbers is left to Spark's ordered offset and limit.
    """
    if not isinstance(df.schema[order_col].dataType, T.IntegralType):
        return df.orderBy(order_col).offset(offset).limit(n)
    x = F.col(order_col)
    first = df.agg(F.count(x).alias("rows"), F.count_if(x.isNull()).alias("nulls")).first()
    rows, skipped = first["rows"], first["nulls"]
    low = high = None
    inside = F.lit(True)
    while rows > n + most:
        start, stop = max(0, offset - skipped), max(0, offset - skipped + n)  # the window among the range's rows
        at = [min(1.0, max(0.0, start / rows - SLACK)), min(1.0, stop / rows + SLACK)]
        values = df.where(inside).agg(F.percentile_approx(x, at, SKETCH).alias("q")).first()["q"]
        new_low, new_high = values if start else (None, values[1])
        tail = stop >= rows  # the window goes to the range's end or beyond
        narrower = (x >= new_low if new_low is not None else F.lit(True)) & (F.lit(True) if tail else x <= new_high)
        found = df.where(inside & x.isNotNull()).agg(F.count_if(x < new_low if new_low is not None else F.lit(False)).alias("below"), F.count_if(narrower).alias("rows")).first()
        if found["rows"] == rows or start < found["below"] or (not tail and stop > found["below"] + found["rows"]):
            break
        rows = found["rows"]
        if new_low is not None:
            low, skipped = new_low, skipped + found["below"]
        high = high if tail else new_high
        inside = (x >= low if low is not None else F.lit(True)) & (x <= high if high is not None else F.lit(True))
    if low is None:
        part = df.where(x.isNull() | inside) if high is not None else df
        return part.orderBy(order_col).offset(offset).limit(n)
    return df.where(inside).orderBy(order_col).offset(max(0, offset - skipped)).limit(n)
