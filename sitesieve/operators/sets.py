"""Set operations between a table column and a list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .enrich import with_global_position
from .urls import _require


def merge_into_list(df: DataFrame, col: str, existing: DataFrame, out: str = "value") -> DataFrame:
    """Column values together with the existing list, duplicates removed.

    ``existing`` has one column.  Empty values are not list items.
    """
    _require(df, col)
    a = df.select(F.col(col).cast("string").alias(out))
    b = existing.select(F.col(existing.columns[0]).cast("string").alias(out))
    both = a.unionByName(b)
    return both.where(F.col(out).isNotNull() & (F.col(out) != "")).distinct()


def diff_with_list(df: DataFrame, col: str, existing: DataFrame, out: str = "value") -> DataFrame:
    """Distinct column values not in the list (the result replaces the list).

    Both sides are made distinct before the anti-join, so a hot value is one
    row when it reaches the join's shuffle.
    """
    _require(df, col)
    a = df.select(F.col(col).cast("string").alias(out)).where(F.col(out).isNotNull() & (F.col(out) != "")).distinct()
    b = existing.select(F.col(existing.columns[0]).cast("string").alias(out)).distinct()
    return a.join(b, out, "left_anti")


def numbered(df: DataFrame, order_col: str = "row_id") -> DataFrame:
    """``df`` with ``order_col`` 0, 1, .. in its present order (persisted, so a
    retried task sees the same numbers)."""
    ensure_checkpoint_dir(df.sparkSession)
    placed = df.withColumn("_place", F.monotonically_increasing_id()).checkpoint(eager=True)
    return with_global_position(placed, "_place", order_col).drop("_place")


def append_rows(df: DataFrame, new: DataFrame, order_col: str = "row_id") -> DataFrame:
    """Append ``new`` by column name; missing columns are empty.

    Appended rows get row ids after the table's largest one (a scalar
    subquery, no join): ``new.row_id`` + max + 1.  Without row ids the new rows
    are numbered 0.. by position first (:func:`numbered`).
    """
    if order_col in df.columns:
        if order_col not in new.columns:
            new = numbered(new, order_col)
        top = df.select(F.coalesce(F.max(order_col), F.lit(-1)).alias("m")).scalar()
        new = new.withColumn(order_col, F.col(order_col) + top + 1)
    return df.unionByName(new, allowMissingColumns=True)


def replace_or_append(df: DataFrame, imported: DataFrame, mode: str = "append", order_col: str = "row_id") -> DataFrame:
    """U4: the imported rows replace the table or are appended to it.

    Decision: ``append`` really appends (the reference rebuilds either way).
    """
    if mode == "replace":
        return imported
    if mode == "append":
        return append_rows(df, imported, order_col)
    raise ValueError(f"mode must be 'replace' or 'append', not {mode!r}")
