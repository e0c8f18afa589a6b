"""Left join with one answer row per key, safe against hot keys.

Keys of more than 1 / ``SHARE`` of the rows are fewer than ``SHARE``, whatever the
table's size, so their answers are broadcast and their rows stay where they
are.  All other rows go through an ordinary join, where no key is large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

SHARE = 1000


def hot_keys(rows: DataFrame, on: str | list[str]) -> DataFrame:
    """The keys of more than 1 / ``SHARE`` of the rows: fewer than ``SHARE``."""
    on = [on] if isinstance(on, str) else on
    limit = rows.count() / SHARE
    return saved(rows.dropna(subset=on).groupBy(*on).count().where(F.col("count") > limit).select(*on), "hot")


def attach(rows: DataFrame, answers: DataFrame, on: str | list[str], hot: DataFrame | None = None) -> DataFrame:
    """``rows`` with the other columns of ``answers`` (one row per ``on``, or a few), null where it has none.

    Rows with a null in ``on`` get nulls and are not shuffled.  ``rows`` is read three times, or once with
    the ``hot_keys`` of rows that are dealt alike.
    """
    on = [on] if isinstance(on, str) else on
    hot = hot_keys(rows, on) if hot is None else hot
    marked = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), on, "left")
    null = F.lit(False)
    for c in on:
        null = null | F.col(c).isNull()
    stays = F.coalesce(F.col("__hot"), null)
    few = answers.join(F.broadcast(hot), on, "left_semi")
    columns = [*rows.columns, *(c for c in answers.columns if c not in on)]
    warm = marked.where(stays).join(F.broadcast(few), on, "left").select(columns)
    return warm.unionAll(marked.where(~stays).join(answers, on, "left").select(columns))
