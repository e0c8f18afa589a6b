"""Extraction-rule catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .urls import _require


def list_rules(rules: DataFrame, groups: DataFrame, key: str = "group_id") -> DataFrame:
    """Every rule with its group (left join), ordered by group name then rule name.

    The group table is a small dimension; AQE broadcasts it when its measured
    size allows and keeps a shuffle join otherwise.
    """
    _require(rules, key, "name")
    _require(groups, key, "group_name")
    joined = rules.join(groups.dropDuplicates([key]), key, "left")
    return joined.orderBy(F.col("group_name").asc_nulls_first(), F.col("name"))
