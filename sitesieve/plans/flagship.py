"""Flagship job for the smoke check: L1 reduced to dedup → status → remove bad → outbound links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import jobs
from .fixtures import Inputs


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp = Inputs(spark, sf_dir)
    return jobs.clean_and_enrich(
        inp.url_table(),
        fetch_log=inp.fetch_log(),
        pages=inp.html(),
        steps=("dedup", "status", "remove_bad", "obl"),
    )
