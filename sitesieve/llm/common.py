"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark, name: str) -> str:
    """A fresh path in the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` but columnar and compressed; every
    executor sees the files, so losing one loses nothing.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(docs: DataFrame) -> Column:
    """Names a row by its contents, for rows whose doc_id is null or repeated."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def held_out(doc_id: Column) -> Column:
    """The rows no model learns from: crc32(doc_id as text) mod 4 = 2."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))


def per_process(key, make):
    """``make()``, once per Python process and ``key``: tasks of one worker share tables and caches.

    Code is shipped with each task, so its module variables do not outlive a task; this entry in ``sys.modules`` does.
    """
    import sys
    from types import ModuleType

    held = vars(sys.modules.setdefault("_sitesieve_worker", ModuleType("_sitesieve_worker")))
    if key not in held:
        held[key] = make()
    return held[key]
