"""Structured Streaming forms of the incremental behaviours.

* T1 ``stream_links``: pages arrive as files; links are extracted per
  micro-batch and appended to a Parquet sink (same operator as the batch C1).
* T2 ``stream_dedup``: duplicate URLs are dropped with
  ``dropDuplicatesWithinWatermark`` (the first arrival wins in a stream, so
  only the key set is comparable with A1).
* T3 ``stream_counts``: running counts per event-time window with a
  watermark; emitted in update mode through ``foreachBatch`` into a Parquet
  folder, so windows still open when an ``availableNow`` run ends are not
  lost; :func:`latest_counts` reads the last value per window back.
  ``foreachBatch`` writes overwrite a ``batch=<id>`` folder, so a batch that
  is replayed after a failure does not write twice.

Sinks and checkpoints live under the session's checkpoint folder (the shared
folder the cluster names), so a restarted query resumes from its offsets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.content import extract_links
from ..session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's (shared) checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_links(pages_stream: DataFrame) -> DataFrame:
    """C1 over a stream of pages."""
    return extract_links(pages_stream)


def stream_items(pages_stream: DataFrame, rules: list) -> DataFrame:
    """T1 for extracted items: attribute/count rules (C3 regex engine, a pure
    projection) evaluated on each micro-batch of pages, one row per item."""
    from ..operators.elements import extract_items

    return item_rows(extract_items(pages_stream, rules, engine="regex"), rules)


def item_rows(items: DataFrame, rules: list) -> DataFrame:
    """(page_id, rule, idx, item) of :func:`extract_items`' array columns; the input is read once for all rules."""
    each = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(r.name).alias("items")) for r in rules])
    rows = items.select("page_id", F.explode(each).alias("_r"))
    return rows.select("page_id", "_r.rule", F.posexplode("_r.items").alias("idx", "item"))


def run_append_with_session(sdf: DataFrame, sink: str, session: str, checkpoint: str, item_col: str = "item") -> None:
    """T1 + S10: each micro-batch goes to the Parquet sink and its non-empty items
    to the session text folder, as each batch of pages finishes.  Both writes
    go to ``batch=<id>`` folders overwritten on replay (exactly-once)."""
    from ..sources.sinks import append_session_results

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        append_session_results(batch, f"{session}/batch={batch_id}", item_col, mode="overwrite")

    q = (sdf.writeStream.outputMode("append").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def run_items_per_batch(pages_stream: DataFrame, rules: list, sink: str, session: str, checkpoint: str) -> None:
    """T1 for any rule (text rules included): each micro-batch of pages is an
    ordinary DataFrame inside ``foreachBatch``, so C3 runs with its parser
    engine and one aggregation per batch; items go to ``sink/batch=<id>`` and
    the session folder (exactly-once on replay).  The session lines are read
    back from the written items, so the parser runs once per batch."""
    from ..operators.elements import extract_items
    from ..sources.sinks import append_session_results

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = item_rows(extract_items(batch, rules), rules)
        out = f"{sink}/batch={batch_id}"
        rows.write.mode("overwrite").parquet(out)
        written = batch.sparkSession.read.parquet(out)
        append_session_results(written, f"{session}/batch={batch_id}", "item", mode="overwrite")

    q = (pages_stream.writeStream.foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def stream_dedup(url_stream: DataFrame, col: str = "url", ts_col: str = "ts", delay: str = "7 days") -> DataFrame:
    """Drop URLs already seen within ``delay`` (the caller's bound on the state) of their first arrival."""
    if url_stream.schema[ts_col].dataType.typeName() != "timestamp":
        url_stream = url_stream.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    return url_stream.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark([col])


def stream_counts(events: DataFrame, ts_col: str = "ts", window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Events per tumbling event-time window, with a watermark."""
    if events.schema[ts_col].dataType.typeName() != "timestamp":
        events = events.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    w = events.withWatermark(ts_col, delay).groupBy(F.window(ts_col, window).alias("w")).agg(F.count("*").alias("events"))
    return w.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events")


def run_append(sdf: DataFrame, sink: str, checkpoint: str) -> None:
    """Run a stream to the end of its input (``availableNow``) into a Parquet sink."""
    q = (sdf.writeStream.format("parquet").outputMode("append").option("path", sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def run_updates(sdf: DataFrame, sink: str, checkpoint: str) -> None:
    """Run an aggregating stream in update mode; each batch's changed rows go to
    ``sink/batch=<id>``.  A replayed batch overwrites its own folder, so the
    sink is exactly-once even when a batch is re-run after a failure."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    q = (sdf.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def latest_counts(spark: SparkSession, sink: str, key: str = "window_start") -> DataFrame:
    """Last emitted row per window of a :func:`run_updates` sink."""
    df = spark.read.parquet(sink)
    cols = [c for c in df.columns if c not in (key, "batch")]
    picked = df.groupBy(key).agg(F.max_by(F.struct(*cols), "batch").alias("_r"))
    return picked.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])
