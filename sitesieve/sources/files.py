"""File readers.

All readers are Spark file scans (``spark.read.text`` / ``spark.read.csv``).
Marker and header are read from the first split of the first file alone, the way
``spark.read.csv(header=True)`` reads a header; they and two format flags are all that
reaches the driver.  Row order is carried by a
``row_id`` that increases with (file position in ``paths``, position in the
file): each path is read on its own and the reads are concatenated, and
``monotonically_increasing_id`` numbers rows in that order.
"""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators.urls import coerce_metric_types

# Marker lines of provider reports (fixed values).
PROVIDER_MARKERS = {"Ahrefs": "# API : Ahrefs", "Majestic": "# API : Majestic", "Moz": "# API : Moz"}
DEFAULT_TXT_HEADER = ["URL", "PR"]
# Files without a line to find that are tried one by one before all are read at once.
HEAD_FILES = 8
# Lines whose format is tried before the whole text is.
HEAD_LINES = 100


def stable_ids(df: DataFrame) -> DataFrame:
    """Fix the ``row_id`` values of a read: the table is checkpointed into the
    session's shared checkpoint folder, so every later use (and every retry)
    sees the same ids (SURVEY §7.4: build the order column at ingest)."""
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _paths(paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def read_lines(spark: SparkSession, paths) -> DataFrame:
    """Lines of the files with ``_file`` (index in ``paths``), ``_path`` and
    ``_start`` (file and split offset, from the file source's ``_metadata``)
    and ``_ord`` (increasing within a split)."""
    parts = [
        spark.read.text(p).select(F.lit(i).alias("_file"), F.col("value"),
                                  F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"))
        for i, p in enumerate(_paths(paths))
    ]
    lines = reduce(lambda a, b: a.unionAll(b), parts)
    return lines.withColumn("_ord", F.monotonically_increasing_id())


def _line_order():
    """Sort key of a line: path index, file, split offset, position in the split."""
    return F.struct("_file", "_path", "_start", "_ord")


def _files(spark: SparkSession, paths) -> list[str] | None:
    """The files below ``paths`` in line order, from the listing alone; None if a name cannot be read back on its own."""
    found = []
    for p in _paths(paths):
        found += sorted(spark.read.text(p).inputFiles())
    found = [unquote(f) for f in found]
    return None if any(c in f for f in found for c in "*?[]{}\\") else found


def first_lines(spark: SparkSession, paths, wanted=None, n: int = 1) -> list[str]:
    """The first ``n`` lines that meet ``wanted`` (a condition on ``value``), or fewer, from one file.

    The job reads the first split of the first file, and stops there when it has them; the rest of the file, and
    then the files after it, are read only if no line has been found yet.
    """
    wanted = F.lit(True) if wanted is None else wanted
    files = _files(spark, paths)
    for f in files[:HEAD_FILES] if files is not None else []:
        lines = spark.read.text(f).select("value", F.col("_metadata.file_block_start").alias("_start"))
        found = lines.where(F.col("_start") == 0).where(wanted).limit(n).collect()
        found = found or lines.where(wanted).withColumn("_ord", F.monotonically_increasing_id()).orderBy("_start", "_ord").limit(n).collect()
        if found:
            return [r["value"] for r in found]
    if files is not None and len(files) <= HEAD_FILES:
        return []
    return [r["value"] for r in read_lines(spark, paths).where(wanted).orderBy(_line_order()).limit(n).collect()]


def _is_comment(c):
    return c.startswith("#") | c.startswith('"#')


def read_url_list(spark: SparkSession, paths, stable: bool = False) -> DataFrame:
    """One URL per line; blank lines and lines starting ``#`` or ``"#`` skipped.
    ``stable`` fixes the row ids at ingest (:func:`stable_ids`)."""
    lines = read_lines(spark, paths)
    v = F.col("value")
    keep = lines.where((F.trim(v) != "") & ~_is_comment(v))
    out = keep.select(F.col("_ord").alias("row_id"), v.alias("url"))
    return stable_ids(out) if stable else out


def _named_columns(parts, names: list[str]):
    return [F.try_element_at(parts, F.lit(i + 1)).alias(n) for i, n in enumerate(names)]


def read_result_txt(spark: SparkSession, paths, sep: str = "|", stable: bool = False) -> DataFrame:
    """Delimited text.

    The header is line 1 of the first file without ``#``; when that line has
    no ``#`` the default header ``URL|PR`` is used and all lines are data.
    Header names become logical names (``HTTP Status`` → ``http_status``).
    Short rows are padded with NULL, extra values are cut.
    """
    sep_re = "\\" + sep if not sep.isalnum() else sep
    lines = read_lines(spark, paths)
    v = F.col("value")
    data = lines.where((F.trim(v) != "") & ~_is_comment(v))
    line1 = "".join(first_lines(spark, paths, F.trim(v) != "")).strip()
    header = line1.replace("#", "").split(sep) if line1.startswith("#") else DEFAULT_TXT_HEADER
    names = [S.logical_name(h) for h in header]
    table = data.select(F.col("_ord").alias("row_id"), *_named_columns(F.split(v, sep_re), names))
    out = coerce_metric_types(table)
    return stable_ids(out) if stable else out


def read_result_csv(spark: SparkSession, paths, sep: str = ",", quote: str = '"', stable: bool = False) -> DataFrame:
    """S3: CSV with a header line; every cell quoted, ``\\`` escapes quotes.

    Lines starting ``"#`` are skipped; header names become logical names.
    """
    parts = []
    for i, p in enumerate(_paths(paths)):
        df = (spark.read.option("header", True).option("sep", sep).option("quote", quote).option("escape", "\\")
              .option("comment", "\u0000").csv(p))
        parts.append(df.withColumn("_file", F.lit(i)))
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    first = df.columns[0]
    df = df.where(~F.coalesce(F.col(first).startswith("#"), F.lit(False)))
    df = df.withColumn("row_id", F.monotonically_increasing_id()).drop("_file")
    renamed = df.select("row_id", *[F.col(f"`{c}`").alias(S.logical_name(c)) for c in df.columns if c != "row_id"])
    out = coerce_metric_types(renamed)
    return stable_ids(out) if stable else out


def detect_format(spark: SparkSession, paths, sep: str = "|", csv_sep: str = ",", quote: str = '"') -> str:
    """S4 detection: ``csv`` if quote+sep+quote occurs, else ``txt`` if the text
    separator occurs, else ``urls``: from the first lines if they are CSV, else one aggregate over all."""
    pattern = quote + csv_sep + quote
    if any(pattern in line for line in first_lines(spark, paths, n=HEAD_LINES)):
        return "csv"
    lines = read_lines(spark, paths)
    r = lines.agg(F.max(F.col("value").contains(pattern)).alias("csv"), F.max(F.col("value").contains(sep)).alias("txt")).first()
    if r["csv"]:
        return "csv"
    if r["txt"]:
        return "txt"
    return "urls"


def read_results(spark: SparkSession, paths, sep: str = "|", stable: bool = False) -> DataFrame:
    """One reader for S1-S3 and S5 by detected format; ``stable`` fixes the row ids.

    Files whose first line is a provider marker are a provider's report, whatever their separator.
    """
    if _provider(spark, paths) is not None:
        out = read_provider_report(spark, paths, sep)
        return stable_ids(out) if stable else out
    fmt = detect_format(spark, paths, sep)
    if fmt == "csv":
        out = read_result_csv(spark, paths)
    elif fmt == "txt":
        out = read_result_txt(spark, paths, sep)
    else:
        out = read_url_list(spark, paths)
    return stable_ids(out) if stable else out


def _provider(spark: SparkSession, paths) -> str | None:
    """The provider that the first line's marker names."""
    first = "".join(first_lines(spark, paths))
    return next((name for name, marker in PROVIDER_MARKERS.items() if marker in first), None)


def read_provider_report(spark: SparkSession, paths, sep: str = "|") -> DataFrame:
    """Reports whose line 1 is ``# API : Ahrefs`` / ``Majestic`` / ``Moz`` and
    line 2 the header; rows land in that provider's backlinks schema (S6).

    The first file names the provider and the header; the marker, header and
    comment lines of every further file are skipped.
    """
    lines = read_lines(spark, paths)
    provider = _provider(spark, paths)
    if provider is None:
        raise ValueError("not a provider report: line 1 carries no '# API : <provider>' marker")
    v = F.col("value")
    marked = F.lit(False)
    for marker in PROVIDER_MARKERS.values():
        marked = marked | v.contains(marker)
    wanted = ~marked & (F.trim(v) != "")
    body = lines.where(wanted)
    first = first_lines(spark, paths, wanted)
    header_row = first[0] if first else sep.join(S.display_name(c) for c in S.SCHEMAS[f"backlinks/{provider.lower()}"])
    is_csv = header_row.startswith('"')
    if is_csv:
        header = [h.strip('"') for h in header_row.split('","')]
        split_re = '","'
    else:
        header = header_row.lstrip("#").split(sep)
        split_re = "\\" + sep
    names = [S.logical_name(h) for h in header]
    data = body.where((v != F.lit(header_row)) & ~_is_comment(v))
    value = F.regexp_replace(F.col("value"), '^"|"$', "") if is_csv else F.col("value")
    parts = F.split(value, split_re)
    cols = []
    for i, n in enumerate(names):
        c = F.try_element_at(parts, F.lit(i + 1))
        if is_csv:
            c = F.replace(c, F.lit('\\"'), F.lit('"'))
        cols.append(c.alias(n))
    table = data.select(F.col("_ord").alias("row_id"), *cols)
    return align_to_schema(coerce_metric_types(table), f"backlinks/{provider.lower()}")


def align_to_schema(df: DataFrame, schema: str, keep_row_id: bool = True) -> DataFrame:
    """The schema's columns in order, matched by name; missing → NULL."""
    cols = ([F.col("row_id")] if keep_row_id and "row_id" in df.columns else [])
    for name in S.SCHEMAS[schema]:
        dtype = S.TYPES.get(name)
        if name in df.columns:
            c = F.col(name)
            if dtype is not None and df.schema[name].dataType != dtype:
                c = c.cast("string").try_cast(dtype) if dtype.typeName() != "boolean" else F.lower(c.cast("string")).isin("1", "true", "yes")
            cols.append(c.alias(name))
        else:
            cols.append(F.lit(None).cast(dtype).alias(name))
    return df.select(*cols)
