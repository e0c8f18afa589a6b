"""Statistics of whole texts as DataFrame expressions (no Python on the executors).

Words are runs of characters other than ASCII white space.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the struct column ``s`` of its texts' statistics; a null text counts as empty.

    n_chars, n_words, word_chars (characters in words), n_symbols (characters
    of ``#*$%&|<>``), n_upper (A-Z and other capitals), n_marks (``!``), n_lines
    (lines with a word), n_dup_lines (such lines equal to an earlier one),
    n_repeat_words (words in 3-word windows found twice or more), n_distinct
    (different words).
    """
    out = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn("_w", F.filter(F.split("_t", SPACE + "+"), lambda w: w != ""))
    out = out.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    # windows of three hashes; shorter texts have none
    out = out.withColumn("_n", F.size("_w"))
    h = F.col("_h")
    windows = F.when(F.col("_n") >= 3, F.transform(F.slice(h, F.lit(1), F.greatest(F.col("_n") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))))
    out = out.withColumn("_x", F.coalesce(windows, F.array().cast("array<bigint>")))
    out = out.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda v: v.rlike(r"[^\x20\x09-\x0D]")))
    # Only a text that repeats a window sorts its windows with their positions.  Every
    # array that a lambda looks into is a column: an expression there would be evaluated for each element.
    repeats = F.size(F.array_distinct("_x")) < F.size("_x")
    at = F.sort_array(F.transform("_x", lambda v, i: F.struct(v.alias("h"), i.alias("i"))))
    out = out.withColumn("_at", F.when(repeats, at))
    again = F.filter("_at", lambda x, k: ((k > 0) & (F.get("_at", k - 1)["h"] == x["h"])) | (F.coalesce(F.get("_at", k + 1)["h"] == x["h"], F.lit(False))))
    out = out.withColumn("_from", F.array_append(F.sort_array(F.transform(again, lambda x: x["i"])), F.lit(2**31 - 1)))
    covered = F.transform("_from", lambda x, k: F.when(F.get("_from", k + 1).isNotNull(), F.least(F.lit(3), F.get("_from", k + 1) - x)).otherwise(0))
    stats = {
        "n_chars": F.length("_t"),
        "n_words": F.col("_n"),
        "word_chars": F.aggregate(F.transform("_w", lambda w: F.length(w)), F.lit(0).cast("long"), lambda a, x: a + x),
        "n_symbols": F.regexp_count("_t", F.lit(r"[#*$%&|<>]")),
        "n_upper": F.regexp_count("_t", F.lit(r"\p{Lu}")),
        "n_marks": F.regexp_count("_t", F.lit("!")),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)),
        "n_distinct": F.size(F.array_distinct("_h")),
    }
    return out.select(*docs.columns, F.struct(*[v.cast("long").alias(k) for k, v in stats.items()]).alias("s"))
