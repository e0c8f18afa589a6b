"""Semi-join reduction with a Bloom filter, as DataFrame expressions.

The filter of a key column is a table of 64-bit words: a key's hash names its word and
four bits of it.  It has at most ``MAX_WORDS`` words, so it can always be
broadcast; a row's test is one map-side lookup, and rows (page bodies, say)
stay where they are.  Beyond ``MAX_WORDS`` words' worth of keys the filter lets more
rows through, never fewer: what passes is confirmed by the caller's exact join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .urls import _require

MAX_WORDS = 1 << 20  #: 16 MB as a broadcast table
BITS_PER_KEY = 16  #: about one wrong pass in 200


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words))


def _bits(key: Column) -> Column:
    h = F.xxhash64(F.lit(1), key)
    mask = F.lit(0).cast("long")
    for i in range(4):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return mask


class BloomFilter:
    """The filter of the distinct values of ``keys[col]``; nulls are never held."""

    def __init__(self, keys: DataFrame, col: str, max_words: int = MAX_WORDS):
        _require(keys, col)
        self.n_keys = keys.count()
        self.words = min(max_words, max(1, -(-self.n_keys * BITS_PER_KEY // 64)))
        key = F.col(col)
        held = keys.where(key.isNotNull()).select(_word(key, self.words).alias("_word"), _bits(key).alias("_bits"))
        self.table = held.groupBy("_word").agg(F.bit_or("_bits").alias("_held"))

    def keep(self, df: DataFrame, col: str) -> DataFrame:
        """The rows of ``df`` whose ``col`` the filter may hold: all that it does, and few others."""
        _require(df, col)
        key = F.col(col)
        probed = df.withColumns({"_word": _word(key, self.words), "_bits": _bits(key)})
        hit = probed.join(F.broadcast(self.table), "_word").where(key.isNotNull() & (F.col("_held").bitwiseAND(F.col("_bits")) == F.col("_bits")))
        return hit.select(df.columns)

    def split(self, df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
        """(rows whose ``col`` the filter may hold, rows that it surely does not)."""
        _require(df, col)
        key = F.col(col)
        probed = df.withColumns({"_word": _word(key, self.words), "_bits": _bits(key)}).join(F.broadcast(self.table), "_word", "left")
        may = F.coalesce(key.isNotNull() & (F.col("_held").bitwiseAND(F.col("_bits")) == F.col("_bits")), F.lit(False))
        return probed.where(may).select(df.columns), probed.where(~may).select(df.columns)


def anti_join(df: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    """The rows of ``df`` whose ``col`` is not in ``keys`` (its distinct values, same column name); a null is in no list.

    Rows that the filter of the keys surely does not hold stay where they are; only the
    others are shuffled for the exact anti-join.  ``df`` is read twice.  Where the filter would let
    every row through (four bits a key no longer fit), or the types of the two sides hash differently, it is
    the plain anti-join of all rows.
    """
    _require(df, col)
    _require(keys, col)
    kind = df.schema[col].dataType
    if keys.schema[col].dataType != kind or not isinstance(kind, (T.IntegralType, T.DateType)) and kind != T.StringType():
        return df.join(keys, col, "left_anti")
    held = BloomFilter(keys, col)
    if held.n_keys * 4 > 64 * MAX_WORDS:
        return df.join(keys, col, "left_anti")
    may, never = held.split(df, col)
    return never.unionAll(may.join(keys, col, "left_anti").select(df.columns))
