"""Crawl frontier generation.

A frontier row is ``(url, custom1, custom2)``.  Templates carry placeholders
(``{%footprint%}``, ``{%custom1%}``, ``{%custom1::encoded%}``, ``{%custom2%}`` …)
that are replaced by Spark string functions.  The two parameter lists are
combined as a product (that is the feature) by an equi-join on blocks of the
shorter list, so there is no cartesian-product operator, no bound on either
list and no task that holds a whole list.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import url as U
from .urls import _require

# Values of one list that are joined to a row of the other one at a time.
PRODUCT_BLOCK = 1000
INTLOOP_RE = r"\{%intloop:(-?[0-9]+):(-?[0-9]+):(-?[0-9]+)%\}"
GET_FIRST_RE = r"get_first\(([^)]+)\)"


def url_value_encoded(c: Column) -> Column:
    """A plain placeholder value that is an absolute URL is put in encoded form:
    spaces and non-ASCII are percent-encoded, URL delimiters stay."""
    e = F.url_encode(c)
    e = F.replace(e, F.lit("+"), F.lit("%20"))
    for enc, ch in (("%3A", ":"), ("%2F", "/"), ("%3F", "?"), ("%23", "#"), ("%5B", "["), ("%5D", "]"), ("%40", "@"),
                    ("%21", "!"), ("%24", "$"), ("%26", "&"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%2B", "+"),
                    ("%2C", ","), ("%3B", ";"), ("%3D", "="), ("%25", "%"), ("%7E", "~")):
        e = F.replace(e, F.lit(enc), F.lit(ch))
    return e


def _custom_value(c: Column, encoded: bool) -> Column:
    v = F.coalesce(c.cast("string"), F.lit(""))
    if encoded:
        out = U.percent_encode_keep_percent(v)
    else:
        out = F.when(U.is_absolute(v), url_value_encoded(v)).otherwise(v)
    # a {%custom2%} inside a custom1 value is put back after encoding
    return F.replace(out, F.lit("%7B%25custom2%25%7D"), F.lit("{%custom2%}"))


def first_form_encoded(template: str, name: str) -> bool:
    """Whether the first ``{%name...%}`` placeholder of the template is the ``::encoded`` form."""
    m = re.search(r"\{%" + name + r"(::encoded)?%\}", template or "")
    return bool(m and m.group(1))


def fill_template(template: Column, name: str, value: Column, encoded: bool | None = None) -> Column:
    """Replace ``{%name%}`` and ``{%name::encoded%}`` in ``template``.

    With ``encoded`` given, both forms get the same value, encoded or not (the
    reference encodes every occurrence the way its first occurrence asks);
    without it each form gets its own encoding."""
    if encoded is None:
        t = F.replace(template, F.lit("{%" + name + "::encoded%}"), _custom_value(value, True))
        return F.replace(t, F.lit("{%" + name + "%}"), _custom_value(value, False))
    v = _custom_value(value, encoded)
    t = F.replace(template, F.lit("{%" + name + "::encoded%}"), v)
    return F.replace(t, F.lit("{%" + name + "%}"), v)


def frontier_footprint(footprints: DataFrame, template: str, col: str = "footprint") -> DataFrame:
    """G1: one URL per footprint: ``{%footprint%}`` ← the percent-encoded footprint."""
    _require(footprints, col)
    enc = U.percent_encode(F.coalesce(F.col(col).cast("string"), F.lit("")))
    url = F.replace(F.lit(template), F.lit("{%footprint%}"), enc)
    return footprints.select(url.alias("url"), F.col(col).alias("footprint"))


def _uses(name: str, texts: list[str]) -> bool:
    return any(re.search(r"\{%" + name + r"(::encoded)?%\}", t or "") for t in texts)


def drop_unused_lists(template: str, rule_texts: list[str], custom1: DataFrame | None, custom2: DataFrame | None):
    """A list whose placeholder occurs in neither the URL template, the
    content rule, the prefix nor the suffix is dropped (no needless product)."""
    texts = [template, *rule_texts]
    return (custom1 if _uses("custom1", texts) else None, custom2 if _uses("custom2", texts) else None)


def frontier_customs(
    spark: SparkSession,
    template: str,
    custom1: DataFrame | None,
    custom2: DataFrame | None,
    footprint: str | None = None,
    rule_texts: list[str] | None = None,
) -> DataFrame:
    """G2 (with J11 and G4): one URL per (c1, c2) of the two lists.

    Each list is a one-column DataFrame.  Unused lists are dropped first (G4).
    With both lists the product is built block by block (J11).  A missing
    list gives ``""`` in its column.  All occurrences of a list's placeholder
    are encoded the way its first occurrence asks; the footprint is put in
    percent-encoded.  Decision (SURVEY §2.10): list 2 alone fills
    ``{%custom2%}``.
    """
    base = F.lit(template)
    if footprint:
        base = F.replace(base, F.lit("{%footprint%}"), U.percent_encode(F.lit(footprint)))
    enc1, enc2 = first_form_encoded(template, "custom1"), first_form_encoded(template, "custom2")
    c1, c2 = drop_unused_lists(template, rule_texts or [], custom1, custom2)

    def one(df: DataFrame) -> DataFrame:
        return df.select(F.col(df.columns[0]).cast("string").alias("v"))

    if c1 is None and c2 is None:
        return spark.range(1).select(base.alias("url"), F.lit("").alias("custom1"), F.lit("").alias("custom2"))
    if c2 is None:
        l1 = one(c1)
        return l1.select(fill_template(base, "custom1", F.col("v"), enc1).alias("url"), F.col("v").alias("custom1"), F.lit("").alias("custom2"))
    if c1 is None:
        l2 = one(c2)
        return l2.select(fill_template(base, "custom2", F.col("v"), enc2).alias("url"), F.lit("").alias("custom1"), F.col("v").alias("custom2"))
    return expand_customs(base, one(c1), one(c2), enc1, enc2)


def expand_customs(template: Column, c1: DataFrame, c2: DataFrame, enc1: bool | None = None, enc2: bool | None = None) -> DataFrame:
    """Product of two lists (column ``v`` each) of any length.

    The shorter list is dealt into blocks of about ``PRODUCT_BLOCK`` values, one
    row per block and salt; every value of the longer list is repeated per block
    and finds it by an equi-join on (block, salt).  No task holds more than a
    block of values, and the salts spread a block over the cluster.
    """
    n1 = c1.count()
    n2 = c2.count()
    big, small, small_is_2 = (c1, c2, True) if n1 >= n2 else (c2, c1, False)
    blocks = max(1, -(-min(n1, n2) // PRODUCT_BLOCK))
    salts = max(1, int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks)
    # a repeated value is held once, with its count
    small = small.groupBy("v").agg(F.count("*").alias("n"))
    small = small.groupBy(F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int").alias("_block")).agg(F.collect_list(F.struct("v", "n")).alias("_vs"))
    small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    big = big.select(F.col("v").alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    big = big.withColumn("_salt", F.pmod(F.xxhash64("_b"), F.lit(salts)).cast("int"))
    pairs = big.join(small, ["_block", "_salt"]).select("_b", F.explode("_vs").alias("_s"))
    pairs = pairs.select("_b", F.col("_s.v").alias("_s"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("_s.n")))).drop("col")
    v1, v2 = (F.col("_b"), F.col("_s")) if small_is_2 else (F.col("_s"), F.col("_b"))
    url = fill_template(fill_template(template, "custom1", v1, enc1), "custom2", v2, enc2)
    return pairs.select(url.alias("url"), v1.alias("custom1"), v2.alias("custom2"))


def int_loop(df: DataFrame, col: str = "spec", out: str = "value") -> DataFrame:
    """``{%intloop:a:b:s%}`` → a, a+s, … up to b inclusive (Decision: always
    inclusive); step 0 raises (the reference loops forever)."""
    _require(df, col)
    a = F.regexp_extract(F.col(col), INTLOOP_RE, 1).try_cast("long")
    b = F.regexp_extract(F.col(col), INTLOOP_RE, 2).try_cast("long")
    s = F.regexp_extract(F.col(col), INTLOOP_RE, 3).try_cast("long")
    step = F.when(s == 0, F.raise_error(F.lit("intloop step must not be 0"))).otherwise(s)
    seq = F.when((step > 0) & (a <= b) | (step < 0) & (a >= b), F.sequence(a, b, step)).otherwise(F.array().cast("array<bigint>"))
    return df.select(*[c for c in df.columns], F.explode(seq).alias(out))


def first_of_macro(c: Column) -> Column:
    """``get_first(a~~b~~c)`` → ``a``; inside a URL every macro is replaced
    by the first motif of the first macro."""
    motif = F.substring_index(F.regexp_extract(c, GET_FIRST_RE, 1), "~~", 1)
    whole = F.substring_index(F.regexp_replace(c, GET_FIRST_RE, "$1"), "~~", 1)
    safe = F.replace(F.replace(motif, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    inner = F.regexp_replace(c, F.lit(GET_FIRST_RE), safe)
    return F.when(c.startswith("get_first("), whole).when(c.contains("get_first("), inner).otherwise(c)


def suggest_wildcard(c: Column) -> Column:
    """A suggest-endpoint URL whose ``q`` holds ``*`` gets ``&cp=<0-based index of *>``."""
    q = F.regexp_extract(c, r"[?&]q=([^&#]*)", 1)
    idx = F.instr(q, "*") - 1
    hit = c.rlike(r"^https?://suggestqueries\.google\.com") & (idx >= 0)
    return F.when(hit, F.concat(c, F.lit("&cp="), idx.cast("string"))).otherwise(c)
