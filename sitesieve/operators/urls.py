"""URL-table operators.

Every operator is ``DataFrame -> DataFrame`` and usable with ``df.transform``.
Trims and domain reductions keep the first row id of each surviving value
(``min(row_id)`` per value, partially aggregated before the shuffle so a hot
value costs one row per map task), which is the order-preserving distinct the
reference performs on its in-memory list.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import url as U


def _require(df: DataFrame, *cols: str) -> None:
    """Decision: an absent column raises instead of aliasing column 0."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"column(s) {missing} not in {df.columns}")


@dataclass
class SuffixTable:
    """A public-suffix table (one ``suffix`` per row, no leading dot).

    Rows may be exact suffixes (``co.uk``), wildcards (``*.ck``: every label
    under ``ck`` is a suffix) or exceptions (``!www.ck``: not a suffix despite
    a wildcard), as in the public suffix list.  ``depth`` is the largest
    number of labels in a rule; it, and whether wildcards/exceptions occur,
    come from one small aggregate over the table, and so does its size in
    bytes: within the session's own broadcast threshold the table is broadcast
    (Spark cannot see the size of every source before it runs), beyond it the
    lookups stay ordinary equi-joins, whose hot suffixes AQE splits.
    """

    df: DataFrame
    depth: int
    small: bool = False
    wildcards: bool = False
    exceptions: bool = False

    @classmethod
    def of(cls, suffixes: DataFrame) -> "SuffixTable":
        clean = suffixes.select(F.lower(F.regexp_replace(F.trim(F.col("suffix")), r"^\.", "")).alias("suffix")).distinct()
        stats = clean.agg(
            F.sum(F.octet_length("suffix") + 32).alias("b"),
            F.max(F.size(F.split(F.regexp_replace("suffix", "^!", ""), r"\."))).alias("d"),
            F.max(F.col("suffix").startswith("*.")).alias("w"),
            F.max(F.col("suffix").startswith("!")).alias("e"),
        ).first()
        small = int(stats["b"] or 0) <= _broadcast_threshold(suffixes.sparkSession)
        return cls(clean, int(stats["d"] or 0), small, bool(stats["w"]), bool(stats["e"]))

    def side(self, name: str, kind: str = "exact") -> DataFrame:
        s = F.col("suffix")
        if kind == "exact":
            d = self.df.where(~s.startswith("*.") & ~s.startswith("!")).select(s.alias(name))
        elif kind == "wild":
            d = self.df.where(s.startswith("*.")).select(F.expr("substring(suffix, 3)").alias(name))
        else:
            d = self.df.where(s.startswith("!")).select(F.expr("substring(suffix, 2)").alias(name))
        return F.broadcast(d) if self.small else d


def _broadcast_threshold(spark) -> int:
    """Spark's setting in bytes (-1: never broadcast)."""
    m = re.fullmatch(r"(-?\d+)\s*([kmgt]?)i?b?", spark.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().lower())
    return int(m[1]) * 1024 ** " kmgt".index(m[2] or " ") if m else -1


def with_public_suffix(df: DataFrame, suffixes: SuffixTable | DataFrame, host_col: Column, out: str = "_suffix") -> DataFrame:
    """Add the longest public suffix of ``host_col`` (``""`` when none matches).

    Candidates are the last k labels of the host for k = 1..depth (the whole
    host included, as in Qt).  A candidate is a suffix when it is listed, or
    when its parent (last k-1 labels) has a wildcard rule and the candidate
    has no exception rule.  Each lookup is one left equi-join with the suffix
    table, which Spark broadcasts when it is small; wildcard
    and exception lookups are only planned when the table has such rules.
    """
    st = suffixes if isinstance(suffixes, SuffixTable) else SuffixTable.of(suffixes)
    hcol = "_host_for_suffix"
    cur = df.withColumn(hcol, host_col)
    labels = F.split(F.col(hcol), r"\.")
    picked: list[Column] = []
    temp = [hcol]
    for k in range(1, st.depth + 1):
        cand, hit = f"_cand{k}", f"_hit{k}"
        cur = cur.withColumn(
            cand,
            F.when((F.col(hcol) != "") & (F.size(labels) >= k), F.array_join(F.slice(labels, -k, k), ".")),
        )
        cur = cur.join(st.side(hit), F.col(cand) == F.col(hit), "left")
        is_suffix = F.col(hit).isNotNull()
        temp += [cand, hit]
        if st.wildcards and k >= 2:
            parent, whit = f"_par{k}", f"_wild{k}"
            cur = cur.withColumn(parent, F.when(F.col(cand).isNotNull(), F.array_join(F.slice(labels, -(k - 1), k - 1), ".")))
            cur = cur.join(st.side(whit, "wild"), F.col(parent) == F.col(whit), "left")
            wild = F.col(whit).isNotNull()
            temp += [parent, whit]
            if st.exceptions:
                ehit = f"_exc{k}"
                cur = cur.join(st.side(ehit, "exc"), F.col(cand) == F.col(ehit), "left")
                wild = wild & F.col(ehit).isNull()
                temp.append(ehit)
            is_suffix = is_suffix | wild
        picked.append(F.when(is_suffix, F.col(cand)))
    longest = F.coalesce(*reversed(picked), F.lit("")) if picked else F.lit("")
    cur = cur.withColumn(out, longest)
    return cur.drop(*temp)


def registered_domain(
    df: DataFrame,
    suffixes: SuffixTable | DataFrame,
    col: str = "url",
    out: str = "domain",
    domain_only: bool = True,
    scheme: bool = True,
) -> DataFrame:
    """Registered domain of ``col``.

    Empty or relative URL → ``""``.  ``domain_only=False`` → the host.  Else
    the last label before the longest public suffix plus that suffix; when
    exactly ``www`` precedes the suffix the suffix alone is returned, without
    dot and without scheme (explicit reference behaviour, SURVEY §7.6).  With
    no matching suffix the last label of the host is used.  ``scheme=True``
    prefixes ``scheme://``.
    """
    _require(df, col)
    x = F.col(col)
    # the URL regex runs once per row: host and scheme become columns first
    cur = df.withColumn("_h", U.url_host(x)).withColumn("_s", U.url_scheme(x))
    host = F.col("_h")
    prefix = F.concat(F.col("_s"), F.lit("://")) if scheme else F.lit("")
    empty = (x.isNull()) | (host == "")
    if not domain_only:
        return cur.withColumn(out, F.when(empty, F.lit("")).otherwise(F.concat(prefix, host))).drop("_h", "_s")
    cur = with_public_suffix(cur, suffixes, host, "_sfx")
    sfx = F.col("_sfx")
    tld = F.when(sfx == "", F.lit("")).otherwise(F.concat(F.lit("."), sfx))
    pre = F.expr("substring(_h, 1, length(_h) - length(_t))")
    cur = cur.withColumn("_t", tld).withColumn("_pre", pre)
    value = (
        F.when(empty, F.lit(""))
        .when(F.col("_pre") == "www", sfx)
        .otherwise(F.concat(prefix, F.substring_index(F.col("_pre"), ".", -1), F.col("_t")))
    )
    return cur.withColumn(out, value).drop("_sfx", "_h", "_s", "_t", "_pre")


def _distinct_first(df: DataFrame, value: Column, col: str, order_col: str) -> DataFrame:
    """One row per value with the smallest ``order_col``; other columns blanked."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    reduced = df.select(F.col(order_col), value.alias(col))
    # rows without a value go after the aggregation: a filter on the value itself would be pushed below it and evaluate it twice
    reduced = reduced.groupBy(col).agg(F.min(order_col).alias(order_col), F.count(col).alias("_n")).where("_n > 0")
    out = []
    for name, dtype in fields.items():
        if name in (col, order_col):
            out.append(F.col(name))
        else:
            out.append(F.lit(None).cast(dtype).alias(name))
    return reduced.select(*out)


def trim_to_root(df: DataFrame, col: str = "url", order_col: str = "row_id") -> DataFrame:
    """``scheme://host`` of each URL (whitespace simplified, port/user/path dropped),
    de-duplicated keeping first occurrence; all other columns blanked."""
    _require(df, col, order_col)
    x = U.simplified(col)
    root = F.concat(U.url_scheme(x), F.lit("://"), U.url_host(x))
    return _distinct_first(df, root, col, order_col)


def trim_to_last_folder(df: DataFrame, col: str = "url", order_col: str = "row_id") -> DataFrame:
    """Drop the last path segment.

    A root URL (nothing but the authority after ``scheme://``, one trailing
    ``/`` allowed) stays unchanged; this includes a root with a port or query
    (Decision, SURVEY §7.6).  Otherwise ``[^/]+/?$`` is removed, even inside a
    query string; the row is dropped when that segment (without ``/``) equals
    the host or when nothing matches.  De-duplicated, other columns blanked.
    """
    _require(df, col, order_col)
    fields = df.schema
    # each part is a column of its own, evaluated once
    x, body, seg = F.col("_x"), F.col("_body"), F.col("_seg")
    cur = df.select(F.col(order_col), U.simplified(col).alias("_x"))
    cur = cur.withColumn("_body", F.when(x.endswith("/"), F.expr("substring(_x, 1, length(_x) - 1)")).otherwise(x))
    cur = cur.withColumn("_seg", F.substring_index(body, "/", -1))
    value = (
        F.when(U.is_root(x), x)
        .when((seg == "") | (seg == U.url_host(x)), F.lit(None).cast("string"))
        .otherwise(F.expr("substring(_body, 1, length(_body) - length(_seg))"))
    )
    cur = cur.select(F.col(order_col), value.alias(col)).select(
        *[F.col(f.name) if f.name in (col, order_col) else F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    return _distinct_first(cur, F.col(col), col, order_col)


def keep_only_domain(df: DataFrame, suffixes: SuffixTable | DataFrame, col: str = "url", order_col: str = "row_id") -> DataFrame:
    """P5: registered domain with scheme, de-duplicated, other columns blanked."""
    _require(df, col, order_col)
    simple = df.select(order_col, U.simplified(col).alias(col))
    dom = registered_domain(simple, suffixes, col, "_dom")
    reduced = dom.groupBy(F.col("_dom").alias(col)).agg(F.min(order_col).alias(order_col))
    fields = {f.name: f.dataType for f in df.schema.fields}
    return reduced.select(*[F.col(n) if n in (col, order_col) else F.lit(None).cast(t).alias(n) for n, t in fields.items()])


def replace_text(df: DataFrame, search: str, repl: str, col: str = "url") -> DataFrame:
    """Literal, case-sensitive replace of all occurrences."""
    _require(df, col)
    return df.withColumn(col, U.replace_literal(col, search, repl))


def replace_regex(df: DataFrame, pattern: str, repl: str, col: str = "url") -> DataFrame:
    """Regex replace of all matches."""
    _require(df, col)
    return df.withColumn(col, U.replace_regex(col, pattern, repl))


def replace_text_keep_scheme(df: DataFrame, search: str, repl: str, col: str = "url") -> DataFrame:
    """Literal replace after the first ``://`` (whole string if none)."""
    _require(df, col)
    return df.withColumn(col, U.replace_literal_keep_scheme(col, search, repl))


def _valid_pattern(spark, pattern: str) -> bool:
    """Whether the engine that runs the pattern accepts it."""
    try:
        spark.range(1).select(F.concat(F.col("id").cast("string")).rlike(pattern)).collect()
    except Exception as e:  # the JVM's syntax error, wrapped by whichever stage meets it first
        if "regex" in str(e).lower() or "pattern" in str(e).lower():
            return False
        raise
    return True


def remove_regex_mask(df: DataFrame, pattern: str, col: str = "url", changed_col: str | None = None) -> DataFrame:
    """Delete every match of ``pattern`` from ``col``; rows are kept.

    An invalid pattern changes nothing.  With ``changed_col`` a boolean column
    flags the rows that changed (count them with :func:`changed_rows`).
    """
    _require(df, col)
    if not pattern or not _valid_pattern(df.sparkSession, pattern):
        out = df
        new = F.col(col)
    else:
        new = F.regexp_replace(F.col(col), F.lit(pattern), F.lit(""))
        out = df
    if changed_col:
        out = out.withColumn(changed_col, F.coalesce(new != F.col(col), F.lit(False)))
    return out.withColumn(col, new)


def changed_rows(df: DataFrame, changed_col: str) -> int:
    """Action: number of rows flagged by :func:`remove_regex_mask`."""
    return int(df.agg(F.count_if(F.col(changed_col)).alias("n")).first()["n"])


def clear_column(df: DataFrame, name: str) -> DataFrame:
    """P10: set a column to NULL (the empty cell) for all rows."""
    _require(df, name)
    dtype = df.schema[name].dataType
    return df.withColumn(name, F.lit(None).cast(dtype))


# Metric columns that are rounded to a whole number (fixed values, SURVEY §1.2).
ROUNDED_METRICS = ("page_authority", "domain_authority")


def coerce_metric_types(df: DataFrame) -> DataFrame:
    """Cast metric columns to the types the schema registry gives them.

    Decision: an unparsable value becomes NULL (the reference's ``toInt``
    gives 0); an empty value stays NULL.
    """
    out = df
    for name in df.columns:
        c = F.trim(F.col(name).cast("string"))
        c = F.when(c == "", F.lit(None)).otherwise(c)
        kind = S.TYPES.get(name)
        if name in ROUNDED_METRICS:
            out = out.withColumn(name, F.round(c.try_cast("double")).try_cast("int"))
        elif isinstance(kind, T.IntegerType):
            out = out.withColumn(name, c.try_cast("int"))
        elif isinstance(kind, T.DoubleType):
            out = out.withColumn(name, c.try_cast("double"))
        elif isinstance(kind, T.LongType) and name != "row_id":
            out = out.withColumn(name, F.round(c.try_cast("double")).try_cast("long"))
    return out


def display_round(df: DataFrame) -> DataFrame:
    """Double columns shown with two decimals, except ``backlinks``."""
    out = df
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name != "backlinks":
            out = out.withColumn(f.name, F.round(F.col(f.name), 2))
    return out


def decode_absolute_urls(df: DataFrame, col: str = "url") -> DataFrame:
    """Percent-decode values that are absolute URLs (``+`` kept)."""
    _require(df, col)
    return df.withColumn(col, U.decode_if_absolute(col))


# Sentinel per enrichment for a timed-out request (fixed values, SURVEY P20).
TIMEOUT_SENTINELS = {
    "status": ("http_status", 503),
    "redirect": ("http_status", 503),
    "dofollow": ("dofollow_pct", -2.0),
    "obl": ("obl", -1),
    "availability": ("domain_available", "API timeout"),
    "platform": ("platform", "Server timeout"),
}


def fill_timeouts(df: DataFrame, op: str, outcome_col: str = "outcome") -> DataFrame:
    """P20: where ``outcome = 'timeout'`` put the operation's sentinel in its column."""
    if op not in TIMEOUT_SENTINELS:
        raise ValueError(f"unknown operation {op!r}")
    col, value = TIMEOUT_SENTINELS[op]
    _require(df, outcome_col)
    if col not in df.columns:
        df = df.withColumn(col, F.lit(None).cast(T.StringType() if isinstance(value, str) else T.DoubleType() if isinstance(value, float) else T.IntegerType()))
    dtype = df.schema[col].dataType
    return df.withColumn(col, F.when(F.col(outcome_col) == "timeout", F.lit(value).cast(dtype)).otherwise(F.col(col)))


def with_url_parts(df: DataFrame, col: str = "url") -> DataFrame:
    """Scheme, host, path and the ``is_absolute`` guard."""
    _require(df, col)
    return (
        df.withColumn("scheme", U.url_scheme(col))
        .withColumn("host", U.url_host(col))
        .withColumn("path", U.url_path(col))
        .withColumn("is_absolute", U.is_absolute(col))
    )


def with_status_class(df: DataFrame, col: str = "http_status", out: str = "status_class") -> DataFrame:
    """P14."""
    _require(df, col)
    return df.withColumn(out, U.status_class(col))


def with_rendered_line(df: DataFrame, cols: list[str], out: str = "line") -> DataFrame:
    """copy/export line of chosen columns."""
    _require(df, *cols)
    return df.withColumn(out, U.render_line(cols))


def with_split_platform(df: DataFrame, col: str = "platform_raw") -> DataFrame:
    """``platform_category`` and ``platform`` from ``cat | name``."""
    _require(df, col)
    cat, name = U.split_platform(col)
    return df.withColumn("platform_category", cat).withColumn("platform", name)
