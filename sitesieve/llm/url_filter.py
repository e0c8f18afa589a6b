"""URL filters: sort-merge range join of URLs with nested prefix rules.

The key of a host and path is the host's labels reversed, a zero byte, then
the path, so the paths below a rule's path are the interval of keys that begin with the
rule's key.  A rule holds for its subdomains too, so a URL gives one key per suffix of its
host.  Keys and rules are cut into ranges of the key order; a rule goes
to every range that its interval meets.  Within a range one sweep over the sorted rows keeps the
stack of rules whose interval is open; its top is the longest rule of a key.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST = "\U0010ffff"
PER_RANGE = 40  #: keys sampled per range of the key order; the sample decides the balance, not the result


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1)).otherwise(F.lit(None))
    rest = F.coalesce(F.substring(url, F.length(rest) + 4, F.length(url)), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit("\0"), path)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, key, kind, host, path, rule, verdict) sorted by range, key, kind; rules are kind 0."""
    stack, now = [], None
    for batch in batches:
        out = {k: [] for k in ("host", "path", "rule", "rule_host", "verdict")}
        columns = [batch.column(c).to_pylist() for c in ("range", "key", "kind", "host", "path", "verdict")]
        for part, key, kind, host, path, verdict in zip(*columns):
            if part != now:
                stack, now = [], part
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, host + path, len(host), verdict))
            elif stack:
                _, rule, rule_host, verdict = stack[-1]
                for name, value in zip(out, (host, path, rule, rule_host, verdict)):
                    out[name].append(value)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k == "rule_host" else pa.string()) for k, v in out.items()], names=list(out))


def longest_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) for the different (host, path) of ``urls`` that some rule of ``rules`` (host, path, verdict) fits."""
    spark = urls.sparkSession
    urls = urls.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    points = urls.withColumn("_l", labels).withColumn("_i", F.explode(F.sequence(F.lit(1), F.size("_l"))))
    points = points.select(_key(F.slice("_l", F.col("_i"), F.size("_l")), F.col("path")).alias("key"), "host", "path")
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> '' and verdict is not null")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block beats allow on equal rules
    rules = rules.select(_key(F.split("host", r"\."), F.col("path")).alias("key"), "host", "path", "verdict")

    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = points.count()
    share = min(1.0, PER_RANGE * ranges / max(total, 1))
    place = F.pmod(F.xxhash64("key", "host"), F.lit(2**31)) < F.lit(int(share * 2**31))
    sample = sorted(r["key"] for r in points.where(place).select("key").limit(4 * PER_RANGE * ranges).collect())
    cuts = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []

    @F.pandas_udf("int")
    def range_of(keys):
        return keys.map(lambda k: bisect_right(cuts, k)).astype("int32")

    # a rule's interval ends before every key that does not begin with it
    rules = rules.withColumn("range", F.explode(F.sequence(range_of("key"), range_of(F.concat("key", F.lit(LAST))))))
    points = points.withColumn("range", range_of("key"))
    columns = ("range", "key", "kind", "host", "path", "verdict")
    rows = rules.withColumn("kind", F.lit(0)).select(*columns).unionAll(points.withColumn("kind", F.lit(1)).withColumn("verdict", F.lit(None).cast("string")).select(*columns))
    rows = rows.repartition(ranges, "range").sortWithinPartitions("range", "key", "kind")
    found = rows.mapInArrow(_sweep, "host string, path string, rule string, rule_host long, verdict string")
    best = F.max(F.struct(F.length("rule").alias("n"), "rule_host", "rule", "verdict")).alias("best")
    return found.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.verdict")


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    A rule (host, path, verdict) fits its host and all subdomains where the URL's
    path starts with its path; the longest rule (host and path together, then host) wins,
    and ``block`` wins between equal ones.  URLs that no rule fits get rule
    null and the verdict ``default``; so do null URLs and URLs without ``://``, whose host and
    path are empty.  Rules with an empty host or without a verdict are
    ignored.  Columns of ``pages`` called host, path, rule or verdict are replaced;
    repeated rows stay.
    """
    host, path = host_and_path(F.col(url))
    pages = pages.drop("rule", "verdict").withColumns({"host": host, "path": path})
    best = longest_rules(pages, rules).withColumnsRenamed({"host": "__host", "path": "__path"})
    out = pages.join(best, (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path")), "left").drop("__host", "__path")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
