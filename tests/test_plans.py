"""Plan properties that matter at scale (checked on the physical plan text)."""

import contextlib
import io

from pyspark.sql import functions as F

from sitesieve.operators import dedup as D
from sitesieve.operators import enrich as E
from sitesieve.operators import urls as P
from sitesieve.plans.fixtures import FX_SUFFIXES


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def skewed(spark, n=3000):
    """One URL holds a third of the rows."""
    rows = [(i, "http://hot.com/" if i % 3 == 0 else f"http://h{i % 97}.com/p{i}", i % 50) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, url string, tf int")


def test_dedups_aggregate_before_shuffle(spark):
    df = skewed(spark)
    for out in (D.dedup_urls(df), D.dedup_domains(df, "tf")):
        p = plan(out)
        assert "partial_max_by" in p or "partial_min_by" in p, p
    got = {r.url: r.row_id for r in D.dedup_urls(df).collect()}
    assert got["http://hot.com/"] == 2997


def test_latest_fetch_is_partial(spark):
    log = skewed(spark).select("url", F.timestamp_seconds("row_id").alias("fetched_at"), F.col("tf").alias("http_status"))
    assert "partial_max(struct(_at" in plan(E.latest_fetch(log, ["http_status"]))


def test_suffix_lookup_is_broadcast_and_keeps_rows_in_place(spark):
    sfx = spark.createDataFrame([(s,) for s in FX_SUFFIXES], "suffix string")
    out = P.registered_domain(skewed(spark), sfx)
    p = plan(out)
    assert "BroadcastHashJoin" in p or "broadcast" in p.lower()
    # the URL table itself is never shuffled for the lookup
    assert "Exchange hashpartitioning(url" not in p
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = P.registered_domain(skewed(spark), sfx)
        assert "Broadcast" not in plan(joined)
        assert sorted(map(str, joined.collect())) == sorted(map(str, out.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [P._broadcast_threshold(type("S", (), {"conf": {"spark.sql.autoBroadcastJoinThreshold": v}})()) for v in ("10485760b", "256k", "-1", "10MB")] == [10485760, 262144, -1, 10485760]


def test_trims_and_domains_run_once(spark):
    """One scan and two exchanges for A2 (URL, then host); P4's value is not evaluated again by a filter."""
    from sitesieve.operators.dedup import dedup_domains
    from sitesieve.streaming.streams import shared_folder

    folder = shared_folder(spark, "once")
    skewed(spark).write.parquet(folder)
    p = plan(dedup_domains(spark.read.parquet(folder)))
    assert p.count("FileScan") == 1 and p.count("Exchange hashpartitioning") == 2
    p = plan(P.trim_to_last_folder(spark.read.parquet(folder)))
    assert p.count("FileScan") == 1 and p.count("regexp_replace") == 3  # two to simplify, one for the root test


def test_rules_of_one_query_parse_a_page_once(spark):
    from sitesieve.operators import elements as EL
    from sitesieve.streaming.streams import item_rows

    pages = spark.createDataFrame([(1, "<h1>a</h1><h2>b</h2>")], "page_id long, html string")
    rules = [EL.Rule("x", "h1"), EL.Rule("y", "h2"), EL.Rule("z", "h3")]
    out = item_rows(EL.extract_items(pages, rules), rules)
    assert plan(out).count("MapInPandas") == 1
    assert sorted((r.rule, r.item) for r in out.collect()) == [("x", "a"), ("y", "b")]


def test_session_has_aqe_skew_join(spark):
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"


def test_filters_reach_the_parquet_scan(spark):
    """Comparison filters are pushed into the scan; unused columns are not read."""
    from sitesieve.operators import filters as FL
    from sitesieve.streaming.streams import shared_folder

    folder = shared_folder(spark, "pushdown")
    skewed(spark).withColumn("http_status", F.col("tf") * 10).withColumn("payload", F.lit("x" * 50)).write.parquet(folder)
    df = spark.read.parquet(folder)
    out = FL.drop_lower(FL.remove_bad_urls(df), "tf", 25).select("url", "http_status")
    p = plan(out)
    # explain truncates long filter lists; the first pushed predicate is visible
    assert "PushedFilters: [Or(IsNull(http_status),And(GreaterThanOrEqual(http_status,200)" in p.replace(" ", "").replace("PushedFilters:[", "PushedFilters: ["), p
    read_schema = p.split("ReadSchema:")[1].split("\n")[0]
    assert "payload" not in read_schema and "row_id" not in read_schema, p


def test_salted_update_equals_plain(spark):
    df = skewed(spark)
    upd = spark.createDataFrame([("http://hot.com/", 7), ("http://h1.com/p1", 3)], "url string, obl int")
    plain = sorted(tuple(r) for r in E.update_by_url(df, upd, ["obl"]).collect())
    salted_df = E.update_by_url(df, upd, ["obl"], salt=8)
    assert sorted(tuple(r) for r in salted_df.collect()) == plain
    assert salted_df.columns == ["row_id", "url", "tf", "obl"]
    assert "xxhash64" in plan(salted_df)


def test_link_and_attribute_rules_stay_in_the_jvm(spark):
    from sitesieve.operators import content as C
    from sitesieve.operators import elements as EL
    from sitesieve.plans.fixtures import Fixtures

    pages = Fixtures(spark, "/root/testdata/sf0.001").pages()
    rule = EL.Rule("nav", "a", (EL.Test("href", "starts-with", "/"),), "@href")
    for df in (C.extract_links(pages), C.outbound_links(pages), C.dofollow_pct(pages), EL.extract_items(pages, [rule])):
        p = plan(df)
        assert "MapInPandas" not in p and "PythonUDF" not in p and "ArrowEvalPython" not in p, p
    assert "MapInPandas" in plan(EL.extract_items(pages, [EL.Rule("h1", "h1")]))
