"""Hot keys, runtime filters and observed counts: same answers, less moved or read."""

import pytest
from pyspark.sql import functions as F

from sitesieve.operators import bloom
from sitesieve.operators import content as C
from sitesieve.operators import enrich as E
from sitesieve.operators import filters as FL
from sitesieve.session import written

from .test_plans import plan, skewed


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_only_hot_keys_get_salts(spark):
    df = skewed(spark)
    hot = E.hot_keys(df, ["url"], 12)
    found = {r._hash: r._salts for r in hot.collect()}
    (key,) = [r.h for r in spark.sql("SELECT xxhash64('http://hot.com/') AS h").collect()]
    assert set(found) == {key} and found[key] in (4, 5)
    assert E.hot_keys(df.withColumn("url", F.col("row_id").cast("string")), ["url"], 12).count() == 0
    assert E.hot_keys(df.withColumn("url", F.lit(None).cast("string")), ["url"], 12).count() == 0
    assert E.hot_keys(df.where("false"), ["url"], 12).count() == 0
    with pytest.raises(ValueError):
        E.hot_keys(df, ["url"], E.MAX_SALT + 1)


def test_salted_join_spreads_the_hot_key_and_repeats_its_answer_only(spark):
    """A third of the rows share a URL; no shuffle partition of the join holds them all."""
    df = skewed(spark)
    upd = df.select("url", F.lit(7).alias("obl")).distinct()
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        largest = {}
        for salt in (1, 48):
            out = E.update_by_url(df, upd, ["obl"], salt=salt)
            largest[salt] = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("obl").alias("n")).agg(F.max("n")).first()[0]
            assert out.where("obl = 7").count() == df.count()
        assert largest[1] >= 1000 and largest[48] < 400, largest
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("salt", [2, 8, 1000])
def test_salted_updates_equal_plain_ones(spark, salt):
    """Null and empty keys, repeated rows, an answer without rows and rows without an answer."""
    rows = [(1, None), (2, ""), (3, "http://a.com/"), (3, "http://a.com/"), (4, "http://b.com/"), (5, "rel")] + [(9, "http://a.com/")] * 40
    df = spark.createDataFrame(rows, "row_id long, url string").withColumn("http_status", F.lit(None).cast("int"))
    upd = spark.createDataFrame([("http://a.com/", 1), ("", 2), (None, 3), ("http://z.com/", 4), ("rel", 5)], "url string, obl int")
    assert rows_of(E.update_by_url(df, upd, ["obl"], salt=salt)) == rows_of(E.update_by_url(df, upd, ["obl"]))
    log = upd.select("url", F.current_timestamp().alias("fetched_at"), F.col("obl").alias("http_status"))
    assert rows_of(E.enrich_status(df, log, salt=salt)) == rows_of(E.enrich_status(df, log))
    pairs = df.withColumn("backlink_for", F.lit("t"))
    answers = upd.withColumn("backlink_for", F.lit("t"))
    assert rows_of(E.update_by_pair(pairs, answers, ["obl"], salt=salt)) == rows_of(E.update_by_pair(pairs, answers, ["obl"]))
    hosts = spark.createDataFrame([("a.com", "1.1.1.1", 0)], "host string, ip string, ord int")
    assert rows_of(E.enrich_ip(df, hosts, salt=salt)) == rows_of(E.enrich_ip(df, hosts))
    assert E.update_by_url(df.where("false"), upd, ["obl"], salt=salt).count() == 0


def test_anti_join_equals_the_plain_one(spark):
    df = skewed(spark).unionByName(spark.createDataFrame([(-1, None, 0), (-2, "", 0)], "row_id long, url string, tf int"))
    for done in (df.where("tf < 10"), df.where("false"), df, df.where("url is null or url = ''")):
        keys = done.select("url").distinct()
        assert rows_of(bloom.anti_join(df, keys, "url")) == rows_of(df.join(keys, "url", "left_anti").select(df.columns))
    # types whose values hash differently take the plain join
    longs = spark.range(0, 3000, 2).select(F.col("id").cast("int").alias("row_id"))
    assert bloom.anti_join(skewed(spark), longs, "row_id").count() == 1500


def test_an_overfull_filter_is_not_tried(spark, monkeypatch):
    frontier, done = spark.range(100), spark.range(0, 100, 2)
    assert "bit_or" in plan(bloom.anti_join(frontier, done, "id"))
    monkeypatch.setattr(bloom, "MAX_WORDS", 2)
    out = bloom.anti_join(frontier, done, "id")
    assert "bit_or" not in plan(out) and out.count() == 50


def test_anti_join_shuffles_possible_members_only(spark):
    """One in a hundred frontier items is done: about as many reach the exact join."""
    frontier = spark.range(20000).select(F.concat(F.lit("http://f.com/"), F.col("id")).alias("url"))
    held = bloom.BloomFilter(frontier.where(F.crc32("url") % 100 == 0).select("url"), "url")
    may, never = held.split(frontier, "url")
    assert held.n_keys <= may.count() < held.n_keys + 20000 * 0.02
    assert may.count() + never.count() == 20000


def test_filter_chain_counts_while_writing(spark):
    df = skewed(spark).withColumn("http_status", F.col("tf") * 10)
    steps = [("bad", FL.remove_bad_urls), ("text", lambda d: FL.drop_containing(d, "url", "hot")), ("none", lambda d: FL.drop_containing(d, "url", "")),
             ("all", lambda d: d.where("tf < 0"))]
    chain = FL.FilterChain(df, steps)
    assert plan(chain.result).count("Scan") == 1
    written(chain.result, "chain")
    left, want = df, []
    for i, (name, step) in enumerate(steps):
        after = step(left)
        want.append((i + 1, name, FL.removed_count(left, after), after.count()))
        left = after
    assert chain.report() == want and want[-1][3] == 0


def test_observed_statistics_equal_the_queries(spark):
    df = skewed(spark).withColumn("http_status", F.when(F.col("tf") % 3 > 0, F.col("tf") * 10)).withColumn("note", F.when(F.col("tf") > 9, F.lit("")).otherwise("x"))
    table, seen = E.observe_statistics(df, ["url", "note"], "http_status", ["http_status"])
    written(table, "observed")
    want = {"total": 3000, "filled_url": 3000, "filled_note": E.count_filled(df, "note").first()[0], "redirects": E.count_redirects(df).first()[0],
            "done_http_status": E.enrichment_progress(df, "http_status").first()["done"]}
    assert seen.get == want
    empty, seen = E.observe_statistics(df.where("false"), ["url"])
    written(empty, "observed")
    assert seen.get == {"total": 0, "filled_url": 0}


@pytest.mark.parametrize("parts", [1, 7])
def test_link_alive_is_independent_of_the_order_of_copies(spark, parts):
    pages = spark.createDataFrame(
        [(1, "u", None, 500), (2, "u", "<a href='http://t.com/x'>", 200), (3, "v", "", 503), (4, "v", None, 404)], "page_id long, url string, html string, st int")
    urls = spark.createDataFrame([(1, "u"), (2, "v"), (3, "w")], "row_id long, url string")
    out = C.link_alive(urls, pages.repartition(parts, F.rand(parts)), target="t.com", status_col="st")
    assert [r.link_alive for r in out.orderBy("row_id").collect()] == ["yes", "error : 404", None]
