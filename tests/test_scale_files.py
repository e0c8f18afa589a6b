"""Work per task, per Arrow batch and on the driver that must not grow with the tables."""

import pytest

from sitesieve.operators import elements as EL
from sitesieve.plans import catalog, jobs
from sitesieve.plans import cat_sources as CS  # registers itself through the catalog, which is imported first
from sitesieve.sources import sinks as SK
from sitesieve.streaming.streams import run_append, shared_folder

from .conftest import SF
from .test_plans import plan


@pytest.fixture
def small_partitions(spark):
    """Spark advises partitions of 1 KB."""
    held = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def files(spark, folder):
    return len(spark.read.text(folder).inputFiles())


@pytest.mark.parametrize("json_path", ["arr", None])
def test_items_are_not_broadcast_whatever_the_planner_takes_them_for(spark, json_path):
    """an exploded VARIANT is planned 34 times too small; only the Bloom filter goes through the driver."""
    body = '{"arr": ["a", "b", "a"]}' if json_path else "<i>a</i><i>b</i><i>a</i>"
    pages = spark.createDataFrame([(k, f"http://o/{k}", body) for k in range(5)], "page_id long, url string, html string")
    rule = EL.Rule("v", "i", suffix=" ({%custom1%})")
    out = jobs.scrape_snapshot(spark, "{%custom1%}", pages.select("url"), None, pages, rule, json_path=json_path)
    p = plan(out)
    assert all("[_word#" in line for line in p.splitlines() if "BroadcastHashJoin" in line) and p.count("SortMergeJoin") >= 2, p
    got = sorted((r.item, r.url, r.page_id) for r in out.collect())
    assert got == [(f"{x} (http://o/{k})", f"http://o/{k}", k) for x in "ab" for k in range(5)]


def test_placeholder_rules_are_not_broadcast(spark):
    """F1, the same step: elements tested against each frontier row."""
    pages = spark.createDataFrame([(k, f"http://o/{k}", f'<a href="http://o/{k}#x">x</a><a href="http://p/">p</a>') for k in range(5)], "page_id long, url string, html string")
    rule = EL.Rule("own", "a", (EL.Test("href", "starts-with", "{%custom1%}"),), "@href")
    out = jobs.scrape_snapshot(spark, "{%custom1%}", pages.select("url"), None, pages, rule)
    assert all("[_word#" in line for line in plan(out).splitlines() if "BroadcastHashJoin" in line)
    assert sorted(r["item"] for r in out.collect()) == [f"http://o/{k}#x" for k in range(5)]


def test_element_rows_leave_python_in_bounded_batches(monkeypatch):
    """one Arrow batch of pages gave one frame of all its elements."""
    import pandas as pd

    monkeypatch.setattr(EL, "CHUNK_ROWS", 7, raising=False)
    monkeypatch.setattr(EL, "CHUNK_CHARS", 500, raising=False)
    pages = ["<p>a<b>c</b></p>" * k for k in range(9)] + [None, "", "<div>" + "x" * 2000 + "<i title=t>y</i></div>"]
    pdf = pd.DataFrame({"page_id": range(len(pages)), "html": pages, "u": [f"u{k}" for k in range(len(pages))]})
    frames = list(EL._elements_fn(None, ["u"])(iter([pdf, pdf.head(0)])))
    assert max(map(len, frames)) <= 7 and len(frames) > 10 and min(map(len, frames)) > 0
    got = pd.concat(frames)[["page_id", "pos", "tag", "attrs", "text", "depth", "u"]].values.tolist()
    assert got == [[k, *row, f"u{k}"] for k, html in enumerate(pages) for row in EL._parse(html)]
    assert max(f["text"][:-1].map(len).sum() for f in frames) < 500


def test_staged_streams_take_files_of_one_size(spark, small_partitions):
    """the stream's input was four files however large the table."""
    df = spark.range(20_000).selectExpr("id", "sha2(cast(id as string), 256) as url")
    arriving = CS._stage(df, spark, "sizes")
    sink = shared_folder(spark, "sizes-out")
    run_append(arriving, sink, shared_folder(spark, "sizes-ckpt"))
    out = spark.read.parquet(sink)
    assert out.count() == out.distinct().count() == 20_000
    small = CS._stage(df.limit(10), spark, "few")
    few = shared_folder(spark, "few-out")
    run_append(small, few, shared_folder(spark, "few-ckpt"))
    assert spark.read.parquet(few).count() == 10


@pytest.mark.parametrize("rows", [0, 1, 20_000])
def test_part_files_grow_in_number(spark, small_partitions, rows):
    """No writer takes a fixed share of the table."""
    df = spark.range(rows).selectExpr("id as row_id", "concat('http://h/', sha2(cast(id as string), 256)) as url")
    for write, read in ((SK.write_result_csv, CS.SF.read_result_csv), (SK.write_result_txt, CS.SF.read_result_txt), (CS._as_parquet, None)):
        folder = shared_folder(spark, "parts")
        CS.write_parts(write, df, folder, 3)
        assert files(spark, folder) > 20 if rows > 1 else files(spark, folder) <= 3
        if read and rows:
            assert sorted(r.url for r in read(spark, folder).select("url").collect()) == sorted(r.url for r in df.collect())


@pytest.mark.parametrize("name", ["read_url_list", "read_result_csv", "read_result_txt_ragged", "read_results_urls", "read_result_txt", "stream_dedup"])
def test_queries_write_their_input_in_part_files_of_one_size(spark, small_partitions, monkeypatch, name):
    """The query's files number more than the two to four that they were."""
    made = []
    plain = CS.ST.shared_folder
    monkeypatch.setattr(CS.ST, "shared_folder", lambda s, n: made.append(plain(s, n)) or made[-1])
    catalog.QUERIES[name](spark, SF).count()
    assert files(spark, made[0]) > 4, files(spark, made[0])
