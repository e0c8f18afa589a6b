"""O2/O3 rank selection, header probes of S2/S4/S5, literals of platform patterns."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitesieve.operators import dedup as D
from sitesieve.operators import platform as PL
from sitesieve.sources import files as SF


@pytest.fixture(scope="module")
def numbers(spark):
    """60 000 rows, ids with gaps, 40 without id, 500 with the same one."""
    df = spark.range(60_000).select(F.when(F.col("id") < 40, None).when(F.col("id").between(30_000, 30_499), 90_000).otherwise(F.col("id") * 3).alias("row_id"), "id")
    return df.orderBy(F.xxhash64("id")).persist()


@pytest.fixture(scope="module")
def in_order(numbers):
    return sorted((r.row_id is not None, r.row_id or 0) for r in numbers.select("row_id").collect())


@pytest.mark.parametrize("offset, n", [(0, 5), (0, 60), (30, 50), (40, 7), (1000, 100), (29_900, 300), (30_200, 10), (45_678, 1), (59_990, 100), (60_000, 5), (70_000, 5), (100, 59_000), (0, 10_000)])
def test_windows(numbers, in_order, offset, n):
    out = D.ranked(numbers, offset, n, "row_id", most=200)
    assert sorted((r.row_id is not None, r.row_id or 0) for r in out.collect()) == in_order[offset : offset + n]


def test_a_deep_window_sorts_its_range_only(spark, monkeypatch):
    df = spark.range(200_000).select(F.col("id").alias("row_id"))
    ranges = []
    inner = type(df).orderBy
    monkeypatch.setattr(type(df), "orderBy", lambda self, *a: ranges.append(self.count()) or inner(self, *a))
    out = D.ranked(df, 150_000, 50, "row_id", most=300)
    assert [r.row_id for r in out.collect()] == list(range(150_000, 150_050))
    assert ranges and ranges[0] <= 50 + 300
    assert D.ranked(df.limit(0), 5, 5, "row_id").collect() == []
    names = df.select(F.format_string("%06d", "row_id").alias("row_id"))  # no whole numbers: Spark's own
    assert [r.row_id for r in D.page_of(names, 7, 2).collect()] == ["000007", "000008"]


def test_header_job_reads_one_split(spark, tmp_path, monkeypatch):
    folder = tmp_path / "lists"
    folder.mkdir()
    for i in range(5):
        lines = (["#URL|HTTP Status"] if i == 0 else []) + [f"http://s{i}/{j}|200" for j in range(3000)]
        (folder / f"part-{i}.txt").write_text("\n".join(lines) + "\n")
    seen = spark.sparkContext.accumulator(0)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        read = []
        inner = SF.read_lines
        monkeypatch.setattr(SF, "read_lines", lambda *a: read.append(1) or inner(*a))
        assert SF.first_lines(spark, str(folder)) == ["#URL|HTTP Status"]
        assert not read  # no scan over all files
        plan = spark.read.text(str(folder / "part-0.txt")).select("value", F.col("_metadata.file_block_start").alias("s")).where("s = 0")
        assert plan.count() < 1500 and spark.read.text(str(folder)).rdd.getNumPartitions() > 10
        table = SF.read_result_txt(spark, str(folder))
        assert table.columns == ["row_id", "url", "http_status"] and table.count() == 15_000 and len(read) == 1
        read.clear()
        assert SF.read_results(spark, str(folder)).count() == 15_000
        assert len(read) == 2  # the format's pass and the rows
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen.value == 0


def test_headers_in_odd_places(spark, tmp_path):
    blank, named = tmp_path / "blank", tmp_path / "with space"
    blank.mkdir(), named.mkdir()
    for i in range(12):
        (blank / f"p{i:02d}.txt").write_text("\n \n" if i < 11 else "\n#URL|TF\nhttp://a|3\n")
    assert SF.read_result_txt(spark, str(blank)).drop("row_id").columns == ["url", "trust_flow"] or SF.read_result_txt(spark, str(blank)).count() == 1
    assert SF.first_lines(spark, str(blank), F.trim("value") != "") == ["#URL|TF"]
    (named / "a b%20[1].txt").write_text("# API : Moz\n#URL|Anchor Text\nhttp://a|x\n")
    assert SF.first_lines(spark, str(named)) == ["# API : Moz"]
    assert SF.read_results(spark, str(named)).count() == 1
    (tmp_path / "none.txt").write_text("")
    assert SF.first_lines(spark, str(tmp_path / "none.txt")) == []


LITERALS = {
    "wp-content": "content", r"jquery-3\.[0-9]": "jquery", r"WordPress( [\d.]+)?": "wordpress", "a|b": "", r"foo\sbarbaz": "barbaz", "colou?r": "colo",
    "x{2}yz": "yz", "ab{0,3}cde": "cde", "(abc|def)ghi": "ghi", r"[abc]\.js": "js", r"\Qa.b\E": "", "(?i)abc": "", "abc(?=def)": "", "(?:abc)def": "def",
    r"(?<v>[eé]t)Éxyz": "xyz", "a(b": "", r"powered\sby\s<a[^>]+phpbb": "powered", "": "",
}


@pytest.mark.parametrize("pattern", LITERALS)
def test_literals(pattern):
    assert PL.required_literal(pattern) == LITERALS[pattern]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "c", "ab", r"\.", ".", "[ab]", "(a|b)", "(?:bc)", "a?", "b*", "c+", "a{2}", "b{0,2}", r"\d", r"\s", "-"]), max_size=7).map("".join), st.text("aAbBcC.-1 ", max_size=14))
def test_every_match_holds_the_literal(pattern, text):
    if re.search(pattern, text, re.I):
        assert PL.required_literal(pattern) in text.lower()


def test_case_folding_of_odd_letters(spark):
    """Letters that Java takes for ASCII ones regardless of case are found behind the prefilter as well."""
    from sitesieve.plans.fixtures import Fixtures  # noqa: F401

    rules = spark.createDataFrame([("App", "CMS", 0, "html", "", "kiss-me"), ("Ant", "CMS", 1, "meta", "generator", "Ant[0-9]")], PL.RULE_SCHEMA)
    pages = spark.createDataFrame([(1, "KISS-ME"), (2, "KIſs-me"), (3, "kiss me"), (4, '<META name="Generator" content="aNT7">'), (5, '<meta name="x" content="ant7">')], "page_id int, html string")
    found = {r.page_id: r.platform_raw for r in PL.detect_platform(pages, rules).collect()}
    assert found == {1: "CMS | App", 2: "CMS | App", 3: "Not Found", 4: "CMS | Ant", 5: "Not Found"}
    assert {(r.page_id, r.app) for r in PL.match_platform_rules(pages, rules).collect()} == {(1, "App"), (2, "App"), (4, "Ant")}
