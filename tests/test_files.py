"""File readers and writers: format detection, order across paths, round trips."""

import pytest

from sitesieve.sources import files as SF
from sitesieve.sources import sinks as SK
from sitesieve.streaming.streams import shared_folder


def lines_file(spark, lines, name):
    folder = shared_folder(spark, name)
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(folder)
    return folder


def test_detect_formats(spark):
    csv = lines_file(spark, ['"URL","HTTP Status"', '"http://a.com/","200"'], "csv")
    txt = lines_file(spark, ["#URL|HTTP Status", "http://a.com/|200"], "txt")
    urls = lines_file(spark, ["http://a.com/", "# c", "", "http://b.com/"], "urls")
    assert [SF.detect_format(spark, p) for p in (csv, txt, urls)] == ["csv", "txt", "urls"]
    r = SF.read_results(spark, txt).first()
    assert (r.url, r.http_status) == ("http://a.com/", 200)
    assert [x.url for x in SF.read_results(spark, urls).orderBy("row_id").collect()] == ["http://a.com/", "http://b.com/"]


def test_txt_without_header_uses_default(spark):
    p = lines_file(spark, ["http://a.com/|3", "http://b.com/|4"], "nohdr")
    rows = SF.read_result_txt(spark, p).orderBy("row_id").collect()
    assert [(r.url, r.pr) for r in rows] == [("http://a.com/", "3"), ("http://b.com/", "4")]


def test_url_lists_keep_path_order(spark):
    a = lines_file(spark, ["http://a.com/1", "http://a.com/2"], "a")
    b = lines_file(spark, ["http://b.com/1"], "b")
    got = [r.url for r in SF.read_url_list(spark, [b, a]).orderBy("row_id").collect()]
    assert got == ["http://b.com/1", "http://a.com/1", "http://a.com/2"]


def test_report_needs_marker(spark):
    p = lines_file(spark, ["#URL|Anchor", "http://a.com/|x"], "nomarker")
    with pytest.raises(ValueError):
        SF.read_provider_report(spark, p)


def test_csv_round_trip_with_quotes_and_nulls(spark):
    df = spark.createDataFrame([(1, 'say "hi"', None), (2, "plain", 404)], "row_id long, anchor string, http_status int")
    folder = shared_folder(spark, "rt")
    SK.write_result_csv(df, folder)
    back = sorted((r.anchor, r.http_status) for r in SF.read_result_csv(spark, folder).collect())
    assert back == [("plain", 404), ('say "hi"', None)]


def test_short_rows_are_padded_and_long_ones_cut(spark):
    folder = shared_folder(spark, "mixed")
    spark.createDataFrame([("#URL|HTTP Status",), ("http://a.com/|200",)], "value string").coalesce(1).write.text(folder + "/f1")
    spark.createDataFrame([("http://b.com/|200",), ("http://c.com/|200|x",)], "value string").coalesce(1).write.text(folder + "/f2")
    rows = SF.read_result_txt(spark, [folder + "/f1", folder + "/f2"]).collect()
    got = sorted((r.url, r.http_status) for r in rows)
    assert got == [("http://a.com/", 200), ("http://b.com/", 200), ("http://c.com/", 200)]
    short = lines_file(spark, ["#URL|CF|TF", "http://a/|10|n/a", "http://b/", "http://c/|3"], "short")
    rows = SF.read_result_txt(spark, short).orderBy("row_id").collect()
    assert [(r.url, r.citation_flow, r.trust_flow) for r in rows] == [("http://a/", 10, None), ("http://b/", None, None), ("http://c/", 3, None)]
    from sitesieve.operators.filters import drop_lower

    assert [r.url for r in drop_lower(SF.read_result_txt(spark, short), "citation_flow", 5).where("citation_flow is not null").collect()] == ["http://a/"]


@pytest.mark.parametrize("provider", ["Ahrefs", "Majestic", "Moz"])
def test_two_reports_and_reports_through_the_ordinary_import(spark, provider):
    txt = [lines_file(spark, [f"# API : {provider}", "#Backlinks for|URL|Anchor", f"http://t/|http://a/{i}|x"], f"two{i}") for i in range(2)]
    csv = [lines_file(spark, [f"# API : {provider}", '"Backlinks for","URL","Anchor"', f'"http://t/","http://a/{i}","x"'], f"csv{i}") for i in range(2)]
    for paths in (txt, csv):
        for read in (SF.read_provider_report, SF.read_results):
            got = read(spark, paths)
            assert [(r.backlink_for, r.url, r.anchor) for r in got.orderBy("row_id").collect()] == [("http://t/", f"http://a/{i}", "x") for i in range(2)]
            assert got.columns[1:] == SF.S.SCHEMAS[f"backlinks/{provider.lower()}"]


def test_appended_rows_get_ids_and_survive_dedup(spark):
    from sitesieve.operators.dedup import dedup_urls
    from sitesieve.operators.sets import append_rows

    table = spark.createDataFrame([(0, "http://a/"), (1, "http://b/")], "row_id long, url string")
    both = append_rows(table, spark.createDataFrame([("http://c/",), ("http://a/",)], "url string").coalesce(1))
    assert sorted((r.url, r.row_id) for r in dedup_urls(both).collect()) == [("http://a/", 3), ("http://b/", 1), ("http://c/", 2)]
    with pytest.raises(Exception, match="row_id must not be null"):
        dedup_urls(table.unionByName(spark.createDataFrame([(None, "http://x/")], "row_id long, url string"))).collect()


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from sitesieve.session import ensure_checkpoint_dir

    context = SimpleNamespace(master="spark://h:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None)))


def test_stable_ids(spark):
    p = lines_file(spark, ["http://a.com/1", "http://a.com/2"], "stable")
    df = SF.read_results(spark, p, stable=True)
    assert [r.url for r in df.orderBy("row_id").collect()] == ["http://a.com/1", "http://a.com/2"]
    assert df.select("row_id").collect() == df.select("row_id").collect()


def test_provider_report_csv(spark):
    lines = ["# API : Ahrefs", '"Backlinks for","URL","Anchor","Nofollow","URL Rank"',
             '"http://t.com/","http://a.com/1","say \\"x\\"","true","12"', '"http://t.com/","http://b.com/2","y","false","3"']
    folder = shared_folder(spark, "csvreport")
    spark.createDataFrame(list(enumerate(lines)), "o long, value string").orderBy("o").coalesce(1).select("value").write.text(folder)
    rows = sorted((r.url, r.anchor, r.nofollow, r.url_rank) for r in SF.read_provider_report(spark, folder).collect())
    assert rows == [("http://a.com/1", 'say "x"', True, 12), ("http://b.com/2", "y", False, 3)]
    assert "target_url" in SF.read_provider_report(spark, folder).columns


def test_stable_ids_csv_txt(spark):
    txt = lines_file(spark, ["#URL|HTTP Status", "http://a.com/|200", "http://b.com/|404"], "stxt")
    csv = lines_file(spark, ['"URL","HTTP Status"', '"http://a.com/","200"'], "scsv")
    t = SF.read_result_txt(spark, txt, stable=True)
    c = SF.read_result_csv(spark, csv, stable=True)
    assert [r.url for r in t.orderBy("row_id").collect()] == ["http://a.com/", "http://b.com/"]
    assert [(r.url, r.http_status) for r in c.collect()] == [("http://a.com/", 200)]
