"""The SQL functions give the same values as the Column functions (whole fixture tables)."""

from pyspark.sql import functions as F

from sitesieve.functions import url as U
from sitesieve.functions.sql import register_sql_functions
from sitesieve.plans.fixtures import Fixtures


def test_sql_functions_equal_column_functions(spark):
    register_sql_functions(spark)
    u = Fixtures(spark, "/root/testdata/sf0.001").urls()
    refs = F.element_at(F.array(*[F.lit(x) for x in ["/q", "q", "?p=2", "#t", "../a/./b", "//cdn.x/y", "https://b.com/", "x/.."]]),
                        (F.col("row_id") % 8 + 1).cast("int"))
    df = u.select("row_id", "url", "http_status", refs.alias("ref"),
                  F.concat(F.col("url"), F.lit("#%7Ea%20b")).alias("enc"))
    df.createOrReplaceTempView("ss_test_urls")
    sql = spark.sql("""SELECT row_id, ss_url_scheme(url) AS scheme, ss_url_host(url) AS host, ss_url_path(url) AS path,
                              ss_is_absolute(url) AS abs, ss_site_root(url) AS root, ss_simplified(concat(' ', url, '  x')) AS simp,
                              ss_status_class(http_status) AS cls, ss_percent_encode(url) AS pe, ss_decode_if_absolute(enc) AS dec,
                              ss_resolve_url(url, ref) AS res FROM ss_test_urls""")
    col = df.select("row_id", U.url_scheme("url").alias("scheme"), U.url_host("url").alias("host"), U.url_path("url").alias("path"),
                    U.is_absolute("url").alias("abs"), U.site_root("url").alias("root"),
                    U.simplified(F.concat(F.lit(" "), F.col("url"), F.lit("  x"))).alias("simp"),
                    U.status_class("http_status").alias("cls"), U.percent_encode("url").alias("pe"),
                    U.decode_if_absolute("enc").alias("dec"), U.resolve_url("url", "ref").alias("res"))
    a = sorted(tuple(r) for r in sql.collect())
    b = sorted(tuple(r) for r in col.collect())
    assert a == b and len(a) > 1000
