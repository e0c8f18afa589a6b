"""Properties: idempotent trims and dedups, complementary filters, partition-count independence."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sitesieve.operators import dedup as D
from sitesieve.operators import filters as FL
from sitesieve.operators import urls as P

HOSTS = ["a.com", "www.a.com", "blog.a.co.uk", "x.fr", "A.org"]
PATHS = ["", "/", "/p/", "/p/q.html", "/p/q/?u=/y/z", "/d/e/f"]
url = st.builds(lambda s, h, p: f"{s}://{h}{p}", st.sampled_from(["http", "https"]), st.sampled_from(HOSTS), st.sampled_from(PATHS))
table = st.lists(st.tuples(url, st.one_of(st.none(), st.integers(0, 600))), min_size=0, max_size=25)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def frame(spark, rows, parts=3):
    df = spark.createDataFrame([(i, u, s) for i, (u, s) in enumerate(rows)], "row_id long, url string, http_status int")
    return df.repartition(parts)


def rows_of(df, cols=("row_id", "url", "http_status")):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@SETTINGS
@given(table)
def test_trims(spark, rows):
    """trim_to_root is idempotent; trim_to_last_folder removes one folder per
    call, so it only shortens URLs and reaches the roots after a few calls."""
    df = frame(spark, rows)
    once = P.trim_to_root(df)
    assert rows_of(P.trim_to_root(once), ("url",)) == rows_of(once, ("url",))
    schema = "row_id long, url string, http_status int"
    cur = [(r.row_id, r.url, r.http_status) for r in df.collect()]
    for _ in range(7):  # deepest generated path has five segments
        nxt = [(r.row_id, r.url, r.http_status) for r in P.trim_to_last_folder(spark.createDataFrame(cur, schema)).collect()]
        before = {u for _, u, _ in cur}
        assert all(any(b.startswith(u) for b in before) for _, u, _ in nxt)
        cur = nxt
    again = P.trim_to_last_folder(spark.createDataFrame(cur, schema)).collect()
    assert sorted(r.url for r in again) == sorted(u for _, u, _ in cur)


@SETTINGS
@given(table)
def test_dedup_idempotent_and_partition_independent(spark, rows):
    df = frame(spark, rows)
    once = D.dedup_urls(df)
    assert rows_of(D.dedup_urls(once)) == rows_of(once)
    assert rows_of(D.dedup_urls(frame(spark, rows, 1))) == rows_of(once)
    assert rows_of(D.dedup_domains(frame(spark, rows, 5), "http_status")) == rows_of(D.dedup_domains(frame(spark, rows, 1), "http_status"))


@SETTINGS
@given(table, st.sampled_from(["a.com", "/p/", "https", "blog"]))
def test_contain_filters_complement(spark, rows, s):
    df = frame(spark, rows)
    both = rows_of(FL.drop_containing(df, "url", s)) + rows_of(FL.drop_not_containing(df, "url", s))
    assert sorted(both) == rows_of(df)


@SETTINGS
@given(table, st.integers(0, 600))
def test_value_filters_complement(spark, rows, v):
    df = frame(spark, rows)
    both = rows_of(FL.drop_equal(df, "http_status", v)) + rows_of(FL.drop_not_equal(df, "http_status", v))
    assert sorted(both) == rows_of(df)


@SETTINGS
@given(table)
def test_domain_ops_partition_independent(spark, rows):
    from sitesieve.operators import filters as FLT
    from sitesieve.plans.fixtures import FX_SUFFIXES

    sfx = spark.createDataFrame([(s,) for s in FX_SUFFIXES], "suffix string")
    one, many = frame(spark, rows, 1), frame(spark, rows, 5)
    dom = lambda d: sorted((r.row_id, r.domain) for r in P.registered_domain(d, sfx).collect())
    assert dom(one) == dom(many)
    for op in (P.trim_to_root, P.trim_to_last_folder):
        assert rows_of(op(one), ("url",)) == rows_of(op(many), ("url",))
    assert rows_of(FLT.remove_subdomains(one, sfx)) == rows_of(FLT.remove_subdomains(many, sfx))
