import re
from collections import Counter
from itertools import permutations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sitesieve.llm import filter_audit as A

from .cases import docs, empty, texts

lists = st.lists(st.integers(0, 3000), unique=True).map(lambda x: np.array(sorted(x), dtype=np.int32))


@settings(max_examples=200, deadline=None)
@given(lists, lists, lists)
def test_merges(a, b, c):
    assert A.union([a, b, c]).tolist() == sorted({*a.tolist()} | {*b.tolist()} | {*c.tolist()})
    assert A.difference(a, b).tolist() == sorted({*a.tolist()} - {*b.tolist()})


def test_merges_of_long_lists():
    rng = np.random.default_rng(1)
    for n, m in ((5000, 9), (9, 5000), (4000, 3000), (0, 50)):
        a, b = (np.sort(rng.choice(20_000, k, replace=False)).astype(np.int32) for k in (n, m))
        assert A.difference(a, b).tolist() == np.setdiff1d(a, b).tolist()
        assert A.union([a, b]).tolist() == np.union1d(a, b).tolist()
    x = np.arange(0, 10**6, 3)
    for key in (0, 1, 17, 299_999, 10**6):
        assert A.gallop(x, key, 0) == np.searchsorted(x, key)


def brute(rows, labels):
    """Every order applied to every row, one filter after the other."""
    smallest = {}
    for i, _, t in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    out = Counter()
    for i, lang, text in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and t in smallest and smallest[t] < i}
        for order in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                key = (lang or "", "".join(order), step)
                removed = fails[f] and not gone
                out.update({(key, "redundant"): fails[f] and gone, (key, "unique_fails"): fails[f] and sum(fails.values()) == 1, (key, "removed"): removed,
                            (key, "good_lost"): removed and i in good, (key, "toxic_lost"): removed and i in toxic, (lang or "", f): removed})
                gone |= fails[f]
                out[key, "kept"] += not gone
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    keys = {(lang or "", "".join(o), step) for _, lang, _ in rows for o in permutations("ABCDE") for step in range(1, 6)}
    return {(*k, *(out[k, n] for n in names), out[k[0], k[1][k[2] - 1]]) for k in keys}


LABELS = [(i, i % 2, int(i % 5 == 0)) for i in range(10, 60)] + [(12, 0, 0), (13, None, 1), (None, 1, 1), (10**6, 1, 1)]


def cases():
    rows = [(i, [None, "en", "de"][k % 3], t) for k, (i, t) in enumerate(texts())]
    return rows + [(900, "fr", "Only One"), (7, "fr", "Only One"), (None, "fr", "Only One"), (901, "fr", None), (6, "", ""), (902, "de", "a " * 300 + "#")]


def run(spark, rows, labels=LABELS):
    df = docs(spark, [(i, t) for i, _, t in rows]).limit(0).select("doc_id", "text", "lang", "source", "id", "part")
    df = df.unionByName(spark.createDataFrame([(i, t, lang, "s", "i", 1) for i, lang, t in rows], df.schema)).repartition(3)
    out = A.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return {tuple(r) for r in out.collect()}


def test_equals_brute_force(spark):
    assert run(spark, cases()) == brute(cases(), LABELS)


def test_blocks_cut_a_part(spark):
    """Lists of many small blocks add up to the same counts."""
    names = [*"ABCDE", "good", "toxic"]
    rows = [("p" if i % 4 else "q", i // 2, *[(i * k) % 7 < k for k in range(1, 8)]) for i in range(500)]
    df = spark.createDataFrame(rows, "part string, id long, " + ", ".join(f"{n} boolean" for n in names))
    small, large = (A.posting_lists(df, names, block).persist() for block in (9, 10**6))
    assert max(len(r.ids) for r in small.collect()) == 9 and sum(len(r.ids) for r in small.collect()) == 500
    assert all(r.ids == sorted(r.ids) for r in small.collect())
    same = [{tuple(r) for r in A.interactions(x, list("ABCDE"), ["good", "toxic"]).collect()} for x in (small, large)]
    assert same[0] == same[1] and len(same[0]) == 2 * 600


def test_empty_table(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(empty(spark), labels).collect() == []
    assert len(run(spark, [(1, None, "x")], [(1, 1, 1)])) == 600
