import random

import numpy as np
import pyarrow as pa
import pytest

from sitesieve.llm import near_dup as N
from sitesieve.llm.components import connected_components
from sitesieve.llm.shingles import Shingler

from .cases import docs, empty, texts, words


def shingle_sets(rows, k):
    out = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out.append((i, frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())))
    return out


def classes(rows, k, num):
    """Brute force: (doc_id, set size) to the smallest doc_id reachable."""
    sets = shingle_sets(rows, k)
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= num * len(x | y):
                la, lb = label[a], label[b]
                label = [min(la, lb) if v in (la, lb) else v for v in label]
    least = {}
    for v, (i, _) in zip(label, sets):
        if i is not None:
            least[v] = min(least.get(v, i), i)
    return sorted(((i, len(s), least.get(v)) for v, (i, s) in zip(label, sets)), key=str)


@pytest.mark.parametrize("k,threshold", [(3, 0.85), (5, 0.8)])
def test_classes_equal_brute_force(spark, k, threshold):
    rows = texts()
    got = N.near_duplicates(docs(spark, rows), k, threshold).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == classes(rows, k, round(100 * threshold))
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)


def test_rows_go_by_their_contents(spark):
    """Two texts under one doc_id, and near copies without ids, keep their links."""
    rng = random.Random(8)
    bases = [words(rng, 100) for _ in range(4)]
    near = lambda w, n: " ".join([*w[:50], f"new{n}", *w[51:]])
    rows = [(5, " ".join(bases[0])), (5, " ".join(bases[1])), (7, near(bases[0], 1)), (9, near(bases[1], 2)), (5, " ".join(bases[1])),
            (None, " ".join(bases[2])), (None, near(bases[2], 3)), (None, " ".join(bases[3])), (4, near(bases[3], 4)), (None, ""), (None, None)]
    got = N.near_duplicates(docs(spark, rows), 3, 0.85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == classes(rows, 3, 85)
    assert sorted((r.doc_id, r.kept) for r in got if r.doc_id in (7, 9)) == [(7, False), (9, False)]
    chosen = [(r.doc_id, r.n_shingles, r.component_id) for r in got if r.chosen]
    assert sorted(chosen, key=str) == sorted([(5, 98, 5), (5, 98, 5), (5, 98, 5), (None, 98, None), (4, 98, 4), (None, 0, None), (None, 0, None)], key=str)


def test_pipeline_stage_keeps_one_of_each_group(spark):
    import corpus_pipeline

    rng = random.Random(9)
    base, other = words(rng, 100), words(rng, 100)
    copy = " ".join([*base[:50], "new", *base[51:]])
    rows = [(5, " ".join(base)), (5, " ".join(other)), (7, copy), (None, copy), (None, " ".join(other)), (5, " ".join(other)), (None, "z " * 99), (None, "z " * 99)]
    kept = corpus_pipeline.minhash_dedup(spark, docs(spark, rows), "").select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(5, " ".join(base)), (5, " ".join(other)), (None, "z " * 99)], key=str)


def test_deep_nodes_are_compared_whole(spark, monkeypatch):
    """Nodes that are still large at the last level: every two of their parts are compared."""
    for name, value in (("TASK_NODE", 40), ("SMALL", 8), ("MAX_DEPTH", 2), ("BLOCK_DOCS", 16)):
        monkeypatch.setattr(N, name, value)
    rng = random.Random(6)
    head = words(rng, 200)
    rows = [(1, " ".join(head))]
    for pair in range(90):  # pairs that resemble each other more than the head
        w = list(head)
        for i in rng.sample(range(200), 18):
            w[i] = f"p{pair}x{i}"
        rows += [(10 + 2 * pair, " ".join(w)), (11 + 2 * pair, " ".join([*w[:100], "last", *w[101:]]))]
    got = N.near_duplicates(docs(spark, rows), 3, 0.85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == classes(rows, 3, 85)


def test_empty_table(spark):
    assert N.near_duplicates(empty(spark)).collect() == []


def test_large_group_is_found_whole(spark, monkeypatch):
    """Nodes branch as shuffles and families split into blocks: the same classes."""
    for name, value in (("TASK_NODE", 40), ("SMALL", 8), ("BLOCK_DOCS", 16)):
        monkeypatch.setattr(N, name, value)
    rng = random.Random(5)
    base = words(rng, 120)
    rows = [(i, " ".join(words(rng, 60))) for i in range(60)]
    for i in range(100, 220):
        w = list(base)
        w[rng.randrange(120)] = f"n{i}"
        rows.append((i, " ".join(w)))
    got = N.near_duplicates(docs(spark, rows), 3, 0.85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == classes(rows, 3, 85)


def test_exact_links_match_set_arithmetic():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    sets = []
    for _ in range(60):
        own = np.concatenate([rng.choice(base, rng.integers(150, 200), replace=False), rng.integers(0, 2**63, 12, dtype=np.uint64)])
        sets.append(np.unique(own))
    for split in (0, 25):
        a, b = N.exact_links(sets, split, 70, 100)
        label = list(range(60))
        for i in range(60):
            for j in range(i + 1, 60):
                n = len(np.intersect1d(sets[i], sets[j]))
                if 100 * n >= 70 * (len(sets[i]) + len(sets[j]) - n) and (not split or i < split <= j):
                    x, y = label[i], label[j]
                    label = [min(x, y) if v in (x, y) else v for v in label]
        got = list(range(60))
        for u, v in zip(a.tolist(), b.tolist()):
            x, y = got[u], got[v]
            got = [min(x, y) if w in (x, y) else w for w in got]
        assert got == label


def test_shingles_ignore_spacing_and_case_and_chunking():
    s = Shingler(3)
    t = ["A b  C\td", "a B c d", "é É x y", "", None, "solo", "x" * 3_000_000 + " y z"]
    sets = list(s.sets(pa.array(t)))
    assert (sets[0] == sets[1]).all() and [len(x) for x in sets] == [2, 2, 1, 0, 0, 1, 1]
    assert (list(Shingler(3).sets(pa.array(t[:1])))[0] == sets[0]).all()
    assert (list(s.sets(pa.array(["pad"] + t).slice(1)))[0] == sets[0]).all()


def test_components_of_long_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(1, 60)]
    star = [(100, i) for i in range(101, 400)]
    edges = spark.createDataFrame(path + star + [(7, 7), (None, 3), (300, 100)], "a long, b long").repartition(5)
    got = {r.id: r.component_id for r in connected_components(edges).collect()}
    assert got == {**{i: 1 for i in range(2, 61)}, **{i: 100 for i in range(101, 400)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
