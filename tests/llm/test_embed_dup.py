import math

import numpy as np
import pytest

from sitesieve.llm import embed_dup as E

SCHEMA = "vec_id long, embedding array<float>, label int, id int, n string, h string, kept string"


def rows_of(vectors):
    return [(i, v, 0, 1, "n", "h", "k") for i, v in vectors]


def brute(vectors, threshold):
    ok = [(i, np.array(v, dtype=float)) for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, label = [0] * len(ok), list(range(len(ok)))
    for a in range(len(ok)):
        for b in range(a):
            x, y = ok[a][1], ok[b][1]
            if len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold - 1e-12:
                links[a] += 1
                links[b] += 1
                p, q = label[a], label[b]
                label = [min(p, q) if v in (p, q) else v for v in label]
    least = {}
    for v, (i, _) in zip(label, ok):
        least[v] = min(least.get(v, i), i)
    out = [(i, n, least[v]) for (i, _), n, v in zip(ok, links, label)]
    good = {id(v) for _, v in vectors if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    return sorted(out + [(i, 0, i) for i, v in vectors if id(v) not in good], key=str)


def cases():
    rng = np.random.default_rng(4)
    out = []
    for g in range(15):
        base = rng.normal(size=24)
        for c in range(1 + g % 6):
            out.append((base + rng.normal(size=24) * 0.05 * c).astype(np.float32).tolist())
    out += [out[0], out[0], [2 * x for x in out[0]], [-x for x in out[1]], [0.0] * 24, [0.0, -0.0] * 12, None, [], [None] * 24, [math.nan] * 24, [math.inf] + [1.0] * 23, [1.0, 0.0], [1.0, 0.01]]
    rows = list(enumerate(map(lambda v: list(v) if v is not None else None, out), 5))
    return rows + [rows[3]]


@pytest.mark.parametrize("tile", [4096, 7])
def test_links_and_components_equal_brute_force(spark, tile):
    vectors = cases()
    got = E.embedding_duplicates(spark.createDataFrame(rows_of(vectors), SCHEMA).repartition(3), 0.95, tile).collect()
    expected = brute(vectors, 0.95)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == expected
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_empty_table_and_null_ids(spark):
    assert E.embedding_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    got = E.embedding_duplicates(spark.createDataFrame(rows_of([(None, [1.0, 2.0]), (None, [1.0, 2.0]), (3, [1.0, 2.1])]), SCHEMA)).collect()
    assert sorted((str(r.vec_id), r.n_links, r.kept) for r in got) == [("3", 0, True), ("None", 1, False), ("None", 1, False)]


def test_bounds_never_lose_a_link():
    rng = np.random.default_rng(8)
    x = E.unit(rng.normal(size=(300, 40)) * rng.choice([1, 1, 30], size=(300, 40)))
    q = E.quantise(x)
    cos = x @ x.T
    for threshold in (0.2, 0.5, 0.9, -0.1):
        a, b = E.possible(q, q, slice(0, 300), threshold)
        found = set(zip(a.tolist(), b.tolist()))
        assert {(i, j) for i, j in zip(*np.nonzero(cos >= threshold))} <= found
