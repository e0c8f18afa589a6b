import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from sitesieve.llm import substring_dedup as S

from .cases import docs, empty, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size):
    """(doc_id, words, removed words, kept text), each window compared with all others."""
    all_words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + size]) for w in all_words for i in range(len(w) - size + 1))
    out = []
    for (doc_id, _), w in zip(rows, all_words):
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        out.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def passages(seed, n=60):
    """Texts sharing passages at the edge of a window's length, cut at every place, and periodic ones."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    shared = [[word() for _ in range(length)] for length in (34, 35, 36, 47, 120)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(4)):
            parts += [word() for _ in range(rng.randrange(50))]
            p = rng.choice(shared)
            a = rng.randrange(len(p)) if rng.random() < 0.4 else 0
            parts += p[a : a + rng.randrange(1, 130)] if rng.random() < 0.5 else p[a:]
        out.append(rng.choice([" ", "\n", " \t "]).join(parts))
    out += ["a b " * 30, "b a " * 18, "a " * 35, "a " * 34, "A " * 36, "é 漢 " * 20, "é 漢 " * 20]
    return list(enumerate(out))


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept").collect()), key=str)


@pytest.mark.parametrize("limit", [None, 0, 3])
def test_equals_brute_force(spark, limit):
    """With no bucket hot, all hot, and some."""
    rows = passages(1) + [(None if k % 7 == 0 else i, t) for k, (i, t) in enumerate(texts())]
    assert result(S.without_duplicates(docs(spark, rows), limit=limit)) == brute(rows, 35)


@pytest.mark.parametrize("size", [1, 5, 16, 17])
def test_other_sizes(spark, size):
    rows = passages(2, 20)
    assert result(S.without_duplicates(docs(spark, rows), size=size, limit=20)) == brute(rows, size)


def test_empty_table(spark):
    assert S.without_duplicates(empty(spark)).collect() == []
    assert S.duplicate_spans(docs(spark, [(1, None), (2, "")])).collect() == []


def test_factors_end_where_a_phrase_ends():
    again = np.array([1, 1, 0, 1, 1, 1, 0, 0, 1], dtype=bool)
    phrase, a, b = S.factors(again, np.array([2, 4, 4, 6, 9]))
    assert list(zip(phrase.tolist(), a.tolist(), b.tolist())) == [(0, 0, 1), (1, 1, 1), (3, 0, 1), (4, 2, 2)]


def test_equal_windows_are_in_phrases_of_equal_anchor():
    """Wherever a window stands, its anchor is the same."""
    rng = random.Random(5)
    for _ in range(30):
        w = [f"x{rng.randrange(4)}" for _ in range(80)]
        found = {}
        for pad in range(3):
            t = " ".join(["y"] * pad + w)
            data = np.frombuffer(t.encode(), dtype=np.uint8)
            p = S.Phrases(S.Words(), data, np.array([0, len(data)]), 35)
            assert p.windows.sum() == len(w) + pad - 34
            for h, a in zip(p.hashes.tolist(), np.repeat(p.anchor, p.windows).tolist()):
                assert found.setdefault(h, a) == a


def test_query(spark):
    from sitesieve.llm.queries import QUERIES

    out = QUERIES["op11_substring_dedup"](spark, "/root/testdata/sf0.001").collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    expected = {(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute(rows, 35)}
    assert {tuple(r) for r in out} == expected and len(out) == len(rows)
