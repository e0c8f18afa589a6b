import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sitesieve.llm import packing as P

from .cases import docs, empty, texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(placed, size):
    """Gapless from 0 on, nothing twice, no sequence longer than size."""
    by = {}
    for sequence, offset, length in placed:
        by.setdefault(sequence, []).append((offset, length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def plain_best_fit(lengths, size):
    """Best-fit decreasing, one piece at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is None:
            rooms.append(size - n)
        else:
            rooms[rooms.index(fit)] = fit - n
    return sorted(rooms)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=120), st.sampled_from([32, 33]))
def test_runs_are_best_fit_decreasing(lengths, size):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    rows = P.best_fit(histogram, size)
    placed, ranks = [], {n: set() for n in histogram}
    for length, rank, count, first, offset in rows.tolist():
        for i in range(count):
            assert rank + i not in ranks[length]
            ranks[length].add(rank + i)
            placed.append((first + i, offset, length))
    assert all(ranks[n] == set(range(histogram[n])) for n in histogram)
    check(placed, size)
    used = {}
    for s, _, n in placed:
        used[s] = used.get(s, 0) + n
    assert sorted(size - v for v in used.values()) == plain_best_fit(lengths, size)


@given(st.sets(st.integers(0, 50)), st.integers(0, 50))
def test_tree_finds_the_tightest_room(rooms, least):
    tree = P.Rooms(50)
    for r in rooms:
        tree.set(r, True)
    assert tree.tightest(least) == min((r for r in rooms if r >= least), default=None)


def test_pieces_hold_all_ids(spark):
    rows = texts()
    out = P.pack(docs(spark, rows), PATH, size=64).collect()
    tokenizer = Tokenizer.from_file(PATH)
    expected = sorted(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for _, t in rows)
    assert len(out) == sum(-(-len(e) // 64) for e in expected)
    by = {}
    for r in out:
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert len(ids) == r.length
        by.setdefault((r.doc_id, r.doc_tokens), {}).setdefault(r.start, []).append(ids)
    for (doc_id, n), pieces in by.items():  # repeated rows repeat their pieces
        copies = {len(v) for v in pieces.values()}
        assert sum(len(v[0]) for v in pieces.values()) == n and (len(copies) == 1 or doc_id is None)
    first = {i: t for i, t in rows if i is not None}
    for i, t in first.items():
        e = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        assert [x for _, v in sorted(by[(i, len(e))].items()) for x in v[0]] == e
    check([(r.sequence_id, r.offset, r.length) for r in out], 64)


def test_empty_table(spark):
    assert P.pack(empty(spark), PATH).collect() == []


def test_ids_equal_the_tokenizers_library():
    rng = random.Random(3)
    own, fast = Tokenizer.from_file(PATH), P.ByteBPE(PATH)
    alphabet = "aAbz 09\n\t\r.,'s't\"#éßñ ȿ"
    for _ in range(3000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(30)))
        assert fast.ids(t, True).tolist() == own.encode(t, add_special_tokens=False).ids, t
    t = "x<|endoftext|>y 漢字 ǅ"
    assert fast.ids(t, False).tolist() == own.encode(t, add_special_tokens=False).ids
    assert fast.ids("a<|endoftext|>", True).tolist() == own.encode("a<|endoftext|>", add_special_tokens=False).ids


def test_query_digest(spark):
    from sitesieve.llm.queries import QUERIES

    out = QUERIES["op2_packing"](spark, "/root/testdata/sf0.001").collect()
    tokenizer = Tokenizer.from_file(PATH)
    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in out:
        ids = np.array(tokenizer.encode(text[r.doc_id] or "", add_special_tokens=False).ids + [0], dtype="<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    n = check([(r.sequence_id, r.offset, r.length) for r in out], 1024)
    assert sum(r.length for r in out) > 0.95 * 1024 * (n - 1)
