"""Filter interaction audit: what each of several filters removes, whatever their order.

For every part of a table and every filter a sorted posting list is kept of the
rows that fail it.  Lists are cut into blocks of id ranges of bounded length, so
a part of any size is many blocks.  Inside a block the unions of the lists of every
set of filters, and the differences that the next filter would remove from
what they leave, are computed by galloping merges; their sizes are summed over
blocks by Spark.  n filters have n * 2**(n-1) such differences, from which the
counts of all n! orders follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .hot_keys import attach
from .shingles import Shingler, chunks, mix

BLOCK = 1 << 16  #: rows of a part in a block
RUN = 256  #: neighbouring entries of a list that are searched for together


def gallop(ids: np.ndarray, key: int, start: int) -> int:
    """The first place from ``start`` on whose id is not below ``key``: doubling steps, then bisection."""
    step, low, high = 1, start, start
    while high < len(ids) and ids[high] < key:
        low = high + 1
        high += step
        step *= 2
    return low + int(np.searchsorted(ids[low : min(high, len(ids))], key))


def places(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Where each of the sorted ``keys`` stands, or would stand, in the sorted ``ids``."""
    out = np.empty(len(keys), dtype=np.int64)
    at = 0
    for i in range(0, len(keys), RUN):
        run = keys[i : i + RUN]
        end = gallop(ids, run[-1], at)
        out[i : i + RUN] = at + np.searchsorted(ids[at:end], run)
        at = end
    return out


def among(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which entries of list ``a`` are in list ``b``; the shorter one gallops through the longer."""
    found = np.zeros(len(a), dtype=bool)
    if len(a) <= len(b):
        at = places(a, b)
        inside = at < len(b)
        found[inside] = b[at[inside]] == a[inside]
    elif len(b):
        at = places(b, a)
        inside = at < len(a)
        at, b = at[inside], b[inside]
        found[at[a[at] == b]] = True
    return found


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[~among(a, b)]


def union(lists: list[np.ndarray]) -> np.ndarray:
    """k-way merge: every list gallops to the end of each id range, and the ranges are merged one by one."""
    lists = [x for x in lists if len(x)]
    if not lists:
        return np.empty(0, dtype=np.int32)
    lead = max(lists, key=len)
    at = [0] * len(lists)
    out = []
    for key in [*lead[RUN::RUN].tolist(), None]:
        parts = []
        for i, x in enumerate(lists):
            end = len(x) if key is None else gallop(x, key, at[i])
            parts.append(x[at[i] : end])
            at[i] = end
        out.append(np.unique(np.concatenate(parts)))
    return np.concatenate(out)


def _blocks(names: list[str], block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(table: pa.Table) -> pa.RecordBatch:
            cells = [pa.array([table["part"][0].as_py()]), pa.ListArray.from_arrays([0, len(table)], table["id"].combine_chunks())]
            for n in names:
                rows = np.flatnonzero(table[n].combine_chunks().fill_null(False).to_numpy(zero_copy_only=False)).astype(np.int32)
                cells.append(pa.ListArray.from_arrays([0, len(rows)], pa.array(rows)))
            return pa.RecordBatch.from_arrays(cells, names=["part", "ids", *names])

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            parts = held["part"].combine_chunks().dictionary_encode().indices.to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(edges[:-1], edges[1:]):
                while b - a > block or (b < len(parts) and b > a):
                    end = min(a + block, b)
                    yield lists(held.slice(a, end - a))
                    a = end
            held = held.slice(a)
        if held is not None and len(held):
            yield lists(held)
    return run


def posting_lists(rows: DataFrame, names: list[str], block: int = BLOCK) -> DataFrame:
    """Blocks of rows of one part in id order: part, ids, and for each of ``names`` the sorted places in ``ids`` where it holds.

    ``rows`` has part (text, not null), id (long) and boolean columns ``names``.  A
    repeated or null id has a place for each of its rows.  Blocks come from a range partitioning by part and id (ties dealt
    evenly), so neither a hot part nor a hot id is one task.
    """
    rows = rows.select("part", "id", *names).withColumn("tie", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange("part", "id", "tie").sortWithinPartitions("part", "id").drop("tie")
    schema = "part string, ids array<long>, " + ", ".join(f"`{n}` array<int>" for n in names)
    return dealt.mapInArrow(_blocks(names, block), schema)


def _sizes(filters: list[str], marks: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(filters)
        schema = pa.schema([("part", pa.string()), *((c, pa.int64()) for c in ("before", "filter", "rows", "fails", "alone", "gone", "removed", *marks))])
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                of = {c: batch.column(c)[r].values.to_numpy() for c in (*filters, *marks)}
                part, rows = batch.column("part")[r].as_py(), len(batch.column("ids")[r].values)
                unions = [union([of[f] for i, f in enumerate(filters) if s >> i & 1]) for s in range(1 << n)]
                for i, f in enumerate(filters):
                    alone = len(difference(of[f], unions[(1 << n) - 1 - (1 << i)]))
                    for s in range(1 << n):
                        if not s >> i & 1:
                            removed = difference(of[f], unions[s])
                            lost = [int(among(removed, of[m]).sum()) for m in marks]
                            out.append((part, s, i, rows, len(of[f]), alone, len(unions[s]) + len(removed), len(removed), *lost))
            columns = list(zip(*out)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    return run


def interactions(lists: DataFrame, filters: list[str], marks: list[str]) -> DataFrame:
    """One row per part, order of ``filters`` and step, from ``posting_lists``.

    Columns: part, filter_order (the filters' names joined), step (from 1), kept,
    removed, redundant, unique_fails, ``{mark}_lost`` for each of ``marks``, shapley.
    """
    counts = ("rows", "fails", "alone", "gone", "removed", *marks)
    sizes = lists.mapInArrow(_sizes(filters, marks), ", ".join(["part string", "before long", "filter long", *(f"{c} long" for c in counts)]))
    sizes = saved(sizes.groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in counts]), "sizes")
    steps = [("".join(filters[i] for i in order), step + 1, sum(1 << i for i in order[:step]), order[step])
             for order in permutations(range(len(filters))) for step in range(len(filters))]
    orders = lists.sparkSession.createDataFrame(steps, "filter_order string, step int, before long, filter long")
    all_steps = sizes.join(F.broadcast(orders), ["before", "filter"])  # as many orders whatever the input
    shapley = all_steps.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return all_steps.join(shapley, ["part", "filter"]).select(
        "part", "filter_order", "step", (F.col("rows") - F.col("gone")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
        F.col("alone").alias("unique_fails"), *[F.col(m).alias(f"{m}_lost") for m in marks], "shapley")


class _Words(Shingler):
    """Hashes of the words as they are, letters' case kept."""

    def __init__(self):
        super().__init__(1)
        self.byte = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x2545F491))


def _within(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of ``flags`` hold in each text."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(.., text) to (.., n_words, n_distinct, n_chars, n_upper, n_marks)."""
    words = _Words()
    symbols = np.isin(np.arange(256), list(b"#$%&*|"))
    for batch in batches:
        found = [np.empty((0, 5), dtype=np.int64)]
        for _, data, offsets in chunks(batch.column(batch.num_columns - 1)):
            h, first = words.words(data, offsets)
            owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
            order = np.lexsort((h, owner))
            h, owner = h[order], owner[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
            found.append(np.column_stack([
                np.diff(first), np.bincount(owner[new], minlength=len(first) - 1), _within((data & 0xC0) != 0x80, offsets),
                _within((data >= 65) & (data <= 90), offsets), _within(symbols[data], offsets)]))
        found = np.concatenate(found)
        columns = [pa.array(found[:, i], pa.int64()) for i in range(5)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], "n_words", "n_distinct", "n_chars", "n_upper", "n_marks"])


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: part (its lang; null: empty), id, which of the filters A to E it fails, good, toxic.

    A: under 200 words.  B: fewer than half of the words are distinct.  C: over 3 % of the
    code points are A-Z.  D: holds one of # $ % & * |.  E: some row of a smaller doc_id has
    the same text.  Null text counts as empty; a row without doc_id fails E never, nor has it labels.
    good and toxic: some row of ``labels`` for the doc_id has quality, or toxic, 1.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), text.alias("text"))
    rows = saved(rows.mapInArrow(_measure, "id long, part string, digest string, n_words long, n_distinct long, n_chars long, n_upper long, n_marks long"), "measures")
    first = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = attach(rows, saved(first, "first"), "digest")
    rows = saved(rows.select(
        "part", "id", (F.col("n_words") < 200).alias("A"), (100 * F.col("n_distinct") < 50 * F.col("n_words")).alias("B"),
        (100 * F.col("n_upper") > 3 * F.col("n_chars")).alias("C"), (F.col("n_marks") > 0).alias("D"),
        F.coalesce(F.col("first") < F.col("id"), F.lit(False)).alias("E")), "failures")
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = attach(rows, saved(marks.where("id is not null"), "marks"), "id")
    return rows.select("part", "id", *"ABCDE", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``interactions`` of the filters A to E of ``failures`` over whole ``docs``, in all 120 orders.

    Every row counts, repeated rows too; empty texts fail A; very long ones are one row like any
    other; columns other than doc_id, text and lang are ignored.  An empty table gives no rows.
    """
    marks = ["good", "toxic"]
    lists = saved(posting_lists(saved(failures(docs, labels), "rows"), [*"ABCDE", *marks]), "postings")
    return interactions(lists, list("ABCDE"), marks)
