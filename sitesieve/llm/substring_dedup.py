"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

What has to go are all words of windows of ``size`` words whose word sequence also
starts elsewhere.  Texts are cut into phrases by their own contents: every window
has an anchor, its run of ``GRAM`` words of smallest hash, and a phrase is a run
of windows with one anchor.  Equal windows have equal anchors, so the phrases are
dealt into reference blocks by anchor, and a text meets only blocks that may
hold a part of it.  A block indexes the windows of all its phrases; each phrase is
parsed greedily against the rest of its block: from the first window that the rest
holds, a factor extends word by word for as long as the rest holds the next window, and
the parse starts anew at its boundary.  Factors are spans of duplicate words.

Anchors shared by very many phrases (``limits``) would be hot keys.  They are found by
counts of ``BUCKETS`` hash buckets; each chunk of texts is parsed against itself for them, and the
windows that it holds once are counted one by one, with map-side combine, instead of meeting in one block.

A window's name is the 64-bit hash of its anchor with 48 bits of its own (64 bits
for hot anchors), a text's its 64-bit hash with its doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .hot_keys import attach
from .shingles import Shingler, chunks, mix

GRAM = 16  #: words of an anchor
BUCKETS = 1 << 20  #: at most this many hot buckets reach the tasks
WIDTH = 6  #: bytes of a window in a block
_U = np.uint64


def limits(phrases: int) -> int:
    """Phrases of a bucket from which on it is hot: a thousandth of all, at most a million, at least 256."""
    return max(256, min(phrases // 1000, 1_000_000))


class Words(Shingler):
    """Places and hashes of the words of texts as they are, letters' case kept."""

    def __init__(self):
        super().__init__(1)
        self.byte = mix(np.arange(256, dtype=_U) + _U(0x1CE4E5B9))

    def places(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first byte of each word, byte after it, first word of each text and the end)."""
        inside = ~self.space[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
        ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
        return starts, ends, np.searchsorted(starts, offsets)


class Phrases:
    """The phrases of a chunk of texts, one after the other.

    text: which text it is of; start: its first word there; windows: its number of windows;
    anchor: hash; hashes: of all windows of all phrases.
    """

    def __init__(self, words: Words, data: np.ndarray, offsets: np.ndarray, size: int):
        h, first = words.words(data, offsets)
        n, gram = len(h), min(GRAM, size)
        if n < size:
            self.text = self.start = self.windows = np.empty(0, np.int64)
            self.anchor = self.hashes = np.empty(0, _U)
            return
        words._powers(n)
        total = np.concatenate([[_U(0)], np.cumsum(h * words.power[:n])])
        hashes = lambda k: mix((total[k:] - total[:-k]) * words.inverse[: n - k + 1] + _U(k))
        grams, windows = hashes(gram), hashes(size)
        least, at = grams[: len(windows)].copy(), np.zeros(len(windows), dtype=np.int64)
        for i in range(1, size - gram + 1):  # the leftmost of the smallest
            here = grams[i : i + len(windows)]
            less = here < least
            least[less] = here[less]
            at[less] = i
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(windows)]
        whole = np.flatnonzero(np.arange(len(windows)) + size <= first[text + 1])
        anchor = whole + at[whole]
        begin = np.flatnonzero(np.diff(anchor, prepend=-1))
        self.windows = np.diff(np.append(begin, len(whole)))
        self.text = text[whole[begin]]
        self.start = whole[begin] - first[self.text]
        self.anchor = grams[anchor[begin]]
        self.hashes = windows[whole]


def _bucket(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(anchor) % _U(buckets)).astype(np.int64)


def _count(size: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = Words(), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, data, offsets in chunks(batch.column(0)):
                found, times = np.unique(_bucket(Phrases(words, data, offsets, size).anchor, buckets), return_counts=True)
                n[found] += times
        filled = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(n[filled])], names=["bucket", "n"])
    return run


def _cold(size: int, buckets: int, hot: np.ndarray):
    """The phrases of buckets that are not hot, with their windows packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        cold = np.ones(buckets, dtype=bool)
        cold[hot] = False
        for batch in batches:
            for row, data, offsets in chunks(batch.column("text")):
                p = Phrases(words, data, offsets, size)
                pick = cold[_bucket(p.anchor, buckets)]
                hashes, n, text = p.hashes[np.repeat(pick, p.windows)], p.windows[pick], pa.array(row + p.text[pick])
                packed = np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH])
                ends = np.concatenate([[0], np.cumsum(n) * WIDTH]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(text), batch.column("key").take(text), pa.array(p.start[pick].astype(np.int32)), pa.array(p.anchor[pick].view(np.int64)),
                     pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(packed)])],
                    names=["id", "key", "start", "anchor", "windows"])
    return run


def _hot(size: int, buckets: int, hot: np.ndarray):
    """The windows of hot buckets, after a parse of each chunk of texts against itself.

    Three kinds of rows: factors whose windows the chunk holds again, final (begin, end); one row for each such window
    (hash, n of 2); and the windows that the chunk holds once (begin, end, hash, n of 1).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        is_hot = np.zeros(buckets, dtype=bool)
        is_hot[hot] = True
        for batch in batches:
            for row, data, offsets in chunks(batch.column("text")):
                p = Phrases(words, data, offsets, size)
                pick = is_hot[_bucket(p.anchor, buckets)]
                hashes, n = p.hashes[np.repeat(pick, p.windows)], p.windows[pick]
                _, group = np.unique(p.anchor[pick], return_inverse=True)
                again, one = twins(np.repeat(group, n), hashes)
                phrase, a, b = factors(again, np.cumsum(n))
                single = np.flatnonzero(~again)
                of = np.searchsorted(np.cumsum(n), np.arange(len(hashes)), "right")  # the phrase of each window
                start = p.start[pick][of] + np.arange(len(hashes)) - (np.cumsum(n) - n)[of]
                text, anchor = row + p.text[pick], p.anchor[pick].view(np.int64)
                f, s, o = len(phrase), len(single), len(one)
                owner = pa.array(np.concatenate([text[phrase], text[of[single]], np.zeros(o, np.int64)]), mask=np.arange(f + s + o) >= f + s)
                begin = np.concatenate([p.start[pick][phrase] + a, start[single], np.zeros(o, np.int64)])
                end = np.concatenate([p.start[pick][phrase] + b + size, start[single] + size, np.zeros(o, np.int64)])
                final = np.arange(f + s + o) < f
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(owner), batch.column("key").take(owner), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)),
                     pa.array(np.concatenate([np.zeros(f, np.int64), anchor[of[single]], anchor[of[one]]]), mask=final),
                     pa.array(np.concatenate([np.zeros(f, np.int64), hashes[single].view(np.int64), hashes[one].view(np.int64)]), mask=final),
                     pa.array(np.repeat(np.array([0, 1, 2], dtype=np.int32), [f, s, o]))],
                    names=["id", "key", "begin", "end", "anchor", "window", "n"])
    return run


def twins(group: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which (group, hash) occur more than once, one place of each that does)."""
    order = np.lexsort((hashes, group))
    same = (hashes[order][1:] == hashes[order][:-1]) & (group[order][1:] == group[order][:-1])
    again = np.zeros(len(hashes), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return again, order[:-1][same & ~np.concatenate([[False], same[:-1]])] if len(same) else order[:0]


def factors(again: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors of phrases, given which of their windows the rest of the block holds and where each phrase ends.

    (phrase, first window in it, last window in it): a factor is a longest run of such windows.
    """
    phrase = np.searchsorted(ends, np.arange(len(again)), "right")
    fresh = np.diff(phrase, prepend=-1) != 0
    begin = np.flatnonzero(again & (fresh | ~np.concatenate([[False], again[:-1]])))
    stop = np.flatnonzero(again & np.concatenate([fresh[1:] | ~again[1:], [True]]))
    base = np.concatenate([[0], ends])[phrase[begin]]
    return phrase[begin], begin - base, stop - base


def _parse(size: int):
    def block(rows: pa.Table) -> pa.RecordBatch:
        anchor = rows["anchor"].to_numpy()
        same = anchor[1:] == anchor[:-1]
        rows = rows.take(np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))) if len(anchor) > 1 else rows.slice(0, 0)
        # the index: every window of the block, sorted by anchor and hash
        packed = b"".join(rows["windows"].to_pylist())
        wide = np.zeros((len(packed) // WIDTH, 8), dtype=np.uint8)
        wide[:, :WIDTH] = np.frombuffer(packed, dtype=np.uint8).reshape(-1, WIDTH)
        hashes = wide.view("<u8").ravel()
        n = np.array([len(w) // WIDTH for w in rows["windows"].to_pylist()], dtype=np.int64)
        _, group = np.unique(rows["anchor"].to_numpy(), return_inverse=True)
        again, _ = twins(np.repeat(group, n), hashes)
        phrase, a, b = factors(again, np.cumsum(n))
        at, start = pa.array(phrase), rows["start"].to_numpy()[phrase]
        return pa.RecordBatch.from_arrays(
            [rows["id"].combine_chunks().take(at), rows["key"].combine_chunks().take(at), pa.array((start + a).astype(np.int32)), pa.array((start + b + size).astype(np.int32))],
            names=["id", "key", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # sorted by anchor; the last one may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            anchor = held["anchor"].to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))
            if cut:
                yield block(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield block(held)
    return run


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` with id and key, which name a row's text: rows alike in both have equal results."""
    return docs.withColumns({"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "key": F.xxhash64("text")})


def duplicate_spans(docs: DataFrame, size: int = 35, buckets: int = BUCKETS, limit: int | None = None) -> DataFrame:
    """(id, key, begin, end): spans of words, end not included, all of whose ``size``-word windows also start elsewhere.

    Together they hold every such window; they may touch, overlap and repeat.  id and key are those of ``_named``.
    """
    texts = _named(docs.where("text is not null")).select("id", "key", "text")
    counts = texts.select("text").mapInArrow(_count(size, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = saved(counts, "buckets")
    if limit is None:
        limit = limits(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    hot = counts.where(F.col("n") > limit).select("bucket").toPandas()["bucket"].to_numpy(dtype=np.int64)
    cold = texts.mapInArrow(_cold(size, buckets, hot), "id long, key long, start int, anchor long, windows binary")
    spans = cold.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_parse(size), "id long, key long, begin int, end int")
    if not len(hot):
        return spans
    windows = saved(texts.mapInArrow(_hot(size, buckets, hot), "id long, key long, begin int, end int, anchor long, window long, n int"), "windows")
    again = windows.where("n > 0").groupBy("anchor", "window").agg(F.sum("n").alias("n")).where("n > 1").select("anchor", "window", F.lit(True).alias("again"))
    found = attach(windows.where("n = 1").drop("n"), saved(again, "again"), ["anchor", "window"]).where("again")
    return spans.unionAll(windows.where("n = 0").select(spans.columns)).unionAll(found.select(spans.columns))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in batches:
        spans = batch.column("spans")
        columns: tuple[list, list, list] = [], [], []
        for row, data, offsets in chunks(batch.column("text")):
            starts, ends, first = words.places(data, offsets)
            here = spans.slice(row, len(offsets) - 1)
            owner = here.value_parent_indices().to_numpy()
            covered = np.zeros(len(starts) + 1, dtype=np.int64)
            flat = here.flatten()
            np.add.at(covered, first[owner] + flat.field("begin").to_numpy(), 1)
            np.add.at(covered, first[owner] + flat.field("end").to_numpy(), -1)
            stay = np.cumsum(covered)[:-1] == 0
            # bytes of the words that stay, and the one after each but a text's last
            total = np.concatenate([[0], np.cumsum(stay)])
            left = total[first[1:]] - total[first[:-1]]
            mark = np.zeros(len(data) + 1, dtype=np.int64)
            np.add.at(mark, starts[stay], 1)
            last = np.zeros(int(total[-1]), dtype=bool)
            last[np.cumsum(left)[left > 0] - 1] = True
            np.add.at(mark, ends[stay] + ~last, -1)
            pick = np.cumsum(mark)[:-1] > 0
            out = np.where(words.space[data], np.uint8(32), data)[pick].tobytes()
            edge = np.concatenate([[0], np.cumsum(pick)])[offsets].tolist()
            columns[0].extend(np.diff(first).tolist())
            columns[1].extend((np.diff(first) - left).tolist())
            columns[2].extend(out[a:b] for a, b in zip(edge[:-1], edge[1:]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept"])


def without_duplicates(docs: DataFrame, size: int = 35, buckets: int = BUCKETS, limit: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the remaining words, joined by a space) of every row of ``docs``.

    A null text has no words; texts of fewer than ``size`` words lose nothing.  Rows of equal text are
    copies of each other, whatever their doc_id, which may be null or repeated: all lose all of their windows.  Other
    columns are ignored; an empty table gives an empty result.
    """
    spans = duplicate_spans(docs, size, buckets, limit)
    spans = spans.groupBy("id", "key").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    rows = attach(_named(docs.select("doc_id", "text")), saved(spans, "spans"), ["id", "key"])
    none = F.array().cast("array<struct<begin:int,end:int>>")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("spans", none).alias("spans"))
    return rows.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept string")
