"""Packing of documents into training sequences: best-fit decreasing.

``tokenised`` turns every document into pieces of token ids: overlong documents
are cut into full windows, their rest is a shorter piece.  ``place`` packs the
pieces: longest first, each into the open sequence with the least room that
still takes it, which a segment tree indexed by remaining room finds.

Best-fit decreasing only depends on how many pieces have each length, so one
global packing is computed from the histogram of lengths (at most ``size``
numbers, however large the corpus) for whole runs of equal pieces at a time;
each piece then looks its place up by its length and its rank among the pieces
of that length.  Ranks come from counters of the tokenising tasks and prefix
sums over tasks, so no length, however frequent, is one task's work.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved
from .shingles import chunks


class ByteBPE:
    """Ids of a byte-level BPE file of the ``tokenizers`` library, special tokens not added.

    The same vocabulary runs in tiktoken, which is several times faster on
    plain text; texts with characters beyond Latin Extended-A, or with the
    string of a special token, go through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        spec = json.loads(self.own.to_str())
        self.special = [t["content"] for t in spec["added_tokens"]]
        # byte-level vocabularies write byte b as a printable character: itself, or the next free one from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str, plain: bool) -> np.ndarray:
        if plain and not any(s in text for s in self.special):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.own.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def _tokenise(path: str, size: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = ByteBPE(path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            texts, keys = batch.column(1).fill_null(""), batch.column(0)
            for first, data, offsets in chunks(texts):
                n = len(offsets) - 1
                high = np.concatenate([[0], np.cumsum(data >= 0xC9)])  # leads of characters from U+0240 on
                plain = (high[offsets[1:]] == high[offsets[:-1]]).tolist()
                row, start, length, total, rank, ids = [], [], [], [], [], []
                for i in range(n):
                    tokens = np.append(tokenizer.ids(texts[first + i].as_py(), plain[i]), end).astype("<u4")
                    for s in range(0, len(tokens), size):
                        piece = tokens[s : s + size]
                        row.append(first + i), start.append(s), length.append(len(piece)), total.append(len(tokens))
                        rank.append(int(seen[len(piece)])), ids.append(piece.tobytes())
                        seen[len(piece)] += 1
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()),
                     pa.array(ids, pa.binary()), pa.array([part] * len(row), pa.int64()), pa.array(rank, pa.int64())],
                    names=["doc_id", "start", "length", "doc_tokens", "ids", "part", "rank"])
    return run


def tokenised(docs: DataFrame, path: str, size: int = 1024, end: int = 0) -> DataFrame:
    """Pieces of at most ``size`` ids: doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit), part, rank.

    A document's ids are those of its whole text, then ``end``; a null text is
    empty, so its one piece is ``end`` alone.  part and rank say which task made
    the piece, and how many pieces of its length that task made before it.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _tokenise(path, size, end), "doc_id long, start long, length long, doc_tokens long, ids binary, part long, rank long")


class Rooms:
    """Segment tree over 0..size: which amounts of remaining room some open sequence has."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()  # a power of two above size
        self.any = [False] * (2 * self.leaves)

    def set(self, room: int, is_open: bool) -> None:
        i = room + self.leaves
        self.any[i] = is_open
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest open amount of room >= least."""
        i = least + self.leaves
        if self.any[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit(histogram: dict[int, int], size: int) -> np.ndarray:
    """Best-fit decreasing of ``histogram`` (length: pieces): rows (length, first rank, pieces, first sequence, offset).

    A row says that the pieces of a length with ranks from first rank on lie in
    consecutive sequences at one offset.  Equal pieces that meet equally full
    sequences are placed together; every step uses up a length or an amount of
    room, so there are at most about 2 * size**2 rows whatever the corpus.
    """
    rooms, open_runs, rows, sequences = Rooms(size), [[] for _ in range(size + 1)], [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = rooms.tightest(length)
            if room is None:
                # k to a new sequence, as long as there is room: the tightest open one is the one just begun
                k = size // length
                full, rest = divmod(left, k)
                if full:
                    for d in range(k):
                        rows.append((length, rank + d * full, full, sequences, d * length))
                    rank, left = rank + k * full, left - k * full
                    _open(open_runs, rooms, size - k * length, sequences, full)
                    sequences += full
                elif rest:
                    for d in range(rest):
                        rows.append((length, rank + d, 1, sequences, d * length))
                    rank, left = rank + rest, 0
                    _open(open_runs, rooms, size - rest * length, sequences, 1)
                    sequences += 1
                continue
            first, count = open_runs[room].pop()
            # an open sequence takes as many of these pieces as fit: after one, it is the tightest again
            k = room // length
            full = min(count, left // k)
            if full:
                for d in range(k):
                    rows.append((length, rank + d * full, full, first, size - room + d * length))
                rank, left = rank + k * full, left - k * full
                _open(open_runs, rooms, room - k * length, first, full)
                used = full
            else:
                for d in range(left):
                    rows.append((length, rank + d, 1, first, size - room + d * length))
                _open(open_runs, rooms, room - left * length, first, 1)
                rank, left, used = rank + left, 0, 1
            if count > used:
                open_runs[room].append((first + used, count - used))
            if not open_runs[room]:
                rooms.set(room, False)
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def _open(runs: list, rooms: Rooms, room: int, first: int, count: int) -> None:
    if room:
        runs[room].append((first, count))
        rooms.set(room, True)


def place(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """``pieces`` (length, part, rank and any others) with sequence_id and offset; part and rank are dropped.

    Every piece lies in exactly one sequence, without gaps from offset 0 on, and
    no sequence is longer than ``size``.  An empty table gives an empty result.
    """
    pieces = saved(pieces, "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = saved(counts.select("part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    rows = best_fit(histogram, size)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    bounds = {int(k): (int(a), int(b)) for k, a, b in zip(*_spans(rows[:, 0]))}

    @F.pandas_udf("sequence_id long, offset long")
    def look_up(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(length), 2), dtype=np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for k in np.unique(lengths):
            a, b = bounds[int(k)]
            at = np.flatnonzero(lengths == k)
            i = a + np.searchsorted(rows[a:b, 1], ranks[at], "right") - 1
            out[at, 0] = rows[i, 3] + ranks[at] - rows[i, 1]
            out[at, 1] = rows[i, 4]
        return pd.DataFrame({"sequence_id": out[:, 0], "offset": out[:, 1]})

    others = [c for c in pieces.columns if c not in ("part", "rank")]
    placed = pieces.join(counts.drop("n"), ["part", "length"]).withColumn("_at", look_up("length", F.col("base") + F.col("rank")))
    return placed.select(*others, "_at.sequence_id", "_at.offset")


def _spans(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k, first = np.unique(keys, return_index=True)
    return k, first, np.append(first[1:], len(keys))


def pack(docs: DataFrame, path: str, size: int = 1024, end: int = 0) -> DataFrame:
    """Every document's pieces with their ids and places: doc_id, start, length, doc_tokens, ids, sequence_id, offset.

    Null and empty texts are one piece of one id; repeated rows and null
    doc_ids are documents of their own; other columns of ``docs`` are ignored.
    """
    return place(tokenised(docs, path, size, end), size)
