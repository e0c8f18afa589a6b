"""Alignment of two tokenizers' tokens, as an Arrow pipeline inside Spark tasks.

A batch of texts becomes two list arrays of token ids.  Flattened, with parent
indices and segmented cumulative sums of the tokens' byte lengths, they are two tables of
(document, end); an Acero hash join on those keys finds the places where both
tokenizers end a token.  These cut the tokens into groups, and the tokens that meet there
are links.  ``Table.group_by`` counts the linked id pairs of each batch, and Spark merges the
counts.

The corpus-wide counts come back to the documents in two ways: pairs of more than one in
``SHARE`` of all links are fewer than ``SHARE``, so they are sent to all tasks; the
others, none of which is hot, by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_process, saved
from .packing import ByteBPE
from .shingles import chunks

SHARE = 1 << 18  #: at most this many pairs and their counts are sent to the tasks
TEXT = 1 << 17  #: bytes of text aligned at a time
LINKS = 1 << 17  #: links counted or looked up at a time


class Tokenizers:
    """Both tokenizers, with the bytes of every id: A byte-level BPE of space + text, B sentencepiece of text."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = ByteBPE(a_path)
        self.a.own.encode_special_tokens = True  # their strings are plain text
        self.a.special = []
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        ids = range(self.b.vocab_size())
        b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in ids]
        ranks = {i: t for t, i in self.a.fast._mergeable_ranks.items()}
        a_bytes = [ranks.get(i, b"") for i in range(max(ranks) + 1)]
        self.a_bytes, self.b_bytes = pa.array(a_bytes, pa.large_binary()), pa.array(b_bytes, pa.large_binary())
        # an id as text with what may follow it: in its side, at its side's end, at the document's end
        self.n_a, self.n_b = len(a_bytes), len(b_bytes)
        self.written = pa.array([f"{i}{c}" for c in ",|" for i in range(self.n_a)] + [f"{i}{c}" for c in (",", ";", "") for i in range(self.n_b)], pa.large_string())

    def lists(self, texts: list[str], plain: list[bool]) -> tuple[pa.LargeListArray, pa.LargeListArray]:
        return (_list_array([self.a.ids(" " + t, p) if t else () for t, p in zip(texts, plain)]),
                _list_array(self.b.encode(texts, num_threads=1) if texts else []))


def _list_array(ids: list) -> pa.LargeListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
    flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in ids]) if ids else np.empty(0, np.int64)
    return pa.LargeListArray.from_arrays(offsets, flat)


def _sound(lists: pa.LargeListArray, surface: pa.Array, texts: list[bytes]) -> np.ndarray:
    """Which lists' bytes joined are the texts."""
    taken = surface.take(lists.flatten())
    bounds = np.frombuffer(taken.buffers()[1], dtype=np.int64)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
    joined = taken.buffers()[2].to_pybytes() if len(taken) and taken.buffers()[2] else b""
    at = bounds[lists.offsets.to_numpy()].tolist()
    return np.array([joined[x:y] == t for x, y, t in zip(at[:-1], at[1:], texts)], dtype=bool)


def _ends(lists: pa.LargeListArray, surface: pa.Array) -> pa.Table:
    """doc, end, place: the document of each token, its end there in bytes, its place among all tokens."""
    doc = pc.list_parent_indices(lists).cast(pa.int64())
    total = pc.cumulative_sum(pc.binary_length(surface.take(lists.flatten())))
    before = np.concatenate([[0], total.to_numpy()])[lists.offsets.to_numpy()[:-1]]
    end = pc.subtract(total, pa.array(before).take(doc))
    return pa.table({"doc": doc, "end": end, "place": pa.array(np.arange(len(doc)))})


class Alignment:
    """Groups and links of one chunk of texts."""

    def __init__(self, tok: Tokenizers, texts: list[str], plain: list[bool]):
        a, b = tok.lists(texts, plain)
        expected = [(" " + t).encode() if t else b"" for t in texts]
        sound = _sound(a, tok.a_bytes, expected) & _sound(b, tok.b_bytes, expected)
        if not sound.all():
            a, b = ([x if ok else [] for x, ok in zip(y.to_pylist(), sound)] for y in (a, b))
            a, b = _list_array(a), _list_array(b)
        self.n_a, self.n_b = np.diff(a.offsets.to_numpy()), np.diff(b.offsets.to_numpy())
        left, right = _ends(a, tok.a_bytes), _ends(b, tok.b_bytes)
        met = left.join(right, ["doc", "end"], join_type="inner", right_suffix="_b", use_threads=False)
        at_a, at_b, doc = (met[c].to_numpy() for c in ("place", "place_b", "doc"))
        order = np.argsort(at_a, kind="stable")
        at_a, at_b, doc = at_a[order], at_b[order], doc[order]
        ids_a, ids_b = a.flatten().to_numpy(), b.flatten().to_numpy()
        self.n_links = np.bincount(doc, minlength=len(texts))
        self.link_a, self.link_b = ids_a[at_a].astype(np.int32), ids_b[at_b].astype(np.int32)
        # a group ends where both sides do; its A tokens come before its B tokens
        last_a, last_b = np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)
        last_a[at_a], last_b[at_b] = 1, 1
        self.n_groups = np.add.reduceat(np.append(last_a, 0), a.offsets.to_numpy()[:-1]) * (self.n_a > 0) if len(texts) else self.n_a
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        place_a = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)
        place_b = np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")
        written = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        written[place_a] = ids_a + tok.n_a * last_a
        final = np.zeros(len(ids_b), dtype=np.int64)
        final[b.offsets.to_numpy()[1:][self.n_b > 0] - 1] = 1
        written[place_b] = 2 * tok.n_a + ids_b + tok.n_b * (last_b + final)
        joined = tok.written.take(pa.array(written))
        bounds = np.frombuffer(joined.buffers()[1], dtype=np.int64)[joined.offset : joined.offset + len(joined) + 1] if len(joined) else np.zeros(1, np.int64)
        text = joined.buffers()[2].to_pybytes() if len(joined) else b""
        at = bounds[a.offsets.to_numpy() + b.offsets.to_numpy()].tolist()
        self.groups = [text[x:y] for x, y in zip(at[:-1], at[1:])]


def _align(a_path: str, b_path: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = per_process(("alignment", a_path, b_path), lambda: Tokenizers(a_path, b_path))
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for first, data, offsets in chunks(column, TEXT):
                n = len(offsets) - 1
                high = np.concatenate([[0], np.cumsum(data >= 0xC9)])
                plain = (high[offsets[1:]] == high[offsets[:-1]]).tolist()
                found = Alignment(tok, column.slice(first, n).fill_null("").to_pylist(), plain)
                bounds = np.concatenate([[0], np.cumsum(found.n_links)]).astype(np.int32)
                groups = [sha256(g).hexdigest() if g else "" for g in found.groups] if digest else [g.decode() for g in found.groups]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), ids.slice(first, n), *[pa.array(x.astype(np.int64)) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)],
                     pa.array(groups, pa.string()), *[pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (found.link_a, found.link_b)]],
                    names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "link_a", "link_b"])
                row += n
    return run


def aligned(docs: DataFrame, a_path: str, b_path: str, digest: bool = False) -> DataFrame:
    """Groups and links of every row of ``docs`` (doc_id, text).

    Columns: row (unique), doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2``, ids of A and B by
    group; with ``digest`` its SHA-256 in hexadecimal, or an empty string without tokens), link_a and link_b (the linked
    ids, in order).  A text that is null, empty or not restored by both tokenizers has no tokens.
    """
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, link_a array<int>, link_b array<int>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_align(a_path, b_path, digest), schema)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about ``LINKS`` links at a time, at least one."""
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column("link_a")).to_numpy(zero_copy_only=False))
        i = 0
        while i < batch.num_rows:
            before = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, before + LINKS, "right")))
            yield batch.slice(i, j - i)
            i = j


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        links = pa.table({"a": batch.column("link_a").flatten(), "b": batch.column("link_b").flatten()})
        found = links.group_by(["a", "b"], use_threads=False).aggregate([([], "count_all")])
        yield from found.select(["a", "b", "count_all"]).rename_columns(["a", "b", "n"]).combine_chunks().to_batches()


def pair_counts(rows: DataFrame) -> DataFrame:
    """a, b, n (links of that id pair), best (n is the largest of its b) from ``aligned``."""
    counts = saved(rows.select("link_a", "link_b").mapInArrow(_partial_counts, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    top = counts.groupBy("b").agg(F.max("n").alias("top"))  # at most one row per id of B
    return counts.join(top, "b").select("a", "b", "n", (F.col("n") == F.col("top")).cast("long").alias("best"))


def _score(frequent: pa.Table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = lambda a, b: (a.astype(np.int64) << 32) + b
        known = code(frequent["a"].to_numpy(), frequent["b"].to_numpy())
        order = np.argsort(known)
        known, n, best = known[order], frequent["n"].to_numpy()[order], frequent["best"].to_numpy()[order]
        for batch in _slices(batches):
            doc = pc.list_parent_indices(batch.column("link_a")).to_numpy()
            a, b = (batch.column(c).flatten().to_numpy() for c in ("link_a", "link_b"))
            links = code(a, b)
            at = np.minimum(np.searchsorted(known, links), max(len(known) - 1, 0))
            hit = known[at] == links if len(known) else np.zeros(len(links), dtype=bool)
            sums = pa.table({"doc": doc[hit], "n": n[at[hit]], "best": best[at[hit]]}).group_by("doc", use_threads=False).aggregate([("n", "sum"), ("best", "sum")])
            totals = np.zeros((2, batch.num_rows), dtype=np.int64)
            totals[0, sums["doc"].to_numpy()], totals[1, sums["doc"].to_numpy()] = sums["n_sum"].to_numpy(), sums["best_sum"].to_numpy()
            bounds = np.concatenate([[0], np.cumsum(np.bincount(doc[~hit], minlength=batch.num_rows))]).astype(np.int32)
            rare = pa.ListArray.from_arrays(bounds, pa.array(links[~hit]))
            names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(totals[0]), pa.array(totals[1]), rare], names=[*names, "count_sum", "n_best", "rare"])
    return run


def alignment_scores(docs: DataFrame, a_path: str, b_path: str, digest: bool = False, share: int = SHARE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    count_sum is the sum over the row's links of the links that their id pair has in all rows;
    n_best counts the links whose pair is the most frequent of its B id, ties included.  Repeated rows count each;
    very long texts are aligned whole; other columns are ignored; an empty table gives an empty result.
    """
    rows = saved(aligned(docs, a_path, b_path, digest), "aligned")
    pairs = saved(pair_counts(rows), "pair-counts")
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = pairs.where(F.col("n") * share > total).toArrow()  # fewer than share rows
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, count_sum long, n_best long, rare array<long>"
    rows = saved(rows.mapInArrow(_score(frequent), schema), "scored")
    rare = rows.select("row", F.explode("rare").alias("pair")).select("row", F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"))
    rest = rare.join(pairs.where(F.col("n") * share <= total), ["a", "b"]).groupBy("row").agg(F.sum("n").alias("more"), F.sum("best").alias("more_best"))
    more = lambda c, m: (F.col(c) + F.coalesce(F.col(m), F.lit(0))).alias(c)
    return rows.join(rest, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", more("n_best", "more_best"), more("count_sum", "more"), "groups")
