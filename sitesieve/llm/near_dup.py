"""MinHash near-dedup by chosen-path set similarity join.

1. Each text becomes its set of word shingles; of texts with equal sets one
   stands for all, so exact copies never meet each other again.
2. Every set gets ``SIG`` minwise tokens.  A tree branches documents by the
   minwise token at a coordinate that the path so far chooses (one coordinate
   per node, a second one with probability 1/threshold - 1, so that a pair at
   the threshold shares one child per level on average).  Nodes of more than
   ``TASK_NODE`` documents branch as distributed levels; smaller ones finish
   inside one task, and nodes of at most ``SMALL`` are compared exhaustively on
   their sketches.  ``TREES`` independent trees bring the recall to its target.
3. What a node finds is a forest of its most similar pairs (never all pairs),
   which joins documents to families.
4. Inside a family every pair is decided on full sets, in blocks that hold a
   bounded number of documents and shingles; again only a forest of the links
   leaves the task.

Recall: a pair of similarity s shares a node of depth d in one tree with
probability of at least about s**d; unrelated texts part at depth 1 or 2, so
ten trees miss a lone pair at 0.85 with a probability under 1e-5.  A pair in a
larger family is found if any chain of found pairs joins it.  A sketch may
underrate a pair: the cut lies 4 standard deviations below the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, saved
from .components import connected_components, forest
from .hot_keys import attach
from .shingles import Shingler, mix

SIG = 64  #: minwise tokens (coordinates) of a document
TREES = 10
SMALL = 64  #: documents of a node that are compared exhaustively
TASK_NODE = 4096  #: documents of a node that one task finishes
MAX_DEPTH = 12  #: levels after which a node is compared whatever its size, in blocks
BLOCK_DOCS, BLOCK_SHINGLES = 2048, 1_000_000  #: of one side of an exact comparison

_MULTIPLIERS = (mix(np.arange(1, SIG + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def signature(s: np.ndarray) -> np.ndarray:
    """The smallest value of the set under each of ``SIG`` hash functions."""
    h = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(SIG, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(h), 4096):
        out = np.minimum(out, (h[None, i : i + 4096] * _MULTIPLIERS[:, None]).min(axis=1))
    return out


def _shingle_table(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for batch in batches:
            n, key, sig = [], [], []
            for s in shingler.sets(batch.column(batch.num_columns - 1)):
                n.append(len(s))
                # two independent 64-bit sums name the set
                key.append((mix(s).sum().tobytes() + mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum().tobytes()) if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())],
                names=[*batch.schema.names[:-1], "n_shingles", "set_key", "sig"])
    return run


# --- trees --------------------------------------------------------------------

def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def children(node: np.ndarray, sig: np.ndarray, second: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) of documents with the minwise tokens ``sig`` in the nodes ``node``."""
    rows, out = [], []
    path = mix(node.view(np.uint64))
    rank = mix(path + np.uint64(1))
    for turn in range(2):
        if turn:
            pick = np.flatnonzero((mix(path + np.uint64(2)) >> np.uint64(11)).astype(np.float64) < second * 2.0**53)
        else:
            pick = np.arange(len(node))
        c = ((rank[pick] + np.uint64(turn * 7)) % np.uint64(SIG)).astype(np.int64)
        token = sig[pick, c].astype(np.uint64)
        rows.append(pick)
        out.append(_signed(mix(mix(path[pick] + np.uint64(turn)) ^ (token * np.uint64(0x9E3779B97F4A7C15)))))
    return np.concatenate(rows), np.concatenate(out)


def _branch(second: float):
    """Map: (node, id, sig) to one row for each child."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _matrix(batch.column("sig"))
            rows, child = children(batch.column("node").to_numpy(zero_copy_only=False), sig, second)
            yield pa.RecordBatch.from_arrays([pa.array(child), batch.column("id").take(pa.array(rows))], names=["node", "id"])
    return run


def _roots(trees: int, second: float):
    """Map: (id, sig) to the children of every tree's root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _matrix(batch.column("sig"))
            for t in range(trees):
                root = np.full(len(sig), t * (2**40) + 12345, dtype=np.int64)
                rows, child = children(root, sig, second)
                yield pa.RecordBatch.from_arrays([pa.array(child), batch.column("id").take(pa.array(rows))], names=["node", "id"])
    return run


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.empty((0, SIG), np.uint32)
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, SIG)


def spanning(sig: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the most similar pairs (share of equal tokens >= ``least``) of one node's documents."""
    n = len(sig)
    x, y, s = [], [], []
    step = max(1, 2_000_000 // (n * SIG))
    for i in range(0, n, step):
        share = (sig[i : i + step, None, :] == sig[None, :, :]).mean(axis=2, dtype=np.float32)
        a, b = np.nonzero(share >= least)
        keep = a + i < b
        x.append(a[keep] + i), y.append(b[keep]), s.append(share[a[keep], b[keep]])
    x, y, s = np.concatenate(x), np.concatenate(y), np.concatenate(s)
    root, kept = np.arange(n), []
    for k in np.argsort(-s, kind="stable").tolist():  # Kruskal
        a, b = root[x[k]], root[y[k]]
        if a != b:
            root[root == b] = a
            kept.append(k)
            if len(kept) == n - 1:
                break
    return x[kept], y[kept]


def node_pairs(node: int, ids: np.ndarray, sig: np.ndarray, least: float, second: float, depth: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs that the subtree below one node finds."""
    todo = [(node, np.arange(len(ids)), depth)]
    while todo:
        node, rows, depth = todo.pop()
        if len(rows) <= SMALL or depth >= MAX_DEPTH:
            a, b = spanning(sig[rows], least)
            if len(a):
                yield ids[rows[a]], ids[rows[b]]
            continue
        if (sig[rows] == sig[rows[0]]).mean(axis=1).min() >= 0.95:  # all of one kind: a star joins them
            yield np.full(len(rows) - 1, ids[rows[0]]), ids[rows[1:]]
            continue
        pick, child = children(np.full(len(rows), node, dtype=np.int64), sig[rows], second)
        order = np.argsort(child, kind="stable")
        cuts = np.flatnonzero(np.diff(child[order])) + 1
        for part in np.split(order, cuts):
            if len(part) > 1:
                todo.append((int(child[part[0]]), rows[pick[part]], depth + 1))


def _finish(least: float, second: float, depth: int):
    """Map over rows sorted by node: the forests of all nodes of the partition."""

    def emit(node, ids, sig):
        ids, first = np.unique(np.concatenate(ids), return_index=True)  # a node may hold a document twice
        sig = np.concatenate(sig)[first]
        if len(ids) > 1:
            yield from node_pairs(node, ids, sig, least, second, depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, sig = None, [], []
        for batch in batches:
            nodes = batch.column("node").to_numpy(zero_copy_only=False)
            own, tokens = batch.column("id").to_numpy(zero_copy_only=False), _matrix(batch.column("sig"))
            cuts = [0, *(np.flatnonzero(np.diff(nodes)) + 1).tolist(), len(nodes)]
            found = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if nodes[a] != node:
                    if node is not None:
                        found.extend(emit(node, ids, sig))
                    node, ids, sig = int(nodes[a]), [], []
                ids.append(own[a:b]), sig.append(tokens[a:b])
            if found:
                yield _pairs(found)
        if node is not None and (found := list(emit(node, ids, sig))):
            yield _pairs(found)
    return run


def _pairs(found: list) -> pa.RecordBatch:
    a, b = (np.concatenate([f[i] for f in found]) for i in range(2))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def candidate_pairs(sigs: DataFrame, threshold: float, trees: int = TREES) -> DataFrame:
    """(a, b): pairs of ``sigs`` (id, sig) that the trees find, a forest for each node.

    A node of more than ``TASK_NODE`` documents branches again as a shuffle; at
    ``MAX_DEPTH`` it is dealt into parts of about half that size, and every two parts are finished
    together, so that no pair of the node is left out.
    """
    least = threshold - 4 * (threshold * (1 - threshold) / SIG) ** 0.5
    second = 1 / threshold - 1
    nodes = sigs.mapInArrow(_roots(trees, second), "node long, id long")
    depth, found = 1, []
    while True:
        nodes = saved(nodes, "nodes")
        sizes = nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        rows = saved(nodes.join(sizes, "node"), "sized")
        last = depth >= MAX_DEPTH
        if last:
            parts = F.greatest(F.lit(1), F.ceil(2 * F.col("n") / TASK_NODE)).cast("int")
            rows = rows.select("node", "id", parts.alias("parts"), F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
            # part p meets every part q: node (p, q) with p <= q
            rows = rows.select("node", "id", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
            ready = rows.select(F.xxhash64("node", F.least("part", "other"), F.greatest("part", "other")).alias("node"), "id")
        else:
            ready = rows.where(F.col("n") <= TASK_NODE).select("node", "id")
        tagged = ready.join(sigs, "id").repartition("node").sortWithinPartitions("node")
        found.append(tagged.mapInArrow(_finish(least, second, depth), "a long, b long"))
        large = rows.where(F.col("n") > TASK_NODE).select("node", "id") if not last else None
        if last or large.isEmpty():
            break
        nodes = large.join(sigs, "id").mapInArrow(_branch(second), "node long, id long")
        depth += 1
    pairs = found[0]
    for f in found[1:]:
        pairs = pairs.unionAll(f)
    return pairs


# --- exact comparison of a family ---------------------------------------------

def exact_links(sets: list[np.ndarray], split: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (den * |A and B| >= num * |A or B|) among ``sets``; with ``split``, only between those before it and the others.

    Shingles of many sets are counted by a matrix product of 0/1 columns,
    shingles of few sets through their postings; a shingle of one set is none.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(n), size)
    _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = df >= max(8, n // 16)
    number = np.cumsum(often) - 1
    dense = np.zeros((n, int(often.sum())), dtype=np.float32)
    at = often[column]
    dense[owner[at], number[column[at]]] = 1
    few = (df > 1) & ~often
    at = few[column]
    c, o = column[at], owner[at]
    order = np.argsort(c, kind="stable")
    posting = o[order]
    start = np.searchsorted(c[order], np.arange(len(df)))
    stop = np.searchsorted(c[order], np.arange(len(df)), "right")
    by_owner = np.searchsorted(o, np.arange(n + 1))  # owners are in order
    left = np.arange(split) if split else np.arange(n)
    xs, ys = [], []
    for i in range(0, len(left), 256):
        rows = left[i : i + 256]
        common = np.rint(dense[rows] @ dense.T).astype(np.int64)
        for k, r in enumerate(rows):
            own = c[by_owner[r] : by_owner[r + 1]]
            if len(own):
                lengths = stop[own] - start[own]
                base = np.repeat(start[own] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
                common[k] += np.bincount(posting[base + np.arange(lengths.sum())], minlength=n)
        union = size[rows][:, None] + size[None, :] - common
        a, b = np.nonzero(den * common >= num * union)
        keep = b >= split if split else rows[a] < b
        a, b = forest(rows[a[keep]], b[keep])  # a forest of this strip's links
        xs.append(a), ys.append(b)
    return forest(np.concatenate(xs), np.concatenate(ys))


def _confirm(k: int, num: int, den: int):
    """Map over rows sorted by block: (block, side, id, text) to a forest of the block's links."""

    def emit(sides, shingler):
        ids = np.array([i for side in sides for i in side], dtype=np.int64)
        if len(ids) < 2:
            return None
        sets = [s for side in sides for s in side.values()]
        a, b = exact_links(sets, len(sides[0]) if sides[1] else 0, num, den)
        return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, block, sides = Shingler(k), None, ({}, {})
        for batch in batches:
            sets = shingler.sets(batch.column("text"))
            for own, side, i, s in zip(batch.column("block").to_pylist(), batch.column("side").to_pylist(), batch.column("id").to_pylist(), sets):
                if own != block:
                    if block is not None and (out := emit(sides, shingler)) is not None:
                        yield out
                    block, sides = own, ({}, {})
                sides[side][i] = s
        if block is not None and (out := emit(sides, shingler)) is not None:
            yield out
    return run


def family_links(families: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b): a forest, block by block, of the exact links inside each family.

    ``families`` has id, family, n_shingles; ``texts`` id and text.  A family
    whose documents exceed one block is split into parts, and every two parts
    make a block; both sides of a block are bounded.
    """
    sizes = families.groupBy("family").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    parts = F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.ceil(F.col("s") / BLOCK_SHINGLES))
    rows = families.join(sizes, "family").select("id", "family", parts.cast("int").alias("parts"))
    rows = rows.select("id", "family", "parts", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    # part p meets every part q: block (p, q) with p <= q, side 0 for the smaller
    rows = rows.select("id", "family", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    rows = rows.select("id", F.xxhash64("family", F.least("part", "other"), F.greatest("part", "other")).alias("block"), (F.col("part") > F.col("other")).cast("int").alias("side"))
    rows = rows.join(texts, "id").repartition("block").sortWithinPartitions("block")
    return rows.select("block", "side", "id", "text").mapInArrow(_confirm(k, num, den), "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8, trees: int = TREES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, key, chosen.

    Texts whose ``k``-word shingle sets have a Jaccard similarity of
    ``threshold`` or more (tested on full sets) are linked; component_id is the
    smallest doc_id reachable, kept marks that document.  Rows with equal sets
    are linked.  A null, empty or blank text has no shingle and is linked with
    nothing.  Rows go by their contents: rows of different texts under one doc_id are linked each
    on its own, and rows without doc_id are linked like any other; they are never kept, and their component_id is null
    if no document reachable has an id.  key names a row by doc_id and text; chosen marks the rows of one key in each
    group of linked rows (that of the smallest doc_id; without ids, of the smallest key), and every row that is linked with nothing.  Other
    columns of ``docs`` are ignored; an empty table gives an empty result.
    """
    num, den = round(threshold * 100), 100
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("key"), "text")
    table = saved(docs.mapInArrow(_shingle_table(k), "doc_id long, key long, n_shingles long, set_key binary, sig binary"), "shingled")
    filled = table.where("set_key is not null")
    # the row whose text stands for the set, and which stays if the set's group is represented by it
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first")
    sets = filled.groupBy("set_key").agg(first, F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    sets = saved(sets.select(F.monotonically_increasing_id().alias("id"), "*"), "sets")  # numbers, fixed by being written
    pairs = candidate_pairs(sets.select("id", "sig"), threshold, trees)
    families = connected_components(pairs)
    families = saved(families.unionAll(families.select(F.col("component_id").alias("id"), "component_id").distinct()), "families")
    members = families.join(sets, "id").select("id", F.col("component_id").alias("family"), "n_shingles", "first.key", "first.doc_id")
    # a row stands for its set; its own text is read, whole
    known = members.select("id", "key", F.coalesce("doc_id", F.lit(0)).alias("_id"))
    texts = docs.withColumn("_id", F.coalesce("doc_id", F.lit(0))).join(known, ["key", "_id"]).select("id", "text")
    links = family_links(members.select("id", "family", "n_shingles"), texts, k, num, den)
    found = connected_components(links)
    found = found.unionAll(found.select(F.col("component_id").alias("id"), "component_id").distinct())
    linked = saved(found.join(sets.select("id", "first"), "id"), "linked")
    heads = saved(linked.groupBy("component_id").agg(F.min("first").alias("head")), "heads")
    linked = attach(linked, heads, "component_id").select("id", "head")
    classes = sets.join(linked, "id", "left").select("set_key", F.coalesce("head", "first").alias("head"))
    out = filled.join(classes, "set_key", "left").select("doc_id", "n_shingles", F.col("head.doc_id").alias("component_id"), "key", (F.col("key") == F.col("head.key")).alias("chosen"))
    out = out.unionAll(table.where("set_key is null").select("doc_id", "n_shingles", "doc_id", "key", F.lit(True)))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "key", "chosen")
