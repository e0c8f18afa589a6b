"""Embedding near-dedup: Int8 tile products with exact error bounds.

Every unit vector x is held as 8-bit codes q with a scale s, x = q / s + e, and
the norm of e is computed in double precision.  For two vectors
|x.y - (q_x.q_y) / (s_x s_y)| <= |q_x / s_x| |e_y| + |e_x| (|q_y / s_y| + |e_y|),
so a pair whose bound stays below the threshold is certainly no link; only the
others are computed again in double precision.  The products of codes are
whole numbers below 2**24 per 1,000 dimensions and are summed exactly by a
32-bit float matrix product.

Equal vectors are one row with a count.  The rows are dealt into tiles of
at most about ``TILE`` vectors and every two tiles meet in one task; what
leaves a task is a count per vector and a forest of the links, never the pairs.
All pairs of tiles meet, so the work grows with the square of the number of
different vectors, as exact search in high dimensions does; tiles of
``TILE`` vectors make each vector travel N / TILE times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .components import connected_components, forest

TILE = 4096
ROWS = 512  #: rows of a tile product that are in memory at once


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, 1 / scale, norm of the coded vector, norm of the error) of unit vectors."""
    step = np.abs(x).max(axis=1) / 127.0
    codes = np.rint(x / step[:, None]).astype(np.int8)
    coded = codes * step[:, None]
    return codes, step, np.linalg.norm(coded, axis=1), np.linalg.norm(x - coded, axis=1)


def possible(a: tuple, b: tuple, rows: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row of a, row of b): pairs whose upper bound reaches the threshold."""
    (qa, sa, na, ea), (qb, sb, nb, eb) = a, b
    width = qa.shape[1]
    # 1,000 dimensions at a time: sums of such products are exact in 32 bits
    dot = sum(qa[rows, i : i + 1000].astype(np.float32) @ qb[:, i : i + 1000].astype(np.float32).T for i in range(0, max(width, 1), 1000))
    # dot * sa * sb + na * eb + ea * (nb + eb) >= threshold, as one comparison for each element
    slack = 1e-6 * (1 + width / 1000)
    scaled = dot * sb.astype(np.float32)[None, :]
    worst_b, most_b = eb.max(initial=0.0), (nb + eb).max(initial=1.0)
    least = (threshold - slack - na[rows] * worst_b - ea[rows] * most_b) / sa[rows]
    x, y = np.nonzero(scaled >= (least * (1 - np.sign(least) * 1e-6)).astype(np.float32)[:, None])
    if len(x):  # the bound of the pair itself
        r = x + rows.start
        keep = dot[x, y].astype(np.float64) * sa[r] * sb[y] + na[r] * eb[y] + ea[r] * (nb[y] + eb[y]) >= threshold - slack
        x, y = x[keep], y[keep]
    return x + rows.start, y


def tile_links(a: np.ndarray, b: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (cosine >= threshold in double precision) between two tiles of raw vectors, or inside one if b is None."""
    x = unit(a)
    y = x if b is None else unit(b)
    qx = quantise(x)
    qy = qx if b is None else quantise(y)
    for i in range(0, len(x), ROWS):
        r, c = possible(qx, qy, slice(i, min(i + ROWS, len(x))), threshold)
        if b is None:
            r, c = r[r < c], c[r < c]
        for k in range(0, len(r), 1 << 16):
            p, q = r[k : k + (1 << 16)], c[k : k + (1 << 16)]
            link = np.einsum("ij,ij->i", x[p], y[q]) >= threshold
            if link.any():
                yield p[link], q[link]


def _block(ids, counts, vectors, other, threshold):
    """Rows (id, other, n): other is null in a count of n links, n is 0 in an edge of the forest."""
    n = np.zeros(len(ids) + (len(other[0]) if other else 0), dtype=np.int64)
    all_ids = np.concatenate([ids, other[0]]) if other else ids
    all_counts = np.concatenate([counts, other[1]]) if other else counts
    shift = len(ids) if other else 0
    u = v = np.empty(0, dtype=np.int64)
    for p, q in tile_links(vectors, other[2] if other else None, threshold):
        q = q + shift
        np.add.at(n, p, all_counts[q])
        np.add.at(n, q, all_counts[p])
        u, v = forest(np.concatenate([u, all_ids[p]]), np.concatenate([v, all_ids[q]]))
    has = n > 0
    return np.concatenate([all_ids[has], u]), np.concatenate([np.full(has.sum(), -1), v]), np.concatenate([n[has], np.zeros(len(u), np.int64)]), int(has.sum())


def _products(threshold: float):
    """Map over rows (block, side, id, n, embedding) sorted by block."""

    def emit(sides):
        tiles = [(np.array(s[0]), np.array(s[1]), np.array(s[2], dtype=np.float64)) for s in sides[:2] if s[0]]
        # a block has one side where a tile meets itself; a lone side of two tiles meets nothing
        if not tiles or (sides[2] and len(tiles) < 2):
            return None
        ids, other, n, counted = _block(*tiles[0], tiles[1] if len(tiles) > 1 else None, threshold)
        mask = np.arange(len(ids)) < counted
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(other, pa.int64(), mask=mask), pa.array(n, pa.int64())], names=["id", "other", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sides = None, None
        for batch in batches:
            blocks = batch.column("block").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if i == j:
                    continue
                if blocks[i] != block:
                    if block is not None and (out := emit(sides)) is not None:
                        yield out
                    block, sides = blocks[i], [([], [], []), ([], [], []), False]
                part = batch.slice(i, j - i)
                column = part.column("embedding")
                values = column.flatten().to_numpy(zero_copy_only=False).reshape(j - i, -1)
                side = part.column("side").to_numpy(zero_copy_only=False)
                for k in (0, 1):
                    at = side == k
                    sides[k][0].extend(part.column("id").to_numpy(zero_copy_only=False)[at].tolist())
                    sides[k][1].extend(part.column("n").to_numpy(zero_copy_only=False)[at].tolist())
                    sides[k][2].extend(values[at])
                sides[2] = sides[2] or bool(part.column("two")[0].as_py())
        if block is not None and (out := emit(sides)) is not None:
            yield out
    return run


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.95, tile: int = TILE) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    n_links counts the other rows whose vector has a cosine >= ``threshold``
    (0 < threshold <= 1) in double precision; component_id is the smallest
    vec_id reachable by links, kept marks it.  A vector that is null, empty, zero or
    holds null or non-finite components links with nothing, nor do vectors of
    different lengths with each other.  Repeated rows count as rows of their
    own; a null vec_id is never kept, and a vector that only such rows hold meets
    its copies alone.
    Other columns are ignored; an empty table gives an empty result.
    """
    # 32-bit components travel as such; all arithmetic is in double precision
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = kind if kind == "float" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    # 0.0 and -0.0 are one value
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0).cast(kind)))
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    good = rows.where("sound").select("vec_id", "embedding", F.xxhash64("embedding").alias("h"))
    # all copies of a vector are one row; id is the smallest vec_id among them
    different = saved(good.groupBy("h", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "vectors")
    named = different.where("id is not null")
    sizes = {r["d"]: r["c"] for r in named.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("c")).collect()}  # a row for each length of vector
    pieces = []
    for d, c in sorted(sizes.items()):
        tiles = max(1, -(-c // tile))
        part = F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")
        own = named.where(F.size("embedding") == d).withColumn("part", part)
        own = own.select("id", "n", "embedding", "part", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("other"))
        low, high = F.least("part", "other"), F.greatest("part", "other")
        own = own.select((F.lit(d).cast("long") * 2**40 + low.cast("long") * tiles + high).alias("block"), (F.col("part") > F.col("other")).cast("int").alias("side"), (F.col("part") != F.col("other")).alias("two"), "id", "n", "embedding")
        blocks = tiles * (tiles + 1) // 2
        own = own.repartition(min(blocks, 20_000), "block").sortWithinPartitions("block")
        pieces.append(own.mapInArrow(_products(threshold), "id long, other long, n long"))
    found = pieces[0] if pieces else vectors.sparkSession.createDataFrame([], "id long, other long, n long")
    for p in pieces[1:]:
        found = found.unionAll(p)
    found = saved(found, "links")
    links = found.where("other is null").groupBy("id").agg(F.sum("n").alias("links"))
    components = connected_components(found.where("other is not null").select("id", "other"))
    classes = different.join(links, "id", "left").join(components, "id", "left").select(
        "h", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    out = good.join(classes, ["h", "embedding"]).select("vec_id", "n_links", "component_id")
    out = out.unionAll(rows.where("not sound").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
