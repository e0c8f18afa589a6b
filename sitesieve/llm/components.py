"""Connected components of an edge table: alternating large-star / small-star.

Every round replaces each edge by an edge to a smaller neighbour until all
nodes point at the smallest id of their component, in O(log n) rounds on the
graphs met here.  Rounds are two aggregations (map-side combined, so a node
with very many neighbours is no hot task) and two joins; the edge table is
checkpointed in the shared folder each round.  The edges are first reduced to a
forest inside each partition, which removes most of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest id of its component) of the given edges, for nodes that are not smallest."""
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, root):
            break
        root = new
    moved = root != np.arange(len(ids))
    return ids[moved], ids[root[moved]]


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    u = v = np.empty(0, dtype=np.int64)
    for pdf in batches:  # at most one row per node stays in memory
        u, v = forest(np.concatenate([u, pdf["u"].to_numpy()]), np.concatenate([v, pdf["v"].to_numpy()]))
    yield pd.DataFrame({"u": u, "v": v})


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component_id) for every id in ``edges``' two long columns but the smallest of each component.

    Self-loops, repeated edges and nulls are ignored; an empty table gives an
    empty result.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    a, b = edges.columns[:2]
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    e = e.where("u is not null and v is not null and u > v").mapInPandas(_contract, "u long, v long").distinct().checkpoint()
    state = None
    while True:
        # both tests are exact up to a hash of all edges
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
        state = now
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("x"), "u", "m")
        small = pairs.select(F.explode(F.array("x", "u")).alias("u"), F.col("m").alias("v")).where("u > v")
        e = small.distinct().checkpoint()
