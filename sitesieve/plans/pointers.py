"""Long chains in few rounds: pointer doubling over an edge table.

An edge table has one row (node, to) per node that leads on.  Each round joins the
pointers with themselves, so after k rounds a pointer spans 2**k edges: a chain of a
thousand nodes takes ten rounds, each one equi-join over compact rows.  Every
round is written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def _twice(pointers: DataFrame, table: DataFrame) -> DataFrame:
    """Pointers of ``pointers`` carried on by those of ``table`` (other columns are the table's)."""
    carried = [c for c in table.columns if c not in ("node", "to")]
    step = table.select(F.col("node").alias("to"), F.col("to").alias("_to"), *[F.col(c).alias(f"_{c}") for c in carried])
    return pointers.select("node", "to").join(step, "to").select("node", F.col("_to").alias("to"), *[F.col(f"_{c}").alias(c) for c in carried])


def path_ends(edges: DataFrame) -> DataFrame:
    """Where the path from each node of ``edges`` (node, to; one row per node, no nulls) ends.

    Columns: node; end, the first node without an edge, or null if the path runs into a
    cycle; then entry is the first node on the cycle and last the node of the cycle that leads to
    entry, where a walk that visits no node twice stops.

    Rounds double the pointers until no pending one ends any more; what is pending then leads into cycles.
    Their nodes are the image of ever longer pointers once it stops shrinking.
    """
    goes_on = edges.select(F.col("node").alias("to"), F.lit(True).alias("goes"))
    t = edges.select("node", "to").join(goes_on, "to", "left").select("node", "to", F.coalesce("goes", F.lit(False)).alias("goes"))
    t = written(t, "pointers")
    pending = t.where("goes").count()
    while pending:
        t = written(t.where("not goes").unionByName(_twice(t.where("goes"), t)), "pointers")
        left = t.where("goes").count()
        if left == pending:
            break
        pending = left
    none = F.lit(None).cast("string")
    out = t.where("not goes").select("node", F.col("to").alias("end"), none.alias("entry"), none.alias("last"))
    if not pending:
        return out
    p = t.where("goes").select("node", "to")
    size = p.select("to").distinct().count()
    left = pending if size == pending else None  # every pending node is an image: all are on cycles
    while left != size:
        p = written(_twice(p, p), "pointers")
        size, left = p.select("to").distinct().count(), size
    cycle = p.select(F.col("to").alias("node")).distinct()
    rest = edges.select("node", "to").join(p.select("node"), "node", "left_semi")
    if size == pending:
        before, entries = rest, cycle.select("node", F.col("node").alias("entry"))
    else:
        cycle = written(cycle, "cycles")
        before = rest.join(cycle, "node", "left_semi")
        tails = path_ends(rest.join(cycle, "node", "left_anti")).select("node", F.col("end").alias("entry"))
        entries = tails.unionByName(cycle.select("node", F.col("node").alias("entry")))
    before = before.select(F.col("to").alias("entry"), F.col("node").alias("last"))
    return out.unionByName(entries.join(before, "entry").select("node", none.alias("end"), "entry", "last"))


def walks(starts: DataFrame, edges: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Every node on the path from each start: (seed_id, node, hop), a node once per seed, with its first hop.

    ``starts`` has seed_id and node.  Round k carries the first 2**k nodes of every path over the
    pointers of 2**k edges, so each row of the answer is made once and a path of 500 nodes takes ten rounds.  A path that
    runs into a cycle ends when a round adds nothing.  ``max_hops`` bounds the hops (nodes with hop < max_hops).
    """
    found = starts.select("seed_id", "node", F.lit(0).alias("hop")).distinct()
    if max_hops is not None:
        found = found.where(F.col("hop") < max_hops)
    found = written(found, "walks")
    size, span = found.count(), 1
    jump = edges.select("node", "to")
    while size and (max_hops is None or span < max_hops):
        ahead = found.join(jump, "node").select("seed_id", F.col("to").alias("node"), (F.col("hop") + span).alias("hop"))
        if max_hops is not None:
            ahead = ahead.where(F.col("hop") < max_hops)
        found = written(found.unionByName(ahead).groupBy("seed_id", "node").agg(F.min("hop").alias("hop")), "walks")
        now = found.count()
        if now == size:
            break
        size, span = now, span * 2
        jump = written(_twice(jump, jump), "pointers")
    return found
