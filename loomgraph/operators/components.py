"""Connected components by alternating star contractions, helped by contractions within tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.storage import drop, stored


#: A task contracts at most about so many edges by itself.
TASK_EDGES = 500_000


def _contract(batches):
    """The edges of one task as stars: each node with the least node that these edges lead to."""
    cols = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if not cols:
        return
    ends = np.concatenate([np.concatenate([u for u, _ in cols]), np.concatenate([v for _, v in cols])])
    names, at = np.unique(ends, return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(names))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while not (root[root] == root).all():
            root = root[root]
    own = np.flatnonzero(root != np.arange(len(names)))
    yield pa.RecordBatch.from_arrays([pa.array(names[own]), pa.array(names[root[own]])], ["u", "v"])


def _contracted(stars: DataFrame, n: int) -> DataFrame:
    """Merge tasks, never beyond TASK_EDGES each on average, and contract within them; no shuffle."""
    return stars.coalesce(max(1, -(-n // TASK_EDGES))).mapInArrow(_contract, "u long, v long")


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(stars: DataFrame) -> DataFrame:
    both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_neighbour(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(stars: DataFrame) -> DataFrame:
    least = _least_neighbour(stars)
    moved = stars.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component (its least node id) for each node that has an edge to another node.

    Loops and null ends are ignored; direction and repeats don't matter. A hub is never gathered: its least
    neighbour comes from a partial aggregate, and the join back to its edges can be split by adaptive execution.
    Tasks contract what they hold before each round; edges that fit one task need no round. Each round is written to the shared folder, and the number of rounds grows with the logarithm of the size.
    """
    ends = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a != b")
    raw = stored(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "links")
    n = raw.count()
    stars = stored(_contracted(raw, n), "stars")
    state = None
    while n > TASK_EDGES:  # several tasks had a part each
        after = stored(_contracted(_small_star(_large_star(stars)), stars.count()), "stars")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(stars)
        stars = after
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
