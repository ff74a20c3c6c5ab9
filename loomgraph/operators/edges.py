"""Edges as relations: canonical form, adjacency, degrees, subgraphs, twins, balls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.components import connected_components
from loomgraph.storage import stored


def canonical(pairs: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """src < dst, each once; loops and null ends are no edges."""
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    return pairs.where(a != b).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, without a second scan."""
    ends = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return edges.select(ends.alias("e")).select("e.src", "e.dst")


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes."""
    ends = nodes.select("node").distinct()
    return edges.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def new_nodes(nodes: DataFrame, fitted: DataFrame) -> DataFrame:
    return nodes.join(fitted.select("node"), "node", "left_anti")


def largest_component(edges: DataFrame) -> DataFrame:
    """node of the component with the most nodes; of equals that with the smallest id."""
    found = stored(connected_components(edges), "components")
    sizes = found.groupBy("component").agg(F.count("*").alias("n"))
    best = sizes.agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))
    return found.join(best, "component", "left_semi").select("node")


def relabelled(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids from 0 in the order of the old ones, and the edges in them.

    Places within range partitions and the sizes of the partitions before make the numbers, so no task sees all nodes."""
    ranged = stored(nodes.select("node").distinct().repartitionByRange("node").withColumn("part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("node")) - 1
    numbered = stored(ranged.withColumn("place", place).join(before, "part").select("node", (F.col("before") + F.col("place")).alias("id")), "numbered")
    src, dst = (numbered.select(F.col("node").alias(c), F.col("id").alias(f"new_{c}")) for c in ("src", "dst"))
    return numbered, canonical(edges.join(src, "src").join(dst, "dst"), "new_src", "new_dst")


def twins(edges: DataFrame) -> DataFrame:
    """node, kind ('open' or 'closed') and group (its smallest node) of nodes with the same neighbourhood as another.

    Neighbourhoods are compared by size and two commutative 64-bit sums of hashes, so none is gathered."""
    adj = adjacency(edges)
    self_too = adj.union(adj.select("src", F.col("src").alias("dst")).distinct())
    out = None
    for kind, rel in (("open", adj), ("closed", self_too)):
        wide = lambda s: F.sum(F.xxhash64(F.lit(s), "dst").cast("decimal(20,0)"))
        prints = rel.groupBy("src").agg(F.count("*").alias("n"), wide(1).alias("a"), wide(2).alias("b"))
        groups = prints.groupBy("n", "a", "b").agg(F.min("src").alias("group"), F.count("*").alias("size")).where("size > 1")
        found = prints.join(groups, ["n", "a", "b"]).select(F.col("src").alias("node"), F.lit(kind).alias("kind"), "group")
        out = found if out is None else out.union(found)
    return out


def ball(edges: DataFrame, seeds: DataFrame, hops: int, keep=stored) -> DataFrame:
    """Nodes within so many hops of any seed; keep() writes each hop's nodes."""
    adj, reached = adjacency(edges), seeds.select("node").distinct()
    for _ in range(hops):
        step = reached.withColumnRenamed("node", "src").join(adj, "src").select(F.col("dst").alias("node"))
        reached = keep(reached.union(step).distinct(), "ball")
    return reached


def normalised_adjacency(edges: DataFrame) -> DataFrame:
    """src, dst, w = 1 / sqrt(degree * degree), both directions."""
    deg = degrees(edges)
    adj = adjacency(edges)
    adj = adj.join(deg.select(F.col("node").alias("src"), F.col("degree").alias("ds")), "src")
    adj = adj.join(deg.select(F.col("node").alias("dst"), F.col("degree").alias("dd")), "dst")
    return adj.select("src", "dst", (1.0 / F.sqrt((F.col("ds") * F.col("dd")).cast("double"))).alias("w"))


def two_hop_pairs(edges: DataFrame, cap_per_node: int | None = None, seed: int = 0) -> DataFrame:
    """a < b at distance two exactly, with how many common neighbours. cap_per_node keeps that many per smaller end, by hash."""
    adj = adjacency(edges)
    left, right = adj.select(F.col("dst").alias("m"), F.col("src").alias("a")), adj.select(F.col("src").alias("m"), F.col("dst").alias("b"))
    pairs = left.join(right, "m").where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    pairs = pairs.join(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_anti")
    if cap_per_node is None:
        return pairs
    order = Window.partitionBy("a").orderBy(F.xxhash64(F.lit(seed), "a", "b"), "b")
    return pairs.withColumn("k", F.row_number().over(order)).where(F.col("k") <= cap_per_node).drop("k")
