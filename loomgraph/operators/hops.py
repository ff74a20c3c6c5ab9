"""Hop distances: breadth-first search from many sources as a frontier relation, pivots and bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.components import connected_components
from loomgraph.operators.edges import adjacency, degrees
from loomgraph.storage import stored

#: Sources that are numbered in one task.
RANGE = 1 << 16


def _named(sources: DataFrame) -> DataFrame:
    """source, g, bit: sources in groups of 64, each with a bit of its group's words. Numbered within ranges, so that no task sees all of very many."""
    start = stored(sources.select(F.col("node").cast("long").alias("source")).distinct(), "sources")
    dealt = stored(start.repartitionByRange(max(1, -(-start.count() // RANGE)), "source").withColumn("part", F.spark_partition_id()), "dealt")
    place = F.row_number().over(Window.partitionBy("part").orderBy("source")) - 1
    return stored(dealt.withColumn("i", place).select("source", (F.col("part").cast("long") * RANGE + F.floor(F.col("i") / 64)).alias("g"), (F.col("i") % 64).cast("int").alias("bit")), "named")


def _reached(edges: DataFrame, named: DataFrame, most: int | None = None) -> DataFrame:
    """g, node, bits, d: which sources of a group reach a node first after d rounds, a bit for each, so that a step of up to 64 searches is one row.

    A round joins the frontier with the adjacency and drops bits already set; since a neighbour of the frontier lies at most one hop nearer, only
    the last two frontiers need to be looked at. Each round is written out."""
    adj = adjacency(edges)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    frontier = stored(named.select("g", F.col("source").alias("node"), one.alias("bits"), F.lit(0).alias("d")), "frontier")
    rounds, before, d = [frontier], None, 0
    while most is None or d < most:
        d += 1
        step = frontier.select("g", F.col("node").alias("src"), "bits").join(adj, "src").select("g", F.col("dst").alias("node"), "bits", F.lit(0).cast("long").alias("known"))
        known = (frontier if before is None else frontier.union(before)).select("g", "node", F.lit(0).cast("long").alias("bits"), F.col("bits").alias("known"))
        step = step.union(known).groupBy("g", "node").agg(F.bit_or("bits").alias("bits"), F.bit_or("known").alias("known"))
        step = stored(step.select("g", "node", F.col("bits").bitwiseAND(F.bitwise_not("known")).alias("bits"), F.lit(d).alias("d")).where("bits != 0"), "frontier")
        if step.isEmpty():
            break
        before, frontier = frontier, step
        rounds.append(step)
    out = rounds[0]
    for r in rounds[1:]:
        out = out.union(r)
    return out


def hop_distances(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """source, node, d for each node that a source reaches (itself at 0); unreachable pairs have no row."""
    named = _named(sources)
    names = named.groupBy("g").agg(F.collect_list(F.struct("bit", "source")).alias("names"))  # 64 at most
    own = F.filter("names", lambda n: F.call_function("getbit", F.col("bits"), n.bit) == 1)
    return _reached(edges, named, most).join(names, "g").select(F.explode(own).alias("n"), "node", "d").select("n.source", "node", "d")


def hop_columns(edges: DataFrame, ordinals: DataFrame) -> DataFrame:
    """node, hops: pivot_columns() of the distances from the pivots (source, ordinal), without a row for each distance."""
    named = _named(ordinals.select(F.col("source").alias("node")))
    n = ordinals.count()
    order = {}  # a number for each pivot
    for r in named.join(ordinals, "source").select("g", "bit", "ordinal").collect():
        order.setdefault(r.g, np.full(64, -1))[r.bit] = r.ordinal

    def run(batches):
        for b in batches:
            if b.num_rows:
                e = b.column("e")
                row, each = np.repeat(np.arange(b.num_rows), pa.compute.list_value_length(e).to_numpy(zero_copy_only=False)), e.flatten()
                g, bits, d = (each.field(c).to_numpy(zero_copy_only=False) for c in ("g", "bits", "d"))
                hops = np.full((b.num_rows, n), -1, np.int16)
                for group, names in order.items():
                    own = np.flatnonzero(g == group)
                    at, bit = np.nonzero(np.unpackbits(bits[own].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                    hops[row[own[at]], names[bit]] = d[own[at]]
                yield pa.RecordBatch.from_arrays([b.column("node"), _lists(hops)], ["node", "hops"])

    return _reached(edges, named).groupBy("node").agg(F.collect_list(F.struct("g", "bits", "d")).alias("e")).mapInArrow(run, "node long, hops array<short>")


def _lists(hops: np.ndarray) -> pa.Array:
    """Rows as lists, with null for what is below 0."""
    flat = pa.array(hops.ravel(), pa.int16(), mask=hops.ravel() < 0)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(hops) + 1, dtype=np.int32) * hops.shape[1]), flat)


def farthest_pivots(edges: DataFrame, nodes: DataFrame, n: int, first: int | None) -> DataFrame:
    """pivot, ordinal, node, d: pivots chosen one by one as the node farthest from those chosen (the smallest id of
    equals; a node that none reaches is farther than any other), each with its hop column. Stops early when every node is a pivot; without a first there is none."""
    if first is None:
        return edges.sparkSession.createDataFrame([], "pivot long, ordinal int, node long, d int")
    columns, least, pivot = None, nodes.select("node").withColumn("least", F.lit(None).cast("int")), first
    for k in range(n):
        own = hop_distances(edges, edges.sparkSession.createDataFrame([(pivot,)], "node long")).select("node", "d")
        own = stored(own, "column")
        out = own.select(F.lit(pivot).alias("pivot"), F.lit(k).alias("ordinal"), "node", "d")
        columns = out if columns is None else columns.union(out)
        least = stored(least.join(own, "node", "left").select("node", F.least("least", "d").alias("least")), "least")
        far = F.struct(F.col("least").isNull(), "least", -F.col("node"))
        top = least.agg(F.max_by("node", far).alias("node"), F.max_by(F.coalesce("least", F.lit(1)), far).alias("d")).first()
        if not top.d:
            break
        pivot = top.node
    return columns


def hashed_pivots(nodes: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n nodes by hash order: the same ones whatever the partitioning."""
    return nodes.select("node").orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(n)


def component_pivots(edges: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n nodes of the graph by hash order, and the first by it of each component that holds none of them."""
    found = stored(connected_components(edges), "components")
    chosen = stored(hashed_pivots(found, n, seed), "pivots")
    met = found.join(chosen, "node", "left_semi").select("component").distinct()
    others = found.join(met, "component", "left_anti").groupBy("component").agg(F.min_by("node", F.struct(F.xxhash64(F.lit(seed), "node"), "node")).alias("node"))
    return stored(chosen.union(others.select("node")), "pivots")


def leading_nodes(edges: DataFrame, n: int) -> DataFrame:
    """The n nodes with the most edges, and the one with the most of each component that holds none of them; smaller ids first. So every node
    with an edge is reached from one, and sources with their nodes are at most n + 1 rows a node."""
    found = stored(connected_components(edges).join(degrees(edges), "node"), "components")
    top = found.orderBy(F.col("degree").desc(), "node").limit(n).select("node")
    best = found.groupBy("component").agg(F.min_by("node", F.struct(-F.col("degree"), "node")).alias("node"))
    return top.union(best.select("node")).distinct()


def pivot_columns(hops: DataFrame, ordinals: DataFrame) -> DataFrame:
    """node, hops: the distances to the pivots (source, ordinal) in their order; null where there is no path."""
    n = ordinals.count()

    def run(batches):
        for b in batches:
            if b.num_rows:
                e = b.column("e")
                row, each = np.repeat(np.arange(b.num_rows), pa.compute.list_value_length(e).to_numpy(zero_copy_only=False)), e.flatten()
                wide = np.full((b.num_rows, n), -1, np.int16)
                wide[row, each.field("ordinal").to_numpy(zero_copy_only=False)] = each.field("d").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([b.column("node"), _lists(wide)], ["node", "hops"])

    rows = hops.join(F.broadcast(ordinals), "source")  # one row for each pivot
    return rows.groupBy("node").agg(F.collect_list(F.struct("ordinal", F.col("d").cast("short").alias("d"))).alias("e")).mapInArrow(run, "node long, hops array<short>")


def in_order(sources: DataFrame) -> DataFrame:
    """source, ordinal: sources (node) in the order of their ids."""
    order = Window.orderBy("node")  # a row for each source
    return sources.select("node").distinct().select(F.col("node").alias("source"), (F.row_number().over(order) - 1).alias("ordinal"))


def numbered_columns(edges: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hop columns (node, hops) to the sources in the order of their ids, and that order (source, ordinal)."""
    ordinals = stored(in_order(sources), "ordinals")
    return stored(hop_columns(edges, ordinals), "columns"), ordinals


def lower_bounds(pairs: DataFrame, columns: DataFrame) -> DataFrame:
    """a, b, bound: the largest difference of their hop columns, which no path undercuts; null where no source reaches both.

    columns is node, hops (arrays), or source, node, d: such rows stay few where each of very many sources reaches its own component alone."""
    if "hops" not in columns.columns:
        ends = (columns.select("source", F.col("node").alias(c), F.col("d").alias(f"d{c}")) for c in ("a", "b"))
        both = pairs.select("a", "b").distinct().join(next(ends), "a").join(next(ends), ["b", "source"]).groupBy("a", "b").agg(F.max(F.abs(F.col("da") - F.col("db"))).alias("bound"))
        return pairs.join(both, ["a", "b"], "left").select("a", "b", "bound")
    left, right = columns.select(F.col("node").alias("a"), F.col("hops").alias("ha")), columns.select(F.col("node").alias("b"), F.col("hops").alias("hb"))
    gap = F.array_max(F.zip_with("ha", "hb", lambda x, y: F.abs(x.cast("int") - y.cast("int"))))
    return pairs.join(left, "a").join(right, "b").select("a", "b", gap.alias("bound"))


def placed_distances(edges: DataFrame, hops: DataFrame, fresh: DataFrame, rounds: int = 2) -> DataFrame:
    """source, node, d for fresh nodes from their neighbours' distances plus one, relaxed along edges between
    fresh nodes; known distances aren't revised, so these are upper bounds."""
    adj = adjacency(edges)
    into = adj.join(fresh.select(F.col("node").alias("dst")), "dst", "left_semi")
    known = hops.join(fresh.select("node"), "node", "left_anti").select("source", "node", "d")
    best = None
    for _ in range(rounds):
        have = known if best is None else known.union(best)
        step = into.join(have.withColumnRenamed("node", "src"), "src").groupBy("source", F.col("dst").alias("node")).agg((F.min("d") + 1).alias("d"))
        best = stored(step, "placed")
    return best
