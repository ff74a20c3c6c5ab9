"""Layout energies and forces as joins and grouped sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.draws import uniform
from loomgraph.functions.geometry import distance, ray_segment_distance, sector, turn
from loomgraph.operators.edges import degrees
from loomgraph.operators.spatial import block_pairs, near_segments, placed_edges, range_join
from loomgraph.storage import stored

#: Fixed floor of distances that divide.
NEAR = 1e-9


def at_both_ends(pairs: DataFrame, a: str, b: str, fx: Column, fy: Column) -> DataFrame:
    """node, fx, fy: sums of a force at one end and of its opposite at the other, in one pass over the pairs."""
    each = F.explode(F.array(F.struct(F.col(a).alias("node"), fx.alias("fx"), fy.alias("fy")), F.struct(F.col(b).alias("node"), (-fx).alias("fx"), (-fy).alias("fy"))))
    return pairs.select(each.alias("e")).groupBy("e.node").agg(F.sum("e.fx").alias("fx"), F.sum("e.fy").alias("fy"))


def attraction(edges: DataFrame, layout: DataFrame, k: float, law: str = "fr") -> DataFrame:
    """Pull along edges: d**2 / k by law 'fr', 1 by 'linlog', d by 'fa2'."""
    rows = placed_edges(edges, layout)
    d = F.greatest(distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), F.lit(NEAR))
    size = {"fr": d * d / k, "linlog": F.lit(1.0), "fa2": d}[law]
    return at_both_ends(rows, "src", "dst", size * (F.col("x2") - F.col("x1")) / d, size * (F.col("y2") - F.col("y1")) / d)


def near_repulsion(layout: DataFrame, k: float, radius: float) -> DataFrame:
    """node, fx, fy: exact k**2 / d among points closer than radius."""
    at = [layout.select(F.col("node").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y")) for c in "ab"]
    pairs = range_join(layout, layout, radius).where("a < b").join(at[0], "a").join(at[1], "b")
    d = F.greatest("d", F.lit(NEAR))
    return at_both_ends(pairs, "a", "b", k * k / d * (F.col("ax") - F.col("bx")) / d, k * k / d * (F.col("ay") - F.col("by")) / d)


def edge_attraction_energy(edges: DataFrame, layout: DataFrame) -> DataFrame:
    """attraction: mean of log(1 + d**2) over edges."""
    rows = placed_edges(edges, layout)
    d = distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return rows.agg(F.avg(F.log1p(d * d)).alias("attraction"))


def sampled_pairs(layout: DataFrame, per_node: int, seed: int, step: int = 0) -> DataFrame:
    """a, b: per_node partners of each node, drawn by hash among nodes numbered from 0."""
    n = layout.count()
    draws = layout.select(F.col("node").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))).alias("i"))
    return draws.select("a", F.floor(uniform("a", "i", F.lit(step), seed=seed) * n).cast("long").alias("b"))


def pair_repulsion_energy(pairs: DataFrame, layout: DataFrame) -> DataFrame:
    """repulsion: mean of -log(d**2 / (1 + d**2) + 1e-6) over pairs."""
    at = [layout.select(F.col("node").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y")) for c in "ab"]
    d = distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return pairs.join(at[0], "a").join(at[1], "b").agg(F.avg(-F.log(d * d / (1 + d * d) + 1e-6)).alias("repulsion"))


def clearance_energy(gaps: DataFrame, clearance: float) -> DataFrame:
    """clearance_loss: mean of max(0, 1 - gap / clearance)**2."""
    return gaps.agg(F.avg(F.pow(F.greatest(F.lit(0.0), 1 - F.col("clearance") / clearance), 2)).alias("clearance_loss"))


def smooth_crossing_energy(pairs: DataFrame, layout: DataFrame, tau: float) -> DataFrame:
    """crossing_loss over pairs of edges (a1, a2, b1, b2): mean product of sigmoids that is near 1 where both straddle each other."""
    rows = pairs
    for c in ("a1", "a2", "b1", "b2"):
        rows = rows.join(layout.select(F.col("node").alias(c), F.col("x").alias(c + "x"), F.col("y").alias(c + "y")), c)
    p = {c: (F.col(c + "x"), F.col(c + "y")) for c in ("a1", "a2", "b1", "b2")}
    t = lambda u, v, w: turn(*p[u], *p[v], *p[w])
    soft = lambda v: 1 / (1 + F.exp(-F.greatest(F.least(v / tau, F.lit(60.0)), F.lit(-60.0))))
    one = soft(-t("a1", "a2", "b1") * t("a1", "a2", "b2"))
    two = soft(-t("b1", "b2", "a1") * t("b1", "b2", "a2"))
    return rows.agg(F.avg(one * two).alias("crossing_loss"))


def majorised(hops: DataFrame, layout: DataFrame) -> DataFrame:
    """node, x, y: where the stress bound of the present positions is least for each node: the weighted mean of what
    its targets (source, node, d) ask for, weights d**-2. One Guttman step when hops hold all pairs."""
    at = [layout.select(F.col("node").alias(c), F.col("x").alias(f"{c}_x"), F.col("y").alias(f"{c}_y")) for c in ("source", "node")]
    rows = hops.where("d > 0").join(at[0], "source").join(at[1], "node")
    gap = F.greatest(distance(F.col("source_x"), F.col("source_y"), F.col("node_x"), F.col("node_y")), F.lit(NEAR))
    w, pull = 1 / (F.col("d") * F.col("d")), F.col("d") / gap
    num = lambda c: F.sum(w * (F.col(f"source_{c}") + pull * (F.col(f"node_{c}") - F.col(f"source_{c}"))))
    return rows.groupBy("node").agg((num("x") / F.sum(w)).alias("x"), (num("y") / F.sum(w)).alias("y"))


def repulsion(layout: DataFrame, anchors: DataFrame, k: float, law: str = "fr", cutoff: float = 0.0, near: float = 0.0, edges: DataFrame | None = None, bounds: DataFrame | None = None) -> DataFrame:
    """node, fx, fy at the anchors from all other nodes, which grows as 1 / d: k**2 / d ('fr'), 1 / d ('linlog'), and k**2 / d times
    (degree + 1) of both ('fa2').

    Nodes further away than cutoff * k, or nearer than near * k (whose part near_repulsion has exactly), don't count. bounds
    (a, b, bound) weigh a pair by how far apart the graph holds it, 0.05 at least, over the mean of its anchor's; pairs without one
    weigh as the least. Anchors are a bounded sample, sent to every task; each task sums over its own nodes."""
    mass = F.coalesce("degree", F.lit(0)) + 1
    heavy = law == "fa2" and edges is not None
    rows = layout.join(degrees(edges), "node", "left").select("node", "x", "y", mass.alias("m")) if heavy else layout.select("node", "x", "y", F.lit(1).alias("m"))
    some = rows.join(anchors.select("node"), "node", "left_semi").select(F.col("node").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("m").alias("am"))
    pairs = rows.join(F.broadcast(some), F.col("node") != F.col("a"))
    dx, dy = F.col("ax") - F.col("x"), F.col("ay") - F.col("y")
    q = F.greatest(dx * dx + dy * dy, F.lit(NEAR**2))
    pairs = pairs.select("a", "node", dx.alias("dx"), dy.alias("dy"), q.alias("q"), (F.col("m") * F.col("am")).alias("w"))
    if cutoff > 0:
        pairs = pairs.where(F.col("q") <= (cutoff * k) ** 2)
    if near > 0:
        pairs = pairs.where(F.col("q") >= (near * k) ** 2)
    if bounds is not None:
        mean = bounds.groupBy("a").agg(F.avg("bound").alias("mean"))
        share = bounds.join(mean, "a").select("a", F.col("b").alias("node"), F.greatest(F.col("bound") / F.col("mean"), F.lit(0.05)).alias("share"))
        pairs = pairs.join(share, ["a", "node"], "left").withColumn("w", F.col("w") * F.coalesce("share", F.lit(0.05)))
    size = (1.0 if law == "linlog" else k * k) * F.col("w") / F.col("q")
    return pairs.groupBy(F.col("a").alias("node")).agg(F.sum(size * F.col("dx")).alias("fx"), F.sum(size * F.col("dy")).alias("fy"))


def gravity(layout: DataFrame, strength: float) -> DataFrame:
    """node, fx, fy: a pull to the layout's centre that grows with the distance from it."""
    centre = layout.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    return layout.crossJoin(F.broadcast(centre)).select("node", (strength * (F.col("mx") - F.col("x"))).alias("fx"), (strength * (F.col("my") - F.col("y"))).alias("fy"))


def summed(*forces: DataFrame) -> DataFrame:
    out = forces[0]
    for f in forces[1:]:
        out = out.unionByName(f)
    return out.groupBy("node").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))


def stepped(layout: DataFrame, forces: DataFrame, most: float) -> DataFrame:
    """Nodes moved along their forces, no further than most; nodes without a force stay."""
    rows = layout.join(forces, "node", "left").withColumn("f", F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy")))
    share = F.coalesce(F.least(F.col("f"), F.lit(most)) / F.greatest("f", F.lit(NEAR)), F.lit(0.0))
    return rows.select("node", (F.col("x") + share * F.coalesce("fx", F.lit(0.0))).alias("x"), (F.col("y") + share * F.coalesce("fy", F.lit(0.0))).alias("y"))


def force_layout(edges: DataFrame, layout: DataFrame, k: float, law: str = "fr", rounds: int = 50, anchors: int = 80, temperature: float = 0.1, cooling: float = 0.99, pull: float = 0.0, seed: int = 0) -> DataFrame:
    """Rounds of attraction along all edges and repulsion by a sample of anchors, each node's share scaled to all nodes.

    Every node repels in every round: the anchors' roles turn around (they push, all others are pushed), so no pair is compared
    twice and no task holds more than its own nodes and the sample."""
    n = layout.count()
    for step in range(rounds):
        some = layout.orderBy(F.xxhash64(F.lit(seed + step), "node"), "node").limit(anchors).select("node", "x", "y")
        pushed = _pushed(layout, some, k, law, edges, n / max(1, min(anchors, n)))
        parts = [attraction(edges, layout, k, law), pushed] + ([gravity(layout, pull)] if pull else [])
        layout = stored(stepped(layout, summed(*parts), temperature * cooling**step), "forces")
    return layout


def _pushed(layout: DataFrame, some: DataFrame, k: float, law: str, edges: DataFrame, scale: float) -> DataFrame:
    """node, fx, fy at all nodes, from a sample of them that stands for all."""
    mass = degrees(edges).select("node", (F.col("degree") + 1).alias("m"))
    weighed = lambda df: df.join(mass, "node", "left").withColumn("m", F.coalesce("m", F.lit(1))) if law == "fa2" else df.withColumn("m", F.lit(1))
    few = weighed(some).select(F.col("node").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("m").alias("am"))
    pairs = weighed(layout).join(F.broadcast(few), F.col("node") != F.col("a"))
    dx, dy = F.col("x") - F.col("ax"), F.col("y") - F.col("ay")
    size = scale * (1.0 if law == "linlog" else k * k) * F.col("m") * F.col("am") / F.greatest(dx * dx + dy * dy, F.lit(NEAR**2))
    return pairs.groupBy("node").agg(F.sum(size * dx).alias("fx"), F.sum(size * dy).alias("fy"))


def force_energy(edges: DataFrame, layout: DataFrame, k: float) -> DataFrame:
    """energy: (sum over edges of d**3 / 3k, less k**2 times the sum over all pairs of log d) / nodes. Pairs meet in blocks of nodes."""
    rows = placed_edges(edges, layout)
    pull = F.pow(distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), 3) / (3 * k)
    along = rows.agg(F.coalesce(F.sum(pull), F.lit(0.0)).alias("pull"))
    log = F.log(F.greatest(distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")), F.lit(1e-6)))
    apart = block_pairs(layout).where("a < b").agg(F.coalesce(F.sum(log), F.lit(0.0)).alias("push"))
    both = along.crossJoin(apart).crossJoin(layout.agg(F.count("*").alias("n")))  # one row each
    return both.select(F.try_divide(F.col("pull") - k * k * F.col("push"), F.col("n")).alias("energy"))


def pivot_edge_stress(hops: DataFrame, edges: DataFrame, layout: DataFrame) -> DataFrame:
    """stress, scale over pivot rows (source, node, d) and all edges, whose target is 1, with one scale."""
    rows = hops.where("d > 0").select("source", "node", "d").unionByName(edges.select(F.col("src").alias("source"), F.col("dst").alias("node"), F.lit(1).alias("d")))
    return stress_of(rows, layout)


def stress_of(targets: DataFrame, layout: DataFrame) -> DataFrame:
    """stress, scale, n_pairs of any rows (source, node, d): held-out pivots, local pairs, edges."""
    at = [layout.select(F.col("node").alias(c), F.col("x").alias(f"{c}_x"), F.col("y").alias(f"{c}_y")) for c in ("source", "node")]
    r = distance(F.col("source_x"), F.col("source_y"), F.col("node_x"), F.col("node_y")) / F.col("d")
    rows = targets.where("d > 0").join(at[0], "source").join(at[1], "node").select(r.alias("r"))
    s, q, n = F.sum("r"), F.sum(F.col("r") * F.col("r")), F.count("*")
    return rows.agg((1 - s * s / (n * q)).alias("stress"), (s / q).alias("scale"), n.alias("n_pairs"))


def spread_energy(pairs: DataFrame, layout: DataFrame, scale: float = 1.0) -> DataFrame:
    """spread: minus the mean log of the scaled distances of pairs (a, b), the maximum-entropy term."""
    return _placed_pairs(pairs, layout).agg((-F.avg(F.log(F.greatest(scale * F.col("d"), F.lit(NEAR))))).alias("spread"))


def contrast_energy(edges: DataFrame, negatives: DataFrame, layout: DataFrame) -> DataFrame:
    """contrast: mean over edges of -log(q / (q + sum of q over the negatives of its first end)), q = 1 / (1 + d**2)."""
    q = 1 / (1 + F.col("d") * F.col("d"))
    other = _placed_pairs(negatives.select(F.col("node").alias("a"), F.col("negative").alias("b")), layout).groupBy("a").agg(F.sum(q).alias("rest"))
    own = _placed_pairs(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), layout).select("a", q.alias("q"))
    return own.join(other, "a", "left").agg(F.avg(-F.log(F.col("q") / (F.col("q") + F.coalesce("rest", F.lit(0.0))))).alias("contrast"))


def neighbour_energy(edges: DataFrame, pairs: DataFrame, layout: DataFrame, exaggeration: float = 1.0, weight: float = 1.0, dead_zone: float = 0.0) -> DataFrame:
    """energy of a neighbour embedding: exaggeration times the attraction, where edges shorter than dead_zone root mean squares
    of edges pull no more, and weight times the repulsion of pairs (a, b)."""
    along = _placed_pairs(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), layout)
    if dead_zone:
        unit = along.agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rms"))
        along = along.crossJoin(F.broadcast(unit)).withColumn("d", F.greatest(F.col("d") - dead_zone * F.col("rms"), F.lit(0.0)))
    pull = along.agg(F.avg(F.log1p(F.col("d") * F.col("d"))).alias("pull"))
    both = pull.crossJoin(pair_repulsion_energy(pairs, layout))  # one row each
    return both.select((exaggeration * F.col("pull") + weight * F.col("repulsion")).alias("energy"))


def _placed_pairs(pairs: DataFrame, layout: DataFrame) -> DataFrame:
    at = [layout.select(F.col("node").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y")) for c in "ab"]
    return pairs.join(at[0], "a").join(at[1], "b").select("a", "b", distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")).alias("d"))


def mean_field_rows(layout: DataFrame, columns: DataFrame, anchors: DataFrame, edges: DataFrame) -> DataFrame:
    """node, num_x, num_y, den, scale at the anchors: sums over all nodes that aren't their neighbours of w (x_j - x_i + r / d (x_i - x_j))
    and of w = r**-2, over the number of nodes. r is the hop columns' bound, 0.9 at least, times one scale, which fits distances best.

    Anchors are a bounded sample, sent to every task with their hop columns."""
    rows = layout.join(columns, "node")
    few = rows.join(anchors.select("node"), "node", "left_semi").select(F.col("node").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("hops").alias("ah"))
    bound = F.array_max(F.zip_with("ah", "hops", lambda s, t: F.abs(s.cast("int") - t.cast("int"))))
    d = F.greatest(distance(F.col("ax"), F.col("ay"), F.col("x"), F.col("y")), F.lit(1e-6))
    pairs = rows.join(F.broadcast(few)).select("a", "node", "ax", "ay", "x", "y", d.alias("d"), F.greatest(F.coalesce(bound, F.lit(0)).cast("double"), F.lit(0.9)).alias("r"))
    pairs = stored(pairs, "anchor_pairs")
    scale = pairs.agg((F.sum(F.col("d") * F.col("r")) / F.sum(F.col("r") * F.col("r"))).alias("scale"), F.countDistinct("node").alias("n"))
    near = edges.select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("node")), F.struct(F.col("dst").alias("a"), F.col("src").alias("node")))).alias("e")).select("e.*")
    others = pairs.where("a != node").join(near, ["a", "node"], "left_anti").crossJoin(F.broadcast(scale))
    r = F.col("scale") * F.col("r")
    w = 1 / (r * r)
    part = lambda c: F.sum(w * (F.col(c) - F.col("a" + c) + r / F.col("d") * (F.col("a" + c) - F.col(c)))) / F.first("n")
    return others.groupBy(F.col("a").alias("node")).agg(part("x").alias("num_x"), part("y").alias("num_y"), (F.sum(w) / F.first("n")).alias("den"), F.first("scale").alias("scale"))


def edge_terms(edges: DataFrame, rests: DataFrame, layout: DataFrame, scale: float, n: int) -> DataFrame:
    """node, num_x, num_y, den: the same sums over a node's edges with rests (src, dst, rest), exactly."""
    rows = placed_edges(edges, layout).join(rests, ["src", "dst"])
    r = F.lit(scale) * F.col("rest")
    w = 1 / (r * r)
    pull = w * (1 - r / F.greatest(distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), F.lit(1e-12)))
    gx, gy = pull * (F.col("x2") - F.col("x1")), pull * (F.col("y2") - F.col("y1"))
    each = F.explode(F.array(F.struct(F.col("src").alias("node"), gx.alias("gx"), gy.alias("gy"), w.alias("w")), F.struct(F.col("dst").alias("node"), (-gx).alias("gx"), (-gy).alias("gy"), w.alias("w"))))
    return rows.select(each.alias("e")).groupBy("e.node").agg((F.sum("e.gx") / n).alias("num_x"), (F.sum("e.gy") / n).alias("num_y"), (F.sum("e.w") / n).alias("den"))


def rescaled(layout: DataFrame, share: float = 0.98) -> DataFrame:
    """Positions about their centre, over the radius that so many of them stay within."""
    centre = layout.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    about = layout.crossJoin(F.broadcast(centre)).select("node", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))
    radius = about.agg(F.greatest(F.percentile(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")), share), F.lit(NEAR)).alias("r"))
    return about.crossJoin(F.broadcast(radius)).select("node", (F.col("x") / F.col("r")).alias("x"), (F.col("y") / F.col("r")).alias("y"))


def majorised_with(hops: DataFrame, edges: DataFrame, layout: DataFrame, local: DataFrame | None = None, edge_weight: float = 1.0, local_weight: float = 1.0) -> DataFrame:
    """node, x, y: majorisation targets from pivots, from edges (length 1) and from local pairs (a, b, d), all by the
    scale that fits the pivots best. Pivot rows pull their node only, pairs pull both ends."""
    scale = stress_of(hops, layout).select((1 / F.col("scale")).alias("unit"))
    ways = lambda df, a, b: df.select(F.explode(F.array(F.struct(F.col(a).alias("source"), F.col(b).alias("node")), F.struct(F.col(b).alias("source"), F.col(a).alias("node")))).alias("e"), "d", "w").select("e.*", "d", "w")
    rows = hops.where("d > 0").select("source", "node", F.col("d").cast("double").alias("d"), (1.0 / (F.col("d") * F.col("d"))).alias("w"))
    rows = rows.unionByName(ways(edges.withColumn("d", F.lit(1.0)).withColumn("w", F.lit(edge_weight)), "src", "dst"))
    if local is not None:
        rows = rows.unionByName(ways(local.select("a", "b", F.col("d").cast("double").alias("d")).withColumn("w", local_weight / (F.col("d") * F.col("d"))), "a", "b"))
    at = [layout.select(F.col("node").alias(c), F.col("x").alias(f"{c}_x"), F.col("y").alias(f"{c}_y")) for c in ("source", "node")]
    rows = rows.join(at[0], "source").join(at[1], "node").crossJoin(F.broadcast(scale))
    gap = F.greatest(distance(F.col("source_x"), F.col("source_y"), F.col("node_x"), F.col("node_y")), F.lit(NEAR))
    num = lambda c: F.sum(F.col("w") * (F.col(f"source_{c}") + F.col("d") * F.col("unit") / gap * (F.col(f"node_{c}") - F.col(f"source_{c}"))))
    return rows.groupBy("node").agg((num("x") / F.sum("w")).alias("x"), (num("y") / F.sum("w")).alias("y"))


def separated(layout: DataFrame, fresh: DataFrame, k: float, rounds: int = 30, cooling: float = 0.97) -> DataFrame:
    """fresh nodes pushed off each other and off those already placed, which stay: exact repulsion within 2 k, in shrinking steps."""
    for step in range(rounds):
        push = near_repulsion(layout, k, 2 * k).join(fresh.select("node"), "node", "left_semi")
        layout = stored(stepped(layout, push, 0.1 * k * cooling**step), "separated")
    return layout


def passed(edges: DataFrame, before: DataFrame, after: DataFrame, reach: float) -> DataFrame:
    """node, src, dst: nodes that came to the other side of an edge, and the edge, as all move straight from their places before to those after.

    A node can only pass an edge that is no further from it before than both move together. reach is the furthest that any node and
    edge come towards each other; it bounds what is looked at. Moves about an edge's end count where they pass its line so near to it."""
    pairs = near_segments(edges, before, reach).select("node", "src", "dst", "d")
    both = before.join(after.withColumnsRenamed({"x": "tx", "y": "ty"}), "node")
    for c, k in (("node", "p"), ("src", "a"), ("dst", "b")):
        pairs = pairs.join(both.select(F.col("node").alias(c), *(F.col(v).alias(k + v) for v in ("x", "y", "tx", "ty"))), c)
    at = lambda k, t: (F.col(f"{k}{t}x"), F.col(f"{k}{t}y"))
    side = lambda t: turn(*at("a", t), *at("b", t), *at("p", t)) > 0
    way = lambda k: distance(*at(k, ""), *at(k, "t"))
    return pairs.where((side("") != side("t")) & (F.col("d") <= way("p") + F.greatest(way("a"), way("b")) + 1e-12)).select("node", "src", "dst")


def without_passing(edges: DataFrame, before: DataFrame, after: DataFrame, reach: float, rounds: int = 6) -> DataFrame:
    """The places after, where only nodes that passed an edge are back where they were: in each round the node, or, where that didn't move, both ends
    of the edge. What still passes after so many rounds takes all moves with it."""
    for k in range(rounds + 1):
        over = stored(passed(edges, before, after, reach), "passed")
        if over.isEmpty():
            return after
        if k == rounds:
            return before
        moved = before.join(after.withColumnsRenamed({"x": "tx", "y": "ty"}), "node").where("x != tx or y != ty").select("node")
        own = over.join(moved, "node", "left_semi").select("node")
        others = over.join(moved, "node", "left_anti").select(F.explode(F.array("src", "dst")).alias("node"))
        back = stored(own.unionByName(others).distinct(), "back")
        after = stored(after.join(back, "node", "left_anti").unionByName(before.join(back, "node", "left_semi").select("node", "x", "y")), "kept")
    return after


def refined(edges: DataFrame, layout: DataFrame, gamma: float, rounds: int = 10, sectors: int = 8, cooling: float = 0.95) -> DataFrame:
    """Nodes moved off edges that they come closer to than gamma, never across one: attraction along edges, repulsion of near nodes
    and of near edges, each move cut to what the rays of its sector leave free of edges. Of a round's moves those stand that pass no edge."""
    for step in range(rounds):
        push = summed(attraction(edges, layout, gamma, "fa2"), near_repulsion(layout, gamma, 2 * gamma), edge_repulsion(edges, layout, gamma))
        free = sector_limits(edges, layout, 3 * gamma, sectors)
        rows = layout.join(push, "node", "left").withColumn("sector", sector(F.col("fx"), F.col("fy"), sectors)).join(free, ["node", "sector"], "left")
        f = F.greatest(F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy")), F.lit(1e-12))
        most = F.least(F.coalesce(F.greatest(F.col("free") - 1e-4, F.lit(0.0)), F.lit(gamma)), F.lit(gamma)) * (0.5 * cooling**step)
        share = F.coalesce(F.least(F.lit(1.0), most / f), F.lit(0.0))
        moved = stored(rows.select("node", (F.col("x") + share * F.coalesce("fx", F.lit(0.0))).alias("x"), (F.col("y") + share * F.coalesce("fy", F.lit(0.0))).alias("y")), "refined")
        layout = without_passing(edges, layout, moved, 1.01 * gamma)  # no node moves by more than a half of gamma
    return layout


def edge_repulsion(edges: DataFrame, layout: DataFrame, gamma: float) -> DataFrame:
    """node, fx, fy: (gamma - d)**2 / (gamma d) off the nearest point of each edge within gamma that isn't the node's; half of it back at the edge's ends."""
    near = near_segments(edges, layout, gamma)
    ux, uy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.least(F.greatest(((F.col("x") - F.col("x1")) * ux + (F.col("y") - F.col("y1")) * uy) / F.greatest(ux * ux + uy * uy, F.lit(1e-12)), F.lit(0.0)), F.lit(1.0))
    off = near.withColumn("dx", F.col("x") - F.col("x1") - t * ux).withColumn("dy", F.col("y") - F.col("y1") - t * uy)
    d = F.greatest(F.col("d"), F.lit(NEAR))
    size = F.pow(gamma - d, 2) / (gamma * d)
    gx, gy = size * F.col("dx"), size * F.col("dy")
    back = lambda c: F.struct(F.col(c).alias("node"), (-0.5 * gx).alias("fx"), (-0.5 * gy).alias("fy"))
    each = F.explode(F.array(F.struct("node", gx.alias("fx"), gy.alias("fy")), back("src"), back("dst")))
    return off.select(each.alias("e")).groupBy("e.node").agg(F.sum("e.fx").alias("fx"), F.sum("e.fy").alias("fy"))


def sector_limits(edges: DataFrame, layout: DataFrame, reach: float, sectors: int = 8) -> DataFrame:
    """node, sector, free: how far the ray in the middle of each sector goes before it meets an edge within reach that isn't the node's."""
    near = near_segments(edges, layout, reach)
    each = near.withColumn("sector", F.explode(F.sequence(F.lit(0), F.lit(sectors - 1))))
    angle = (F.col("sector") + 0.5) * (2 * math.pi / sectors) - math.pi
    hit = ray_segment_distance(F.col("x"), F.col("y"), F.cos(angle), F.sin(angle), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return each.withColumn("hit", hit).where("hit is not null").groupBy("node", "sector").agg(F.min("hit").alias("free"))
