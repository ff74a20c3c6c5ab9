"""Graphs as node and edge tables: readers, generators and graphs derived from relational tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.arrays import squared_distance
from loomgraph.functions.draws import uniform
from loomgraph.operators.edges import canonical
from loomgraph.storage import replaced, stored

#: Rows whose products with a block are held at once, and pairs whose distances are.
STRIP, PAIRS = 256, 1 << 15


def edge_list(spark: SparkSession, path: str, sep: str = " ", comment: str = "#") -> DataFrame:
    """src, dst from text with two ids a line; compressed files are read as they are."""
    return canonical(spark.read.csv(path, sep=sep, comment=comment, schema="src long, dst long"))


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """src, dst from a sparse matrix file: after % comments and the line of sizes (the first that is no comment), a row and a column a line. Values are ignored."""
    lines = spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.select(F.monotonically_increasing_id().alias("i"), parts.alias("p"))
    first = rows.agg(F.min("i").alias("first"))
    body = rows.join(F.broadcast(first), rows.i != F.col("first")).select(F.col("p")[0].cast("long").alias("src"), F.col("p")[1].cast("long").alias("dst"))
    return canonical(body)


def citations(spark: SparkSession, content: str, cites: str) -> tuple[DataFrame, DataFrame]:
    """nodes (id, label) and edges (src, dst as text ids) of a citation dump; pairs with unknown ids are dropped."""
    words = F.split(F.trim("value"), r"\s+")
    nodes = spark.read.text(content).where(F.trim("value") != "").select(words[0].alias("id"), F.element_at(words, -1).alias("label"))
    pairs = spark.read.text(cites).where(F.size(words) >= 2).select(words[0].alias("src"), words[1].alias("dst"))
    known = nodes.select("id")
    pairs = pairs.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes, pairs.where("src != dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def grid(spark: SparkSession, side: int) -> DataFrame:
    nodes = spark.range(side * side).select(F.col("id").alias("src"))
    right = nodes.where(F.col("src") % side < side - 1).select("src", (F.col("src") + 1).alias("dst"))
    return right.union(nodes.where(F.col("src") < side * (side - 1)).select("src", (F.col("src") + side).alias("dst")))


def balanced_tree(spark: SparkSession, branching: int, depth: int) -> DataFrame:
    n = sum(branching**k for k in range(depth + 1))
    return spark.range(1, n).select(F.expr(f"(id - 1) div {branching}").alias("src"), F.col("id").alias("dst"))


def random_tree(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Each node but the first hangs on an earlier one drawn by hash (a recursive tree, not a uniform one)."""
    return spark.range(1, n).select(F.floor(uniform("id", seed=seed) * F.col("id")).cast("long").alias("src"), F.col("id").alias("dst"))


def _block_rows(sizes: list[int], inside: float, across: float, seed: int):
    bounds = np.cumsum([0, *sizes])

    def run(batches):
        for b in batches:
            for i in b["id"].tolist():
                rng, own = np.random.default_rng([seed, i]), int(np.searchsorted(bounds, i, "right")) - 1
                later = []
                for block in range(own, len(sizes)):
                    lo, hi = max(i + 1, int(bounds[block])), int(bounds[block + 1])
                    n = int(rng.binomial(max(hi - lo, 0), inside if block == own else across))
                    later.append(lo + rng.choice(hi - lo, n, replace=False) if n else np.zeros(0, np.int64))
                to = np.concatenate(later)
                yield pd.DataFrame({"src": np.full(len(to), i), "dst": to})

    return run


def block_model(spark: SparkSession, sizes: list[int], inside: float, across: float, seed: int = 0) -> DataFrame:
    """Communities of the given sizes; every two nodes are linked by a chance that depends on whether they share one.

    A node draws how many later nodes of each community it is linked with, then which, so that the work grows with the edges, not with the pairs."""
    return spark.range(sum(sizes)).mapInPandas(_block_rows(sizes, inside, across, seed), "src long, dst long")


def rewired_ring(spark: SparkSession, n: int, k: int, chance: float, seed: int = 0) -> DataFrame:
    """Each node linked with its k // 2 next ones; an end moves by the given chance. Loops and repeats fall out."""
    each = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(k // 2))).alias("step"))
    moved = F.floor(uniform("src", "step", seed=seed + 1) * n).cast("long")
    return canonical(each.select("src", F.when(uniform("src", "step", seed=seed) < chance, moved).otherwise((F.col("src") + F.col("step")) % n).alias("dst")))


def with_extra_edges(edges: DataFrame, n_nodes: int, extra: int, seed: int = 0) -> DataFrame:
    """The edges and `extra` random pairs that are none yet, drawn by hash."""
    draws = edges.sparkSession.range(4 * extra + 16).select(F.floor(uniform("id", F.lit(0), seed=seed) * n_nodes).cast("long").alias("src"), F.floor(uniform("id", F.lit(1), seed=seed) * n_nodes).cast("long").alias("dst"))
    new = canonical(draws).join(edges, ["src", "dst"], "left_anti").orderBy(F.xxhash64(F.lit(seed), "src", "dst"), "src", "dst").limit(extra)
    return edges.select("src", "dst").unionByName(new)


def _nearest_in_blocks(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "q": np.zeros(0)})
        x, y = (np.stack(d["v"]).astype(np.float64) for d in (left, right))
        a, b, out = left["id"].to_numpy(), right["id"].to_numpy(), []
        for at in range(0, len(x), 32):
            q = ((x[at : at + 32, None] - y) ** 2).sum(2)
            q[a[at : at + 32, None] == b] = np.inf
            for i, row in enumerate(q):
                near = np.lexsort((b, row))[:k]
                near = near[np.isfinite(row[near])]
                out.append(pd.DataFrame({"a": a[at + i], "b": b[near], "q": row[near]}))
        return pd.concat(out)

    return run


def _matrix_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, without those that hold a null or no finite number."""
    v = rows["v"].combine_chunks()
    width = len(v[0]) if len(v) else 0
    if not pa.compute.all(pa.compute.equal(pa.compute.list_value_length(v), width), min_count=0).as_py():
        raise ValueError("vectors of several lengths")
    x, ids = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), width), rows["id"].to_numpy()
    fine = np.isfinite(x).all(1)
    return ids[fine], x[fine]


def _first_of_equals(ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Which rows are among the `most` smallest ids of those with the same vector."""
    _, same = np.unique((np.ascontiguousarray(x) + 0.0).view(np.dtype((np.void, max(1, x.itemsize * x.shape[1])))).ravel(), return_inverse=True) if x.shape[1] else (None, np.zeros(len(x), int))
    order = np.lexsort((ids, same))
    starts = np.flatnonzero(np.r_[True, np.diff(same[order]) != 0])
    place = np.arange(len(x)) - np.repeat(starts, np.diff(np.r_[starts, len(x)]))
    return np.sort(order[place < most])


def _nearest_of(k: int, a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """a, b, q: the k nearest rows of y to each row of x by (squared distance, id), itself left out.

    Products of matrices in single precision tell which rows can be among them, with room for all that rounding may do; the distances of these are then taken
    exactly. Of equal vectors only the first k + 1 by id can be, so that copies make no square of candidates."""
    kept = _first_of_equals(b, y, k + 1)
    b, y = b[kept], y[kept]
    centre = y.mean(0)
    unit = max(np.abs(x - centre).max(initial=0), np.abs(y - centre).max(initial=0)) or 1.0
    near, far = (((v - centre) / unit).astype(np.float32) for v in (x, y))
    room = np.float32((x.shape[1] + 16) * 2.5e-7)
    nx, ny = (np.einsum("ij,ij->i", v, v) for v in (near, far))
    far, groups, out = np.ascontiguousarray(far.T) * np.float32(-2), max(64, 4 * (k + 1)), []
    for at in range(0, len(x), STRIP):
        some = slice(at, at + STRIP)
        part = near[some] @ far
        if len(y) <= k + 1:
            i, j = np.nonzero(np.ones(part.shape, bool))
        else:
            high = part + ny * (1 + room)
            width = len(y) // groups
            if width > 3:  # the least of some parts can't be less than the least of all
                high = high[:, : groups * width].reshape(len(part), groups, width).min(2)
            most = np.partition(high, k, 1)[:, k] + 2 * room * nx[some] + np.float32(1e-37)
            part += ny * (1 - room)
            i, j = np.divmod(np.flatnonzero(part <= most[:, None]), part.shape[1])
        q = np.concatenate([((x[at + i[c : c + PAIRS]] - y[j[c : c + PAIRS]]) ** 2).sum(1) for c in range(0, len(i), PAIRS)] or [np.zeros(0)])
        ok = (a[at + i] != b[j]) & np.isfinite(q)
        i, j, q = i[ok], j[ok], q[ok]
        order = np.lexsort((b[j], q, i))
        i, j, q = i[order], j[order], q[order]
        first = np.searchsorted(i, np.arange(len(part)))
        best = np.arange(len(i)) - first[i] < k
        out.append((a[at + i[best]], b[j[best]], q[best]))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def _met(k: int):
    """a, b, q of a group that holds one block of vectors, or two."""

    def run(rows: pa.Table) -> pa.Table:
        lo, hi = rows["lo"][0].as_py(), rows["hi"][0].as_py()
        blocks = [_matrix_of(rows.filter(pa.compute.equal(rows["own"], o))) for o in sorted({lo, hi})]
        pairs = [(blocks[0], blocks[0])] if lo == hi else [(blocks[0], blocks[1]), (blocks[1], blocks[0])]
        found = [_nearest_of(k, *one, *other) for one, other in pairs if len(one[0]) and len(other[0])]
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({n: pa.array(c) for n, c in zip("abq", columns, strict=True)})

    return run


def knn_graph(vectors: DataFrame, k: int, id_col: str, vector_col: str, block: int = 8192) -> DataFrame:
    """Each vector with its k nearest by Euclidean distance (ties to smaller ids), both directions joined.

    Exact: each two blocks of at most about so many vectors meet in one group, and only the k best of a block leave it. Null ids and vectors take no part."""
    rows = stored(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null"), "vectors")
    n = rows.count()
    blocks = max(1, -(-n // block), min(8, -(-n // 256)))
    own, every = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = rows.select("id", "v", own.alias("own"), every.alias("other")).select("id", "v", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    met = dealt.repartition(blocks * (blocks + 1) // 2, "lo", "hi").groupBy("lo", "hi")
    best = met.applyInArrow(_met(k), "a long, b long, q double")
    near = best.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("q", "b"))).where(F.col("rank") <= k)
    return canonical(near, "a", "b")


def place_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions (from 1), their nations (from 100) and their customers (from 1000) as a forest."""
    nation, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "customer"))
    up = nation.select((F.col("n_regionkey") + 1).cast("long").alias("src"), (F.col("n_nationkey") + 100).cast("long").alias("dst"))
    return up.union(customer.select((F.col("c_nationkey") + 100).cast("long").alias("src"), (F.col("c_custkey") + 1000).cast("long").alias("dst")))


def suppliers_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers (below 0) and the parts that they delivered."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return canonical(lines.select((-F.col("l_suppkey") - 1).alias("src"), F.col("l_partkey").alias("dst")))


def users_in_turn(events: DataFrame) -> DataFrame:
    """src, dst, first, n: users of consecutive events of one type, since when and how often.

    Events lie in ranges of (type, time), each looked through by itself; a range's first event of a type looks back to the last one of
    an earlier range. So no task holds all events of a type."""
    ranged = stored(events.select("event_type", "ts", "event_id", "user_id").repartitionByRange("event_type", "ts", "event_id").withColumn("part", F.spark_partition_id()), "events")
    inside = Window.partitionBy("part", "event_type").orderBy("ts", "event_id")
    steps = ranged.withColumn("before", F.lag("user_id").over(inside)).withColumn("begins", F.row_number().over(inside) == 1)
    ends = ranged.groupBy("part", "event_type").agg(F.max_by("user_id", F.struct("ts", "event_id")).alias("end"))
    back = ends.withColumn("earlier", F.lag("end").over(Window.partitionBy("event_type").orderBy("part"))).select("part", "event_type", "earlier")  # a row for each range
    linked = steps.join(back, ["part", "event_type"]).withColumn("before", F.when(F.col("begins"), F.col("earlier")).otherwise(F.col("before"))).where("before != user_id")
    return linked.groupBy(F.least("before", "user_id").alias("src"), F.greatest("before", "user_id").alias("dst")).agg(F.min("ts").alias("first"), F.count("*").alias("n"))


def labelled_vectors(spark: SparkSession, vectors: str, labels: str, label: str = "Cluster") -> DataFrame:
    """node, v, label from two CSV files with headers whose first column names a row: components of a vector, and a class in the column `label`."""
    rows, classes = (spark.read.csv(p, header=True) for p in (vectors, labels))
    name, *parts = rows.columns
    wide = rows.select(F.col(f"`{name}`").alias("node"), F.array(*(F.col(f"`{c}`").cast("float") for c in parts)).alias("v"))
    return wide.join(classes.select(F.col(f"`{classes.columns[0]}`").alias("node"), F.col(f"`{label}`").cast("short").alias("label")), "node", "left")


def scattered_points(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("node"), uniform("id", F.lit(0), seed=seed).alias("x"), uniform("id", F.lit(1), seed=seed).alias("y"))


def _cell_neighbours(width: float):
    """src, dst: whose region of nearest places, within the unit square, a point of the task's own cells borders on.

    A point's region is the square cut by its bisector with each other point, nearest first, until no further point can
    reach the region. Points too near the edge of what the task knows to tell come out with dst -1."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["own"]]
        ids, at = pdf["node"].to_numpy(), pdf[["x", "y"]].to_numpy()
        lo, hi = np.array([own["cx"].iloc[0], own["cy"].iloc[0]]) * width - pdf["halo"].iloc[0] * width, None
        hi = lo + (2 * pdf["halo"].iloc[0] + 1) * width
        src, dst = [], []
        for node, p in zip(own["node"], own[["x", "y"]].to_numpy(), strict=True):
            region, by = np.array([[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]), [-1] * 4  # by[k]: who made the side from corner k on
            far = np.sqrt(((at - p) ** 2).sum(1))
            for k in np.argsort(far, kind="stable"):
                if ids[k] == node:
                    continue
                if far[k] > 2 * np.sqrt(((region - p) ** 2).sum(1).max()):
                    break
                side = (region - (at[k] + p) / 2) @ (at[k] - p)  # positive: nearer to the other
                if (side <= 0).all():
                    continue
                corners, makers = [], []
                for i in range(len(region)):
                    j = (i + 1) % len(region)
                    if side[i] <= 0:
                        corners.append(region[i])
                        makers.append(by[i])
                    if (side[i] <= 0) != (side[j] <= 0):
                        corners.append(region[i] + side[i] / (side[i] - side[j]) * (region[j] - region[i]))
                        makers.append(int(ids[k]) if side[i] <= 0 else by[i])
                region, by = np.array(corners), makers
            reach = 2 * np.sqrt(((region - p) ** 2).sum(1).max())
            room = min(np.where(lo <= 0, np.inf, p - lo).min(), np.where(hi >= 1, np.inf, hi - p).min())
            found = [-1] if reach > room else sorted({m for m in by if m >= 0})
            src += [int(node)] * len(found)
            dst += found
        return pd.DataFrame({"src": np.array(src, np.int64), "dst": np.array(dst, np.int64)})

    return run


def triangulated(points: DataFrame, n: int) -> DataFrame:
    """src, dst: points (node, x, y in the unit square) whose regions of nearest places border on one another within the square: the
    Delaunay triangulation, less edges along the hull that only meet outside.

    Each cell of about 16 points is worked on with the cells around it; the few that need to see further are worked on again with more."""
    side = max(1, int((n / 16) ** 0.5))
    width, halo, out = 1.0 / side, 2, None
    cell = lambda c: F.least(F.floor(F.col(c) * side), F.lit(side - 1)).cast("int")
    points = stored(points.select("node", "x", "y", cell("x").alias("cx"), cell("y").alias("cy")), "points")
    todo = points.select("cx", "cy").distinct()
    while True:
        around = lambda c: F.explode(F.sequence(F.col(c) - halo, F.col(c) + halo))
        seen = todo.select(F.col("cx").alias("tx"), F.col("cy").alias("ty"), around("cx").alias("cx"), "cy").select("tx", "ty", "cx", around("cy").alias("cy"))
        own = (F.col("cx") == F.col("tx")) & (F.col("cy") == F.col("ty"))
        rows = points.join(seen, ["cx", "cy"]).select("tx", "ty", "node", "x", "y", F.col("tx").alias("cx"), F.col("ty").alias("cy"), own.alias("own"), F.lit(halo).alias("halo"))
        found = stored(rows.groupBy("tx", "ty").applyInPandas(_cell_neighbours(width), "src long, dst long"), "triangles")
        sure = found.where("dst >= 0")
        out = sure if out is None else out.union(sure)
        todo = stored(points.join(found.where("dst < 0").select(F.col("src").alias("node")), "node", "left_semi").select("cx", "cy").distinct(), "todo")
        if halo >= side or todo.isEmpty():
            return canonical(out)
        halo *= 2


def delaunay(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    return triangulated(scattered_points(spark, n, seed), n)


def nearly_planar(spark: SparkSession, n: int, extra: int | None = None, seed: int = 0) -> DataFrame:
    """A triangulation with some random edges more, one for twelve nodes by default."""
    return with_extra_edges(delaunay(spark, n, seed), n, max(1, n // 12) if extra is None else extra, seed)


#: Graphs by name; each is made by its size and a seed.
NAMED = {
    "grid": lambda spark, n, seed: grid(spark, max(1, round(n**0.5))),
    "tree": random_tree,
    "delaunay": delaunay,
    "nearly_planar": lambda spark, n, seed: nearly_planar(spark, n, None, seed),
    "sbm": lambda spark, n, seed: block_model(spark, [n // 3] * 3, 0.12, 0.008, seed),
    "ring": lambda spark, n, seed: rewired_ring(spark, n, 6, 0.02, seed),
    "balanced_tree": lambda spark, n, seed: balanced_tree(spark, 3, max(1, round(np.log(2 * n + 1) / np.log(3)) - 1)),
}


def named_graph(spark: SparkSession, name: str, seed: int = 0) -> DataFrame:
    """The largest component of a graph named kind_size ('grid_400'), its nodes numbered from 0."""
    from loomgraph.operators.edges import induced, largest_component, relabelled

    kind, size = name.rsplit("_", 1)
    if kind not in NAMED:
        raise ValueError(f"no graph {name}")
    edges = stored(NAMED[kind](spark, int(size), seed), "graph")
    nodes = stored(largest_component(edges), "component")
    return relabelled(induced(edges, nodes), nodes)[1]


def scaling_graphs(spark: SparkSession, sizes: list[int], seed: int = 0) -> dict[int, DataFrame]:
    return {n: delaunay(spark, n, seed) for n in sizes}


def _best(candidates: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("a").orderBy("q", "b")
    return candidates.groupBy("a", "b").agg(F.min("q").alias("q")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("a", "b", "q")


def near_graph(vectors: DataFrame, k: int, id_col: str, vector_col: str, tables: int = 4, rounds: int = 2, block: int = 1024, seed: int = 5) -> DataFrame:
    """As knn_graph, nearly: vectors meet only in buckets of a few random hyperplanes' signs, drawn several times, and then, in some rounds,
    with the neighbours of their neighbours. The work grows with the number of vectors; recall is what tests measure.

    A bucket of more than `block` vectors is dealt out by hash, so no task holds more than about so many. Of a node that many hold for their
    neighbour only 3 k partners, by hash, are tried in a round; knn_graph tries all. Vectors have neighbours of their own length."""
    rows = stored(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null"), "vectors")
    sizes = [r.d for r in rows.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()]  # one for each length
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "src long, dst long")
    out = None
    for dim in sizes:
        one = canonical(_near_of_length(rows.where(F.size("v") == dim), dim, k, tables, rounds, block, seed), "a", "b")
        out = one if out is None else out.unionByName(one)
    return out


def _near_of_length(rows: DataFrame, dim: int, k: int, tables: int, rounds: int, block: int, seed: int) -> DataFrame:
    """a, b, q: about the k nearest of each vector (id, v) among those of the same length."""
    n = rows.count()
    bits = max(0, int(np.ceil(np.log2(n / block * 2)))) if n > block else 0
    centre = np.array(rows.agg(*(F.avg(F.col("v")[i]) for i in range(dim))).first(), np.float64)
    planes = np.random.default_rng(seed).normal(size=(tables, bits, dim))

    def bucketed(batches):
        for b in batches:
            if b.num_rows:
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, dim) - centre
                signs = np.einsum("nd,tbd->ntb", x, planes) > 0
                name = (signs << np.arange(bits)).sum(2) if bits else np.zeros((len(x), tables), np.int64)
                for t in range(tables if bits else 1):
                    yield pa.RecordBatch.from_arrays([pa.array(name[:, t] * tables + t), b.column("id"), b.column("v")], ["bucket", "id", "v"])

    kind = rows.schema["v"].dataType.simpleString()
    dealt = stored(rows.mapInArrow(bucketed, f"bucket long, id long, v {kind}"), "buckets")
    runs = dealt.groupBy("bucket").agg(F.ceil(F.count("*") / (2 * block)).cast("int").alias("runs"))
    dealt = dealt.join(runs, "bucket").withColumn("run", F.pmod(F.xxhash64("id"), F.col("runs")))
    near = stored(_best(dealt.groupBy("bucket", "run").applyInPandas(lambda x: _nearest_in_blocks(k)(x, x), "a long, b long, q double"), k), "near")
    for _ in range(rounds if bits else 0):
        both = near.select("a", "b").union(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        # of a node that many hold for their neighbour, only so many partners are tried
        few = both.withColumn("i", F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("a", "b")))).where(F.col("i") <= 3 * k).drop("i")
        tried = near.select("a", F.col("b").alias("m")).join(few.select(F.col("a").alias("m"), "b"), "m").where("a != b").select("a", "b").distinct().join(near, ["a", "b"], "left_anti")
        va, vb = rows.select(F.col("id").alias("a"), F.col("v").alias("va")), rows.select(F.col("id").alias("b"), F.col("v").alias("vb"))
        more = tried.join(va, "a").join(vb, "b").select("a", "b", squared_distance(F.col("va"), F.col("vb")).alias("q"))
        near = stored(_best(near.unionByName(more), k), "near")
    return near


def save(layout: DataFrame, path: str, *keys: str) -> None:
    """Layouts as Parquet, one folder for each value of the keys, taking the place of what is there once they are written."""
    replaced(layout, path, lambda w, to: w.partitionBy(*keys).parquet(to))


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_scores(scores: DataFrame, path: str) -> None:
    """Scores as JSON, a line each, taking the place of what is there once they are written."""
    replaced(scores, path, lambda w, to: w.json(to))
