"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a unit vector by floor((a . v + b) / w) for k Gaussian directions a. A query visits buckets
in the order in which they are likely to hold a neighbour: at distance d the neighbour's projection is
normal around the query's with deviation d, so each offset of each coordinate has a known chance, and the
best products are found with a heap until their sum reaches the wanted success. Distance d comes from a
bounded sample; every row is indexed.

Buckets are scanned in blocks: the rows of a bucket and the queries that visit it are each cut into runs of
at most BLOCK, and each run of rows meets each run of queries in one task. Candidates of all tables are
merged and ranked by the exact cosine.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.words import U, mix, signed
from loomgraph.llm.worker import tidy
from loomgraph.storage import drop, stored

SAMPLE = 4096
#: A length of vectors that fewer rows have needs no hashing.
FEW = 1024
BLOCK = 4096
REACH = 4


@dataclass
class Hashing:
    directions: np.ndarray  # tables x k x dimension
    shifts: np.ndarray
    width: float
    distance: float
    success: float

    def places(self, units: np.ndarray) -> np.ndarray:
        """rows x tables x k: projections in widths."""
        return np.einsum("nd,tkd->ntk", units, self.directions) / self.width + self.shifts

    def bucket(self, table: int, coords: np.ndarray) -> np.ndarray:
        h = np.full(len(coords), U(table + 1))
        with np.errstate(over="ignore"):
            for c in coords.astype(np.int64).T:
                h = mix(h * U(31) + c.view(np.uint64) if c.flags.c_contiguous else h * U(31) + np.ascontiguousarray(c).view(np.uint64))
        return h

    def probes(self, place: np.ndarray) -> list[tuple[int, ...]]:
        """Coordinates of the buckets to visit for one query in one table, likeliest first."""
        base = np.floor(place)
        each = []
        for x, b in zip(place, base, strict=True):
            edges = (b + np.arange(-REACH, REACH + 2) - x) * self.width / self.distance
            cdf = np.array([0.5 * (1 + math.erf(e / math.sqrt(2))) for e in edges])
            p = np.diff(cdf)
            each.append(sorted(zip(p.tolist(), (b + np.arange(-REACH, REACH + 1)).astype(int).tolist(), strict=True), reverse=True))
        k = len(each)
        start = (0,) * k
        heap, seen, total, out = [(-math.prod(e[0][0] for e in each), start)], {start}, 0.0, []
        while heap and total < self.success:
            p, at = heapq.heappop(heap)
            total -= p
            out.append(tuple(each[i][at[i]][1] for i in range(k)))
            for i in range(k):
                if at[i] + 1 < len(each[i]):
                    nxt = at[:i] + (at[i] + 1,) + at[i + 1 :]
                    if nxt not in seen:
                        seen.add(nxt)
                        heapq.heappush(heap, (-math.prod(each[j][nxt[j]][0] for j in range(k)), nxt))
        return out


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def fitted(sample: np.ndarray, n_rows: int, dim: int, nearest: int, tables: int, recall: float, seed: int) -> Hashing:
    """Directions, width and the neighbour distance to plan for: that which nine in ten sampled rows have to
    their nearest-th neighbour in the sample. In all rows neighbours are nearer, so plans err to the safe side."""
    rng = np.random.default_rng(seed)
    k = int(np.clip(round(math.log(max(n_rows, 1) / 1024 + 1, 4)), 3, 12))
    d = 1.0
    if len(sample) > nearest:
        u = unit(sample)
        near = np.sort(u[:256] @ u.T, 1)[:, -(nearest + 1)]
        d = float(np.quantile(np.sqrt(np.maximum(2 - 2 * near, 1e-6)), 0.9))
    directions = rng.normal(size=(tables, k, dim))
    return Hashing(directions, rng.random((tables, k)), 1.1 * max(d, 0.05), max(d, 1e-3), 1 - (1 - recall) ** (1 / tables))


def _index(h: Hashing, dim: int):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("v"), dim)
            coords = np.floor(h.places(unit(x)))
            for t in range(coords.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(signed(h.bucket(t, coords[:, t]))), b.column("id"), b.column("v")], ["bucket", "id", "v"])

    return run


def _probe(h: Hashing, dim: int):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                places = h.places(unit(_matrix(part.column("v"), dim)))
                row, bucket = [], []
                for t in range(places.shape[1]):
                    for i in range(len(places)):
                        coords = np.array(h.probes(places[i, t]))
                        bucket.append(h.bucket(t, coords))
                        row.append(np.full(len(coords), i))
                take = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(bucket))), part.column("id").take(take), part.column("v").take(take)], ["bucket", "id", "v"])

    return run


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row over a power of two near its largest number: the cosine keeps every bit, and no square over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in one order of additions whatever else is in the block."""
    a, b = scaled(a), scaled(b)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _scan(nearest: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(rows) or not len(queries):
            return none
        rows = rows.sort_values("id")
        x, q = np.stack(rows["v"]).astype(np.float64), np.stack(queries["v"]).astype(np.float64)
        ids, query_ids = rows["id"].to_numpy(), queries["id"].to_numpy()
        ux, uq = unit(x), unit(q)
        who, what = [], []
        for at in range(0, len(q), 512):
            near = uq[at : at + 512] @ ux.T
            near[query_ids[at : at + 512, None] == ids] = -2
            k = min(nearest, near.shape[1])
            least = np.partition(near, -k, axis=1)[:, -k]
            a, b = np.nonzero((near >= least[:, None] - 1e-12) & (near > -1.5))  # near ties stay
            who.append(a + at)
            what.append(b)
        who, what = np.concatenate(who), np.concatenate(what)
        return pd.DataFrame({"query_id": query_ids[who], "vec_id": ids[what], "score": exact_cosine(q[who], x[what])})

    return run


def _first_of_equals(rows: DataFrame, keep: int) -> DataFrame:
    """Of rows with one and the same vector, those with the smallest ids: no others can be among the nearest."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= keep).drop("n")


def _scanned(index: DataFrame, probes: DataFrame, nearest: int) -> DataFrame:
    """The nearest rows of each bucket to each query that visits it: query_id, vec_id, score."""

    def runs(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))

    cut = runs(index, "row_runs").join(runs(probes, "query_runs"), "bucket")

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        out = df.join(cut, "bucket").withColumn(own, F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
        return out.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select("bucket", "row_runs", "query_runs", "id", "v")

    key = ["bucket", "row_runs", "query_runs"]
    left, right = dealt(index, "row_runs", "query_runs"), dealt(probes, "query_runs", "row_runs")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(lambda a, b: _scan(nearest)(a, b), "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, nearest: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vector_col, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(finite & some).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))


def nearest_neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", query_every: int = 50, nearest: int = 5, tables: int = 2, recall: float = 0.97, seed: int = 11) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the nearest found for each row whose id query_every divides.

    Score is the cosine in double precision. Equal scores rank by the smaller id. A row is no candidate of
    its own query, but another row with an equal vector is. Vectors that are null, all zero, or hold a null
    or non-finite number take no part, nor do null ids; vectors of unlike lengths are no candidates of each
    other. Ids should be distinct; an empty table gives no rows. Each length with at least FEW rows, and the
    most frequent one, is hashed by itself; of rarer lengths all rows are one bucket. A query whose buckets give fewer than
    `nearest` rows is scanned against all rows of its length, in blocks. Extra columns are not read.
    """
    spark = vectors.sparkSession
    rows = valid_vectors(vectors, id_col, vector_col).withColumn("size", F.size("v"))
    lengths = rows.groupBy("size").agg(F.count("*").alias("n"))
    top = lengths.orderBy(F.col("n").desc(), "size").limit(1)
    often = [(r["size"], r.n) for r in lengths.where(F.col("n") >= FEW).union(top).distinct().collect()]  # at most one for each FEW rows
    if not often:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    is_query = F.pmod("id", F.lit(query_every)) == 0
    out = None
    for dim, n in sorted(often):
        same = rows.where(F.col("size") == dim).drop("size")
        picked = same.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
        h = fitted(np.array([r.v for r in picked], np.float64), n, dim, nearest, tables, recall, seed)
        part = _hashed(same, same.where(is_query), h, dim, n, nearest)
        out = part if out is None else out.unionByName(part)
    others = rows.where(~F.col("size").isin([d for d, _ in often])).select(F.col("size").cast("long").alias("bucket"), "id", "v")
    asked = others.where(is_query).select(F.col("bucket").alias("b"), F.col("id").alias("i"), F.col("v").alias("w")).toDF("bucket", "id", "v")
    return out.unionByName(_ranked(_scanned(others, asked, nearest), nearest))


def _hashed(rows: DataFrame, queries: DataFrame, h: Hashing, dim: int, n: int, nearest: int) -> DataFrame:
    """The nearest of n rows of one length to each query, by the hashing; by a scan of all where it finds too few."""
    kind = rows.schema["v"].dataType.simpleString()
    distinct = stored(_first_of_equals(rows, nearest + 1), "vectors")
    layout = f"bucket long, id long, v {kind}"
    index, probes = stored(distinct.mapInArrow(tidy(_index(h, dim)), layout), "index"), stored(queries.mapInArrow(tidy(_probe(h, dim)), layout), "probes")
    ranked = stored(_ranked(_scanned(index, probes, nearest), nearest), "ranked")
    drop(index)
    drop(probes)
    # a query whose buckets hold too few rows is scanned against all of them
    full = ranked.where(F.col("rank") == min(nearest, n - 1)).select(F.col("query_id").alias("id"))
    few = stored(queries.join(full, "id", "left_anti"), "few")
    if n == 1 or few.isEmpty():
        return ranked
    one = F.lit(0).cast("long").alias("bucket")
    rest = _ranked(_scanned(distinct.select(one, "id", "v"), few.select(one, "id", "v"), nearest), nearest)
    return ranked.join(few.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(rest)
