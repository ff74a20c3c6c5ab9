"""Comparing methods over graphs and seeds: cells, ranks and significance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.special import chi_square_tail, student_two_sided

#: Fixed: studentised range at 5 % over sqrt(2), for 2 to 12 methods.
NEMENYI = (1.960, 2.343, 2.569, 2.728, 2.850, 2.949, 3.031, 3.102, 3.164, 3.219, 3.268)


def cells(scores: DataFrame) -> DataFrame:
    """graph, method: mean and sample deviation (0 for one seed) of value, and the number of seeds."""
    return scores.groupBy("graph", "method").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"), F.count("value").alias("seeds"))


def mean_ranks(table: DataFrame, smaller_is_better: bool = True) -> DataFrame:
    """graph, method, rank: ties share the mean of their places. Graphs where a method is missing are left out."""
    methods = table.select("method").distinct().agg(F.count("*").alias("k"))
    whole = table.where("value is not null").groupBy("graph").agg(F.countDistinct("method").alias("n")).join(F.broadcast(methods), F.col("n") == F.col("k")).select("graph")
    v = F.col("value") if smaller_is_better else -F.col("value")
    by = Window.partitionBy("graph")
    tied = F.count("*").over(Window.partitionBy("graph", "value"))
    return table.join(whole, "graph", "left_semi").withColumn("rank", F.rank().over(by.orderBy(v)) + (tied - 1) / 2.0).select("graph", "method", "rank")


def friedman(ranks: DataFrame) -> DataFrame:
    """statistic (with the correction for ties), n graphs, k methods, p."""
    ties = ranks.groupBy("graph", "rank").agg(F.count("*").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    sums = ranks.groupBy("method").agg(F.sum("rank").alias("r"), F.count("*").alias("n")).agg(F.sum(F.col("r") * F.col("r")).alias("q"), F.count("*").alias("k"), F.max("n").alias("n"))
    n, k = F.col("n"), F.col("k")
    plain = 12.0 / (n * k * (k + 1)) * F.col("q") - 3.0 * n * (k + 1)
    stat = plain / (1 - F.col("ties") / (n * (k * k * k - k)))
    tail = F.udf(lambda x, k: None if x is None or k < 2 else chi_square_tail(float(x), int(k) - 1), T.DoubleType())
    return sums.crossJoin(ties).select(stat.alias("statistic"), "n", "k").withColumn("p", tail("statistic", "k"))  # one row


def critical_difference(k: int, n: int) -> float:
    """Mean ranks further apart than this differ at 5 %."""
    return NEMENYI[k - 2] * (k * (k + 1) / (6 * n)) ** 0.5


def marked(table: DataFrame, digits: int = 3, smaller_is_better: bool = True) -> DataFrame:
    """graph, method, mean, mark: 'best' and 'second', values that round alike sharing the mark."""
    v = F.col("mean") if smaller_is_better else -F.col("mean")
    by = Window.partitionBy("graph")
    half = 0.5 * 10**-digits
    first = F.min(v).over(by)
    rows = table.withColumn("v", v).withColumn("first", first)
    second = F.min(F.when(F.col("v") > F.col("first") + half, F.col("v"))).over(by)
    mark = F.when(F.col("v") <= F.col("first") + half, "best").when(F.col("v") <= F.col("second") + half, "second")
    return rows.withColumn("second", second).select("graph", "method", "mean", mark.alias("mark"))


def paired(scores: DataFrame, one: str, other: str) -> DataFrame:
    """graph, n, t, p of the paired differences of two methods over seeds; null where fewer than three or all alike."""
    a, b = (scores.where(F.col("method") == m).select("graph", "seed", F.col("value").alias(c)) for m, c in ((one, "a"), (other, "b")))
    d = a.join(b, ["graph", "seed"]).select("graph", (F.col("a") - F.col("b")).alias("d"))
    stats = d.groupBy("graph").agg(F.count("*").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s"))
    t = F.when((F.col("n") >= 3) & (F.col("s") > 0), F.col("m") / (F.col("s") / F.sqrt(F.col("n").cast("double"))))
    tail = F.udf(lambda t, n: None if t is None else student_two_sided(float(t), int(n) - 1), T.DoubleType())
    return stats.select("graph", "n", t.alias("t")).withColumn("p", tail("t", "n"))


def overall_ranks(ranks: DataFrame) -> DataFrame:
    """method, rank, place: the mean over metrics of the mean over graphs, from (metric, graph, method, rank), and the order it gives."""
    each = ranks.groupBy("metric", "method").agg(F.avg("rank").alias("rank")).groupBy("method").agg(F.avg("rank").alias("rank"))
    return each.withColumn("place", F.row_number().over(Window.orderBy("rank", "method")))  # a row for each method


def selected(cells: DataFrame, by: str, *keys: str) -> DataFrame:
    """For each value of the keys the row whose column `by` is least; of equals the one with the smallest remaining columns."""
    rest = [c for c in cells.columns if c not in (*keys, by)]
    return cells.where(F.col(by).isNotNull()).groupBy(*keys).agg(F.min(F.struct(by, *rest)).alias("best")).select(*keys, "best.*")


def node_split(nodes: DataFrame, n_train: int, held_share: float = 0.2, n_outside: int = 1000, seed: int = 0) -> DataFrame:
    """node, part: 'train', 'held' (of the training nodes a share whose hops no fit sees) and 'outside' (at most so many of the rest; of the training nodes where there is no rest)."""
    order = nodes.select("node").distinct().orderBy(F.xxhash64(F.lit(seed), "node"), "node")
    train = order.limit(n_train)
    marked = train.withColumn("part", F.when(F.pmod(F.xxhash64(F.lit(seed + 1), "node"), F.lit(1000)) < int(1000 * held_share), "held").otherwise("train"))
    rest = nodes.select("node").distinct().join(train, "node", "left_anti")
    outside = (train if rest.isEmpty() else rest).orderBy(F.xxhash64(F.lit(seed + 2), "node"), "node").limit(n_outside)
    return marked.unionByName(outside.withColumn("part", F.lit("outside")))
