"""Ranks within groups of any size and joins by keys of any size, without a task that one group fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.storage import Scratch

#: A key of one in so many rows is broadcast in counted_join(); there are no more such keys than this.
HEAVY = 1024


def ranked(scratch: Scratch, df: DataFrame, keys: list[str], order: list[str], keep: list[Column | str]) -> DataFrame:
    """keep, then rank (long, from 0, among the rows of equal keys, nulls first) and n_rows (of those keys).

    Rows are dealt by ranges of keys and order, so that a group of any size is spread; a range's place follows from
    the counts of the ranges before it. Rows that are equal in both are spread too and numbered in any order. df must be
    the same on each reading (read from files, or stored). The keys must be in keep."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, *order, "_tie"]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    rows = scratch.stored(dealt.select(*keep, F.monotonically_increasing_id().alias("_at")), "dealt").withColumn("_part", F.shiftright("_at", 33))
    runs = rows.groupBy("_part", *keys).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    group = Window.partitionBy(*keys)  # a row for each range that the group lies in
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (before - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias("n_rows"))
    runs = scratch.stored(runs, "runs")
    same = rows._part == runs._p
    for i, k in enumerate(keys):
        same = same & rows[k].eqNullSafe(runs[f"_k{i}"])
    names = [c for c in rows.columns if c not in ("_at", "_part")]
    return rows.join(runs, same).select(*names, (F.col("_at") + F.col("_shift")).alias("rank"), "n_rows")


def counted_join(rows: DataFrame, values: DataFrame, keys: list[str], n: str) -> DataFrame:
    """rows joined with values, which have one row for each key and in n how many rows have it.

    Keys that at least one in HEAVY of these rows have are at most HEAVY: they are broadcast. No other key fills a
    task, so the rest is a plain join. Both tables are read twice, so they should be stored."""
    total = values.agg(F.sum(n)).first()[0] or 0
    heavy = values.where(F.col(n) * HEAVY >= total).drop(n)
    light = values.where(F.col(n) * HEAVY < total).drop(n)
    return rows.join(F.broadcast(heavy), keys).unionByName(rows.join(F.broadcast(heavy.select(keys)), keys, "left_anti").join(light, keys))
