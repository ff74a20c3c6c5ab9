"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the expected number of copies of each of its documents. Its whole part is
taken for certain; what is left is a copy probability p. Words, not documents, should meet the target, so
mass is counted in words: a document of s words holds p * s. Two documents with 0 < p < 1 meet, and one
gives the other mass until one of them is at 0 or at s; which way is drawn so that every p keeps its
expectation. The words of a source therefore change only when its very last open document is rounded.
Documents meet in chunks of a source, what a chunk leaves open (a few documents at most) meets in chunks of
chunks, and so on: a reduction tree whose groups have a fixed size however large a source is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.words import column_words
from loomgraph.llm.worker import tidy
from loomgraph.storage import stored

CHUNK = 4096
FAN_IN = 64
MOST_COPIES = 3


def with_size(rows: DataFrame, text_col: str, out: str) -> DataFrame:
    """rows with the number of words of a text column."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.LongType())])

    def run(batches):
        for b in batches:
            size = np.zeros(b.num_rows, np.int64)
            for row, to, words in column_words(b.column(text_col)):
                size[row:to] = words.counts()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(size)], [*b.schema.names, out])

    return rows.mapInArrow(tidy(run), schema)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target, from (source, size) rows.

    Sources by code point, null last, weigh the given weights, repeating. They share the sum of all sizes;
    no target passes `most` times its source's size, and what is cut off is shared by weight among the rest
    until none passes. That ends at one level t with target = min(most * size, t * weight), and t follows
    from running sums over the sources in the order in which they fill up. One row for each source is
    handled, never the documents.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    weighted = total.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place).cast("double")).withColumn("cap", most * F.col("source_size").cast("double"))
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = full.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    share = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = weighted.withColumn("share", share)
    level = level.withColumn("level", F.min(F.when(F.col("share") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "share"))).over(everything)["share"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return level.select("source", "source_size", target.alias("target"))


def _near_ends(mass: np.ndarray, size: np.ndarray) -> np.ndarray:
    near = 1e-9 * size
    return np.where(mass < near, 0.0, np.where(size - mass < near, size, mass))


def pivot(size: np.ndarray, mass: np.ndarray, draws: np.ndarray, last: bool = True) -> np.ndarray:
    """The mass of each document after all met in turn.

    Documents meet two by two, largest first. One that is more than twice as large as all that are left would stay
    open to the end, for none of them can fill or empty it. So it meets all of them at once: it gains what it
    lacks from them, or gives them what it has, in fixed shares that none of them is too small for. Where they
    hold too little together for that, it stays open for a larger group to round. In the last group there is
    none, and it goes the way that is possible: here alone the words of the source come before the document's
    expectation. At most one document then stays open, else one for each doubling of the size.
    draws: two for each document.
    """
    mass, n = mass.copy(), len(size)
    order = np.argsort(-size, kind="stable")
    held, met_all = -1, False
    for place, i in enumerate(order.tolist()):
        if not 0 < mass[i] < size[i]:
            continue
        if held < 0:
            held, met_all = i, False
            continue
        if 2 * size[i] < size[held] and not met_all:
            rest = order[place:]
            rest = rest[(mass[rest] > 0) & (mass[rest] < size[rest])]
            has, room = mass[rest], size[rest] - mass[rest]
            lacks, gives = size[held] - mass[held], mass[held]
            share = np.minimum(has / lacks, room / gives)
            gains = draws[n + i] * size[held] < gives
            if share.sum() >= 1:
                share /= share.sum()
                moved = -share * lacks if gains else share * gives
            elif not last:
                held = i
                continue
            elif has.sum() >= lacks and (gains or room.sum() < gives):
                gains, moved = True, -has / has.sum() * lacks
            elif room.sum() >= gives:
                gains, moved = False, room / room.sum() * gives
            else:
                moved = None
            if moved is not None:
                mass[rest] = _near_ends(has + moved, size[rest])
                mass[held] = size[held] if gains else 0.0
                held, met_all = (i, False) if 0 < mass[i] < size[i] else (-1, False)
                continue
            met_all = True
        up, down = min(size[held] - mass[held], mass[i]), min(size[i] - mass[i], mass[held])
        # gaining `up` with probability down / (up + down) leaves each expectation as it was
        to, source, moved = (held, i, up) if draws[i] * (up + down) < down else (i, held, down)
        fills, empties = moved == size[to] - mass[to], moved == mass[source]
        mass[to] = size[to] if fills else mass[to] + moved
        mass[source] = 0.0 if empties else mass[source] - moved
        before, held = held, next((x for x in (i, held) if 0 < mass[x] < size[x]), -1)
        met_all = met_all and held == before
    return mass


def _round_group(seed: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # large documents first: the one that stays open is then likely a small one
        pdf = pdf.sort_values(["size", "id", "mass", "h", "n"], ascending=[False, True, False, True, True], na_position="last").reset_index(drop=True)
        # the draws follow from the group's own ids, whatever order its rows came in
        names = pd.util.hash_pandas_object(pdf[["id", "size", "h", "n"]], index=False).to_numpy()
        rng = np.random.default_rng([seed, int(pdf["level"].iloc[0]), int(np.bitwise_xor.reduce(names * np.uint64(3) + np.arange(len(names), dtype=np.uint64)))])
        size = pdf["size"].to_numpy(np.float64)
        mass = pivot(size, pdf["mass"].to_numpy(np.float64), rng.random(2 * len(pdf)), last)
        is_open = (mass > 0) & (mass < size)
        if last and is_open.any():
            i = int(np.flatnonzero(is_open)[0])
            mass[i] = size[i] if rng.random() * size[i] < mass[i] else 0.0
            is_open[i] = False
        pdf["mass"] = mass
        pdf["open"] = is_open
        return pdf

    return run


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with n, which tells equal ones apart: they are counted, and written again one by one in runs, so that no
    task gathers them and every number is the same in a rerun."""
    each = rows.groupBy(*rows.columns).agg((F.count("*") - 1).alias("last"))
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"last div {CHUNK}")))
    dealt = each.withColumn("run", run).repartition("h", "run")
    upto = F.least("last", (F.col("run") + 1) * CHUNK - 1)
    return dealt.select(*rows.columns, F.explode(F.sequence(F.col("run") * CHUNK, upto)).alias("n"))


def pivotal_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), seed: int = 7, key_col: str | None = None) -> DataFrame:
    """One row for each row of docs: id, source, size (words), source_size, target (its source's), copies, taken.

    taken is copies * size. Size counts runs of other than ASCII white space; a null or empty text has size
    0 and takes nothing, and a source of only such texts has target 0. Null ids and repeated rows are rows like any others.
    Reruns over the same rows agree. Extra columns of docs are not read, but key_col is carried along.
    """
    key = ["key"] if key_col else []
    rows = docs.select(F.col(id_col).alias("id"), *(F.col(key_col).alias(k) for k in key), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    sized = stored(with_size(rows, "text", "size").select("id", *key, "source", "size", F.xxhash64("text").alias("h")), "sizes")
    targets = source_targets(sized)
    counts = sized.groupBy("source").agg(F.ceil(F.count("*") / CHUNK).cast("long").alias("chunks"))
    per_source = stored(targets.join(counts, targets.source.eqNullSafe(counts.source)).drop(counts.source), "targets")
    most = per_source.agg(F.max("chunks")).first()[0] or 1
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST_COPIES)))).otherwise(F.lit(0.0))
    joined = _numbered(sized).join(per_source.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # copies that are whole but for rounding errors are whole
    joined = joined.withColumn("ratio", F.when(F.abs(ratio - F.round(ratio)) < 1e-12, F.round(ratio)).otherwise(ratio))
    state = joined.select(
        "id", *key, "source", "size", "h", "n", "source_size", "target", "chunks",
        F.floor("ratio").cast("long").alias("whole"),
        ((F.col("ratio") - F.floor("ratio")) * F.col("size")).alias("mass"),
        F.pmod(F.xxhash64("id", *key, "size", "h", "n"), F.col("chunks")).alias("chunk"),
        F.lit(0).alias("level"), F.lit(True).alias("open"),
    )
    done = []
    level = 0
    while True:
        last = most == 1
        grouped = state.groupBy("source", "chunk").applyInPandas(_round_group(seed, last), state.schema)
        state = stored(grouped, f"round{level}")
        done.append(state.where("not open"))
        if last:
            break
        level += 1
        most = -(-most // FAN_IN)
        chunks = F.ceil(F.col("chunks") / FAN_IN).cast("long")
        state = state.where("open").select("id", *key, "source", "size", "h", "n", "source_size", "target", chunks.alias("chunks"), "whole", "mass", F.expr(f"chunk div {FAN_IN}").alias("chunk"), F.lit(level).alias("level"), "open")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = F.col("whole") + F.when((F.col("size") > 0) & (F.col("mass") >= F.col("size")), 1).otherwise(0)
    return out.select(F.col("id").alias(id_col), *(F.col(k).alias(key_col) for k in key), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
