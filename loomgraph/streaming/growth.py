"""Graphs that grow: edges from an event stream, and places of new nodes as they arrive."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.models.network import CoordinateNetwork, place
from loomgraph.operators.diffusion import feature_table, placed_potentials, standard_features
from loomgraph.operators.edges import ball, canonical, new_nodes, nodes_of
from loomgraph.storage import Scratch, exists, stored

#: What a growing graph's folder holds, in folders named by batch.
TABLES = {"edges": "src long, dst long", "potentials": "landmark long, node long, p double", "places": "node long, x double, y double"}


def windowed_activity(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events and distinct users (estimated) by window and type; events later than the watermark are dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users")).select(F.col("window.start").alias("since"), "event_type", "n", "users")


def place_arrivals(features: DataFrame, network: CoordinateNetwork, path: str, checkpoint: str) -> StreamingQuery:
    """Place each node of a stream of (node, features) once; nodes that already have a place keep it.

    A batch that is run again finds its nodes placed, so retries write nothing twice."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        placed = spark.read.schema("node long, x double, y double").parquet(path) if exists(spark, path) else None
        fresh = batch.dropDuplicates(["node"])
        if placed is not None:
            fresh = fresh.join(new_nodes(fresh.select("node"), placed), "node", "left_semi")
        place(fresh, network).write.mode("append").parquet(path)

    return features.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@dataclass
class Fitted:
    """A network and what it was fitted on: edges as canonical() gives them, potentials (landmark, node, p), landmarks, and moments of the features."""

    network: CoordinateNetwork
    edges: DataFrame
    potentials: DataFrame
    landmarks: DataFrame
    stats: DataFrame
    alpha: float = 0.05
    rounds: int = 2


def grow_by_edges(arrivals: DataFrame, fitted: Fitted, path: str, checkpoint: str, tie_dim: int = 0, seed: int = 0) -> StreamingQuery:
    """Place the new nodes of a stream of edges (src, dst) from their neighbours alone; fitted nodes keep their potentials and places.

    Edges, potentials and places are written to a folder for each batch. An edge changes the degrees of its ends, so a batch places anew what is new within
    `rounds` hops of its edges, from all edges that came so far. Any split of the stream into batches ends with the same potentials: those of placed_potentials()
    on the whole graph. A batch that is run again reads only what came before it and overwrites its own folders, so nothing is placed twice.
    Edges that are known, come twice, are loops or have a null end change nothing. There is no watermark, since no edge is too late to count.
    A batch reads the table of edges once for each hop; a hub among its ends means placing all the hub's new neighbours, as their weights change.
    A checkpoint belongs to one folder."""
    known = stored(nodes_of(fitted.edges), "fitted")

    def write(batch: DataFrame, number: int) -> None:
        spark, kept = batch.sparkSession, Scratch()
        have = fitted.edges.select("src", "dst").unionByName(_read(spark, path, "edges").where(F.col("batch") < number).select("src", "dst"))
        new = kept.stored(canonical(batch).join(have, ["src", "dst"], "left_anti"), "arrivals")
        _write(new, path, "edges", number)
        grown = have.unionByName(new)
        fresh = kept.stored(new_nodes(ball(grown, nodes_of(new), fitted.rounds, kept.stored), known), "fresh")
        around = ball(grown, fresh, fitted.rounds, kept.stored)
        near = kept.stored(_touching(grown, around), "near")
        potentials = fitted.potentials.join(around, "node", "left_semi")
        found = placed_potentials(near, potentials, new_nodes(around, known), fitted.alpha, fitted.rounds, kept.stored)
        found = kept.stored(found.join(fresh, "node", "left_semi").select("landmark", "node", "p"), "found")
        _write(found, path, "potentials", number)
        wide = standard_features(feature_table(found, fresh, fitted.landmarks), fitted.stats, tie_dim, seed=seed)
        _write(place(wide, fitted.network), path, "places", number)
        kept.drop()

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def grown(spark: SparkSession, path: str, table: str = "places") -> DataFrame:
    """What grow_by_edges() wrote to a folder: all edges, or of potentials or places the last of each node."""
    rows = _read(spark, path, table)
    if table == "edges":
        return rows.drop("batch")
    last = rows.groupBy("node").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["node", "batch"], "left_semi").drop("batch")


def _touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end among nodes, each once."""
    first, second = nodes.select(F.col("node").alias("src")), nodes.select(F.col("node").alias("dst"))
    return edges.join(first, "src", "left_semi").unionByName(edges.join(second, "dst", "left_semi").join(first, "src", "left_anti"))


def _read(spark: SparkSession, path: str, table: str) -> DataFrame:
    schema = f"{TABLES[table]}, batch long"
    return spark.read.schema(schema).parquet(f"{path}/{table}") if exists(spark, f"{path}/{table}") else spark.createDataFrame([], schema)


def _write(df: DataFrame, path: str, table: str, number: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{table}/batch={number}")
