"""Graphs that grow by a stream of edges: the places of any split into batches, batches run again, edges that change nothing."""

import os

import numpy as np
import pytest

from loomgraph.models import network
from loomgraph.operators import diffusion, edges, hops
from loomgraph.sources import graphs
from loomgraph.storage import stored
from loomgraph.streaming import growth


@pytest.fixture(scope="module")
def fitted(spark):
    """An 8 x 8 grid of which the first 48 nodes were fitted."""
    first = stored(edges.canonical(graphs.grid(spark, 8)).where("dst < 48"), "first")
    nodes = edges.nodes_of(first)
    marks = stored(hops.hashed_pivots(nodes, 12), "marks")
    potentials = stored(diffusion.diffusion(first, marks, 0.05, 8), "potentials")
    stats = stored(diffusion.moments(diffusion.feature_table(potentials, nodes, marks)), "stats")
    return growth.Fitted(network.started(12, "pivot", 0), first, potentials, marks, stats)


@pytest.fixture(scope="module")
def arriving(spark):
    """Rows of the grid that come later, edges among fitted nodes and from them to new ones, a node far from all fitted ones, one with no way to them."""
    rng = np.random.default_rng(4)
    late = [(r.src, r.dst) for r in edges.canonical(graphs.grid(spark, 8)).where("dst >= 48").collect()]
    es = late + [(0, 13), (5, 60), (3, 47), (63, 70), (70, 71), (71, 72), (90, 91)]
    return [es[i] for i in rng.permutation(len(es))]


def streamed(spark, fitted, folder, batches):
    """Run batches, one file and one trigger each, through a stream."""
    source, schema = f"{folder}/in", "src long, dst long"
    for es in batches:
        spark.createDataFrame(es, schema).coalesce(1).write.mode("append").parquet(source)
        again(spark, fitted, folder)


def again(spark, fitted, folder):
    stream = spark.readStream.schema("src long, dst long").parquet(f"{folder}/in")
    growth.grow_by_edges(stream, fitted, f"{folder}/out", f"{folder}/state").awaitTermination()


def potentials_of(df):
    return {(r.landmark, r.node): r.p for r in df.collect()}


def places_of(df):
    rows = df.collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: (r.x, r.y) for r in rows}


@pytest.fixture(scope="module")
def wanted(spark, fitted, arriving):
    """Potentials and places by the whole graph at once."""
    whole = stored(fitted.edges.unionByName(edges.canonical(spark.createDataFrame(arriving, "src long, dst long")).join(fitted.edges, ["src", "dst"], "left_anti")), "whole")
    fresh = stored(edges.new_nodes(edges.nodes_of(whole), edges.nodes_of(fitted.edges)), "fresh")
    found = stored(diffusion.placed_potentials(whole, fitted.potentials, fresh), "found")
    wide = diffusion.standard_features(diffusion.feature_table(found, fresh, fitted.landmarks), fitted.stats)
    return potentials_of(found), places_of(network.place(wide, fitted.network))


def check(spark, folder, wanted):
    assert potentials_of(growth.grown(spark, f"{folder}/out", "potentials")) == pytest.approx(wanted[0], rel=1e-9, abs=1e-15)
    got = places_of(growth.grown(spark, f"{folder}/out"))
    assert set(got) == set(wanted[1])
    for node, at in got.items():
        assert at == pytest.approx(wanted[1][node], abs=1e-6)


def test_one_batch(spark, fitted, arriving, wanted, tmp_path):
    assert {70, 71, 72, 90, 91} <= set(wanted[1]) and not any(node == 90 for _, node in wanted[0])
    streamed(spark, fitted, tmp_path, [arriving])
    check(spark, tmp_path, wanted)


def test_many_batches_and_a_batch_run_again(spark, fitted, arriving, wanted, tmp_path):
    """Split four ways, with repeated, known, turned, looped and null edges; then the last batch's commit is lost, and it runs again."""
    parts = [arriving[i::4] for i in range(4)]
    parts[1] = parts[1] + [(b, a) for a, b in parts[0]]
    parts[2] = parts[2] + [(7, 7), (None, 50), (60, None), (0, 1)] + parts[2]
    streamed(spark, fitted, tmp_path, parts)
    check(spark, tmp_path, wanted)
    n_edges = growth.grown(spark, f"{tmp_path}/out", "edges").count()
    assert n_edges == len(set(arriving))
    commits = f"{tmp_path}/state/commits"
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for f in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{commits}/{f}"):
            os.remove(f"{commits}/{f}")
    before = set(os.listdir(f"{tmp_path}/out/places/batch={last}"))
    again(spark, fitted, tmp_path)
    assert not {f for f in before if f.startswith("part-")} & set(os.listdir(f"{tmp_path}/out/places/batch={last}"))
    assert growth.grown(spark, f"{tmp_path}/out", "edges").count() == n_edges
    check(spark, tmp_path, wanted)


def test_batches_without_new_edges(spark, fitted, tmp_path):
    streamed(spark, fitted, tmp_path, [[(0, 1), (4, 4), (None, None)]])
    assert not growth.grown(spark, f"{tmp_path}/out").collect() and not growth.grown(spark, f"{tmp_path}/out", "edges").collect()
