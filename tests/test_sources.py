"""Queries on nearest-neighbour graphs in pieces: no node and no kind is lost."""

import numpy as np
import pytest

from loomgraph.plans import registry


@pytest.fixture(scope="module")
def clusters(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    v = rng.normal(0, 1, (60, 64))
    v[30:] += 100
    folder = str(tmp_path_factory.mktemp("clusters"))
    rows = [(i, [float(x) for x in v[i]], i // 30) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


def test_majorised_stress_keeps_and_moves_every_node(spark, clusters):
    before = {r.node: (r.x, r.y) for r in registry._layout(spark, clusters).collect()}
    after = {r.node: (r.x, r.y) for r in registry.QUERIES["fit_majorised_stress"](spark, clusters).collect()}
    assert set(after) == set(range(60)) and sum(before[i] != after[i] for i in range(30, 60)) >= 29


def test_features_tell_nodes_of_every_component_apart(spark, clusters):
    g = registry._knn(spark, clusters)
    rows = registry._features(spark, clusters, g).collect()
    assert len({tuple(np.round(r.features[:-2], 6)) for r in rows if r.node >= 30}) == 30


def test_farthest_pivots_reach_every_component(spark, clusters):
    rows = registry.QUERIES["graph_farthest_pivots"](spark, clusters).collect()
    assert {r.node for r in rows} == set(range(60)) and len({r.pivot for r in rows}) == 16


def test_twins_of_both_kinds(spark, tmp_path):
    """Six equal vectors are neighbours of one another, so all are closed twins."""
    rows = [(i, [float(i // 6 * 100)] * 4, 0) for i in range(12)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {(r.node, r.kind, r.group) for r in registry.QUERIES["graph_twins_knn"](spark, str(tmp_path)).collect()}
    assert found == {(i, "closed", i // 6 * 6) for i in range(12)}
