"""Operators, sources and networks against plain definitions on small graphs, and on skewed ones."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.models import kernel, network
from loomgraph.operators import communities, diffusion, distributions, edges, energies, hops, linear, metrics, pairs, ranking, spatial
from loomgraph.sources import graphs
from loomgraph.storage import Scratch, stored
from loomgraph.streaming import growth


def rows_of(spark, arrays, name="v"):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(arrays)], f"node long, {name} array<double>")


def layout_of(spark, at):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "node long, x double, y double")


def edges_of(spark, es):
    return spark.createDataFrame([(int(a), int(b)) for a, b in es], "src long, dst long")


def array_of(df, *cols):
    return np.array([[r[c] for c in cols] for r in df.orderBy("node").collect()], np.float64)


def gaps(at):
    return np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))


@pytest.fixture(scope="module")
def grid(spark):
    """A 9 x 9 grid, its hops from 20 pivots in columns, and the distances among all nodes."""
    g = stored(graphs.grid(spark, 9), "grid")
    columns, ordinals = hops.numbered_columns(g, hops.hashed_pivots(edges.nodes_of(g), 20))
    at = np.array([(i % 9, i // 9) for i in range(81)])
    return g, columns, ordinals, np.abs(at[:, None] - at[None]).sum(2)


def test_principal_axes(spark):
    x = np.random.default_rng(0).normal(size=(50, 6)) * [5, 3, 1, 1, 1, 0.1]
    v = array_of(linear.placed_by_axes(linear.principal(rows_of(spark, x), "v")), "x", "y")
    c = x - x.mean(0)
    want = c @ np.linalg.svd(c, full_matrices=False)[2][:2].T
    assert np.allclose(np.abs(v), np.abs(want)) and np.allclose(gaps(v), gaps(want))


def test_scaling_by_pivots_and_landmarks(spark, grid):
    g, columns, ordinals, d = grid
    pivots = [r.source for r in ordinals.orderBy("ordinal").collect()]
    sq = d[:, pivots].astype(float) ** 2
    c = -0.5 * (sq - sq.mean(0) - sq.mean(1, keepdims=True) + sq.mean())
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(gaps(array_of(linear.placed_by_axes(linear.pivot_scaling(columns)), "x", "y")), gaps(u[:, :2] * s[:2]), atol=1e-6)
    block = sq[pivots]
    gram = -0.5 * (block - block.mean(0) - block.mean(1, keepdims=True) + block.mean())
    w, v = np.linalg.eigh(gram)
    w, v = w[::-1][:2], v[:, ::-1][:, :2]
    want = -0.5 * (sq - block.mean(1)) @ (v / np.sqrt(w))
    want[pivots] = v * np.sqrt(w)
    assert np.allclose(gaps(array_of(linear.placed_by_axes(linear.landmark_scaling(columns, ordinals)), "x", "y")), gaps(want), atol=1e-6)
    wide = np.array([r.v for r in linear.pivot_embedding(columns, 5).orderBy("node").collect()])
    assert np.allclose(wide.mean(0), 0, atol=1e-6) and np.allclose(wide.std(0), 1, atol=1e-4)
    every, every_ordinal = hops.numbered_columns(g, edges.nodes_of(g))
    classical = array_of(linear.placed_by_axes(linear.landmark_scaling(every, every_ordinal)), "x", "y")
    full = d.astype(float) ** 2
    w, v = np.linalg.eigh(-0.5 * (full - full.mean(0) - full.mean(1, keepdims=True) + full.mean()))
    assert np.allclose(gaps(classical), gaps(v[:, ::-1][:, :2] * np.sqrt(w[::-1][:2])), atol=1e-6)
    eight = np.array([r.v for r in linear.hop_principal(columns).orderBy("node").collect()])
    assert eight.shape == (81, 8) and abs(np.sqrt((eight**2).mean()) - 1) < 1e-6


def test_registration(spark):
    at = np.random.default_rng(1).normal(size=(40, 2))
    turn = np.array([[math.cos(1), math.sin(1)], [-math.sin(1), math.cos(1)]])
    to = 3 * at @ turn + [5, -2]
    matrix, shift, r2 = linear.procrustes(layout_of(spark, at), layout_of(spark, to))
    assert np.allclose(array_of(linear.moved(layout_of(spark, at), matrix, shift), "x", "y"), to) and r2 == pytest.approx(1)
    bent = at @ np.array([[2.0, 1.0], [0.5, -1.0]]) + [1, 1]
    assert np.allclose(array_of(linear.moved(layout_of(spark, at), *linear.affine(layout_of(spark, at), layout_of(spark, bent))), "x", "y"), bent)
    assert linear.procrustes(layout_of(spark, at), layout_of(spark, np.random.default_rng(2).normal(size=(40, 2))))[2] < 0.5


def test_far_pairs_and_negatives(spark, grid):
    g, columns, _, d = grid
    far = pairs.far_pairs(columns).collect()
    assert len(far) > 50 and all(r.a < r.b and 3.5 <= r.bound <= d[r.a, r.b] for r in far)
    three = {(r.a, r.b) for r in pairs.three_hop_pairs(g).collect()}
    assert three == {(a, b) for a in range(81) for b in range(a + 1, 81) if d[a, b] == 3}
    near = edges.two_hop_pairs(g).select("a", "b")
    negatives = pairs.hard_negatives(near, edges.nodes_of(g), 81).collect()
    assert len(negatives) == 81 * 8 and all(0 <= r.negative < 81 for r in negatives)
    for n in (0, 40):
        own = [r.negative for r in negatives if r.node == n]
        assert sum(d[n, x] == 2 for x in own) >= min(8, (d[n] == 2).sum())
    assert pairs.capped(near, 10).count() == 10 and pairs.capped(near, 10).collect() == pairs.capped(near.repartition(3), 10).collect()
    samples = {}
    for r in pairs.nested_samples(edges.nodes_of(g), [5, 20]).collect():
        samples.setdefault(r["count"], set()).add(r.node)
    assert len(samples[5]) == 5 and len(samples[20]) == 20 and samples[5] < samples[20]
    assert pairs.diffusion_steps(g, 0) == 36


def test_communities_of_two_cliques(spark):
    es = [(a, b) for base in (0, 10) for a in range(base, base + 8) for b in range(a + 1, base + 8)] + [(7, 10)]
    labels = {r.node: r.label for r in pairs.communities(edges_of(spark, es)).collect()}
    assert len({labels[i] for i in range(8)}) == 1 and len({labels[i] for i in range(10, 18)}) == 1 and labels[0] != labels[10]


def test_tangent_frames_of_a_flat_sheet(spark, grid):
    g = grid[0]
    sheet = rows_of(spark, [[i % 9, (i // 9) * 0.7, 0, 0.0] for i in range(81)])
    frames = {r.node: (np.array(r.u), np.array(r.v)) for r in pairs.tangent_frames(g, sheet, 0, 4).collect()}
    assert len(frames) == 81
    for u, v in frames.values():
        assert abs(u @ v) < 1e-9 and np.allclose([u @ u, v @ v], 1) and np.allclose(u[2:], 0) and np.allclose(v[2:], 0)
    assert all(frames[0][0] @ u > 0.9 for n, (u, _) in frames.items() if 0 < n % 9 < 8 and 0 < n // 9 < 8)


def test_features_fall_back_to_hops(spark, grid):
    g, _, _, d = grid
    nodes, marks = edges.nodes_of(g), spark.createDataFrame([(0,), (80,)], "node long")
    block = diffusion.feature_block(g, nodes, marks, steps=16)
    assert {len(r.features) for r in block.collect()} == {2} and block.count() == 81
    far = edges_of(spark, [(i, i + 1) for i in range(9)] + [(100 + 2 * i, 101 + 2 * i) for i in range(1500)])
    long = diffusion.feature_block(far, edges.nodes_of(far), spark.createDataFrame([(0,), (1,)], "node long"), steps=2)
    assert {tuple(r.features) for r in long.where("node in (5, 7)").collect()} == {(5.0, 4.0), (7.0, 6.0)}
    wide = diffusion.assembled(g, nodes, marks, steps=4, probe_dim=32, tie_dim=2).collect()
    assert {len(r.features) for r in wide} == {2 + 30 + 2}
    assert np.allclose(np.mean([r.features[:32] for r in wide], 0), 0, atol=1e-6)


def test_triangulation_is_delaunay(spark):
    points = graphs.scattered_points(spark, 70, 3)
    got = {(r.src, r.dst) for r in graphs.triangulated(points, 70).collect()}
    at = array_of(points, "x", "y")
    want = set()
    for a in range(70):
        for b in range(a + 1, 70):
            for c in range(b + 1, 70):
                m = np.array([at[b] - at[a], at[c] - at[a]])
                if abs(np.linalg.det(m)) < 1e-12:
                    continue
                o = at[a] + np.linalg.solve(2 * m, (m**2).sum(1))
                q = ((at - o) ** 2).sum(1)
                if (np.delete(q, [a, b, c]) > q[a]).all():
                    want |= {(a, b), (b, c), (a, c)}
    assert got <= want and len(got) > 0.85 * len(want)
    assert spatial.crossings(edges_of(spark, got), points).count() == 0
    assert edges.largest_component(edges_of(spark, got)).count() == 70


def test_generated_and_named_graphs(spark):
    e = graphs.block_model(spark, [60, 60], 0.3, 0.02, 1).collect()
    inside = sum((r.src < 60) == (r.dst < 60) for r in e)
    assert len({(r.src, r.dst) for r in e}) == len(e) and all(r.src < r.dst < 120 for r in e)
    assert abs(inside - 0.3 * 2 * 60 * 59 / 2) < 120 and abs(len(e) - inside - 0.02 * 3600) < 40
    for name, n in (("grid_49", 49), ("tree_50", 50), ("balanced_tree_40", 40), ("nearly_planar_48", 48)):
        g = stored(graphs.named_graph(spark, name), "named")
        assert sorted(r.node for r in edges.nodes_of(g).collect()) == list(range(n))
    with pytest.raises(ValueError):
        graphs.named_graph(spark, "moebius_10")
    ring = graphs.rewired_ring(spark, 100, 6, 0.02)
    assert 270 <= ring.count() <= 300 and list(graphs.scaling_graphs(spark, [30])) == [30]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# c\n1 2\n2 1\n3 3\n2 3\n")
    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n% c\n3 3 2\n1 2 5\n3 2 1\n")
    (tmp_path / "c.content").write_text("p1 0 1 A\np2 1 0 B\n")
    (tmp_path / "c.cites").write_text("p1 p2\np2 p1\np1 p9\nx\n")
    (tmp_path / "v.csv").write_text("id,PC1,PC2\na,1.5,2\nb,0,1\n")
    (tmp_path / "l.csv").write_text("id,Cluster\nb,3\na,4\n")
    assert sorted(map(tuple, graphs.edge_list(spark, str(tmp_path / "e.txt")).collect())) == [(1, 2), (2, 3)]
    assert sorted(map(tuple, graphs.matrix_market(spark, str(tmp_path / "m.mtx")).collect())) == [(1, 2), (2, 3)]
    nodes, cites = graphs.citations(spark, str(tmp_path / "c.content"), str(tmp_path / "c.cites"))
    assert sorted(map(tuple, nodes.collect())) == [("p1", "A"), ("p2", "B")] and list(map(tuple, cites.collect())) == [("p1", "p2")]
    assert sorted((r.node, list(r.v), r.label) for r in graphs.labelled_vectors(spark, str(tmp_path / "v.csv"), str(tmp_path / "l.csv")).collect()) == [("a", [1.5, 2.0], 4), ("b", [0.0, 1.0], 3)]
    at = layout_of(spark, [(0, 1), (2, 3)]).withColumn("graph", F.lit("g"))
    graphs.save(at, str(tmp_path / "layouts"), "graph")
    graphs.save_scores(at.select("x"), str(tmp_path / "scores"))
    assert graphs.load(spark, str(tmp_path / "layouts")).where("graph = 'g'").count() == 2 and spark.read.json(str(tmp_path / "scores")).count() == 2


def test_near_graph_recall(spark):
    x = np.random.default_rng(4).normal(size=(1500, 8))
    v = rows_of(spark, x)
    exact = {(r.src, r.dst) for r in graphs.knn_graph(v, 5, "node", "v").collect()}
    found = {(r.src, r.dst) for r in graphs.near_graph(v, 5, "node", "v", block=256).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_users_in_turn_of_one_type(spark):
    rows = [(i, i * 7 % 1000, i % 13) for i in range(1000)]
    events = spark.createDataFrame([(e, t, u, "view") for e, t, u in rows], "event_id long, ts long, user_id long, event_type string").repartition(7)
    want = {}
    order = sorted((t, e, u) for e, t, u in rows)
    for (_, _, a), (t, _, b) in zip(order, order[1:], strict=False):
        if a != b:
            first, n = want.get((min(a, b), max(a, b)), (t, 0))
            want[min(a, b), max(a, b)] = (min(first, t), n + 1)
    assert {(r.src, r.dst): (r["first"], r.n) for r in graphs.users_in_turn(events).collect()} == want


@pytest.mark.parametrize("kind", ["outlier", "cluster", "equal"])
def test_plane_joins_with_skew(spark, kind):
    at = np.random.default_rng(6).random((120, 2))
    if kind == "outlier":
        at[0] = [1e3, -1e3]
    elif kind == "cluster":
        at[:90] = 0.5 + at[:90] * 1e-5
    else:
        at[:30] = 0.25
    layout = layout_of(spark, at)
    near = {(r.a, r["rank"]): r.b for r in spatial.nearest_points(layout, layout, 4).collect()}
    d = gaps(at)
    np.fill_diagonal(d, np.inf)
    assert near == {(i, k + 1): int(j) for i in range(120) for k, j in enumerate(np.lexsort((np.arange(120), d[i]))[:4])}
    es = [(i, i + 1) for i in range(119)] + [(0, 60)]
    g = edges_of(spark, es)
    left = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]) > 0
    cross = sum(len({a, b, c, e}) == 4 and left(at[a], at[b], at[c]) != left(at[a], at[b], at[e]) and left(at[c], at[e], at[a]) != left(at[c], at[e], at[b]) for i, (a, b) in enumerate(es) for c, e in es[:i])
    assert spatial.crossings(g, layout).count() == cross
    got = {r.node: r.clearance for r in spatial.clearances(g, layout).collect()}
    for n in range(0, 120, 7):
        best = math.inf
        for a, b in es:
            if n not in (a, b):
                u = at[b] - at[a]
                t = min(max(((at[n] - at[a]) @ u) / max(u @ u, 1e-12), 0), 1)
                best = min(best, float(np.hypot(*(at[n] - at[a] - t * u))))
        assert got[n] == pytest.approx(best, abs=1e-9)


def test_two_hops_through_a_hub(spark):
    g = edges_of(spark, [(0, i) for i in range(1, 60)] + [(1, 2)])
    assert edges.two_hop_pairs(g).count() == 59 * 58 // 2 - 1
    assert edges.two_hop_pairs(g, cap_per_node=3).groupBy("a").count().agg(F.max("count")).first()[0] == 3


def test_forces_bring_energy_down_and_keep_nodes(spark, grid):
    g = grid[0]
    at = metrics.scattered(edges.nodes_of(g), 1)
    before, after = (energies.force_energy(g, x, 0.2).first().energy for x in (at, energies.force_layout(g, at, 0.2, rounds=6, pull=0.01)))
    assert after < before
    for law in ("linlog", "fa2"):
        assert energies.force_layout(g, at, 0.2, law, rounds=1).count() == 81
    bounds = spark.createDataFrame([(0, 1, 4.0), (0, 2, 1.0)], "a long, b long, bound double")
    few = layout_of(spark, [(0, 0), (1, 0), (0, 2)])
    r = energies.repulsion(few, spark.createDataFrame([(0,)], "node long"), 1.0, bounds=bounds).first()
    assert (r.fx, r.fy) == pytest.approx((-1.6, -0.2))


def sides(at, es):
    """Side and position along each edge of each node that isn't its end."""
    out = {}
    for a, b in es:
        u = at[b] - at[a]
        for v in range(len(at)):
            if v not in (a, b):
                w = at[v] - at[a]
                out[v, a, b] = (u[0] * w[1] - u[1] * w[0] > 0, 0 <= w @ u <= u @ u)
    return out


def passing(es, before, after):
    one, two = sides(before, es), sides(after, es)
    return {k for k in one if one[k][0] != two[k][0] and (one[k][1] and two[k][1])}


def test_refinement_passes_no_edge(spark):
    rng = np.random.default_rng(4)
    at = rng.random((30, 2))
    es = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, 30, (40, 2)) if a != b})
    g, layout = edges_of(spark, es), layout_of(spark, at)
    after = stored(energies.refined(g, layout, 0.05, rounds=2), "refined")
    to = array_of(after, "x", "y")
    assert plain_crossings(to, es) == plain_crossings(at, es) and not passing(es, at, to) and np.abs(to - at).max() > 1e-3


def test_only_nodes_that_pass_an_edge_go_back(spark):
    """Random moves of all nodes: nothing changes sides, and nodes far from any change keep their move."""
    rng = np.random.default_rng(12)
    at = np.array([(i % 8, i // 8) for i in range(64)], float) + rng.normal(size=(64, 2)) * 0.05
    es = [(i, i + 1) for i in range(63) if i % 8 < 7] + [(i, i + 8) for i in range(56)]
    to = at + rng.normal(size=(64, 2)) * 0.01
    to[9], to[27] = at[18] + 0.3, at[27] + [1.2, 0.1]
    g = edges_of(spark, es)
    assert plain_crossings(to, es) and passing(es, at, to)
    got = array_of(energies.without_passing(g, layout_of(spark, at), layout_of(spark, to), 4.0), "x", "y")
    assert plain_crossings(got, es) == plain_crossings(at, es) and not passing(es, at, got)
    kept = (got == to).all(1)
    far = np.min([np.hypot(*(at - p).T) for p in (at[9], at[27], to[9], to[27])], 0) > 2.5
    assert far.sum() > 20 and kept[far].all() and not kept[9] and not kept[27] and ((got == at).all(1) | kept).all()


def plain_modularity(es, label):
    m, inside, size = 2 * len(es), {}, {}
    for a, b in es:
        for u in (a, b):
            size[label[u]] = size.get(label[u], 0) + 1
        if label[a] == label[b]:
            inside[label[a]] = inside.get(label[a], 0) + 2
    return sum(inside.get(c, 0) / m - (s / m) ** 2 for c, s in size.items())


def partitions(n):
    """All labelings of n nodes by blocks."""
    def grow(prefix, top):
        if len(prefix) == n:
            yield prefix
            return
        for c in range(top + 1):
            yield from grow([*prefix, c], max(top, c + 1))

    yield from grow([0], 1)


def test_modularity_of_small_graphs_is_the_best(spark):
    ring = [(3 * k + a, 3 * k + b) for k in range(3) for a, b in ((0, 1), (1, 2), (0, 2))] + [(2, 3), (5, 6), (0, 8)]
    bridge = [(a, b) for a in range(4) for b in range(a)] + [(a, b) for a in range(4, 8) for b in range(4, a)] + [(3, 4)]
    for es, n in ((ring, 9), (bridge, 8)):
        g = edges_of(spark, [(min(e), max(e)) for e in es])
        found = {r.node: r.label for r in communities.modularity_communities(g).collect()}
        best = max(plain_modularity(es, p) for p in partitions(n))
        assert plain_modularity(es, found) == pytest.approx(best)
        labels = spark.createDataFrame(list(found.items()), "node long, label long")
        assert communities.modularity(g, labels).first().modularity == pytest.approx(best)


def test_modularity_on_a_block_model(spark):
    g = stored(edges.canonical(graphs.block_model(spark, [40, 40, 40], 0.3, 0.02, 1)), "blocks")
    es = [(r.src, r.dst) for r in g.collect()]
    spread = {r.node: r.label for r in pairs.communities(g).collect()}
    found = {r.node: r.label for r in communities.modularity_communities(g).collect()}
    assert set(found) == set(spread) and plain_modularity(es, found) >= plain_modularity(es, spread) - 1e-9
    assert plain_modularity(es, found) >= plain_modularity(es, {n: n // 40 for n in found}) - 0.02
    assert communities.modularity_communities(g.limit(0)).collect() == []


def test_newcomers_leave_the_others_in_place(spark):
    layout = layout_of(spark, [(0, 0), (1, 1), (0.001, 0), (0, 0.001)])
    fresh = spark.createDataFrame([(2,), (3,)], "node long")
    at = array_of(energies.separated(layout, fresh, 0.5, rounds=10), "x", "y")
    assert at[:2].tolist() == [[0, 0], [1, 1]] and gaps(at)[2, 3] > 0.05 and gaps(at)[0, 2] > 0.05


def test_split_selection_and_steps(spark):
    nodes = spark.range(400).select(F.col("id").alias("node"))
    parts = {}
    for r in ranking.node_split(nodes, 100, n_outside=50).collect():
        parts.setdefault(r.part, set()).add(r.node)
    assert len(parts["train"] | parts["held"]) == 100 and 5 <= len(parts["held"]) <= 40 and len(parts["outside"]) == 50
    assert not parts["outside"] & (parts["train"] | parts["held"])
    assert {r.part for r in ranking.node_split(nodes, 400).collect()} == {"train", "held", "outside"}
    line = spark.createDataFrame([(lam, n, lam**2 * n, 0.0) for lam in (0.0, 0.25, 0.5, 0.75, 1.0) for n in (1, 2)], "lam double, node long, x double, y double")
    assert metrics.equal_steps(line, 3) == [0.0, 0.75, 1.0]
    assert ranking.critical_difference(3, 10) == pytest.approx(2.343 * math.sqrt(12 / 60))
    rows = [("g", s, m, v) for s, (a, b) in enumerate([(1.0, 2.0), (2.0, 3.5), (3.0, 4.1), (4.0, 5.2)]) for m, v in (("a", a), ("b", b))]
    got = ranking.paired(spark.createDataFrame(rows, "graph string, seed int, method string, value double"), "a", "b").first()
    assert got.t == pytest.approx(-11.0, abs=0.2) and got.p == pytest.approx(0.0016, abs=0.0005)


@pytest.mark.parametrize("kind", ["tanh", "gelu", "relu", "sine", "finer", "gabor"])
@pytest.mark.parametrize("film", [False, True])
def test_gradients_of_networks(kind, film):
    shape, rng = kernel.Shape(5, hidden=9, activation=kind, film=film, modulator=7), np.random.default_rng(3)
    p = [w + 0.05 * rng.normal(size=w.shape) for w in shape.start(1)]
    x, d = rng.normal(size=(6, 5)), rng.normal(size=(6, 2))
    out, kept = shape.forward(p, x, 0.3)
    for w, g in zip(p, shape.backward(p, kept, d), strict=True):
        for i in (0, w.size // 2, w.size - 1):
            old, h = w.flat[i], 1e-6
            w.flat[i] = old + h
            up = (shape.forward(p, x, 0.3)[0] * d).sum()
            w.flat[i] = old - h
            down = (shape.forward(p, x, 0.3)[0] * d).sum()
            w.flat[i] = old
            assert g.flat[i] == pytest.approx((up - down) / (2 * h), rel=1e-3, abs=1e-5)


def test_gradients_of_energies():
    rng = np.random.default_rng(5)
    pos, es = rng.normal(size=(7, 2)), np.array([(0, 1), (1, 2), (3, 6)])
    for f in (lambda q: kernel.stress_gradient(q, np.array([0, 0, 2]), np.array([1, 3, 6]), np.array([1.0, 2.0, 3.0])), lambda q: kernel.neighbour_gradient(q, es, np.array([(0, 4), (5, 2)]), 2.0)):
        g = f(pos)[1]
        for i in range(14):
            step = np.zeros(14)
            step[i] = 1e-6
            assert g.flat[i] == pytest.approx((f(pos + step.reshape(7, 2))[0] - f(pos - step.reshape(7, 2))[0]) / 2e-6, abs=1e-6)
    s = np.linalg.svd(kernel.orthogonal(rng.normal(size=(20, 9))))[1]
    assert s.min() > 0.5 and s.max() < 1.3


@pytest.fixture(scope="module")
def features(spark, grid):
    g = grid[0]
    return stored(diffusion.assembled(g, edges.nodes_of(g), hops.hashed_pivots(edges.nodes_of(g), 24), steps=20), "features")


def test_networks_learn_a_grid(spark, grid, features):
    """All nodes and edges teach, in one batch or in several."""
    g, columns, ordinals, d = grid
    far = spark.createDataFrame([(i, j, int(d[i, j])) for i in range(81) for j in range(81)], "source long, node long, d int")
    for energy, plan, most, least in (("pivot", network.Plan(rounds=4), 0.02, 0.9), ("neighbour", network.Plan(rounds=6, muon=True, exaggeration=4.0), 0.06, 0.6)):
        at = stored(network.fit_transform(features, g, energy, columns=columns, ordinals=ordinals, plan=plan), "places")
        assert metrics.stress(far, at).first().stress < most and metrics.neighbour_scores(g, at).first().np_jaccard > least
    blend = network.fit(features, g, "blend", columns, ordinals, network.Plan(rounds=4, steps=30, lam_values=(0.0, 1.0)))
    family = stored(network.family(features, blend, [0.0, 1.0]), "family")
    scores = {r.lam: r.stress for r in metrics.family_scores(g, far, family).collect()}
    assert scores[0.0] < 0.1 and blend.scales != (1.0, 1.0)
    with pytest.raises(ValueError):
        network.fit(features, g, "gravity")


def test_several_partitions_agree_on_one_network(spark, grid, features, monkeypatch):
    g, columns, ordinals, d = grid
    monkeypatch.setattr(network, "PARTITION_ROWS", 60)
    far = spark.createDataFrame([(i, j, int(d[i, j])) for i in range(81) for j in range(81)], "source long, node long, d int")
    rows = network.learning_table(features, g, columns)
    assert rows.rdd.getNumPartitions() > 1 and rows.count() == 81 + 144
    at = network.fit_transform(features, g, "pivot", columns=columns, ordinals=ordinals, plan=network.Plan(rounds=8, steps=30))
    assert metrics.stress(far, at).first().stress < 0.03


def test_mean_field_majorisation_lowers_stress(spark, grid, features):
    g, columns, ordinals, d = grid
    far = spark.createDataFrame([(i, j, int(d[i, j])) for i in range(81) for j in range(81)], "source long, node long, d int")
    start = linear.placed_by_axes(linear.pivot_scaling(columns))
    net = network.fit_mean_field(features, g, columns, rounds=4)
    assert metrics.stress(far, network.place(features, net)).first().stress < min(0.05, metrics.stress(far, start).first().stress + 0.01)


def test_a_grown_graph_moves_old_nodes_little(spark, grid, features):
    g, columns, ordinals, _ = grid
    net = network.fit(features, g, "pivot", columns, ordinals, network.Plan(rounds=3))
    old = stored(network.place(features.where("node < 60"), net), "old")
    after = network.place(features, network.partial_fit(net, features, g, old, columns, ordinals))
    both = old.join(after.withColumnsRenamed({"x": "nx", "y": "ny"}), "node")
    moved = both.agg(F.max(F.hypot(F.col("x") - F.col("nx"), F.col("y") - F.col("ny")))).first()[0]
    assert moved < 0.25 * both.agg(F.max("x") - F.min("x")).first()[0]


def test_arrivals_are_placed_once(spark, grid, features, tmp_path):
    g, columns, ordinals, _ = grid
    net = network.fit(features, g, "pivot", columns, ordinals, network.Plan(rounds=1))
    source = str(tmp_path / "in")
    for part in ("node < 50", "node < 81"):
        features.where(part).write.mode("append").parquet(source)
        growth.place_arrivals(spark.readStream.schema(features.schema).parquet(source), net, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.node for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(81))


def test_windowed_activity(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    stream = growth.windowed_activity(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")))
    stream.writeStream.format("memory").queryName("activity").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    want = {(r.since, r.event_type): r.n for r in events.groupBy(F.date_trunc("day", "ts").cast("timestamp").alias("since"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert {(r.since, r.event_type): r.n for r in spark.table("activity").collect()} == want


def test_placed_features_and_distances(spark):
    path = edges_of(spark, [(0, 1), (1, 2), (2, 3)])
    known = spark.createDataFrame([(0, 0, 0), (0, 1, 1)], "source long, node long, d int")
    fresh = spark.createDataFrame([(2,), (3,)], "node long")
    assert sorted((r.node, r.d) for r in hops.placed_distances(path, known, fresh).collect()) == [(2, 2), (3, 3)]
    p = spark.createDataFrame([(0, 1, 0.5)], "landmark long, node long, p double")
    got = {r.node: r.p for r in diffusion.placed_potentials(path, p, fresh, 0.05).collect()}
    assert got[2] == pytest.approx(0.95 * 0.5 / 2) and got[3] == pytest.approx(0.95 * (0.95 * 0.5 / 2) / math.sqrt(2))


def test_scratch_tables_go(spark):
    import os

    scratch = Scratch()
    one, two = (scratch.stored(spark.range(5), "scratch") for _ in range(2))
    files = [f.removeprefix("file://") for f in one.inputFiles()], [f.removeprefix("file://") for f in two.inputFiles()]
    scratch.drop(one)
    assert not any(map(os.path.exists, files[0])) and two.count() == 5
    scratch.drop()
    assert not any(map(os.path.exists, files[1]))


def test_components_over_many_rounds(spark, monkeypatch):
    from loomgraph.operators import components

    monkeypatch.setattr(components, "TASK_EDGES", 150)
    es = np.random.default_rng(8).integers(0, 700, (600, 2))
    root = list(range(700))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in es:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    ends = {int(i) for a, b in es if a != b for i in (a, b)}
    assert {r.node: r.component for r in components.connected_components(edges_of(spark, es)).collect()} == {i: find(i) for i in ends}


def plain_crossings(at, es):
    left = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]) > 0
    out = set()
    for i, (a, b) in enumerate(es):
        for c, e in es[:i]:
            if len({a, b, c, e}) == 4 and left(at[a], at[b], at[c]) != left(at[a], at[b], at[e]) and left(at[c], at[e], at[a]) != left(at[c], at[e], at[b]):
                out.add(frozenset([(a, b), (c, e)]))
    return out


@pytest.mark.parametrize("kind", ["long", "cluster", "hub", "bundle", "lattice"])
def test_crossings_in_a_quadtree(spark, kind, monkeypatch):
    """One long edge, a dense cluster, a star, edges side by side, and edges on the borders of cells: the same pairs, once, in few comparisons."""
    monkeypatch.setattr(spatial, "FULL", 16)
    rng = np.random.default_rng(8)
    at = rng.random((400, 2)) * 10
    at[1::2] = at[::2] + rng.normal(size=(200, 2)) * 0.05
    es = [(i, i + 1) for i in range(0, 400, 2)]
    if kind == "long":
        at[0], at[1] = [-1000, 5], [1000, 5.1]
    elif kind == "cluster":
        at[:300] = 3 + (at[:300] - 3) * 1e-3
    elif kind == "hub":
        es = [(0, i) for i in range(1, 120)] + es[60:]
    elif kind == "bundle":
        for i in range(100):
            at[2 * i], at[2 * i + 1] = [0, 5 + i * 1e-4], [10, 5 + ((i * 7) % 100) * 1e-4]
    else:
        at = np.array([(x, y) for x in range(20) for y in range(20)], float)
        es = [(20 * x + y, 20 * (x + 1) + (y + 1)) for x in range(19) for y in range(19)] + [(20 * x + y + 1, 20 * (x + 1) + y) for x in range(0, 19, 2) for y in range(19)] + [(20 * x + y, 20 * (x + 2) + y) for x in range(0, 18, 3) for y in range(0, 20, 4)]
        es = [(min(e), max(e)) for e in es]
    es = sorted(set(es))
    g, layout = edges_of(spark, es), layout_of(spark, at)
    got = [frozenset([(r.a1, r.a2), (r.b1, r.b2)]) for r in spatial.crossings(g, layout).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_crossings(at, es)
    leaves = spatial._leaves(stored(spatial.placed_edges(g, layout), "segments")).groupBy("size", "cx", "cy").count()
    work = leaves.agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    if kind in ("long", "cluster"):
        assert work < 20 * len(es)  # all in one cell they would be 40,000


def test_clearances_with_one_long_edge(spark):
    rng = np.random.default_rng(9)
    at = rng.random((300, 2)) * 10
    at[1::2] = at[::2] + rng.normal(size=(150, 2)) * 0.05
    at[0], at[1] = [-500, 5], [500, 5.1]
    es = [(i, i + 1) for i in range(0, 300, 2)]
    got = {r.node: (r.clearance, r.src, r.dst) for r in spatial.clearances(edges_of(spark, es), layout_of(spark, at)).collect()}
    for n in range(300):
        best = []
        for a, b in es:
            if n not in (a, b):
                u = at[b] - at[a]
                t = min(max(((at[n] - at[a]) @ u) / max(u @ u, 1e-12), 0), 1)
                best.append((float(np.hypot(*(at[n] - at[a] - t * u))), a, b))
        assert got[n][1:] == min(best)[1:] and got[n][0] == pytest.approx(min(best)[0], abs=1e-9)


def test_one_hub_asks_for_many_points_alone(spark, monkeypatch):
    at = np.random.default_rng(10).random((200, 2))
    es = [(0, i) for i in range(1, 150)] + [(i, i + 1) for i in range(1, 199)]
    asked = []
    plain = spatial.nearest_points
    monkeypatch.setattr(spatial, "nearest_points", lambda q, p, k: asked.append((q.count(), k)) or plain(q, p, k))
    got = metrics.neighbour_scores(edges_of(spark, es), layout_of(spark, at)).first()
    assert sum(n * k for n, k in asked) < 200 * 20 and (1, 152) not in asked[:1]
    d = gaps(at)
    np.fill_diagonal(d, np.inf)
    near = {i: set() for i in range(200)}
    for a, b in es:
        near[a].add(b)
        near[b].add(a)
    hits = sum(len(near[i] & set(np.lexsort((np.arange(200), d[i]))[: len(near[i])].tolist())) for i in range(200))
    total = sum(map(len, near.values()))
    assert got.knn_recall == pytest.approx(hits / total) and got.np_jaccard == pytest.approx(hits / (2 * total - hits))
    rows = spatial.near_edges(edges_of(spark, es), layout_of(spark, at), 2).groupBy("node").count().collect()
    assert len(rows) == 200 and {r["count"] for r in rows} == {2}


def test_leading_nodes_reach_every_component(spark):
    star = [(0, i) for i in range(1, 6)]
    pieces = [(10, 11), (11, 12), (20, 21), (30, 31), (31, 32), (30, 32)]
    g = spark.createDataFrame(star + pieces, "src long, dst long")
    assert sorted(r.node for r in hops.leading_nodes(g, 1).collect()) == [0, 11, 20, 30]
    assert sorted(r.node for r in hops.leading_nodes(g, 3).collect()) == [0, 11, 20, 30]  # 0, 11 and 30 lead; 20 stands for its own
    assert hops.leading_nodes(g.limit(0), 3).count() == 0


def test_bounds_from_rows_equal_bounds_from_columns(spark):
    g = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(20, 21), (21, 22)], "src long, dst long")
    sources = spark.createDataFrame([(0,), (4,), (20,)], "node long")
    rows = hops.hop_distances(g, sources)
    pairs = spark.createDataFrame([(a, b) for a in (1, 5, 9, 20, 22) for b in (0, 3, 8, 21)] + [(1, 0), (99, 3)], "a long, b long")
    by_rows = sorted(((r.a, r.b, r.bound) for r in hops.lower_bounds(pairs, rows).collect()), key=str)
    by_columns = sorted(((r.a, r.b, r.bound) for r in hops.lower_bounds(pairs, hops.numbered_columns(g, sources)[0]).collect()), key=str)
    assert [r for r in by_rows if r[0] != 99] == by_columns and (99, 3, None) in by_rows and (22, 3, None) in by_rows


def test_scores_from_a_few_sources_count_every_row(spark):
    at = np.random.default_rng(3).normal(size=(9, 2))
    g, layout = edges_of(spark, [(i, i + 1) for i in range(8)]), layout_of(spark, at)
    few = hops.hop_distances(g, spark.createDataFrame([(8,), (4,)], "node long"))
    r = np.array([np.hypot(*(at[s] - at[v])) / abs(s - v) for s in (4, 8) for v in range(9) if s != v])
    assert metrics.evaluate(g, layout, few).first().stress == pytest.approx(1 - r.sum() ** 2 / (len(r) * (r * r).sum()), abs=1e-4)


def test_nearest_of_blocks_with_copies_and_odd_vectors():
    rng = np.random.default_rng(5)
    x = np.concatenate([np.repeat(rng.normal(size=(12, 16)), 40, 0), 1e6 + rng.normal(size=(200, 16)), 1e-30 * rng.normal(size=(30, 16)), np.zeros((20, 16))])
    ids = rng.permutation(len(x)).astype(np.int64)
    a, b, q = graphs._nearest_of(5, ids, x, ids, x)
    got = sorted(zip(a.tolist(), b.tolist(), q.tolist(), strict=True))
    want = []
    for i in range(len(x)):
        d = ((x[i] - x) ** 2).sum(1)
        want += [(int(ids[i]), int(ids[j]), d[j]) for j in [j for j in np.lexsort((ids, d)) if j != i][:5]]
    assert got == sorted(want)


def test_knn_graph_of_several_blocks(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 4)).round(1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (None, [0.0] * 4), (91, [float("nan")] * 4), (92, [1.0, None, 0.0, 0.0])]
    got = {(r.src, r.dst) for r in graphs.knn_graph(spark.createDataFrame(rows, "id long, v array<double>"), 3, "id", "v", block=20).collect()}
    want = set()
    for i in range(90):
        d = ((x[i] - x) ** 2).sum(1)
        want |= {(min(i, j), max(i, j)) for j in [int(j) for j in np.lexsort((np.arange(90), d)) if j != i][:3]}
    assert got == want


def test_searches_share_rows(spark):
    """64 searches step in one row, and columns need no row for each distance."""
    g = graphs.grid(spark, 9).unionByName(spark.createDataFrame([(900, 901)], "src long, dst long"))
    sources = edges.nodes_of(g).where("node % 2 = 0 or node = 901").unionByName(spark.createDataFrame([(5000,)], "node long"))
    named = hops._named(sources)
    groups = -(-sources.count() // 64)
    rows = hops._reached(g, named)
    assert rows.groupBy("d").count().agg(F.max("count")).first()[0] <= groups * 84
    found = {(r.source, r.node): r.d for r in hops.hop_distances(g, sources).collect()}
    at = lambda i: (i // 9, i % 9)
    want = {(a, b): abs(at(a)[0] - at(b)[0]) + abs(at(a)[1] - at(b)[1]) for a in range(0, 81, 2) for b in range(81)} | {(900, 900): 0, (900, 901): 1, (901, 900): 1, (901, 901): 0, (5000, 5000): 0}
    assert found == want
    columns, ordinals = hops.numbered_columns(g, sources)
    order = {r.ordinal: r.source for r in ordinals.collect()}
    wide = {(order[k], r.node): d for r in columns.collect() for k, d in enumerate(r.hops) if d is not None}
    assert wide == want and all(len(r.hops) == len(order) for r in columns.collect())
    assert {(r.source, r.node): r.d for r in hops.hop_distances(g, sources, most=2).collect()} == {k: d for k, d in want.items() if d <= 2}


def test_full_cells_of_long_edges_are_compared_by_arrays(spark, monkeypatch):
    """Sums equal those of the rows that cross, and no row is made for each halving of cells that long edges pass."""
    monkeypatch.setattr(spatial, "RUN", 50)
    rng = np.random.default_rng(7)
    at = rng.normal(size=(150, 2))
    at[:8] = np.round(at[:8])
    g = edges_of(spark, sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, 150, (400, 2)).tolist() if a != b}))
    layout = stored(layout_of(spark, at), "layout")
    segments = stored(spatial.placed_edges(g, layout), "segments")
    assert spatial._leaves(segments, spatial.GAIN).count() < spatial._leaves(segments).count() / 2
    want = spatial.crossings(g, layout).agg(F.count("*").alias("n"), F.sum("angle").alias("angle")).first()
    got = spatial.crossing_sums(g, layout).first()
    assert got.n == want.n > 1000 and abs(got.angle - want.angle) < 1e-6 * want.angle
    near = {r.node: (r.clearance, r.src, r.dst) for r in spatial.clearances(g, layout).collect()}
    ends = [(r.src, r.dst) for r in g.collect()]
    for i in range(150):
        each = []
        for a, b in ends:
            if i not in (a, b):
                u = at[b] - at[a]
                t = min(max(float((at[i] - at[a]) @ u) / max(float(u @ u), 1e-12), 0.0), 1.0)
                each.append((math.dist(at[i], at[a] + t * u), a, b))
        assert abs(near[i][0] - min(each)[0]) < 1e-12


def test_push_of_all_nodes_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(spatial, "RUN", 7)
    at = np.random.default_rng(8).normal(size=(40, 2))
    at[3] = at[4]
    none = spark.createDataFrame([], "a long, b long, p double")
    met, groups = spatial.blocks_met(layout_of(spark, at))
    assert met.select("lo", "hi").distinct().count() == groups == 21
    got = {r.node: (r.gx, r.gy) for r in distributions.distribution_gradient(none, layout_of(spark, at)).collect()}
    d = at[:, None] - at[None]
    w = 1 / (1 + (d * d).sum(2)) * (1 - np.eye(40))
    want = -4 * (w[..., None] ** 2 * d).sum(1) / w.sum()
    assert np.abs(np.array([got[i] for i in range(40)]) - want).max() < 1e-12
