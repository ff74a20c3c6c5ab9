"""Every query of the library itself, by name, and the SQL that most of them equal.

Graphs come from the tables: the 5-nearest-neighbour graph of the vectors with their first two components as
layout, the forest of regions, nations and customers, suppliers of parts, and users of consecutive events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.models import arms, fits, network
from loomgraph.operators import communities, diffusion, distributions, edges, energies, hops, linear, metrics, pairs, ranking, spatial
from loomgraph.operators.components import connected_components
from loomgraph.sources import graphs
from loomgraph.storage import new_path, once, stored
from loomgraph.streaming import growth

#: Fixed: how many landmarks and pivots the published method takes, where the graph has as many nodes.
LANDMARKS, PIVOTS, FARTHEST = 64, 400, 16

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quadratic, so queries of one application over one folder share it."""
    return once(spark, "knn", sf_dir, lambda: graphs.knn_graph(_vectors(spark, sf_dir), 5, "vec_id", "embedding"))


def _layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i, n: F.get("embedding", F.lit(i)).cast("double").alias(n)
    return _vectors(spark, sf_dir).select(F.col("vec_id").alias("node"), at(0, "x"), at(1, "y"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select(F.col("vec_id").alias("node"), "label")


def _first_of_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).groupBy("label").agg(F.min("node").alias("first"))


def _leading(spark: SparkSession, sf_dir: str, n: int = 16) -> DataFrame:
    """The nodes with the most edges, and of each component."""
    return once(spark, f"leading{n}", sf_dir, lambda: hops.leading_nodes(_knn(spark, sf_dir), n))


def _leading_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, "leading_hops", sf_dir, lambda: hops.hop_distances(_knn(spark, sf_dir), _leading(spark, sf_dir)))


def _landmark_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, "landmark_hops", sf_dir, lambda: hops.hop_distances(_knn(spark, sf_dir), _leading(spark, sf_dir, LANDMARKS)))


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes with the most edges alone, as a bounded sample."""
    deg = edges.degrees(_knn(spark, sf_dir))
    return once(spark, "anchors", sf_dir, lambda: deg.orderBy(F.col("degree").desc(), "node").limit(16).select("node"))


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns))


KNN = """pairs as (select a.vec_id a, b.vec_id b, row_number() over (partition by a.vec_id order by list_distance(a.embedding::double[], b.embedding::double[]), b.vec_id) k
  from embeddings a, embeddings b where a.vec_id <> b.vec_id),
edges as (select distinct least(a, b) src, greatest(a, b) dst from pairs where k <= 5),
adj as (select src, dst from edges union all select dst, src from edges),
layout as (select vec_id node, embedding[1]::double x, embedding[2]::double y from embeddings)"""
HOPS = """reach as (select distinct src source, src node, 0 d from adj
  union select r.source, a.dst, r.d + 1 from reach r join adj a on a.src = r.node where r.d < 24),
hops as (select source, node, min(d) d from reach group by all)"""
LEADING = """linked as (select src source, src node from adj union select l.source, a.dst from linked l join adj a on a.src = l.node),
member as (select node, min(source) component from linked group by node), sized as (select src node, count(*) n from adj group by src),
ranked as (select node, row_number() over (order by n desc, node) place, row_number() over (partition by component order by n desc, node) own from sized join member using (node)),
hubs as (select node from ranked where place <= 16 or own = 1),
far_from as (select node source, node, 0 d from hubs union select r.source, a.dst, r.d + 1 from far_from r join adj a on a.src = r.node where r.d < 24),
far as (select source, node, min(d) d from far_from group by all)"""
LANDMARKED = LEADING.replace("place <= 16", f"place <= {LANDMARKS}") + """,
grid as (select n.node, h.node source, coalesce(d, 0) ** 2 s from sized n cross join hubs h left join far on far.node = n.node and far.source = h.node)"""
ANCHORS = """anchors as (select src node from adj group by src order by count(*) desc, src limit 16)"""
TREE = """tree as (select n_regionkey::bigint + 1 src, n_nationkey::bigint + 100 dst from nation union all select c_nationkey::bigint + 100, c_custkey + 1000 from customer),
adj as (select src, dst from tree union all select dst, src from tree)"""


@query(f"with {KNN} select src, dst from edges")
def graph_knn(spark, sf_dir):
    return stored(graphs.knn_graph(_vectors(spark, sf_dir), 5, "vec_id", "embedding"), "knn")


@query(f"with {TREE} select src node, count(*) degree from adj group by src")
def graph_degrees(spark, sf_dir):
    return edges.degrees(graphs.place_tree(spark, sf_dir))


@query("select distinct -l_suppkey - 1 src, l_partkey dst from lineitem")
def graph_bipartite(spark, sf_dir):
    return graphs.suppliers_of_parts(spark, sf_dir)


@query("""with s as (select user_id, ts, lag(user_id) over (partition by event_type order by ts, event_id) b from events)
select least(b, user_id) src, greatest(b, user_id) dst, min(ts) "first", count(*) n from s where b <> user_id group by 1, 2""")
def graph_users_in_turn(spark, sf_dir):
    return graphs.users_in_turn(spark.read.parquet(f"{sf_dir}/events.parquet"))


@query("""select r_regionkey::bigint + 1 node, r_regionkey::bigint + 1 component from region where r_regionkey in (select n_regionkey from nation)
union all select n_nationkey::bigint + 100, n_regionkey::bigint + 1 from nation
union all select c_custkey + 1000, n_regionkey::bigint + 1 from customer join nation on c_nationkey = n_nationkey""")
def graph_components(spark, sf_dir):
    return connected_components(graphs.place_tree(spark, sf_dir))


@query(f"""with {TREE}, regions as (select n_regionkey, count(distinct n_nationkey) + count(c_custkey) n from nation left join customer on c_nationkey = n_nationkey group by 1),
best as (select n_regionkey r from regions order by n desc, r limit 1)
select r::bigint + 1 node from best union all select n_nationkey::bigint + 100 from nation join best on n_regionkey = r
union all select c_custkey + 1000 from customer join nation on c_nationkey = n_nationkey join best on n_regionkey = r""")
def graph_largest_component(spark, sf_dir):
    return edges.largest_component(graphs.place_tree(spark, sf_dir))


BOTH_KINDS = """both_kinds as (select 'open' kind, src node, dst from adj union all select 'closed', src, dst from adj union all select distinct 'closed', src, src from adj),
near as (select kind, node, list(dst order by dst) n from both_kinds group by 1, 2), g as (select kind, n, min(node) g, count(*) c from near group by 1, 2)
select node, kind, g "group" from near join g using (kind, n) where c > 1"""


@query(f"with {TREE}, {BOTH_KINDS}")
def graph_twins(spark, sf_dir):
    return edges.twins(graphs.place_tree(spark, sf_dir))


@query(f"""with edges as (select distinct c_nationkey::bigint src, s_nationkey::bigint dst from customer join supplier on c_nationkey <> s_nationkey union select s_nationkey::bigint, c_nationkey::bigint from customer join supplier on c_nationkey <> s_nationkey),
adj as (select src, dst from edges), {BOTH_KINDS}""")
def graph_twins_trade(spark, sf_dir):
    """Nations that have customers and suppliers of one another: a dense graph, where closed twins are many."""
    customer, supplier = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "supplier"))
    one, other = customer.select(F.col("c_nationkey").alias("src")).distinct(), supplier.select(F.col("s_nationkey").alias("dst")).distinct()
    return edges.twins(stored(edges.canonical(one.join(other, F.col("src") != F.col("dst"))), "trade"))  # a row for each nation


@query(f"""with {KNN}, both_kinds as (select 'open' kind, src node, dst from adj union all select 'closed', src, dst from adj union all select distinct 'closed', src, src from adj),
near as (select kind, node, list(dst order by dst) n from both_kinds group by 1, 2), g as (select kind, n, min(node) g, count(*) c from near group by 1, 2)
select node, kind, g "group" from near join g using (kind, n) where c > 1""")
def graph_twins_knn(spark, sf_dir):
    return edges.twins(_knn(spark, sf_dir))


@query(f"""with {KNN} select l.src a, r.dst b, count(*) common from adj l join adj r on l.dst = r.src
where l.src < r.dst and not exists (select 1 from edges e where e.src = l.src and e.dst = r.dst) group by 1, 2""")
def graph_two_hop_pairs(spark, sf_dir):
    return edges.two_hop_pairs(_knn(spark, sf_dir))


@query(f"""with {KNN}, one as (select min(vec_id) node from embeddings group by label), two as (select node from one union select dst from adj join one on src = node)
select node from two union select dst from adj join two on src = node""")
def graph_ball(spark, sf_dir):
    """Two hops around the first vector of each class."""
    return edges.ball(_knn(spark, sf_dir), _first_of_class(spark, sf_dir).select(F.col("first").alias("node")), 2)


@query(f"with recursive {KNN}, {LANDMARKED} select source, node, d from far")
def graph_hops(spark, sf_dir):
    """Of all nodes from the landmarks."""
    return _landmark_hops(spark, sf_dir)


@query(f"""with recursive {KNN}, {LEADING}, p as (select vec_id a, min(vec_id) over (partition by label) b from embeddings)
select a, b, max(abs(x.d - y.d))::int bound from p join far x on x.node = a left join far y on y.node = b and y.source = x.source group by 1, 2""")
def graph_lower_bounds(spark, sf_dir):
    """Between each vector and the first of its class; null where no pivot reaches both."""
    own = _labels(spark, sf_dir).join(_first_of_class(spark, sf_dir), "label").select(F.col("node").alias("a"), F.col("first").alias("b"))
    return hops.lower_bounds(own, _leading_hops(spark, sf_dir))


@query(f"""with recursive {KNN}, {LEADING}, w as (select a.src, a.dst, 1 / sqrt((s.n * d.n)::double) w from adj a join sized s on s.node = a.src join sized d on d.node = a.dst),
walk as (select node k, node, 0 step, 1.0::double p from hubs union all select k, dst, step + 1, sum(w * p) from walk join w on src = node where step < 20 group by k, dst, step)
select k landmark, node, round(sum(.05 * .95 ** step * p), 9) p from walk group by 1, 2""")
def features_diffusion(spark, sf_dir):
    return _rounded(diffusion.diffusion(_knn(spark, sf_dir), _leading(spark, sf_dir)), "p", digits=9)


@query(f"""with recursive {KNN}, {LANDMARKED}, r as (select sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / d r from far join layout a on a.node = source join layout b on b.node = far.node where d > 0)
select round(1 - sum(r) ** 2 / (count(*) * sum(r * r)), 6) stress, round(sum(r) / sum(r * r), 6) scale, count(*) n_pairs from r""")
def score_stress(spark, sf_dir):
    """Of all nodes against the landmarks; from all nodes as sources it would be the stress of all pairs."""
    return _rounded(metrics.stress(_landmark_hops(spark, sf_dir), _layout(spark, sf_dir), pairs_once=False), "stress", "scale")


@query(f"""with {KNN}, deg as (select src a, count(*) n from adj group by src),
near as (select p.node a, q.node b, row_number() over (partition by p.node order by sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)), q.node) k from layout p, layout q where p.node <> q.node),
h as (select count(*) h from near join deg using (a) join adj on adj.src = a and adj.dst = b where k <= n), t as (select sum(n) n from deg)
select round(h / (2 * n - h), 6) np_jaccard, round(h / n, 6) knn_recall from h, t""")
def score_neighbours(spark, sf_dir):
    return _rounded(metrics.neighbour_scores(_knn(spark, sf_dir), _layout(spark, sf_dir)), "np_jaccard", "knn_recall")


@query(f"""with {KNN}, s as (select row_number() over (order by src, dst) i, src, dst, a.x x1, a.y y1, b.x x2, b.y y2 from edges join layout a on a.node = src join layout b on b.node = dst)
select count(*) crossings from s a, s b where a.i < b.i and a.src <> b.src and a.src <> b.dst and a.dst <> b.src and a.dst <> b.dst
and ((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1) > 0) <> ((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1) > 0)
and ((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1) > 0) <> ((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1) > 0)""")
def score_crossings(spark, sf_dir):
    return metrics.crossing_scores(_knn(spark, sf_dir), _layout(spark, sf_dir)).select("crossings")


@query(f"""with {KNN}, l as (select sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) l from edges join layout a on a.node = src join layout b on b.node = dst)
select round(stddev_pop(l) / (avg(l) + 1e-9), 6) edge_cov, round(avg(l), 6) mean_length from l""")
def score_edge_lengths(spark, sf_dir):
    return _rounded(metrics.edge_length_variation(_knn(spark, sf_dir), _layout(spark, sf_dir)), "edge_cov", "mean_length")


@query(f"""with {KNN}, near as (select p.node a, q.node b, row_number() over (partition by p.node order by sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)), q.node) k from layout p, layout q where p.node <> q.node)
select round(avg((la.label = lb.label)::int), 6) purity from near join embeddings la on la.vec_id = a join embeddings lb on lb.vec_id = b where k <= 10""")
def score_purity(spark, sf_dir):
    return _rounded(metrics.label_purity(_layout(spark, sf_dir), _labels(spark, sf_dir)), "purity")


@query("""with p as (select vec_id n, label l, embedding[1]::double x, embedding[2]::double y, count(*) over (partition by label) m from embeddings),
s as (select a.n, a.l la, b.l lb, any_value(a.m) ma, any_value(b.m) mb, sum(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) s from p a, p b where a.m > 1 and b.m > 1 group by 1, 2, 3),
e as (select n, max(case when la = lb then s / (ma - 1) end) own, min(case when la <> lb then s / mb end) other from s group by n)
select round(avg((other - own) / greatest(own, other)), 6) silhouette from e""")
def score_silhouette(spark, sf_dir):
    return _rounded(metrics.silhouette(_layout(spark, sf_dir), _labels(spark, sf_dir)), "silhouette")


@query(f"""with {KNN}, s as (select src, dst, a.x x1, a.y y1, b.x - a.x ux, b.y - a.y uy from edges join layout a on a.node = src join layout b on b.node = dst),
t as (select node, x, y, x1, y1, ux, uy, least(greatest(((x - x1) * ux + (y - y1) * uy) / greatest(ux * ux + uy * uy, 1e-12), 0), 1) t from layout, s where node <> src and node <> dst)
select node, round(min(sqrt((x - x1 - t * ux) ** 2 + (y - y1 - t * uy) ** 2)), 6) clearance from t group by node""")
def score_clearance(spark, sf_dir):
    return _rounded(spatial.clearances(_knn(spark, sf_dir), _layout(spark, sf_dir)).select("node", "clearance"), "clearance")


@query("""with p as (select vec_id n, embedding[1]::double x, embedding[2]::double y from embeddings)
select a.n a, b.n b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) d from p a, p b where a.n < b.n and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < .1""")
def join_range(spark, sf_dir):
    at = _layout(spark, sf_dir)
    return _rounded(spatial.range_join(at, at, 0.1).where("a < b"), "d")


@query("""with p as (select vec_id node, embedding[1]::double x, embedding[2]::double y from embeddings), c as (select avg(x) mx, avg(y) my, avg(x * x + y * y) q from p)
select node, round((x - mx) / sqrt(q - mx * mx - my * my), 6) x, round((y - my) / sqrt(q - mx * mx - my * my), 6) y from p, c""")
def layout_framed(spark, sf_dir):
    return _rounded(metrics.framed(_layout(spark, sf_dir)), "x", "y")


@query(f"""with recursive {KNN}, {LEADING}, r as (select far.node, 1.0 / (d * d) w, a.x + d / greatest(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 1e-9) * (b.x - a.x) tx,
  a.y + d / greatest(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 1e-9) * (b.y - a.y) ty from far join layout a on a.node = source join layout b on b.node = far.node where d > 0)
select node, round(sum(w * tx) / sum(w), 6) x, round(sum(w * ty) / sum(w), 6) y from r group by node""")
def layout_majorised(spark, sf_dir):
    return _rounded(energies.majorised(_leading_hops(spark, sf_dir), _layout(spark, sf_dir)), "x", "y")


@query(f"""with {KNN}, b as (select min(x) lx, min(y) ly, greatest(max(x) - min(x), max(y) - min(y), 1e-12) s from layout)
select least(floor((x - lx) / s * 16), 15)::int px, least(floor((y - ly) / s * 16), 15)::int py, count(*) n from layout, b group by 1, 2""")
def layout_raster(spark, sf_dir):
    return spatial.points_raster(_layout(spark, sf_dir), 16)


@query("""select o_orderpriority graph, o_orderstatus "method", round(avg(o_totalprice), 4) mean, round(coalesce(stddev_samp(o_totalprice), 0), 4) sd, count(o_totalprice) seeds from orders group by 1, 2""")
def table_cells(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return _rounded(ranking.cells(orders.select(F.col("o_orderpriority").alias("graph"), F.col("o_orderstatus").alias("method"), F.col("o_totalprice").alias("value"))), "mean", "sd", digits=4)


RANKS = """v as (select o_orderpriority graph, l_returnflag "method", round(avg(l_quantity), 6) v from orders join lineitem on l_orderkey = o_orderkey group by 1, 2),
r as (select graph, "method", rank() over (partition by graph order by v) + (count(*) over (partition by graph, v) - 1) / 2.0 "rank" from v)"""


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    rows = orders.join(lines, orders.o_orderkey == lines.l_orderkey).groupBy(F.col("o_orderpriority").alias("graph"), F.col("l_returnflag").alias("method"))
    return ranking.mean_ranks(rows.agg(F.round(F.avg("l_quantity"), 6).alias("value")))


@query(f"""with {RANKS} select graph, "method", "rank"::double "rank" from r""")
def table_ranks(spark, sf_dir):
    return _ranks(spark, sf_dir).withColumn("rank", F.col("rank").cast("double"))


@query(f"""with {RANKS}, t as (select graph, "rank", count(*) t from r group by 1, 2), u as (select sum(t ** 3 - t) ties from t),
m as (select "method", sum("rank") s, count(*) n from r group by 1), q as (select sum(s * s) q, count(*) k, max(n) n from m)
select round((12.0 / (n * k * (k + 1)) * q - 3 * n * (k + 1)) / (1 - ties / (n * (k ** 3 - k))), 6)::double statistic, n, k from q, u""")
def table_friedman(spark, sf_dir):
    return _rounded(ranking.friedman(_ranks(spark, sf_dir)).select(F.col("statistic").cast("double").alias("statistic"), "n", "k"), "statistic")


def _sources(g: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """At most so many nodes of the whole graph, drawn by hash, and one of each component without any."""
    return hops.component_pivots(g, max(1, min(most, edges.nodes_of(g).count() - 1)), seed)


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, "landmarks", sf_dir, lambda: _sources(_knn(spark, sf_dir), LANDMARKS))


def _pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, "pivots", sf_dir, lambda: _sources(_knn(spark, sf_dir), PIVOTS))


def _pivot_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, "pivot_hops", sf_dir, lambda: hops.hop_distances(_knn(spark, sf_dir), _pivots(spark, sf_dir)))


def _columns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Hop columns to the pivots, and their order."""
    ordinals = once(spark, "ordinals", sf_dir, lambda: hops.in_order(_pivots(spark, sf_dir)))
    return once(spark, "columns", sf_dir, lambda: hops.hop_columns(_knn(spark, sf_dir), ordinals)), ordinals


def _features(spark: SparkSession, sf_dir: str, g: DataFrame) -> DataFrame:
    return once(spark, "features", sf_dir, lambda: diffusion.assembled(g, _layout(spark, sf_dir).select("node"), _marks(spark, sf_dir), tie_dim=2))


def _fitted(spark: SparkSession, sf_dir: str, energy: str) -> tuple:
    g = _knn(spark, sf_dir)
    table = _features(spark, sf_dir, g)
    columns, ordinals = _columns(spark, sf_dir)
    return g, table, columns, network.fit(table, g, energy, columns, ordinals)


@query()
def fit_pivot_stress(spark, sf_dir):
    """Places by a network fitted to pivot stress."""
    _, table, _, fitted = _fitted(spark, sf_dir, "pivot")
    return network.place(table, fitted)


@query()
def fit_neighbour_embedding(spark, sf_dir):
    _, table, _, fitted = _fitted(spark, sf_dir, "neighbour")
    return network.place(table, fitted)


@query()
def fit_blend(spark, sf_dir):
    """Places between the two energies, for three values of lambda."""
    _, table, _, fitted = _fitted(spark, sf_dir, "blend")
    return network.family(table, fitted, [0.0, 0.5, 1.0])


@query()
def fit_mean_field(spark, sf_dir):
    """Places by a network fitted to the stress of all pairs."""
    g = _knn(spark, sf_dir)
    columns, _ = hops.numbered_columns(g, _marks(spark, sf_dir))
    table = _features(spark, sf_dir, g)
    return network.place(table, network.fit_mean_field(table, g, columns))


@query()
def fit_legible(spark, sf_dir):
    """Places by a neighbour embedding and its second phase."""
    g, table, _, fitted = _fitted(spark, sf_dir, "neighbour")
    return network.place(table, fits.legible(fitted, table, g))


@query()
def fit_coded(spark, sf_dir):
    """Places by a network that reads a learned code of each node."""
    g, table = _knn(spark, sf_dir), _features(spark, sf_dir, _knn(spark, sf_dir))
    fitted, codes = fits.fit_with_codes(table, g, "pivot", *_columns(spark, sf_dir))
    return network.place(network.with_codes(table, codes, 4), fitted)


@query()
def fit_terms(spark, sf_dir):
    """Places by a network fitted to pivot stress with terms of local, drawn and negative pairs and a barrier against folds."""
    g, table = _knn(spark, sf_dir), _features(spark, sf_dir, _knn(spark, sf_dir))
    return network.place(table, fits.fit_with_terms(table, g, "pivot", *_columns(spark, sf_dir), {"local": 0.3, "spread": 0.005, "contrast": 0.05, "fold": 0.05}))


@query()
def fit_injected(spark, sf_dir):
    """Places by a neighbour embedding with the stress against all pivots beside it."""
    g, table = _knn(spark, sf_dir), _features(spark, sf_dir, _knn(spark, sf_dir))
    columns, ordinals = _columns(spark, sf_dir)
    return network.place(table, fits.fit_with_stress(table, g, None, 1.0, columns=columns, ordinals=ordinals))


@query()
def table_arms(spark, sf_dir):
    """Held-out stress of the best configuration of each trained arm, over the grid of 300 steps."""
    table = _features(spark, sf_dir, _knn(spark, sf_dir))
    sample = arms.sample_of(table, *_columns(spark, sf_dir))
    return arms.chosen_arms(arms.trained_grid(sample, spark, arms.grid(steps=(300,)) if len(sample.x) else []))


@query()
def fit_hybrid(spark, sf_dir):
    """Places by a network fitted by majorisation and then by gradients."""
    g, table = _knn(spark, sf_dir), _features(spark, sf_dir, _knn(spark, sf_dir))
    return network.place(table, fits.fit_majorised(table, g, _pivot_hops(spark, sf_dir), *_columns(spark, sf_dir)).network)


@query()
def graph_communities(spark, sf_dir):
    return pairs.communities(_knn(spark, sf_dir))


@query()
def graph_modularity_communities(spark, sf_dir):
    return communities.modularity_communities(_knn(spark, sf_dir))


@query(f"""with {KNN}, own as (select a.label la, b.label lb from adj join embeddings a on a.vec_id = src join embeddings b on b.vec_id = dst),
each as (select la, count(*) filter (where la = lb) inside, count(*) every from own group by la), total as (select sum(every) m from each)
select round(sum(inside / m - (every / m) ** 2), 6) modularity from each, total""")
def score_modularity(spark, sf_dir):
    """How much better than by chance the classes of the vectors part their graph."""
    return _rounded(communities.modularity(_knn(spark, sf_dir), _labels(spark, sf_dir)), "modularity")


DISTRIBUTION = """two as (select distinct l.src a, r.dst b from adj l join adj r on l.dst = r.src where l.src <> r.dst and not exists (select 1 from adj e where e.src = l.src and e.dst = r.dst)),
rows as (select src node, dst other, 1.0 q from adj union all select a, b, 4.0 from two),
hist as (select node, q - min(q) over (partition by node) q, n from (select node, q, count(*)::double n from rows group by 1, 2)),
band as (select distinct node, -20.0::double low, 20.0::double high, 0 k from rows union all
  select node, case when h > ln(8) then (low + high) / 2 else low end, case when h > ln(8) then high else (low + high) / 2 end, k + 1 from
  (select b.node, low, high, k, ln(sum(n * exp(-exp((low + high) / 2) * q))) + exp((low + high) / 2) * sum(n * exp(-exp((low + high) / 2) * q) * q) / sum(n * exp(-exp((low + high) / 2) * q)) h
   from band b join hist using (node) where k < 60 group by b.node, low, high, k)),
bands as (select node, exp((low + high) / 2) beta, sum(n * exp(-exp((low + high) / 2) * q)) z from band join hist using (node) where k = 60 group by node, low, high),
lows as (select node, min(q) m from rows group by node),
chance as (select node, other, exp(-beta * (q - m)) / z p from rows join bands using (node) join lows using (node)),
prob as (select least(node, other) a, greatest(node, other) b, sum(p) / (2 * (select count(*) from bands)) p from chance group by 1, 2)"""


@query(f"with recursive {KNN}, {DISTRIBUTION} select a, b, round(p, 9) p from prob")
def graph_neighbour_probabilities(spark, sf_dir):
    return _rounded(distributions.neighbour_probabilities(_two_hops(spark, sf_dir), 8.0), "p", digits=9)


@query(f"""with recursive {KNN}, {DISTRIBUTION}, pairs_w as (select p.node a, q.node b, p.x - q.x dx, p.y - q.y dy, 1 / (1 + (p.x - q.x) ** 2 + (p.y - q.y) ** 2) w from layout p, layout q where p.node <> q.node),
push as (select a, sum(w * w * dx) x, sum(w * w * dy) y from pairs_w group by a), total as (select sum(w) t from pairs_w),
pull as (select w.a, sum(p * w * dx) x, sum(p * w * dy) y from pairs_w w join prob on prob.a = least(w.a, w.b) and prob.b = greatest(w.a, w.b) group by w.a)
select a node, round(4 * (coalesce(pull.x, 0) - push.x / t), 9) gx, round(4 * (coalesce(pull.y, 0) - push.y / t), 9) gy from push left join pull using (a), total""")
def energy_distribution_gradient(spark, sf_dir):
    """One gradient of the divergence between the distributions of a graph and of a layout."""
    p = stored(distributions.neighbour_probabilities(_two_hops(spark, sf_dir), 8.0), "probabilities")
    return _rounded(distributions.distribution_gradient(p, _layout(spark, sf_dir)), "gx", "gy", digits=9)


def _two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, other, d of all nodes at one and at two hops."""
    g = _knn(spark, sf_dir)
    two = edges.two_hop_pairs(g)
    both = two.select("a", "b").unionByName(two.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rows = edges.adjacency(g).select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(1).alias("d"))
    return stored(rows.unionByName(both.select(F.col("a").alias("node"), F.col("b").alias("other"), F.lit(2).alias("d"))), "two_hops")


def _axes(m: str) -> str:
    """The two leading axes (i, v) of a symmetric matrix m (i, j, v) with their values: moved until no value is negative, squared over and over
    it becomes the projection onto the first axis, whose largest entry is positive; without that part, onto the second."""
    out = [f"moved1 as (select i, j, v + case when i = j then c else 0 end v from {m}, (select max(r) c from (select sum(abs(v)) r from {m} group by i)))"]
    for k in (1, 2):
        out.append(f"""power{k} as (select i, j, v / (select sum(v) from moved{k} where i = j) v, 0 step from moved{k} union all
  select a.i, b.j, sum(a.v * b.v) / (select sum(v * v) from power{k}), a.step + 1 from power{k} a join power{k} b on a.j = b.i where a.step < 24 group by a.i, b.j, a.step)""")
        out.append(f"""axis{k} as (select i, v / sqrt(top) v from power{k}, (select arg_max(i, v) peak, max(v) top from power{k} where i = j and step = 24) where step = 24 and j = peak),
value{k} as (select sum(m.v * a.v * b.v) v from {m} m join axis{k} a on a.i = m.i join axis{k} b on b.i = m.j)""")
        if k == 1:
            out.append("""moved2 as (select m.i, m.j, m.v - l * a.v * b.v v from moved1 m join axis1 a on a.i = m.i join axis1 b on b.i = m.j, (select sum(m.v * a.v * b.v) l from moved1 m join axis1 a on a.i = m.i join axis1 b on b.i = m.j))""")
    return ",\n".join(out)


def _landmark_columns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ordinals = once(spark, "landmark_ordinals", sf_dir, lambda: hops.in_order(_leading(spark, sf_dir, LANDMARKS)))
    return once(spark, "landmark_columns", sf_dir, lambda: hops.hop_columns(_knn(spark, sf_dir), ordinals)), ordinals


@query(f"""with recursive {KNN}, {LANDMARKED}, c as (select node, source, -.5 * (s - avg(s) over (partition by source) - avg(s) over (partition by node) + avg(s) over ()) c from grid),
m as (select a.source i, b.source j, sum(a.c * b.c) v from c a join c b on a.node = b.node group by 1, 2), {_axes("m")}
select node, round(sum(c * x.v), 5) x, round(sum(c * y.v), 5) y from c join axis1 x on x.i = source join axis2 y on y.i = source group by node""")
def layout_pivot_scaling(spark, sf_dir):
    return _rounded(linear.placed_by_axes(linear.pivot_scaling(_landmark_columns(spark, sf_dir)[0])), "x", "y", digits=5)


@query(f"""with recursive {KNN}, {LANDMARKED}, near as (select node i, source j, s from grid where node in (select node from hubs)), mean as (select i, avg(s) s from near group by i),
m as (select i, j, -.5 * (s - avg(s) over (partition by i) - avg(s) over (partition by j) + avg(s) over ()) v from near), {_axes("m")}
select grid.node, round(sum(-.5 * (grid.s - mean.s) * x.v / sqrt(value1.v)), 5) x, round(sum(-.5 * (grid.s - mean.s) * y.v / sqrt(value2.v)), 5) y
from grid join mean on mean.i = source join axis1 x on x.i = source join axis2 y on y.i = source, value1, value2 where grid.node not in (select node from hubs) group by grid.node
union all select x.i, round(x.v * sqrt(value1.v), 5), round(y.v * sqrt(value2.v), 5) from axis1 x join axis2 y on x.i = y.i, value1, value2""")
def layout_landmark_scaling(spark, sf_dir):
    return _rounded(linear.placed_by_axes(linear.landmark_scaling(*_landmark_columns(spark, sf_dir))), "x", "y", digits=5)


@query(f"""with recursive e as (select vec_id node, generate_subscripts(embedding, 1) i, unnest(embedding)::double v from embeddings),
m as (select a.i, b.i j, avg(a.v * b.v) - avg(a.v) * avg(b.v) v from e a join e b on a.node = b.node group by 1, 2), about as (select node, i, v - avg(v) over (partition by i) v from e), {_axes("m")}
select node, round(sum(about.v * x.v), 5) x, round(sum(about.v * y.v), 5) y from about join axis1 x on x.i = about.i join axis2 y on y.i = about.i group by node""")
def layout_principal(spark, sf_dir):
    return _rounded(linear.placed_by_axes(linear.principal(_vectors(spark, sf_dir).select(F.col("vec_id").alias("node"), "embedding"), "embedding")), "x", "y", digits=5)


@query()
def layout_forces(spark, sf_dir):
    return energies.force_layout(_knn(spark, sf_dir), _layout(spark, sf_dir), 0.1, rounds=10)


@query()
def layout_refined(spark, sf_dir):
    return energies.refined(_knn(spark, sf_dir), _layout(spark, sf_dir), 0.02, rounds=3)


@query()
def graph_near(spark, sf_dir):
    return graphs.near_graph(_vectors(spark, sf_dir), 5, "vec_id", "embedding")


@query()
def fit_majorised_stress(spark, sf_dir):
    """Majorisation against the hops from nodes of every component."""
    return network.stress_layout(_pivot_hops(spark, sf_dir), _layout(spark, sf_dir))


@query(f"""with recursive {KNN}, {HOPS}, sized as (select src node, count(*) n from adj group by src), start as (select node first from sized order by n desc, node limit 1),
state as (select 0 step, first p, sized.node, d own, d near from sized cross join start left join hops on hops.source = first and hops.node = sized.node
  union all select step + 1, next, s.node, d, least(near, d) from state s cross join (select arg_max(node, coalesce(near, 1000000)::bigint * 1000000000 - node) next, max(coalesce(near, 1)) far from state) t
  left join hops on hops.source = next and hops.node = s.node where step < {FARTHEST} - 1 and far > 0)
select p "pivot", step ordinal, node, own d from state where own is not null""")
def graph_farthest_pivots(spark, sf_dir):
    """From the node with the most edges on."""
    g = _knn(spark, sf_dir)
    first = edges.degrees(g).orderBy(F.col("degree").desc(), "node").first()
    return hops.farthest_pivots(g, edges.nodes_of(g), FARTHEST, first.node if first else None)


SEGMENTS = """seg as (select src, dst, a.x x1, a.y y1, b.x x2, b.y y2 from edges join layout a on a.node = src join layout b on b.node = dst)"""
NEAREST = """nearest as (select p.node a, q.node b, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) d,
  row_number() over (partition by p.node order by sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)), q.node) k from layout p, layout q where p.node <> q.node)"""
GAPS = """gaps as (select node, src, dst, x, y, x1, y1, x2, y2, least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / greatest((x2 - x1) ** 2 + (y2 - y1) ** 2, 1e-12), 0), 1) t from layout, seg where node <> src and node <> dst),
clear as (select node, min(sqrt((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2)) clearance, arg_min(src, (sqrt((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2), src, dst)) src,
  arg_min(dst, (sqrt((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2), src, dst)) dst from gaps group by node)"""


@query(f"with recursive {KNN}, {LEADING} select source, node, d from far")
def graph_hub_hops(spark, sf_dir):
    return _leading_hops(spark, sf_dir)


@query(f"""with {KNN}, two as (select distinct l.src a, r.dst b from adj l join adj r on l.dst = r.src), three as (select distinct a, dst b from two join adj on src = b)
select a, b from three where a < b and not exists (select 1 from two t where t.a = three.a and t.b = three.b) and not exists (select 1 from edges e where e.src = three.a and e.dst = three.b)""")
def graph_three_hop_pairs(spark, sf_dir):
    return pairs.three_hop_pairs(_knn(spark, sf_dir))


@query(f"""with recursive {KNN}, {LEADING} select src, dst, max(greatest(abs(x.d - y.d), .9))::double rest from edges join far x on x.node = src join far y on y.node = dst and y.source = x.source group by 1, 2""")
def graph_rest_lengths(spark, sf_dir):
    return pairs.rest_lengths(_knn(spark, sf_dir), _leading_hops(spark, sf_dir))


@query(f"""with {KNN}, deg as (select src, count(*) n from adj group by src) select a.src, a.dst, round(1 / sqrt((s.n * d.n)::double), 9) w from adj a join deg s on s.src = a.src join deg d on d.src = a.dst""")
def graph_normalised(spark, sf_dir):
    return _rounded(edges.normalised_adjacency(_knn(spark, sf_dir)), "w", digits=9)


@query(f"""with {KNN} select src, dst from edges join embeddings a on a.vec_id = src join embeddings b on b.vec_id = dst where a.label = b.label and a.label = (select min(label) from embeddings)""")
def graph_induced(spark, sf_dir):
    labels = _labels(spark, sf_dir)
    least = labels.agg(F.min("label").alias("label"))
    return edges.induced(_knn(spark, sf_dir), labels.join(least, "label", "left_semi"))


@query(f"""with {TREE}, regions as (select n_regionkey, count(distinct n_nationkey) + count(c_custkey) n from nation left join customer on c_nationkey = n_nationkey group by 1),
best as (select n_regionkey r from regions order by n desc, r limit 1), members as (select r::bigint + 1 node from best union all select n_nationkey::bigint + 100 from nation join best on n_regionkey = r
union all select c_custkey + 1000 from customer join nation on c_nationkey = n_nationkey join best on n_regionkey = r), named as (select node, row_number() over (order by node) - 1 id from members)
select least(a.id, b.id) src, greatest(a.id, b.id) dst from tree join named a on a.node = src join named b on b.node = dst""")
def graph_relabelled(spark, sf_dir):
    tree = graphs.place_tree(spark, sf_dir)
    nodes = stored(edges.largest_component(tree), "component")
    return edges.relabelled(edges.induced(tree, nodes), nodes)[1]


@query(f"""with {KNN}, {SEGMENTS}, ranked as (select node, src, dst, least(sqrt((x - x1) ** 2 + (y - y1) ** 2), sqrt((x - x2) ** 2 + (y - y2) ** 2), sqrt((x - (x1 + x2) / 2) ** 2 + (y - (y1 + y2) / 2) ** 2)) d from layout, seg where node <> src and node <> dst),
r as (select *, row_number() over (partition by node order by d, src, dst) "rank" from ranked) select node, src, dst, round(d, 6) d, "rank"::int "rank" from r where "rank" <= 3""")
def graph_near_edges(spark, sf_dir):
    return _rounded(spatial.near_edges(_knn(spark, sf_dir), _layout(spark, sf_dir), 3), "d")


@query(f"""with {KNN}, {SEGMENTS}, m as (select src, dst, (x1 + x2) / 2 x, (y1 + y2) / 2 y from seg), r as (select a.src a1, a.dst a2, b.src b1, b.dst b2, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) d,
row_number() over (partition by a.src, a.dst order by sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) k from m a, m b where a.src <> b.src or a.dst <> b.dst)
select a1, a2, b1, b2, round(d, 6) d from r where k <= 4 and a1 <> b1 and a1 <> b2 and a2 <> b1 and a2 <> b2""")
def graph_crossing_candidates(spark, sf_dir):
    return _rounded(spatial.crossing_candidates(_knn(spark, sf_dir), _layout(spark, sf_dir), 4), "d")


@query(f"""with {KNN}, {SEGMENTS}, {GAPS} select node, src, dst, round(sqrt((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2), 6) d from gaps where sqrt((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2) < .01""")
def join_near_segments(spark, sf_dir):
    return _rounded(spatial.near_segments(_knn(spark, sf_dir), _layout(spark, sf_dir), 0.01).select("node", "src", "dst", "d"), "d")


@query(f"""with {KNN}, {SEGMENTS}, s as (select row_number() over (order by src, dst) i, * from seg), c as (select greatest(least(abs((a.x2 - a.x1) * (b.x2 - b.x1) + (a.y2 - a.y1) * (b.y2 - b.y1)) / (sqrt((a.x2 - a.x1) ** 2 + (a.y2 - a.y1) ** 2) * sqrt((b.x2 - b.x1) ** 2 + (b.y2 - b.y1) ** 2) + 1e-12), 1), 0) cosine
from s a, s b where a.i < b.i and a.src <> b.src and a.src <> b.dst and a.dst <> b.src and a.dst <> b.dst
and ((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1) > 0) <> ((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1) > 0)
and ((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1) > 0) <> ((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1) > 0)),
p as (select count(*) pairs from s a, s b where a.i < b.i and a.src <> b.src and a.src <> b.dst and a.dst <> b.src and a.dst <> b.dst), f as (select count(*) crossings, avg(degrees(acos(cosine))) angle from c)
select crossings, pairs, round(1 - sqrt(crossings / pairs), 6) crosslessness, round(angle, 6) mean_crossing_angle from f, p""")
def score_crossing_angles(spark, sf_dir):
    return _rounded(metrics.crossing_scores(_knn(spark, sf_dir), _layout(spark, sf_dir)), "crosslessness", "mean_crossing_angle")


@query(f"with {KNN}, {SEGMENTS}, {GAPS} select node, src, dst, round(clearance, 6) clearance from clear")
def score_nearest_edges(spark, sf_dir):
    return _rounded(spatial.clearances(_knn(spark, sf_dir), _layout(spark, sf_dir)), "clearance")


@query(f"with {KNN}, {NEAREST} select a node, round(d, 6) nn from nearest where k = 1")
def score_spacing(spark, sf_dir):
    return _rounded(metrics.spacing(_layout(spark, sf_dir)), "nn")


@query(f"""with {KNN}, {SEGMENTS}, {GAPS}, {NEAREST}, len as (select src, dst, sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2) l from seg), u as (select median(l) med_edge, max(l) max_edge, quantile_cont(l, .9) long from len), v as (select median(d) med_nn from nearest where k = 1)
select round(med_edge, 6) med_edge, round(med_nn, 6) med_nn, round(avg((clearance < .25 * med_edge)::int), 6) occ_viol, round(avg((clearance < .25 * med_nn)::int), 6) occ_viol_ns, round(min(clearance / med_nn), 6) occ_min_ns,
round(quantile_cont(clearance / med_nn, .01), 6) occ_p01_ns, round(max_edge / med_edge, 6) edge_tail, round(avg((l >= long)::int) filter (where clearance < .25 * med_edge), 6) long_edge_share
from clear join len using (src, dst), u, v group by med_edge, med_nn, max_edge""")
def score_occlusion(spark, sf_dir):
    return _rounded(metrics.occlusion(_knn(spark, sf_dir), _layout(spark, sf_dir)), "med_edge", "med_nn", "occ_viol", "occ_viol_ns", "occ_min_ns", "occ_p01_ns", "edge_tail", "long_edge_share")


@query(f"""with {KNN}, {SEGMENTS}, len as (select sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2) l from seg), q as (select unnest([.01, .5, .9, .98]) share) select share::double share, round((select quantile_cont(l, [.01, .5, .9, .98]) from len)[list_position([.01, .5, .9, .98], share)], 6) "value" from q""")
def score_length_quantiles(spark, sf_dir):
    return _rounded(metrics.quantiles(metrics.edge_lengths(_knn(spark, sf_dir), _layout(spark, sf_dir)), "length"), "value")


@query(f"with {KNN}, {SEGMENTS} select round(quantile_disc(sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2), .5), 6) median from seg")
def score_median_length(spark, sf_dir):
    return _rounded(metrics.lower_median(metrics.edge_lengths(_knn(spark, sf_dir), _layout(spark, sf_dir)), "length"), "median")


@query(f"""with recursive {KNN}, {LEADING}, rows as (select source, node, d from far where d > 0 union all select src, dst, 1 from edges), r as (select sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / d r from rows join layout a on a.node = source join layout b on b.node = rows.node)
select round(1 - sum(r) ** 2 / (count(*) * sum(r * r)), 6) stress, round(sum(r) / sum(r * r), 6) scale, count(*) n_pairs from r""")
def score_pivot_edge_stress(spark, sf_dir):
    g = _knn(spark, sf_dir)
    return _rounded(energies.pivot_edge_stress(_leading_hops(spark, sf_dir), g, _layout(spark, sf_dir)), "stress", "scale")


@query(f"""with {KNN}, {NEAREST}, deg as (select src node, count(*) n from adj group by src), fresh as (select node from deg where n = (select min(n) from deg)), kept as (select node from layout where node not in (select node from fresh)),
k as (select p.node a, q.node b, row_number() over (partition by p.node order by sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)), q.node) k from layout p join fresh on fresh.node = p.node, layout q join kept on kept.node = q.node),
share as (select a, avg((x.label = y.label)::int) s from k join embeddings x on x.vec_id = a join embeddings y on y.vec_id = b where k.k <= 10 group by a),
odds as (select label, count(*) / (select count(*) from kept) o from kept join embeddings on vec_id = node group by label)
select round((select avg(s) from share), 6) agreement, round(avg(coalesce(o, 0)), 6) chance from fresh join embeddings e on e.vec_id = node left join odds using (label)""")
def score_placement(spark, sf_dir):
    g, at = _knn(spark, sf_dir), _layout(spark, sf_dir)
    deg = stored(edges.degrees(g), "degrees")
    fresh = at.join(deg.join(deg.agg(F.min("degree").alias("degree")), "degree", "left_semi"), "node", "left_semi")
    return _rounded(metrics.placement_agreement(fresh, at.join(fresh, "node", "left_anti"), _labels(spark, sf_dir)), "agreement", "chance")


@query(f"""with {KNN}, {SEGMENTS}, f as (select src, dst, greatest(sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2), 1e-9) d, x2 - x1 dx, y2 - y1 dy from seg), e as (select src node, d * dx / .1 fx, d * dy / .1 fy from f union all select dst, -d * dx / .1, -d * dy / .1 from f)
select node, round(sum(fx), 6) fx, round(sum(fy), 6) fy from e group by node""")
def force_attraction(spark, sf_dir):
    return _rounded(energies.attraction(_knn(spark, sf_dir), _layout(spark, sf_dir), 0.1), "fx", "fy")


@query(f"""with {KNN}, {ANCHORS}, deg as (select src node, count(*) + 1 m from adj group by src), p as (select h.node, a.x - q.x dx, a.y - q.y dy, .01 * da.m * db.m w from anchors h join layout a on a.node = h.node join deg da on da.node = h.node, layout q join deg db on db.node = q.node where q.node <> h.node)
select node, round(sum(w * dx / (dx * dx + dy * dy)), 5) fx, round(sum(w * dy / (dx * dx + dy * dy)), 5) fy from p where dx * dx + dy * dy between .0001 and .25 group by node""")
def force_repulsion(spark, sf_dir):
    """By law 'fa2', with a cut-off and without the pairs that are handled as near ones."""
    g = _knn(spark, sf_dir)
    return _rounded(energies.repulsion(_layout(spark, sf_dir), _anchors(spark, sf_dir), 0.1, "fa2", cutoff=5.0, near=0.1, edges=g), "fx", "fy", digits=5)


@query("""with l as (select vec_id node, embedding[1]::double x, embedding[2]::double y from embeddings), p as (select a.node, a.x - b.x dx, a.y - b.y dy from l a, l b where a.node <> b.node and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < .05)
select node, round(sum(.01 * dx / greatest(dx * dx + dy * dy, 1e-18)), 4) fx, round(sum(.01 * dy / greatest(dx * dx + dy * dy, 1e-18)), 4) fy from p group by node""")
def force_near(spark, sf_dir):
    return _rounded(energies.near_repulsion(_layout(spark, sf_dir), 0.1, 0.05), "fx", "fy", digits=4)


@query("""with l as (select vec_id node, embedding[1]::double x, embedding[2]::double y from embeddings), c as (select avg(x) mx, avg(y) my from l), f as (select node, x, y, .3 * (mx - x) fx, .3 * (my - y) fy from l, c)
select node, round(x + fx * least(1, .01 / greatest(sqrt(fx * fx + fy * fy), 1e-9)), 6) x, round(y + fy * least(1, .01 / greatest(sqrt(fx * fx + fy * fy), 1e-9)), 6) y from f""")
def force_gravity_step(spark, sf_dir):
    at = _layout(spark, sf_dir)
    return _rounded(energies.stepped(at, energies.gravity(at, 0.3), 0.01), "x", "y")


@query(f"""with {KNN}, {SEGMENTS}, a as (select sum(sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2) ** 3 / .3) s from seg), r as (select sum(ln(greatest(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 1e-6))) s from layout a, layout b where a.node < b.node)
select round((a.s - .01 * r.s) / (select count(*) from layout), 6) energy from a, r""")
def energy_forces(spark, sf_dir):
    return _rounded(energies.force_energy(_knn(spark, sf_dir), _layout(spark, sf_dir), 0.1), "energy")


@query(f"with {KNN}, {SEGMENTS} select round(avg(ln(1 + (x1 - x2) ** 2 + (y1 - y2) ** 2)), 6) attraction from seg")
def energy_attraction(spark, sf_dir):
    return _rounded(energies.edge_attraction_energy(_knn(spark, sf_dir), _layout(spark, sf_dir)), "attraction")


@query(f"""with {KNN}, {SEGMENTS}, two as (select distinct l.src a, r.dst b from adj l join adj r on l.dst = r.src where l.src < r.dst and not exists (select 1 from edges e where e.src = l.src and e.dst = r.dst)),
d as (select (p.x - q.x) ** 2 + (p.y - q.y) ** 2 d from two join layout p on p.node = a join layout q on q.node = b), u as (select sqrt(avg((x1 - x2) ** 2 + (y1 - y2) ** 2)) rms from seg),
e as (select avg(ln(1 + greatest(sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2) - .5 * rms, 0) ** 2)) e from seg, u) select round(4 * (select e from e) + .5 * avg(-ln(d / (1 + d) + 1e-6)), 6) energy from d""")
def energy_neighbour(spark, sf_dir):
    """Exaggerated, with a dead zone; the pairs at two hops repel."""
    g = _knn(spark, sf_dir)
    return _rounded(energies.neighbour_energy(g, edges.two_hop_pairs(g), _layout(spark, sf_dir), 4.0, 0.5, 0.5), "energy")


@query(f"""with {KNN}, two as (select distinct l.src a, r.dst b from adj l join adj r on l.dst = r.src where l.src < r.dst and not exists (select 1 from edges e where e.src = l.src and e.dst = r.dst)),
n as (select a, sum(1 / (1 + (p.x - q.x) ** 2 + (p.y - q.y) ** 2)) rest from two join layout p on p.node = a join layout q on q.node = b group by a),
e as (select src a, 1 / (1 + (p.x - q.x) ** 2 + (p.y - q.y) ** 2) q from edges join layout p on p.node = src join layout q on q.node = dst)
select round(avg(-ln(q / (q + coalesce(rest, 0)))), 6) contrast from e left join n using (a)""")
def energy_contrast(spark, sf_dir):
    g = _knn(spark, sf_dir)
    return _rounded(energies.contrast_energy(g, edges.two_hop_pairs(g).select(F.col("a").alias("node"), F.col("b").alias("negative")), _layout(spark, sf_dir)), "contrast")


@query(f"""with {KNN}, two as (select distinct l.src a, r.dst b from adj l join adj r on l.dst = r.src where l.src < r.dst and not exists (select 1 from edges e where e.src = l.src and e.dst = r.dst))
select round(-avg(ln(greatest(2 * sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2), 1e-9))), 6) spread from two join layout p on p.node = a join layout q on q.node = b""")
def energy_spread(spark, sf_dir):
    g = _knn(spark, sf_dir)
    return _rounded(energies.spread_energy(edges.two_hop_pairs(g), _layout(spark, sf_dir), 2.0), "spread")


@query(f"""with {KNN}, {SEGMENTS}, {GAPS} select round(avg(greatest(0, 1 - clearance / .05) ** 2), 6) clearance_loss from clear""")
def energy_clearance(spark, sf_dir):
    return _rounded(energies.clearance_energy(spatial.clearances(_knn(spark, sf_dir), _layout(spark, sf_dir)), 0.05), "clearance_loss")


@query(f"""with {KNN}, {SEGMENTS}, m as (select *, (x1 + x2) / 2 x, (y1 + y2) / 2 y from seg), r as (select a.x1 ax, a.y1 ay, a.x2 bx, a.y2 "by", b.x1 cx, b.y1 cy, b.x2 dx, b.y2 dy, a.src <> b.src and a.src <> b.dst and a.dst <> b.src and a.dst <> b.dst ok,
row_number() over (partition by a.src, a.dst order by sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) k from m a, m b where a.src <> b.src or a.dst <> b.dst),
t as (select ((bx - ax) * (cy - ay) - ("by" - ay) * (cx - ax)) * ((bx - ax) * (dy - ay) - ("by" - ay) * (dx - ax)) u, ((dx - cx) * (ay - cy) - (dy - cy) * (ax - cx)) * ((dx - cx) * ("by" - cy) - (dy - cy) * (bx - cx)) v from r where k <= 4 and ok)
select round(avg(1 / (1 + exp(least(greatest(u / 1e-4, -60), 60))) / (1 + exp(least(greatest(v / 1e-4, -60), 60)))), 6) crossing_loss from t""")
def energy_crossing(spark, sf_dir):
    g, at = _knn(spark, sf_dir), _layout(spark, sf_dir)
    return _rounded(energies.smooth_crossing_energy(spatial.crossing_candidates(g, at, 4).drop("d"), at, 1e-4), "crossing_loss")


@query(f"""with recursive {KNN}, {ANCHORS}, far_from as (select node source, node, 0 d from anchors union select r.source, a.dst, r.d + 1 from far_from r join adj a on a.src = r.node where r.d < 24),
far as (select source, node, min(d) d from far_from group by all), both_ends as (select y.node a, x.node, max(abs(x.d - y.d)) b from anchors h join far y on y.node = h.node join far x on x.source = y.source group by 1, 2),
b as (select h.node a, q.node, coalesce(b, 0) b from anchors h cross join layout q left join both_ends e on e.a = h.node and e.node = q.node),
p as (select a, b.node, s.x ax, s.y ay, q.x, q.y, greatest(sqrt((s.x - q.x) ** 2 + (s.y - q.y) ** 2), 1e-6) d, greatest(b, .9) r from b join layout s on s.node = a join layout q on q.node = b.node),
c as (select sum(d * r) / sum(r * r) scale, count(distinct node) n from p), w as (select a, 1 / (scale * r) ** 2 w, scale * r r, d, ax, ay, x, y, n, scale from p, c where a <> node and not exists (select 1 from adj where src = a and dst = node))
select a node, round(sum(w * (x - ax + r / d * (ax - x))) / any_value(n), 6) num_x, round(sum(w * (y - ay + r / d * (ay - y))) / any_value(n), 6) num_y, round(sum(w) / any_value(n), 6) den, round(any_value(scale), 6) scale from w group by a""")
def layout_mean_field_rows(spark, sf_dir):
    """The exact rows of one mean-field majorisation step, at anchors."""
    g, anchors = _knn(spark, sf_dir), _anchors(spark, sf_dir)
    columns = edges.nodes_of(g).join(hops.numbered_columns(g, anchors)[0], "node", "left")  # nodes that no anchor reaches count as well
    return _rounded(energies.mean_field_rows(_layout(spark, sf_dir), columns, anchors, g), "num_x", "num_y", "den", "scale")


@query(f"""with recursive {KNN}, {LEADING}, r as (select sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / d r from far join layout a on a.node = source join layout b on b.node = far.node where d > 0), u as (select sum(r * r) / sum(r) unit from r),
rows as (select source, node, d, 1.0 / (d * d) w from far where d > 0 union all select src, dst, 1, 1 from adj), t as (select rows.node, w, a.x + d * unit / greatest(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 1e-9) * (b.x - a.x) tx, a.y + d * unit / greatest(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 1e-9) * (b.y - a.y) ty
from rows join layout a on a.node = source join layout b on b.node = rows.node, u) select node, round(sum(w * tx) / sum(w), 6) x, round(sum(w * ty) / sum(w), 6) y from t group by node""")
def layout_majorised_with_edges(spark, sf_dir):
    g = _knn(spark, sf_dir)
    return _rounded(energies.majorised_with(_leading_hops(spark, sf_dir), g, _layout(spark, sf_dir)), "x", "y")


@query(f"""with {KNN}, b as (select min(x) lx, min(y) ly, greatest(max(x) - min(x), max(y) - min(y), 1e-12) s from layout)
select label, least(floor((x - lx) / s * 16), 15)::int px, least(floor((y - ly) / s * 16), 15)::int py, count(*) n from layout join embeddings on vec_id = node, b group by 1, 2, 3""")
def layout_raster_labels(spark, sf_dir):
    return spatial.points_raster(_layout(spark, sf_dir).join(_labels(spark, sf_dir), "node"), 16, "label")


@query(f"""with {KNN}, {SEGMENTS}, b as (select min(x) lx, min(y) ly, greatest(max(x) - min(x), max(y) - min(y), 1e-12) s from layout), along as (select src, dst, x1 + t / 32 * (x2 - x1) x, y1 + t / 32 * (y2 - y1) y from seg, (select unnest(range(33)) t)),
met as (select distinct src, dst, least(floor((x - lx) / s * 16), 15)::int px, least(floor((y - ly) / s * 16), 15)::int py from along, b) select px, py, count(*) n from met group by 1, 2""")
def layout_lines(spark, sf_dir):
    return spatial.lines_raster(_knn(spark, sf_dir), _layout(spark, sf_dir), 16)


@query(f"""with {KNN}, c as (select avg(x) mx, avg(y) my from layout), d as (select node, x - mx x, y - my y from layout, c), r as (select quantile_cont(sqrt(x * x + y * y), .98) r from d) select node, round(x / r, 6) x, round(y / r, 6) y from d, r""")
def layout_rescaled(spark, sf_dir):
    return _rounded(energies.rescaled(_layout(spark, sf_dir)), "x", "y")


@query(f"""with {RANKS}, t as (select graph, "rank", count(*) t from r group by 1, 2), u as (select sum(t ** 3 - t) ties from t), m as (select "method", sum("rank") s, count(*) n from r group by 1), q as (select sum(s * s) q, count(*) k, max(n) n from m)
select k, round(exp(-(12.0 / (n * k * (k + 1)) * q - 3 * n * (k + 1)) / (1 - ties / (n * (k ** 3 - k))) / 2), 6) p from q, u""")
def table_friedman_p(spark, sf_dir):
    """With three methods the tail of the statistic is exp(-statistic / 2)."""
    return _rounded(ranking.friedman(_ranks(spark, sf_dir)).select("k", "p"), "p")


@query("""with v as (select o_orderpriority graph, l_returnflag "method", 'quantity' metric, round(avg(l_quantity), 6) v from orders join lineitem on l_orderkey = o_orderkey group by 1, 2 union all
select o_orderpriority, l_returnflag, 'discount', round(avg(l_discount), 6) from orders join lineitem on l_orderkey = o_orderkey group by 1, 2),
r as (select metric, graph, "method", rank() over (partition by metric, graph order by v) + (count(*) over (partition by metric, graph, v) - 1) / 2.0 r from v), m as (select metric, "method", avg(r) r from r group by 1, 2), o as (select "method", avg(r) r from m group by 1)
select "method", round(r, 6)::double "rank", row_number() over (order by r, "method")::int place from o""")
def table_overall_ranks(spark, sf_dir):
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    rows = orders.join(lines, orders.o_orderkey == lines.l_orderkey).groupBy(F.col("o_orderpriority").alias("graph"), F.col("l_returnflag").alias("method"))
    out = None
    for metric, column in (("quantity", "l_quantity"), ("discount", "l_discount")):
        one = ranking.mean_ranks(rows.agg(F.round(F.avg(column), 6).alias("value"))).withColumn("metric", F.lit(metric))
        out = one if out is None else out.unionByName(one)
    return _rounded(ranking.overall_ranks(out), "rank")


MARKS = """c as (select o_orderpriority graph, o_orderstatus "method", avg(o_totalprice) mean from orders group by 1, 2), f as (select *, min(mean) over (partition by graph) a from c),
s as (select *, min(case when mean > a + 5000 then mean end) over (partition by graph) b from f)"""


@query(f"""with {MARKS} select graph, "method", round(mean, 4) mean, case when mean <= a + 5000 then 'best' when mean <= b + 5000 then 'second' end mark from s""")
def table_marked(spark, sf_dir):
    """Means that differ by less than half of ten thousand share a mark."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    found = ranking.cells(orders.select(F.col("o_orderpriority").alias("graph"), F.col("o_orderstatus").alias("method"), F.col("o_totalprice").alias("value")))
    return _rounded(ranking.marked(found, -4), "mean", digits=4)


@query("""with v as (select o_orderpriority graph, year(o_orderdate) seed, o_orderstatus m, avg(o_totalprice) v from orders group by 1, 2, 3), d as (select a.graph, a.v - b.v d from v a join v b using (graph, seed) where a.m = 'F' and b.m = 'O')
select graph, count(*) n, round(case when count(*) >= 3 and stddev_samp(d) > 0 then avg(d) / (stddev_samp(d) / sqrt(count(*))) end, 6) t from d group by graph""")
def table_paired(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.groupBy(F.col("o_orderpriority").alias("graph"), F.year("o_orderdate").alias("seed"), F.col("o_orderstatus").alias("method")).agg(F.avg("o_totalprice").alias("value"))
    return _rounded(ranking.paired(rows, "F", "O").drop("p"), "t")


@query("""select o_orderpriority graph, arg_min(o_totalprice, (o_totalprice, o_orderkey)) loss, arg_min(o_orderkey, (o_totalprice, o_orderkey)) config from orders group by 1""")
def table_selected(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return ranking.selected(orders.select(F.col("o_orderpriority").alias("graph"), F.col("o_totalprice").alias("loss"), F.col("o_orderkey").alias("config")), "loss", "graph")


def _of(name: str, digits: int | None, *columns: str) -> str:
    """A subquery of another query's SQL."""
    return f"(select {', '.join(c if digits is None else f'round({c}, {digits}) {c}' for c in columns)} from ({ORACLE[name]}))"


OCCLUSION = ("med_edge", "med_nn", "occ_viol", "occ_viol_ns", "occ_min_ns", "occ_p01_ns", "edge_tail", "long_edge_share")
FAR_STRESS = f"""(with recursive {KNN}, {LEADING}, r as (select sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / d r from far join layout a on a.node = source join layout b on b.node = far.node where d > 0)
select round(1 - sum(r) ** 2 / (count(*) * sum(r * r)), 4) stress from r)"""


@query("select * from " + ", ".join([
    FAR_STRESS, _of("score_neighbours", 4, "np_jaccard", "knn_recall"), _of("score_edge_lengths", 4, "edge_cov"), _of("score_crossing_angles", None, "crossings"), _of("score_crossing_angles", 4, "crosslessness"),
    _of("score_crossing_angles", 1, "mean_crossing_angle"), _of("score_silhouette", None, "silhouette"), _of("score_purity", None, "purity"), _of("score_occlusion", None, *OCCLUSION),
]))
def score_bundle(spark, sf_dir):
    """Every score of the layout, against hops from the leading nodes."""
    g = _knn(spark, sf_dir)
    return _rounded(metrics.score_bundle(g, _layout(spark, sf_dir), _leading_hops(spark, sf_dir), _labels(spark, sf_dir)), "silhouette", "purity", *OCCLUSION)


FLAGSHIP = score_bundle


@query("""with forest as (select distinct n_regionkey::bigint + 1 src, n_nationkey::bigint + 100 dst from nation where n_regionkey is not null and n_nationkey is not null),
late as (select c_nationkey::bigint + 100 src, c_custkey::bigint + 1000 dst from customer where c_nationkey is not null and c_custkey is not null
  union select o_custkey::bigint + 1000, -1 - o_orderkey::bigint from orders where o_custkey is not null and o_orderkey is not null),
adj0 as (select src, dst from forest union all select dst, src from forest), deg0 as (select src, count(*) n from adj0 group by src),
adj as (select src, dst from adj0 union all select src, dst from late union all select dst, src from late), deg as (select src, count(*) n from adj group by src),
w as (select a.src, a.dst, 1 / sqrt((s.n * d.n)::double) w from adj a join deg s on s.src = a.src join deg d on d.src = a.dst where a.dst not in (select src from adj0)),
base as (select f.src landmark, f.dst node, .05 * .95 / sqrt((s.n * d.n)::double) p from forest f join deg0 s on s.src = f.src join deg0 d on d.src = f.dst),
p1 as (select landmark, dst node, .95 * sum(w * p) p from base join w on src = node group by 1, 2)
select landmark, dst node, round(.95 * sum(w * p), 9) p from (select * from base union all select * from p1) join w on src = node group by 1, 2""")
def stream_growth(spark, sf_dir):
    """Potentials, from the regions, of customers and of their orders that come by a stream to the graph of regions and nations: customers next to
    a fitted nation in one batch, orders two steps from it in the next. The stream's places are by a network that hasn't learned, and aren't returned."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    forest = stored(edges.canonical(table("nation").select((F.col("n_regionkey").cast("long") + 1).alias("src"), (F.col("n_nationkey").cast("long") + 100).alias("dst"))), "forest")
    regions = stored(forest.select(F.col("src").alias("node")).distinct(), "regions")
    potentials = stored(diffusion.diffusion(forest, regions, 0.05, 2), "potentials")
    stats = stored(diffusion.moments(diffusion.feature_table(potentials, edges.nodes_of(forest), regions)), "stats")
    fitted = growth.Fitted(network.started(max(1, regions.count()), "pivot", 0), forest, potentials, regions, stats)
    path = new_path(spark, "growth")
    customer = F.col("c_custkey").cast("long") + 1000
    batches = table("customer").select((F.col("c_nationkey").cast("long") + 100).alias("src"), customer.alias("dst")), table("orders").select((F.col("o_custkey").cast("long") + 1000).alias("src"), (-1 - F.col("o_orderkey").cast("long")).alias("dst"))
    for batch in batches:
        batch.write.mode("append").parquet(f"{path}/arriving")
        arrivals = spark.readStream.schema("src long, dst long").parquet(f"{path}/arriving")
        growth.grow_by_edges(arrivals, fitted, f"{path}/grown", f"{path}/state").awaitTermination()
    return _rounded(growth.grown(spark, f"{path}/grown", "potentials"), "p", digits=9)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
