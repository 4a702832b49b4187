"""Clusterings, paths, flows and curvature, on the nations' hypergraph where SQL has to iterate and on whole tables elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import basic, centrality, communities, geometry, learning, paths, patterns, transforms
from .graph import PRELUDE, orders_over_parts, segments_over_nations
from .registry import Registry

REGISTRY = Registry(PRELUDE)
q = REGISTRY.add

_JACCARD = """, dn AS (SELECT node_id, count(*) AS d FROM nat GROUP BY 1), sim AS (SELECT a.node_id AS a, b.node_id AS b, count(*) / (x.d + y.d - count(*)) AS s FROM nat a JOIN nat b ON a.edge_id = b.edge_id AND a.node_id <> b.node_id
JOIN dn x ON x.node_id = a.node_id JOIN dn y ON y.node_id = b.node_id GROUP BY 1, 2, x.d, y.d)"""


def _linked(least: float, name: str = "") -> str:
    return f", lk{name} AS (SELECT a, b FROM sim WHERE s >= {least}), rc{name} AS (SELECT node_id AS a, node_id AS b FROM nat UNION SELECT r.a, l.b FROM rc{name} r JOIN lk{name} l ON l.a = r.b)"


@q("single_linkage", _JACCARD + _linked(0.6) + " SELECT a AS node_id, min(b) AS community FROM rc GROUP BY 1")
def _(spark, d):
    return communities.single_linkage(segments_over_nations(spark, d), 0.6)


@q("multi_resolution", _JACCARD + _linked(0.5, "x") + _linked(0.8, "y") + " SELECT 0.5::DOUBLE AS resolution, a AS node_id, min(b) AS community FROM rcx GROUP BY 2 UNION ALL SELECT 0.8, a, min(b) FROM rcy GROUP BY 2")
def _(spark, d):
    return communities.multi_resolution(segments_over_nations(spark, d), (0.5, 0.8))


@q("edge_communities", """, dn AS (SELECT edge_id, count(*) AS d FROM nat GROUP BY 1), lk AS (SELECT a.edge_id AS a, b.edge_id AS b FROM nat a JOIN nat b ON a.node_id = b.node_id AND a.edge_id <> b.edge_id JOIN dn x ON x.edge_id = a.edge_id JOIN dn y ON y.edge_id = b.edge_id
GROUP BY 1, 2, x.d, y.d HAVING count(*) / (x.d + y.d - count(*)) >= 0.7), rc AS (SELECT DISTINCT edge_id AS a, edge_id AS b FROM nat UNION SELECT r.a, l.b FROM rc r JOIN lk l ON l.a = r.b) SELECT a AS edge_id, min(b) AS community FROM rc GROUP BY 1""")
def _(spark, d):
    return communities.edge_communities(segments_over_nations(spark, d), 0.7)


@q("consensus_communities", """, runs AS (SELECT CAST(n_nationkey AS VARCHAR) AS node_id, n_regionkey AS c, 0 AS run FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), n_regionkey % 2, 1 FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), n_nationkey % 3, 2 FROM nation),
lk AS (SELECT a.node_id AS a, b.node_id AS b FROM runs a JOIN runs b ON a.run = b.run AND a.c = b.c AND a.node_id <> b.node_id GROUP BY 1, 2 HAVING count(*) >= 3), rc AS (SELECT DISTINCT node_id AS a, node_id AS b FROM runs UNION SELECT r.a, l.b FROM rc r JOIN lk l ON l.a = r.b) SELECT a AS node_id, min(b) AS community FROM rc GROUP BY 1""")
def _(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"))
    labels = F.array(*[F.struct(F.lit(i).alias("run"), c.cast("string").alias("community")) for i, c in enumerate((F.col("r"), F.col("r") % 2, F.col("k") % 3))])
    runs = n.select(F.col("k").cast("string").alias("node_id"), F.explode(labels).alias("x")).select("x.run", "node_id", "x.community")
    return communities.consensus(runs, 1.0)


def regions(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("node_id"), F.col("n_regionkey").cast("string").alias("community"))


_PARTS = """, mem AS (SELECT i.edge_id, i.node_id, p_type AS c FROM inc i JOIN part ON node_id = CAST(p_partkey AS VARCHAR)), ec AS (SELECT edge_id, count(DISTINCT c) AS c FROM mem GROUP BY 1), sz AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1),
em AS (SELECT avg(inside / (s * (s - 1))) AS m FROM (SELECT edge_id, sum(k) AS s, sum(k * (k - 1)) AS inside FROM (SELECT edge_id, c, count(*) AS k FROM mem GROUP BY 1, 2) GROUP BY 1) WHERE s > 1),
pw AS (SELECT a.c AS ca, b.c AS cb, count(*) AS w FROM mem a JOIN mem b ON a.edge_id = b.edge_id AND a.node_id < b.node_id GROUP BY 1, 2), dd AS (SELECT c, sum(w) AS d FROM (SELECT ca AS c, w FROM pw UNION ALL SELECT cb, w FROM pw) GROUP BY 1)"""
_QUALITY = """(SELECT count(*) FROM sz) AS communities, round(avg(CASE WHEN c = 1 THEN 1.0 ELSE 0 END), 6) AS coverage, round(1 - avg(CASE WHEN c = 1 THEN 1.0 ELSE 0 END), 6) AS conductance, (SELECT round(avg(n), 6) FROM sz) AS size_mean,
(SELECT round(stddev_pop(n), 6) FROM sz) AS size_std, (SELECT max(n) FROM sz) AS size_max, (SELECT min(n) FROM sz) AS size_min, (SELECT round(m, 6) FROM em) AS modularity"""


def by_type(spark: SparkSession, d: str):
    return lambda inc: spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("string").alias("node_id"), F.col("p_type").alias("community"))


@q("clustering_evaluation", _PARTS + f" SELECT {_QUALITY}, round((SELECT sum(w) FILTER (ca = cb) / sum(w) FROM pw) - (SELECT sum(d * d) FROM dd) / (4.0 * (SELECT sum(w) FROM pw) ** 2), 6) AS newman FROM ec")
def _(spark, d):
    inc = orders_over_parts(spark, d)
    return communities.evaluate(inc, by_type(spark, d)(inc))


@q("clustering_analysis", _PARTS + f" SELECT 'types' AS algorithm, {_QUALITY} FROM ec")
def _(spark, d):
    return communities.clustering_analysis(orders_over_parts(spark, d), {"types": by_type(spark, d)})


@q("agglomerative_nations")
def _(spark, d):
    return communities.agglomerative(segments_over_nations(spark, d), 4)


@q("adaptive_nations")
def _(spark, d):
    return communities.adaptive_communities(segments_over_nations(spark, d), 4)


@q("overlapping_nations", "SELECT count(DISTINCT node_id) AS nodes, true AS over_share FROM nat")
def _(spark, d):
    o = communities.overlapping(segments_over_nations(spark, d), 3, rounds=4)
    return o.agg(F.countDistinct("node_id").alias("nodes"), (F.min("membership") > 1 / 3).alias("over_share"))


@q("spectral_clusters", "SELECT count(DISTINCT a) AS nodes, true AS at_most_three FROM nn")
def _(spark, d):
    c = communities.spectral_clustering(segments_over_nations(spark, d), 3)
    return c.agg(F.countDistinct("node_id").alias("nodes"), (F.countDistinct("community") <= 3).alias("at_most_three"))


@q("embedded_clusters", "SELECT count(DISTINCT node_id) AS nodes, true AS at_most_three FROM nat")
def _(spark, d):
    c = communities.kmeans(communities.spectral_embedding(segments_over_nations(spark, d), 2), 3)
    return c.agg(F.countDistinct("node_id").alias("nodes"), (F.countDistinct("community") <= 3).alias("at_most_three"))


@q("label_propagation_parts")
def _(spark, d):
    return communities.label_propagation(orders_over_parts(spark, d, "l_orderkey % 50 = 0 OR l_quantity > 0"), 3)


# components, paths, walks and flows


@q("largest_component", """, nb AS (SELECT a, b FROM nn WHERE abs(CAST(a AS INT) - CAST(b AS INT)) % 7 = 0), rc AS (SELECT DISTINCT node_id AS a, node_id AS b FROM nat UNION SELECT r.a, n.b FROM rc r JOIN nb n ON n.a = r.b), c AS (SELECT a, min(b) AS c FROM rc GROUP BY 1),
top AS (SELECT c FROM c GROUP BY 1 ORDER BY count(*) DESC, c LIMIT 1) SELECT a || '|' || b AS edge_id, CAST(unnest([a, b]) AS VARCHAR) AS node_id FROM nb WHERE a < b AND a IN (SELECT a FROM c WHERE c = (SELECT c FROM top))""")
def _(spark, d):
    e = paths.neighbor_edges(segments_over_nations(spark, d)).where("a < b AND abs(cast(a as int) - cast(b as int)) % 7 = 0")
    inc = e.select(F.concat_ws("|", "a", "b").alias("edge_id"), F.explode(F.array("a", "b")).alias("node_id"))
    return paths.largest_component(inc).select("edge_id", "node_id")


@q("parts_in_one_component", "SELECT count(*) AS nodes, 1 AS components FROM deg")
def _(spark, d):
    """Components of the whole orders-parts hypergraph, which hangs together."""
    return paths.connected_components(orders_over_parts(spark, d)).agg(F.count("*").alias("nodes"), F.countDistinct("component").alias("components"))


@q("bfs_parts", ", one AS (SELECT DISTINCT b.node_id FROM inc a JOIN inc b USING (edge_id) WHERE a.node_id = '1') SELECT node_id AS node, CASE WHEN node_id = '1' THEN 0 ELSE 1 END AS depth FROM one")
def _(spark, d):
    start = spark.createDataFrame([("1",)], "source string")
    return paths.bfs(paths.neighbor_edges(orders_over_parts(spark, d)), start, 1).select("node", "depth")


_WALK = ", walk AS (SELECT '0' AS node, 0 AS depth, ['0'] AS path UNION ALL SELECT b, depth + 1, list_append(path, b) FROM walk JOIN thin ON node = a WHERE depth < 6 AND NOT list_contains(path, b)), best AS (SELECT node, min(depth) AS depth FROM walk GROUP BY 1)"
_THIN = ", thin AS (SELECT a, b FROM nn WHERE abs(CAST(a AS INT) - CAST(b AS INT)) IN (7, 14))"


def thin(spark: SparkSession, d: str) -> DataFrame:
    """A sparse part of the nations' graph: neighbours whose keys differ by 7 or 14."""
    return paths.neighbor_edges(segments_over_nations(spark, d)).where("abs(cast(a as int) - cast(b as int)) IN (7, 14)")


@q("all_shortest_paths", _THIN + _WALK + " SELECT node, CAST(depth AS BIGINT) AS depth, array_to_string(path, '>') AS path FROM walk JOIN best USING (node, depth)")
def _(spark, d):
    return paths.all_shortest_paths(thin(spark, d), "0", most_depth=6).select("node", "depth", F.array_join("path", ">").alias("path"))


@q("shortest_path_pair", _THIN + _WALK + " SELECT node, CAST(depth AS BIGINT) AS depth, min(array_to_string(path, '>')) AS path FROM walk JOIN best USING (node, depth) WHERE node = '21' GROUP BY 1, 2")
def _(spark, d):
    p = paths.all_shortest_paths(thin(spark, d), "0", "21", 6)
    return p.groupBy("node", "depth").agg(F.min(F.array_join("path", ">")).alias("path"))


@q("simple_paths", _THIN + ", walk AS (SELECT ['0'] AS path, '0' AS node UNION ALL SELECT list_append(path, b), b FROM walk JOIN thin ON node = a WHERE len(path) <= 4 AND node <> '21' AND NOT list_contains(path, b)) SELECT array_to_string(path, '>') AS path, len(path) - 1 AS hops FROM walk WHERE node = '21' AND len(path) > 1")
def _(spark, d):
    return paths.simple_paths(thin(spark, d), "0", "21", 4).select(F.array_join("path", ">").alias("path"), "hops")


@q("cycles_of_four", _THIN + """, w3 AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM thin x JOIN thin y ON y.a = x.b WHERE x.a < x.b AND x.a < y.b AND x.b <> y.b)
SELECT p || '>' || q || '>' || r AS cycle FROM w3 JOIN thin z ON z.a = r AND z.b = p WHERE q < r UNION ALL SELECT p || '>' || q || '>' || r || '>' || y.b FROM w3 JOIN thin y ON y.a = r JOIN thin z ON z.a = y.b AND z.b = p WHERE y.b > p AND y.b <> q AND q < y.b""")
def _(spark, d):
    return paths.cycles(thin(spark, d), 4).select(F.array_join("cycle", ">").alias("cycle"))


@q("reachability", _THIN + ", rc AS (SELECT '0' AS n UNION SELECT b FROM rc JOIN thin ON a = n) SELECT CASE WHEN EXISTS (SELECT 1 FROM rc WHERE n = '21') THEN 1.0::DOUBLE ELSE 0.0 END AS connected")
def _(spark, d):
    return paths.reachable(thin(spark, d), "0", "21")


@q("depth_first_nations")
def _(spark, d):
    order = paths.depth_first(segments_over_nations(spark, d), "0")
    return spark.createDataFrame(list(enumerate(order)), "place int, node_id string")


@q("random_walk_steps", "SELECT true AS all_steps_are_links, count(DISTINCT node_id) AS walks FROM nat")
def _(spark, d):
    inc = segments_over_nations(spark, d)
    starts = inc.select("node_id").distinct().select(F.col("node_id").alias("walk"), "node_id")
    w = paths.random_walks(inc, starts, 3)
    step = w.select("walk", "step", F.col("node_id").alias("a")).join(w.select("walk", (F.col("step") - 1).alias("step"), F.col("node_id").alias("b")), ["walk", "step"])
    bad = step.join(paths.neighbor_edges(inc), ["a", "b"], "left_anti")
    return w.agg(F.countDistinct("walk").alias("walks")).join(bad.agg((F.count("*") == 0).alias("all_steps_are_links")))


_COST = ", cst AS (SELECT a, b, CAST(1 + (CAST(a AS INT) + CAST(b AS INT)) % 5 AS DOUBLE) AS cost FROM nn WHERE abs(CAST(a AS INT) - CAST(b AS INT)) IN (7, 14))"


def costs(spark: SparkSession, d: str) -> DataFrame:
    return thin(spark, d).withColumn("cost", (1 + (F.col("a").cast("int") + F.col("b").cast("int")) % 5).cast("double"))


@q("weighted_shortest_distances", _COST + ", w AS (SELECT '0' AS node, 0.0::DOUBLE AS distance, ['0'] AS path UNION ALL SELECT b, distance + cost, list_append(path, b) FROM w JOIN cst ON a = node WHERE len(path) < 9 AND NOT list_contains(path, b)), far AS (SELECT node, min(distance) AS distance FROM w GROUP BY 1) SELECT node, distance FROM far WHERE distance <= 8")
def _(spark, d):
    return paths.weighted_distances(costs(spark, d), "0").where("distance <= 8")


@q("spanning_forest_weight", _COST + """, ks AS (SELECT DISTINCT node_id AS n FROM nat), rc AS (SELECT a, a AS b, 0 AS t FROM cst GROUP BY 1 UNION SELECT r.a, c.b, 0 FROM rc r JOIN cst c ON c.a = r.b)
SELECT (SELECT count(DISTINCT a) FROM cst) - (SELECT count(DISTINCT m) FROM (SELECT a, min(b) AS m FROM rc GROUP BY 1)) AS edges, true AS within_bounds""")
def _(spark, d):
    c = costs(spark, d)
    tree = paths.spanning_forest(c)
    return tree.agg(F.count("*").alias("edges"), F.sum("cost").alias("w")).join(c.agg((F.sum("cost") / 2).alias("all"))).select("edges", F.coalesce(F.col("w") <= F.col("all"), F.lit(True)).alias("within_bounds"))


@q("k_core_rounds", """, e0 AS (SELECT edge_id, node_id FROM nat), l1 AS (SELECT edge_id FROM e0 GROUP BY 1 HAVING count(*) >= 2) SELECT count(DISTINCT node_id) AS nodes, (SELECT count(DISTINCT node_id) FROM e0 WHERE edge_id IN (SELECT edge_id FROM l1)) AS in_first_core FROM e0""")
def _(spark, d):
    return paths.k_core(segments_over_nations(spark, d)).agg(F.count("*").alias("nodes"), F.count_if(F.col("core") >= 1).alias("in_first_core"))


@q("load_centrality_nations")
def _(spark, d):
    return centrality.load(segments_over_nations(spark, d))


@q("incremental_degrees", "SELECT node_id, count(*) AS degree FROM inc WHERE NOT (CAST(edge_id AS BIGINT) % 10 = 0) GROUP BY 1")
def _(spark, d):
    inc = orders_over_parts(spark, d)
    e = F.col("edge_id").cast("long") % 10
    before = basic.node_degrees(inc.where(e < 5))
    return centrality.incremental_degree(before, inc.where(e >= 5), inc.where(e == 0))


# samples, densities, weights, transforms


@q("sampled_degrees", "SELECT node_id, degree FROM deg")
def _(spark, d):
    return learning.sampled(orders_over_parts(spark, d), basic.node_degrees, 10_000_000)


@q("sample_sizes", "SELECT * FROM (VALUES ('clustering', 300), ('centrality', 500), ('general', 400), ('community', 600)) AS v(purpose, nodes)")
def _(spark, d):
    return spark.createDataFrame([(p, learning.sample_size(1000, 100, 5000, p)) for p in ("clustering", "centrality", "general", "community")], "purpose string, nodes int")


@q("hypergraph_density", "SELECT round(count(DISTINCT edge_id) / (2.0 ** count(DISTINCT node_id) - count(DISTINCT node_id) - 1), 6) AS density FROM nat")
def _(spark, d):
    return patterns.density(segments_over_nations(spark, d))


_TRI = """, pw AS (SELECT a.node_id AS a, b.node_id AS b, sum(sqrt(a.weight * b.weight)) AS s FROM nat a JOIN nat b ON a.edge_id = b.edge_id AND a.node_id <> b.node_id GROUP BY 1, 2), dg AS (SELECT a, count(*) AS d FROM pw GROUP BY 1),
tri AS (SELECT x.a AS node_id, sum((x.s * y.s * z.s) ** (1.0 / 3)) / (SELECT max(s) FROM pw) AS t FROM pw x JOIN pw y ON y.a = x.a AND x.b < y.b JOIN pw z ON z.a = x.b AND z.b = y.b GROUP BY 1)"""


@q("weighted_clustering", _TRI + " SELECT n.node_id, round(coalesce(CASE WHEN d > 1 THEN 2 * coalesce(t, 0) / (d * (d - 1)) END, 0), 6) AS coefficient FROM (SELECT DISTINCT node_id FROM nat) n LEFT JOIN dg ON dg.a = n.node_id LEFT JOIN tri ON tri.node_id = n.node_id")
def _(spark, d):
    return patterns.weighted_clustering(segments_over_nations(spark, d))


@q("global_clustering", _TRI + " SELECT round(avg(coalesce(CASE WHEN d > 1 THEN 2 * coalesce(t, 0) / (d * (d - 1)) END, 0)), 6) AS coefficient FROM (SELECT DISTINCT node_id FROM nat) n LEFT JOIN dg ON dg.a = n.node_id LEFT JOIN tri ON tri.node_id = n.node_id")
def _(spark, d):
    return patterns.weighted_clustering(segments_over_nations(spark, d)).agg(F.avg("coefficient").alias("coefficient"))


@q("structural_summary", """SELECT count(DISTINCT node_id) AS nodes, count(DISTINCT edge_id) AS edges, (SELECT count(*) FROM nn) // 2 AS pairs, round((SELECT count(*) FROM nn) / (count(DISTINCT node_id) * (count(DISTINCT node_id) - 1)), 6) AS pair_density FROM nat""")
def _(spark, d):
    return patterns.structural_summary(segments_over_nations(spark, d))


_SETS = ", sm AS (SELECT 'e' || CAST(n_regionkey % 2 AS VARCHAR) || CAST(n_nationkey % 3 AS VARCHAR) AS edge_id, CAST(n_regionkey AS VARCHAR) AS node_id FROM nation)"


def small(spark: SparkSession, d: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/nation.parquet")
    edge = F.concat(F.lit("e"), (F.col("n_regionkey") % 2).cast("string"), (F.col("n_nationkey") % 3).cast("string"))
    return n.select(edge.alias("edge_id"), F.col("n_regionkey").cast("string").alias("node_id"), F.lit(1.0).alias("weight")).distinct()


@q("complement_sets", _SETS + """, ids AS (SELECT DISTINCT node_id FROM sm), sets AS (SELECT node_id AS nodes, node_id AS top FROM ids UNION ALL SELECT nodes || ',' || i.node_id, i.node_id FROM sets JOIN ids i ON i.node_id > top),
have AS (SELECT string_agg(DISTINCT node_id, ',' ORDER BY node_id) AS nodes FROM sm GROUP BY edge_id) SELECT nodes FROM sets WHERE nodes NOT IN (SELECT nodes FROM have)""")
def _(spark, d):
    return transforms.complement(small(spark, d)).select(F.array_join("nodes", ",").alias("nodes"))


@q("maximal_cliques", _SETS + """, pr AS (SELECT DISTINCT a.node_id AS a, b.node_id AS b FROM sm a JOIN sm b ON a.edge_id = b.edge_id AND a.node_id <> b.node_id), cl AS (SELECT [a] AS c, a AS top FROM pr GROUP BY 1, 2 UNION ALL SELECT list_append(c, x.b), x.b FROM cl JOIN (SELECT DISTINCT b FROM pr) x ON x.b > top
WHERE (SELECT count(*) FROM pr WHERE pr.b = x.b AND list_contains(c, pr.a)) = len(c)), mx AS (SELECT c FROM cl k WHERE len(c) >= 2 AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT b FROM pr) x WHERE NOT list_contains(k.c, x.b) AND (SELECT count(*) FROM pr WHERE pr.b = x.b AND list_contains(k.c, pr.a)) = len(k.c)))
SELECT array_to_string(c, '|') AS clique_id, unnest(c) AS node_id FROM mx""")
def _(spark, d):
    return transforms.clique_graph(small(spark, d))


@q("homomorphisms", "SELECT true AS into_itself, false AS into_less")
def _(spark, d):
    inc = small(spark, d)
    less = inc.where("edge_id < 'e1'")
    return spark.createDataFrame([(transforms.homomorphism_possible(inc, inc), transforms.homomorphism_possible(inc, less))], "into_itself boolean, into_less boolean")


# coordinates: nations on a grid of five columns


def grid(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    at = F.array((k % 5).cast("double"), F.floor(k / 5).cast("double") + (k % 3).cast("double") / 4)
    return spark.read.parquet(f"{d}/nation.parquet").select(k.cast("string").alias("id"), at.alias("vector"))


_GRID = """, pos AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, CAST(n_nationkey % 5 AS DOUBLE) AS x, CAST(n_nationkey // 5 AS DOUBLE) + (n_nationkey % 3) / 4.0 AS y FROM nation), spoke AS (SELECT a, b, t.x - f.x AS dx, t.y - f.y AS dy FROM nn JOIN pos f ON f.id = a JOIN pos t ON t.id = b WHERE abs(CAST(a AS INT) - CAST(b AS INT)) IN (7, 14)),
turn AS (SELECT a, dx, dy, coalesce(lead(dx) OVER w, first_value(dx) OVER w) AS ex, coalesce(lead(dy) OVER w, first_value(dy) OVER w) AS ey FROM spoke WINDOW w AS (PARTITION BY a ORDER BY b)),
cv AS (SELECT id, coalesce(c, 0) AS curvature FROM pos LEFT JOIN (SELECT a, CASE WHEN count(*) >= 2 THEN (2 * pi() - sum(acos(greatest(-1.0, least(1.0, (dx * ex + dy * ey) / (sqrt(dx * dx + dy * dy) * sqrt(ex * ex + ey * ey) + 1e-10)))))) / count(*) ELSE 0 END AS c FROM turn GROUP BY 1) ON a = id)"""


@q("node_curvature", _GRID + " SELECT id, round(curvature, 4) AS curvature FROM cv")
def _(spark, d):
    return geometry.node_curvature(grid(spark, d), thin(spark, d)).withColumn("curvature", F.round("curvature", 4))


@q("curvature_outliers", _GRID + ", st AS (SELECT avg(curvature) AS m, stddev_pop(curvature) AS s FROM cv) SELECT id, round(curvature, 4) AS curvature, round((curvature - m) / nullif(s, 0), 3) AS z FROM cv, st WHERE abs((curvature - m) / nullif(s, 0)) > 0.9")
def _(spark, d):
    return geometry.curvature_outliers(geometry.node_curvature(grid(spark, d), thin(spark, d)), 0.9).withColumns({"curvature": F.round("curvature", 4), "z": F.round("z", 3)})


@q("geodesic_distance", _GRID + " SELECT round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS distance FROM pos a, pos b WHERE a.id = '3' AND b.id = '17'")
def _(spark, d):
    return geometry.geodesic(grid(spark, d), "3", "17")


def daily(spark: SparkSession, d: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/events.parquet").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("kind")).agg(F.count("*").cast("double").alias("value"))
    return n.select("kind", F.datediff("day", F.lit("2024-01-01").cast("date")).alias("i"), "value")


_DAILY = ", dl AS (SELECT event_type AS kind, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS i, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2)"


@q("curvature_of_series", _DAILY + """, an AS (SELECT kind, i, atan2(lead(value) OVER w - value, 1) - atan2(value - lag(value) OVER w, 1) AS angle FROM dl WINDOW w AS (PARTITION BY kind ORDER BY i)), zz AS (SELECT kind, i, angle, (angle - avg(angle) OVER (PARTITION BY kind)) / nullif(stddev_pop(angle) OVER (PARTITION BY kind), 0) AS z FROM an WHERE angle IS NOT NULL)
SELECT kind, CAST(i AS BIGINT) AS i, round(angle, 6) AS angle, round(z, 6) AS z FROM zz WHERE abs(z) > 0.9""")
def _(spark, d):
    return geometry.curvature_anomalies(daily(spark, d), ("kind",), 0.9)


@q("geodesic_forecast", _DAILY + """, r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY i DESC) AS r FROM dl), e AS (SELECT kind, max(i) AS top, max(value) FILTER (r = 1) AS x, max(value) FILTER (r = 2) AS y, max(value) FILTER (r = 3) AS z FROM r WHERE r <= 3 GROUP BY 1)
SELECT kind, CAST(top + k AS BIGINT) AS i, round(x + coalesce(x - y, 0) * k + coalesce((x - 2 * y + z) / 2, 0) * k, 6) AS value FROM e, (SELECT unnest([1, 2, 3]) AS k)""")
def _(spark, d):
    return geometry.geodesic_forecast(daily(spark, d), 3, ("kind",))


@q("property_metric", """SELECT x, y, round(c, 4) AS value FROM (SELECT unnest([{'x': 'p_size', 'y': 'p_size', 'c': covar_samp(p_size, p_size) + 1e-6}, {'x': 'p_size', 'y': 'p_retailprice', 'c': covar_samp(p_size, p_retailprice) * 0.5},
{'x': 'p_retailprice', 'y': 'p_size', 'c': covar_samp(p_size, p_retailprice) * 0.5}, {'x': 'p_retailprice', 'y': 'p_retailprice', 'c': covar_samp(p_retailprice, p_retailprice) * 0.25 + 1e-6}], recursive := true) FROM part)""")
def _(spark, d):
    names = ["p_size", "p_retailprice"]
    m = geometry.metric(spark.read.parquet(f"{d}/part.parquet"), names, {"p_retailprice": 0.5})
    return spark.createDataFrame([(x, y, round(float(m[i, j]), 4)) for i, x in enumerate(names) for j, y in enumerate(names)], "x string, y string, value double")


@q("property_distance", "SELECT p_partkey AS id, round(sqrt(0.5 * (p_size - 10) ** 2 + 0.25 * (p_retailprice - 900) ** 2), 6) AS distance FROM part")
def _(spark, d):
    import numpy as np

    at = geometry.mahalanobis(spark.read.parquet(f"{d}/part.parquet"), ["p_size", "p_retailprice"], np.diag([0.5, 0.25]), [10.0, 900.0])
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), at.alias("distance"))


@q("property_correlations", "SELECT 'l_discount' AS x, 'l_quantity' AS y, round(corr(l_discount, l_quantity), 6) AS correlation FROM lineitem")
def _(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").agg(F.corr("l_discount", "l_quantity").alias("correlation")).select(F.lit("l_discount").alias("x"), F.lit("l_quantity").alias("y"), "correlation")
