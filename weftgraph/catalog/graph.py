"""The hypergraph of orders (edges) over parts (nodes), weighted by quantity, and small ones of suppliers and nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..hypergraph import Hypergraph, incidence_from
from ..operators import basic, centrality, communities, paths, patterns, setops, transforms
from ..sources import formats
from .registry import Registry

PRELUDE = """
WITH RECURSIVE inc AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS edge_id, CAST(l_partkey AS VARCHAR) AS node_id, SUM(l_quantity) AS weight
  FROM lineitem GROUP BY 1, 2
), deg AS (SELECT node_id, count(*) AS degree FROM inc GROUP BY 1),
siz AS (SELECT edge_id, count(*) AS size FROM inc GROUP BY 1),
early AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS edge_id, CAST(l_partkey AS VARCHAR) AS node_id, SUM(l_quantity) AS weight
  FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2
), late AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS edge_id, CAST(l_partkey AS VARCHAR) AS node_id, SUM(l_quantity) AS weight
  FROM lineitem WHERE l_linenumber >= 3 GROUP BY 1, 2
), nat AS (
  SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS node_id, c_mktsegment || '-' || CAST(c_nationkey % 7 AS VARCHAR) AS edge_id, 1.0 AS weight
  FROM supplier JOIN customer ON s_nationkey = c_nationkey
), nn AS (SELECT DISTINCT a.node_id AS a, b.node_id AS b FROM nat a JOIN nat b ON a.edge_id = b.edge_id AND a.node_id <> b.node_id)
"""
REGISTRY = Registry(PRELUDE)
q = REGISTRY.add


def orders_over_parts(spark: SparkSession, sf_dir: str, where: str | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return incidence_from(rows if where is None else rows.where(where), "l_orderkey", "l_partkey", "l_quantity")


def early_and_late(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return orders_over_parts(spark, sf_dir, "l_linenumber <= 3"), orders_over_parts(spark, sf_dir, "l_linenumber >= 3")


def segments_over_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with suppliers (nodes) in market segments of a seventh of the nations (edges): at most 25 nodes."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_nationkey").distinct()
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_nationkey", "c_mktsegment").distinct()
    rows = s.join(c, F.col("s_nationkey") == F.col("c_nationkey"))
    edge = F.concat_ws("-", "c_mktsegment", (F.col("c_nationkey") % 7).cast("string"))
    return rows.select(edge.alias("edge_id"), F.col("s_nationkey").cast("string").alias("node_id"), F.lit(1.0).alias("weight")).distinct()


@q("flagship_top_parts", """SELECT d.node_id, d.degree, CAST(d.w AS DOUBLE) AS weighted_degree, round(d.avg_size, 6) AS avg_size, round(d.degree / (SELECT count(*) FROM siz), 6) AS score
FROM (SELECT i.node_id, count(*) AS degree, sum(weight) AS w, avg(size) AS avg_size FROM inc i JOIN siz USING (edge_id) GROUP BY 1) d ORDER BY d.degree DESC, d.node_id LIMIT 20""")
def flagship(spark, d):
    inc = orders_over_parts(spark, d)
    sizes = basic.edge_sizes(inc)
    m = F.broadcast(sizes.agg(F.count("*").alias("m")))
    g = inc.join(sizes, "edge_id").groupBy("node_id").agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted_degree"), F.avg("size").alias("avg_size")).join(m)
    return g.select("node_id", "degree", "weighted_degree", "avg_size", (F.col("degree") / F.col("m")).alias("score")).orderBy(F.desc("degree"), "node_id").limit(20)


@q("hg_statistics", """SELECT count(DISTINCT node_id) AS num_nodes, count(DISTINCT edge_id) AS num_edges, count(*) AS num_incidences, round(avg(weight), 6) AS weight_mean,
round(stddev_samp(weight), 6) AS weight_std, min(weight) AS weight_min, max(weight) AS weight_max, median(weight) AS weight_median,
round(count(*) / count(DISTINCT edge_id), 6) AS avg_edge_size, round(count(*) / count(DISTINCT node_id), 6) AS avg_node_degree FROM inc""")
def _(spark, d):
    return Hypergraph.from_dataframe(spark.read.parquet(f"{d}/lineitem.parquet"), "l_orderkey", "l_partkey", "l_quantity").statistics()


@q("fast_statistics", """SELECT (SELECT count(*) FROM deg) AS num_nodes, round((SELECT avg(degree) FROM deg), 6) AS avg_degree, (SELECT max(degree) FROM deg) AS max_degree,
count(*) AS num_edges, round(avg(size), 6) AS avg_size, max(size) AS max_size, CAST(sum(size) AS BIGINT) AS num_incidences,
round(2 * sum(size) / ((SELECT count(*) FROM deg) * count(*)), 6) AS density FROM siz""")
def _(spark, d):
    return basic.fast_statistics(orders_over_parts(spark, d))


@q("node_degree", "SELECT node_id, degree FROM deg")
def _(spark, d):
    return basic.node_degrees(orders_over_parts(spark, d))


@q("edge_size", "SELECT edge_id, size FROM siz")
def _(spark, d):
    return basic.edge_sizes(orders_over_parts(spark, d))


@q("edge_members", "SELECT edge_id, string_agg(node_id, ',' ORDER BY node_id) AS members FROM inc GROUP BY 1")
def _(spark, d):
    return basic.edge_nodes(orders_over_parts(spark, d)).select("edge_id", F.array_join("nodes", ",").alias("members"))


@q("node_memberships", "SELECT node_id, string_agg(edge_id, ',' ORDER BY edge_id) AS edges FROM inc GROUP BY 1")
def _(spark, d):
    return basic.node_edges(orders_over_parts(spark, d)).select("node_id", F.array_join("edges", ",").alias("edges"))


@q("neighbors_of", "SELECT DISTINCT b.node_id FROM inc a JOIN inc b USING (edge_id) WHERE a.node_id = '1' AND b.node_id <> '1'")
def _(spark, d):
    return basic.neighbors(orders_over_parts(spark, d), "1")


@q("neighbor_counts", "SELECT node_id, count(DISTINCT b) AS neighbors FROM (SELECT a.node_id, CASE WHEN b.node_id <> a.node_id THEN b.node_id END AS b FROM inc a JOIN inc b USING (edge_id)) GROUP BY 1")
def _(spark, d):
    return basic.neighbor_counts(orders_over_parts(spark, d))


@q("degree_centrality_norm", "SELECT node_id, round(degree / (SELECT count(*) FROM siz), 6) AS score FROM deg")
def _(spark, d):
    return centrality.degree_rows(orders_over_parts(spark, d))


@q("degree_centrality", "SELECT node_id, round(degree / ((SELECT count(*) FROM deg) - 1), 6) AS score FROM deg")
def _(spark, d):
    return centrality.degree(orders_over_parts(spark, d))


@q("edge_degree_centrality", "SELECT edge_id, round(size / (SELECT count(*) FROM deg), 6) AS score FROM siz")
def _(spark, d):
    return centrality.edge_degree_rows(orders_over_parts(spark, d))


@q("s_centrality_s2", "SELECT node_id, round(sum((size - 1) * (size - 1)) / (SELECT count(*) * pow(max(size) - 1, 2) FROM siz), 6) AS score FROM inc JOIN siz USING (edge_id) GROUP BY 1")
def _(spark, d):
    return centrality.s_centrality(orders_over_parts(spark, d), 2)


@q("weighted_degree", "SELECT node_id, round(sum(weight), 6) AS score FROM inc GROUP BY 1")
def _(spark, d):
    return centrality.weighted_degree(orders_over_parts(spark, d))


@q("weighted_degree_max_norm", "SELECT node_id, round(w / max(w) OVER (), 6) AS score FROM (SELECT node_id, sum(weight) AS w FROM inc GROUP BY 1)")
def _(spark, d):
    return centrality.weighted_degree(orders_over_parts(spark, d), True)


@q("edge_weighted_degree", "SELECT node_id, round(sum(size) / (SELECT sum(size) FROM siz), 6) AS score FROM inc JOIN siz USING (edge_id) GROUP BY 1")
def _(spark, d):
    return centrality.edge_weighted_degree(orders_over_parts(spark, d), "size")


@q("edge_inverse_size_degree", "SELECT node_id, round(sum(1.0 / size) / (SELECT sum(1.0 / size) FROM siz), 6) AS score FROM inc JOIN siz USING (edge_id) GROUP BY 1")
def _(spark, d):
    return centrality.edge_weighted_degree(orders_over_parts(spark, d), "inverse_size")


@q("edge_weight_centrality", "SELECT edge_id, round(w / max(w) OVER (), 6) AS score FROM (SELECT edge_id, avg(weight) AS w FROM inc GROUP BY 1)")
def _(spark, d):
    return centrality.edge_importance(orders_over_parts(spark, d), "weight")


@q("weight_importance", """SELECT node_id, round(sum(weight), 6) AS weight_centrality, round(coalesce(stddev_samp(weight), 0) * count(*), 6) AS weight_diversity,
round(count(*) / sum(1 / weight), 6) AS harmonic FROM inc GROUP BY 1""")
def _(spark, d):
    return centrality.importance(orders_over_parts(spark, d))


@q("centrality_ranking", "SELECT node_id, round(w, 6) AS score, row_number() OVER (ORDER BY w DESC, node_id) AS rank FROM (SELECT node_id, sum(weight) AS w FROM inc GROUP BY 1) QUALIFY rank <= 50")
def _(spark, d):
    return centrality.ranking(centrality.weighted_degree(orders_over_parts(spark, d)), 50)


@q("centrality_comparison", """SELECT node_id, round(degree, 6) AS degree, round(w, 6) AS weighted, round((rank() OVER (ORDER BY degree DESC) + rank() OVER (ORDER BY w DESC)) / 2.0, 6) AS mean_rank
FROM (SELECT node_id, CAST(count(*) AS DOUBLE) AS degree, sum(weight) AS w FROM inc GROUP BY 1)""")
def _(spark, d):
    inc = orders_over_parts(spark, d)
    return centrality.comparison({"degree": centrality.degree_rows(inc, False), "weighted": centrality.weighted_degree(inc)})


@q("weighted_degree_summary", """SELECT round(avg(w), 6) AS mean, round(stddev_pop(w), 6) AS std, min(w) AS min, max(w) AS max, median(w) AS median, sum(w) AS total, count(*) AS nodes
FROM (SELECT node_id, sum(weight) AS w FROM inc GROUP BY 1)""")
def _(spark, d):
    return patterns.weighted_degree_summary(orders_over_parts(spark, d))


@q("weighted_degree_histogram", """SELECT CAST(least(bins - 1, floor((w - lo) * bins / (hi - lo))) AS BIGINT) AS bin, count(*) AS count
FROM (SELECT w, min(w) OVER () AS lo, max(w) OVER () AS hi, least(50, greatest(10, floor(sqrt(count(*) OVER ())))) AS bins FROM (SELECT node_id, sum(weight) AS w FROM inc GROUP BY 1)) GROUP BY 1""")
def _(spark, d):
    return patterns.weighted_degree_histogram(orders_over_parts(spark, d))


@q("weighted_connectivity_pairs", "SELECT a.node_id AS a, b.node_id AS b, round(sum(sqrt(a.weight * b.weight)), 6) AS strength, count(*) AS shared FROM inc a JOIN inc b USING (edge_id) WHERE a.node_id < b.node_id GROUP BY 1, 2")
def _(spark, d):
    return patterns.weighted_pairs(orders_over_parts(spark, d))


@q("adjacency_graph_t2", "SELECT a.node_id AS a, b.node_id AS b, count(*) AS shared FROM inc a JOIN inc b USING (edge_id) WHERE a.node_id < b.node_id GROUP BY 1, 2 HAVING count(*) >= 2")
def _(spark, d):
    return transforms.adjacency(orders_over_parts(spark, d), 2)


@q("connectivity_matrix", "SELECT a.node_id AS a, count(*) AS n, count(DISTINCT b.node_id) AS distinct_b FROM inc a JOIN inc b USING (edge_id) WHERE a.node_id <> b.node_id GROUP BY 1")
def _(spark, d):
    return transforms.connectivity(orders_over_parts(spark, d)).groupBy("a").agg(F.count("*").alias("n"), F.countDistinct("b").alias("distinct_b"))


@q("line_graph_degrees", "SELECT e, count(*) AS links FROM (SELECT DISTINCT a.edge_id AS e, b.edge_id AS f FROM inc a JOIN inc b USING (node_id) WHERE a.edge_id < b.edge_id) GROUP BY 1")
def _(spark, d):
    return transforms.line_graph(orders_over_parts(spark, d)).groupBy("e").agg(F.count("*").alias("links"))


@q("s_line_graph_2", "SELECT a.edge_id AS e, b.edge_id AS f, count(*) AS shared FROM inc a JOIN inc b USING (node_id) WHERE a.edge_id < b.edge_id GROUP BY 1, 2 HAVING count(*) >= 2")
def _(spark, d):
    return transforms.line_graph(orders_over_parts(spark, d), 2)


@q("dual", "SELECT node_id AS edge_id, edge_id AS node_id, CAST(1.0 AS DOUBLE) AS weight FROM inc")
def _(spark, d):
    return transforms.dual(orders_over_parts(spark, d))


@q("k_uniform_2", """SELECT CASE WHEN size = 2 THEN edge_id ELSE edge_id || '_sub_' || CAST(row_number() OVER (PARTITION BY edge_id ORDER BY a, b) - 1 AS VARCHAR) END AS edge_id, a || '|' || b AS members
FROM (SELECT edge_id, size, a.node_id AS a, b.node_id AS b FROM inc a JOIN inc b USING (edge_id) JOIN siz USING (edge_id) WHERE a.node_id < b.node_id)""")
def _(spark, d):
    k = transforms.k_uniform(orders_over_parts(spark, d), 2)
    return k.groupBy("edge_id").agg(F.array_join(F.array_sort(F.collect_list("node_id")), "|").alias("members"))


@q("bipartite_projection", """SELECT side, a, b, count(*) AS shared FROM (
SELECT x.side, x.node_id AS a, y.node_id AS b FROM (SELECT edge_id, node_id, side FROM nat JOIN (SELECT node_id, CASE WHEN percent_rank() OVER (ORDER BY degree, node_id) < 0.5 THEN 'low' ELSE 'high' END AS side FROM (SELECT node_id, count(*) AS degree FROM nat GROUP BY 1)) USING (node_id)) x
JOIN (SELECT edge_id, node_id, side FROM nat JOIN (SELECT node_id, CASE WHEN percent_rank() OVER (ORDER BY degree, node_id) < 0.5 THEN 'low' ELSE 'high' END AS side FROM (SELECT node_id, count(*) AS degree FROM nat GROUP BY 1)) USING (node_id)) y
ON x.edge_id = y.edge_id AND x.side = y.side AND x.node_id < y.node_id) GROUP BY 1, 2, 3""")
def _(spark, d):
    return transforms.bipartite_projection(segments_over_nations(spark, d))


@q("tensor_small", "SELECT 'T_' || a.edge_id || '_' || b.r_name AS edge_id, '(' || a.node_id || ',' || CAST(b.r_regionkey AS VARCHAR) || ')' AS node_id, CAST(1.0 AS DOUBLE) AS weight FROM nat a CROSS JOIN region b")
def _(spark, d):
    r = spark.read.parquet(f"{d}/region.parquet").select(F.col("r_name").alias("edge_id"), F.col("r_regionkey").cast("string").alias("node_id"))
    return transforms.tensor_product(segments_over_nations(spark, d), r)


@q("contractible_edges", """SELECT edge_id, count(*) AS size, count(*) = 1 AS singleton, count(*) = 2 AND min(degree) = 1 AS pendant, count(*) >= 2 AND min(degree) > 1 AS contractible
FROM inc JOIN deg USING (node_id) GROUP BY 1""")
def _(spark, d):
    return transforms.contractible(orders_over_parts(spark, d))


@q("size_histogram", "SELECT size, count(*) AS edges FROM siz GROUP BY 1")
def _(spark, d):
    return transforms.size_histogram(orders_over_parts(spark, d))


_UNION = "SELECT edge_id, node_id, coalesce(e.weight, l.weight) AS weight FROM early e FULL JOIN late l USING (edge_id, node_id)"


@q("hg_union", _UNION)
def _(spark, d):
    a, b = early_and_late(spark, d)
    return (Hypergraph(a) | Hypergraph(b)).incidence


@q("hg_union_left_edges", f"SELECT * FROM ({_UNION}) WHERE edge_id IN (SELECT edge_id FROM late)")
def _(spark, d):
    a, b = early_and_late(spark, d)
    return setops.union(b, a, edges="left").join(a.select("edge_id", "node_id", F.col("weight").alias("w")), ["edge_id", "node_id"], "left").select("edge_id", "node_id", F.coalesce("w", "weight").alias("weight"))


@q("hg_intersection_edges", "SELECT edge_id, node_id, e.weight FROM early e SEMI JOIN late USING (edge_id, node_id)")
def _(spark, d):
    return setops.intersection(*early_and_late(spark, d))


@q("hg_intersection_nodes", "SELECT edge_id, node_id, weight FROM early WHERE node_id IN (SELECT node_id FROM late)")
def _(spark, d):
    return setops.intersection(*early_and_late(spark, d), "nodes")


@q("hg_intersection_structure", """SELECT edge_id, node_id, weight FROM early WHERE edge_id IN (SELECT edge_id FROM (SELECT edge_id, string_agg(node_id, ',' ORDER BY node_id) AS m FROM early GROUP BY 1)
JOIN (SELECT edge_id, string_agg(node_id, ',' ORDER BY node_id) AS m FROM late GROUP BY 1) USING (edge_id, m))""")
def _(spark, d):
    return setops.intersection(*early_and_late(spark, d), "structure")


@q("hg_difference_edges", "SELECT edge_id, node_id, weight FROM early WHERE edge_id NOT IN (SELECT edge_id FROM late)")
def _(spark, d):
    return setops.difference(*early_and_late(spark, d))


@q("hg_difference_nodes", "SELECT edge_id, node_id, weight FROM late WHERE node_id NOT IN (SELECT node_id FROM early WHERE CAST(node_id AS BIGINT) % 3 = 0)")
def _(spark, d):
    a, b = early_and_late(spark, d)
    return setops.difference(b, a.where("cast(node_id AS bigint) % 3 = 0"), "nodes")


@q("hg_difference_structure", """SELECT edge_id, node_id, weight FROM early WHERE edge_id NOT IN (SELECT edge_id FROM (SELECT edge_id, string_agg(node_id, ',' ORDER BY node_id) AS m FROM early GROUP BY 1)
JOIN (SELECT edge_id, string_agg(node_id, ',' ORDER BY node_id) AS m FROM late GROUP BY 1) USING (edge_id, m))""")
def _(spark, d):
    return setops.difference(*early_and_late(spark, d), "structure")


@q("subgraph_nodes", "SELECT edge_id, node_id, weight FROM inc WHERE node_id IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size <= 10)")
def _(spark, d):
    ids = spark.read.parquet(f"{d}/part.parquet").where("p_size <= 10").select(F.col("p_partkey").cast("string").alias("node_id"))
    return basic.subgraph(orders_over_parts(spark, d), ids).select("edge_id", "node_id", "weight")


@q("subgraph_edges", "SELECT edge_id, node_id, weight FROM inc WHERE edge_id IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F')")
def _(spark, d):
    ids = spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("edge_id"))
    return basic.subgraph(orders_over_parts(spark, d), ids, "edge_id").select("edge_id", "node_id", "weight")


@q("filter_by_degree", "SELECT edge_id, node_id, weight FROM inc WHERE node_id IN (SELECT node_id FROM deg WHERE degree BETWEEN 25 AND 35)")
def _(spark, d):
    return basic.filter_by_degree(orders_over_parts(spark, d), 25, 35).select("edge_id", "node_id", "weight")


@q("filter_nodes_by_degree", "SELECT node_id FROM deg WHERE degree >= 35")
def _(spark, d):
    return basic.nodes_by_degree(orders_over_parts(spark, d), 35).select("node_id")


@q("filter_by_edge_size", "SELECT edge_id, node_id, weight FROM inc WHERE edge_id IN (SELECT edge_id FROM siz WHERE size BETWEEN 2 AND 4)")
def _(spark, d):
    return basic.filter_by_size(orders_over_parts(spark, d), 2, 4).select("edge_id", "node_id", "weight")


@q("filter_by_weight", "SELECT edge_id, node_id, weight FROM inc WHERE weight BETWEEN 10 AND 20")
def _(spark, d):
    return basic.filter_by_weight(orders_over_parts(spark, d), 10, 20)


@q("remove_node_cascade", "SELECT edge_id, node_id, weight FROM inc WHERE edge_id NOT IN (SELECT edge_id FROM inc WHERE node_id = '1')")
def _(spark, d):
    return basic.remove_node(orders_over_parts(spark, d), "1").select("edge_id", "node_id", "weight")


@q("remove_node_only", "SELECT edge_id, node_id, weight FROM inc WHERE node_id <> '1'")
def _(spark, d):
    return basic.remove_node(orders_over_parts(spark, d), "1", cascade=False)


@q("add_and_remove_edge", "SELECT edge_id, node_id, weight FROM inc WHERE edge_id <> '1' UNION ALL SELECT 'new', n, 2.5 FROM (VALUES ('1'), ('2')) t(n)")
def _(spark, d):
    return basic.remove_edge(basic.add_edge(orders_over_parts(spark, d), "new", ["1", "2"], 2.5), "1")


@q("edge_similarity_jaccard", """SELECT e, f, shared, round(shared / (a.size + b.size - shared), 6) AS jaccard FROM
(SELECT a.edge_id AS e, b.edge_id AS f, count(*) AS shared FROM inc a JOIN inc b USING (node_id) WHERE a.edge_id < b.edge_id GROUP BY 1, 2) JOIN siz a ON a.edge_id = e JOIN siz b ON b.edge_id = f WHERE shared / (a.size + b.size - shared) >= 0.3""")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("edge_id"), F.col("l_partkey").alias("node_id"))
    return patterns.edge_jaccard(rows, 0.3)


@q("node_similarity_jaccard", """SELECT a, b, shared, round(shared / (x.degree + y.degree - shared), 6) AS similarity FROM
(SELECT a.node_id AS a, b.node_id AS b, count(*) AS shared FROM inc a JOIN inc b USING (edge_id) WHERE a.node_id < b.node_id GROUP BY 1, 2) JOIN deg x ON x.node_id = a JOIN deg y ON y.node_id = b""")
def _(spark, d):
    return patterns.node_similarity(orders_over_parts(spark, d))


@q("node_similarity_cosine", """SELECT a, b, shared, round(shared / sqrt(x.degree * y.degree), 6) AS similarity FROM
(SELECT a.node_id AS a, b.node_id AS b, count(*) AS shared FROM inc a JOIN inc b USING (edge_id) WHERE a.node_id < b.node_id GROUP BY 1, 2) JOIN deg x ON x.node_id = a JOIN deg y ON y.node_id = b""")
def _(spark, d):
    return patterns.node_similarity(orders_over_parts(spark, d), "cosine")


@q("average_edge_overlap", """SELECT round(sum(shared / (a.size + b.size - shared)) / ((SELECT count(*) FROM siz) * ((SELECT count(*) FROM siz) - 1) / 2), 6) AS average FROM
(SELECT a.edge_id AS e, b.edge_id AS f, count(*) AS shared FROM inc a JOIN inc b USING (node_id) WHERE a.edge_id < b.edge_id GROUP BY 1, 2) JOIN siz a ON a.edge_id = e JOIN siz b ON b.edge_id = f""")
def _(spark, d):
    return patterns.average_edge_overlap(orders_over_parts(spark, d))


@q("motifs_k2", "SELECT a.node_id AS n0, b.node_id AS n1, count(*) AS frequency FROM inc a JOIN inc b USING (edge_id) WHERE a.node_id < b.node_id GROUP BY 1, 2 HAVING count(*) >= 2")
def _(spark, d):
    return patterns.motifs(orders_over_parts(spark, d), 2)


@q("motifs_k3", """SELECT a.node_id AS n0, b.node_id AS n1, c.node_id AS n2, count(*) AS frequency FROM inc a JOIN inc b USING (edge_id) JOIN inc c USING (edge_id)
WHERE a.node_id < b.node_id AND b.node_id < c.node_id GROUP BY 1, 2, 3 HAVING count(*) >= 1 ORDER BY frequency DESC, n0, n1, n2 LIMIT 100""")
def _(spark, d):
    return patterns.motifs(orders_over_parts(spark, d), 3, 1, 100)


@q("frequent_sizes", "SELECT size AS value, count(*) AS count, round(count(*) / (SELECT count(*) FROM siz), 6) AS support FROM siz GROUP BY 1 HAVING support >= 0.1")
def _(spark, d):
    return patterns.frequent_sizes(orders_over_parts(spark, d))


@q("frequent_degrees", "SELECT degree AS value, count(*) AS count, round(count(*) / (SELECT count(*) FROM deg), 6) AS support FROM deg GROUP BY 1 HAVING count(*) / (SELECT count(*) FROM deg) >= 0.05")
def _(spark, d):
    return patterns.frequent_degrees(orders_over_parts(spark, d), 0.05)


@q("weight_quartiles", """SELECT CAST(CASE WHEN weight <= q[1] THEN 1 WHEN weight <= q[2] THEN 2 WHEN weight <= q[3] THEN 3 ELSE 4 END AS BIGINT) AS bin, count(*) AS count
FROM inc, (SELECT quantile_cont(weight, [0.25, 0.5, 0.75]) AS q FROM inc) GROUP BY 1""")
def _(spark, d):
    return patterns.weight_quartiles(orders_over_parts(spark, d))


def _outlier_sql(table: str, key: str, column: str, s: float) -> str:
    return f"""SELECT {key}, CAST({column} AS DOUBLE) AS value, round(({column} - mu) / sd, 6) AS z, CASE WHEN {column} > mu THEN 'high' ELSE 'low' END AS kind
FROM {table}, (SELECT avg({column}) AS mu, stddev_pop({column}) AS sd FROM {table}) WHERE abs(({column} - mu) / sd) > {s}"""


@q("outlier_nodes", _outlier_sql("deg", "node_id", "degree", 2))
def _(spark, d):
    return patterns.outlier_nodes(orders_over_parts(spark, d))


@q("outlier_edges", _outlier_sql("siz", "edge_id", "size", 1.5))
def _(spark, d):
    return patterns.outlier_edges(orders_over_parts(spark, d), 1.5)


@q("weight_anomalies", "SELECT edge_id || '|' || node_id AS incidence, weight AS value, round((weight - mu) / sd, 6) AS z, CASE WHEN weight > mu THEN 'high' ELSE 'low' END AS kind FROM inc, (SELECT avg(weight) AS mu, stddev_pop(weight) AS sd FROM inc) WHERE abs((weight - mu) / sd) > 1.7")
def _(spark, d):
    return patterns.weight_anomalies(orders_over_parts(spark, d), 1.7)


@q("diverse_participation", "SELECT node_id, round(var_pop(size), 6) AS variance FROM inc JOIN siz USING (edge_id) GROUP BY 1")
def _(spark, d):
    return patterns.diverse_participation(orders_over_parts(spark, d))


_CORR = """SELECT x, y, round(c, 6) AS correlation FROM (SELECT unnest([{{'x': 'w_mean', 'y': 'w_std', 'c': corr(w_mean, w_std)}}, {{'x': 'w_mean', 'y': 'w_sum', 'c': corr(w_mean, w_sum)}}, {{'x': 'w_mean', 'y': '{n}', 'c': corr(w_mean, {n})}},
{{'x': 'w_std', 'y': 'w_sum', 'c': corr(w_std, w_sum)}}, {{'x': 'w_std', 'y': '{n}', 'c': corr(w_std, {n})}}, {{'x': 'w_sum', 'y': '{n}', 'c': corr(w_sum, {n})}}], recursive := true)
FROM (SELECT {k}, avg(weight) AS w_mean, coalesce(stddev_samp(weight), 0) AS w_std, sum(weight) AS w_sum, count(*) AS {n} FROM inc GROUP BY 1))"""


@q("node_prop_correlations", _CORR.format(k="node_id", n="n"))
def _(spark, d):
    return patterns.correlations(patterns.node_statistics(orders_over_parts(spark, d)), ["w_mean", "w_std", "w_sum", "n"])


@q("edge_prop_correlations", _CORR.format(k="edge_id", n="size"))
def _(spark, d):
    return patterns.correlations(patterns.edge_statistics(orders_over_parts(spark, d)), ["w_mean", "w_std", "w_sum", "size"])


@q("node_features", "SELECT node_id, count(*) AS degree, round(avg(size), 6) AS avg_size, max(size) AS max_size, min(size) AS min_size, round(stddev_pop(size), 6) AS std_size FROM inc JOIN siz USING (edge_id) GROUP BY 1")
def _(spark, d):
    return patterns.node_features(orders_over_parts(spark, d))


@q("edge_features", """SELECT edge_id, count(*) AS size, round(avg(weight), 6) AS weight, round(avg(degree), 6) AS avg_degree, max(degree) AS max_degree, min(degree) AS min_degree, round(stddev_pop(degree), 6) AS std_degree
FROM inc JOIN deg USING (node_id) GROUP BY 1""")
def _(spark, d):
    return patterns.edge_features(orders_over_parts(spark, d))


@q("global_features", """SELECT n AS num_nodes, round(ad, 6) AS avg_degree, m AS num_edges, round(s, 6) AS avg_size, round(m / (n * (n - 1) / 2), 6) AS density
FROM (SELECT count(*) AS n, avg(degree) AS ad FROM deg), (SELECT count(*) AS m, avg(size) AS s FROM siz)""")
def _(spark, d):
    return patterns.global_features(orders_over_parts(spark, d))


# the small hypergraph: iterations that SQL can express


@q("bfs_levels", """, walk AS (SELECT '0' AS node, 0 AS depth UNION SELECT b, depth + 1 FROM walk JOIN nn ON node = a WHERE depth < 25)
SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY 1""")
def _(spark, d):
    start = spark.createDataFrame([("0",)], "source string")
    return paths.bfs(paths.neighbor_edges(segments_over_nations(spark, d)), start).select("node", "depth")


@q("connected_components", """, reach AS (SELECT node_id AS a, node_id AS b FROM nat UNION SELECT r.a, n.b FROM reach r JOIN nn n ON r.b = n.a)
SELECT a AS node_id, min(b) AS component FROM reach GROUP BY 1""")
def _(spark, d):
    return paths.connected_components(segments_over_nations(spark, d))


_DIST = ", walk AS (SELECT DISTINCT node_id AS s, node_id AS t, 0 AS depth FROM nat UNION SELECT s, b, depth + 1 FROM walk JOIN nn ON t = a WHERE depth < 25), dist AS (SELECT s, t, min(depth) AS depth FROM walk GROUP BY 1, 2), n AS (SELECT count(DISTINCT node_id) AS n FROM nat)"


@q("closeness", _DIST + " SELECT s AS node_id, round(CASE WHEN sum(depth) = 0 THEN 0 ELSE (count(*) - 1) / sum(depth) * (count(*) - 1) / ((SELECT n FROM n) - 1) END, 6) AS score FROM dist GROUP BY 1")
def _(spark, d):
    return centrality.closeness(segments_over_nations(spark, d))


@q("harmonic", _DIST + " SELECT s AS node_id, round(sum(CASE WHEN depth > 0 THEN 1.0 / depth ELSE 0 END) / ((SELECT n FROM n) - 1), 6) AS score FROM dist GROUP BY 1")
def _(spark, d):
    return centrality.harmonic(segments_over_nations(spark, d))


@q("eccentricity", _DIST + " SELECT s AS node_id, CAST(max(depth) AS BIGINT) AS eccentricity FROM dist GROUP BY 1")
def _(spark, d):
    return paths.eccentricities(segments_over_nations(spark, d))


@q("diameter", _DIST + " SELECT CAST(max(depth) AS BIGINT) AS diameter FROM dist")
def _(spark, d):
    return paths.diameter(segments_over_nations(spark, d))


def _unrolled(start: str, step: str, rounds: int) -> str:
    return ", r0 AS (" + start + ")" + "".join(f", r{i + 1} AS (" + step.replace("@", f"r{i}") + ")" for i in range(rounds))


@q("pagerank_5_rounds", ", n AS (SELECT count(DISTINCT node_id) AS n FROM nat), o AS (SELECT a, count(*) AS d FROM nn GROUP BY 1)"
   + _unrolled("SELECT DISTINCT node_id AS v, 1.0 / n AS x FROM nat, n", "SELECT c.v, 0.15 / n + 0.85 * coalesce(f, 0) AS x FROM @ c CROSS JOIN n LEFT JOIN (SELECT nn.b, sum(p.x / o.d) AS f FROM @ p JOIN nn ON nn.a = p.v JOIN o ON o.a = p.v GROUP BY 1) g ON g.b = c.v", 5)
   + " SELECT v AS node_id, round(CAST(x AS DOUBLE), 6) AS score FROM r5")
def _(spark, d):
    return centrality.pagerank(segments_over_nations(spark, d), most=5, fixed=True)


@q("katz_5_rounds", _unrolled("SELECT DISTINCT node_id AS v, CAST(0.0 AS DOUBLE) AS x FROM nat", "SELECT c.v, 1 + 0.1 * coalesce(f, 0) AS x FROM @ c LEFT JOIN (SELECT nn.b, sum(p.x) AS f FROM @ p JOIN nn ON nn.a = p.v GROUP BY 1) g ON g.b = c.v", 5)
   + " SELECT v AS node_id, round(CAST(x AS DOUBLE), 6) AS score FROM r5")
def _(spark, d):
    return centrality.katz(segments_over_nations(spark, d), most=5, fixed=True)


@q("eigenvector_5_rounds", _unrolled("SELECT DISTINCT node_id AS v, 1.0 AS x FROM nat", "SELECT v, f / sum(f) OVER () AS x FROM (SELECT c.v, coalesce(f, 0) AS f FROM @ c LEFT JOIN (SELECT nn.b, sum(p.x) AS f FROM @ p JOIN nn ON nn.a = p.v GROUP BY 1) g ON g.b = c.v)", 5)
   + " SELECT v AS node_id, round(CAST(x AS DOUBLE), 6) AS score FROM r5")
def _(spark, d):
    return centrality.eigenvector(segments_over_nations(spark, d), most=5, fixed=True)


@q("hits_5_rounds", _unrolled("SELECT DISTINCT node_id AS v, 1.0 AS y, 1.0 AS x FROM nat", """SELECT v, y, h / sqrt(sum(h * h) OVER ()) AS x FROM (SELECT c.v, c.y, coalesce(h, 0) AS h FROM
(SELECT v, f / sqrt(sum(f * f) OVER ()) AS y FROM (SELECT c.v, coalesce(f, 0) AS f FROM @ c LEFT JOIN (SELECT nn.b, sum(p.x) AS f FROM @ p JOIN nn ON nn.a = p.v GROUP BY 1) g ON g.b = c.v)) c
LEFT JOIN (SELECT nn.b, sum(p.y) AS h FROM (SELECT v, f / sqrt(sum(f * f) OVER ()) AS y FROM (SELECT c.v, coalesce(f, 0) AS f FROM @ c LEFT JOIN (SELECT nn.b, sum(p.x) AS f FROM @ p JOIN nn ON nn.a = p.v GROUP BY 1) g ON g.b = c.v)) p JOIN nn ON nn.a = p.v GROUP BY 1) g ON g.b = c.v)""", 5)
   + " SELECT v AS node_id, round(y, 6) AS authority, round(x, 6) AS hub FROM r5")
def _(spark, d):
    return centrality.hits(segments_over_nations(spark, d), most=5, fixed=True)


@q("edge_modularity_by_region", """SELECT round(avg(inside / (s * (s - 1))), 6) AS modularity FROM (SELECT edge_id, sum(k) AS s, sum(k * (k - 1)) AS inside FROM
(SELECT edge_id, n_regionkey, count(*) AS k FROM nat JOIN nation ON node_id = CAST(n_nationkey AS VARCHAR) GROUP BY 1, 2) GROUP BY 1) WHERE s > 1""")
def _(spark, d):
    c = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("node_id"), F.col("n_regionkey").cast("string").alias("community"))
    return communities.edge_modularity(segments_over_nations(spark, d), c)


@q("community_quality_by_region", """SELECT (SELECT count(DISTINCT n_regionkey) FROM nation) AS communities, round(avg(CASE WHEN c = 1 THEN 1.0 ELSE 0 END), 6) AS coverage, round(1 - avg(CASE WHEN c = 1 THEN 1.0 ELSE 0 END), 6) AS conductance,
round((SELECT avg(k) FROM (SELECT count(*) AS k FROM nation GROUP BY n_regionkey)), 6) AS size_mean, round((SELECT stddev_pop(k) FROM (SELECT count(*) AS k FROM nation GROUP BY n_regionkey)), 6) AS size_std,
(SELECT max(k) FROM (SELECT count(*) AS k FROM nation GROUP BY n_regionkey)) AS size_max, (SELECT min(k) FROM (SELECT count(*) AS k FROM nation GROUP BY n_regionkey)) AS size_min
FROM (SELECT edge_id, count(DISTINCT n_regionkey) AS c FROM nat JOIN nation ON node_id = CAST(n_nationkey AS VARCHAR) GROUP BY 1)""")
def _(spark, d):
    c = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("node_id"), F.col("n_regionkey").cast("string").alias("community"))
    return communities.quality(segments_over_nations(spark, d), c)


@q("node_laplacian", """, adj AS (SELECT a.node_id AS i, b.node_id AS j, sum(1.0 / (k - 1)) AS value FROM nat a JOIN nat b ON a.edge_id = b.edge_id AND a.node_id <> b.node_id JOIN (SELECT edge_id, count(*) AS k FROM nat GROUP BY 1) s ON s.edge_id = a.edge_id GROUP BY 1, 2),
dd AS (SELECT n.node_id AS i, coalesce(d, 0) AS d FROM (SELECT DISTINCT node_id FROM nat) n LEFT JOIN (SELECT i, sum(value) AS d FROM adj GROUP BY 1) ON i = n.node_id)
SELECT i, i AS j, CAST(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS value FROM dd UNION ALL SELECT a.i, a.j, round(-value / sqrt(x.d * y.d), 6) FROM adj a JOIN dd x ON x.i = a.i JOIN dd y ON y.i = a.j""")
def _(spark, d):
    inc = segments_over_nations(spark, d)
    return communities.laplacian(communities.node_adjacency(inc), inc.select("node_id").distinct())


@q("transition_matrix", """SELECT a.node_id AS i, b.node_id AS j, round(sum(a.weight / dv * b.weight / de), 6) AS value FROM nat a JOIN nat b ON a.edge_id = b.edge_id JOIN (SELECT node_id, sum(weight) AS dv FROM nat GROUP BY 1) x ON x.node_id = a.node_id
JOIN (SELECT edge_id, sum(weight) AS de FROM nat GROUP BY 1) y ON y.edge_id = a.edge_id GROUP BY 1, 2""")
def _(spark, d):
    return communities.transition_matrix(segments_over_nations(spark, d))


@q("contagion_deterministic", _unrolled("SELECT DISTINCT node_id AS v, CASE WHEN node_id = '0' THEN 'I' ELSE 'S' END AS st FROM nat", "SELECT v, CASE WHEN st = 'I' OR v IN (SELECT b FROM @ JOIN nn ON nn.a = v WHERE st = 'I') THEN 'I' ELSE 'S' END AS st FROM @", 3)
   + " SELECT CAST(step AS BIGINT) AS step, state, count(*) AS nodes FROM (SELECT 0 AS step, st AS state FROM r0 UNION ALL SELECT 1, st FROM r1 UNION ALL SELECT 2, st FROM r2 UNION ALL SELECT 3, st FROM r3) GROUP BY 1, 2")
def _(spark, d):
    ill = spark.createDataFrame([("0",)], "node_id string")
    return communities.contagion(segments_over_nations(spark, d), ill, 3, tau=1.0, gamma=0.0)


# results that SQL does not give here: tested on fixtures


@q("betweenness_nations")
def _(spark, d):
    return centrality.betweenness(segments_over_nations(spark, d))


@q("pagerank_parts")
def _(spark, d):
    return centrality.pagerank(orders_over_parts(spark, d), most=20, tol=1e-4)


@q("k_core_parts")
def _(spark, d):
    return paths.k_core(segments_over_nations(spark, d))


@q("label_propagation_nations")
def _(spark, d):
    return communities.label_propagation(segments_over_nations(spark, d))


@q("maximal_cliques_nations")
def _(spark, d):
    return transforms.clique_graph(segments_over_nations(spark, d))


@q("random_walks_nations")
def _(spark, d):
    inc = segments_over_nations(spark, d)
    starts = inc.select("node_id").distinct().select(F.col("node_id").alias("walk"), "node_id")
    return paths.random_walks(inc, starts, 5)


@q("spectral_embedding_nations")
def _(spark, d):
    return communities.spectral_embedding(segments_over_nations(spark, d)).select("node_id", F.get("vector", F.lit(0)).alias("x"), F.get("vector", F.lit(1)).alias("y"))


@q("weighted_distances_nations")
def _(spark, d):
    return paths.weighted_distances(paths.inverse_strength_edges(segments_over_nations(spark, d)), "0")


@q("weighted_clustering_nations")
def _(spark, d):
    return patterns.weighted_clustering(segments_over_nations(spark, d))


@q("edge_list_json", "SELECT edge_id, node_id, weight FROM inc")
def _(spark, d):
    return formats.from_json_rows(formats.to_json_rows(orders_over_parts(spark, d)))
