"""Quality, cleaning, conversion, property and flow queries on the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import basic, geometry, layers, quality
from ..sources import formats
from .registry import Registry

REGISTRY = Registry("")
q = REGISTRY.add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@q("quality_rules", """WITH r AS (SELECT 'key' AS rule, 'unique' AS kind, 'o_orderkey' AS "column", count(DISTINCT o_orderkey) / count(*) AS score, 1.0 AS t FROM orders UNION ALL
SELECT 'price', 'range', 'o_totalprice', avg(CASE WHEN o_totalprice BETWEEN 1000 AND 200000 THEN 1.0 ELSE 0 END), 0.95 FROM orders UNION ALL SELECT 'status', 'enum', 'o_orderstatus', avg(CASE WHEN o_orderstatus IN ('F', 'O') THEN 1.0 ELSE 0 END), 0.9 FROM orders UNION ALL
SELECT 'priority', 'pattern', 'o_orderpriority', avg(CASE WHEN regexp_matches(o_orderpriority, '^[1-5]') THEN 1.0 ELSE 0 END), 1.0 FROM orders UNION ALL SELECT 'date', 'not_null', 'o_orderdate', count(o_orderdate) / count(*), 1.0 FROM orders UNION ALL
SELECT 'customer', 'foreign_key', 'o_custkey', avg(CASE WHEN o_custkey IN (SELECT c_custkey FROM customer) THEN 1.0 ELSE 0 END), 1.0 FROM orders)
SELECT rule, kind, "column", round(score, 6) AS score, CASE WHEN score >= t THEN 'pass' WHEN score >= 0.8 * t THEN 'warn' ELSE 'fail' END AS status FROM r""")
def _(spark, d):
    rules = [
        quality.Rule("key", "unique", "o_orderkey"), quality.Rule("price", "range", "o_totalprice", (1000, 200000), 0.95), quality.Rule("status", "enum", "o_orderstatus", ("F", "O"), 0.9),
        quality.Rule("priority", "pattern", "o_orderpriority", "^[1-5]"), quality.Rule("date", "not_null", "o_orderdate"), quality.Rule("customer", "foreign_key", "o_custkey", (table(spark, d, "customer"), "c_custkey")),
    ]
    return quality.evaluate(table(spark, d, "orders"), rules)


@q("completeness_uniqueness", """SELECT 'p_partkey' AS "column", count(*) - count(p_partkey) AS nulls, count(DISTINCT p_partkey) AS "distinct", round(count(p_partkey) / count(*), 6) AS completeness, round(count(DISTINCT p_partkey) / count(*), 6) AS uniqueness FROM part UNION ALL
SELECT 'p_brand', count(*) - count(p_brand), count(DISTINCT p_brand), round(count(p_brand) / count(*), 6), round(count(DISTINCT p_brand) / count(*), 6) FROM part UNION ALL SELECT 'p_size', count(*) - count(p_size), count(DISTINCT p_size), round(count(p_size) / count(*), 6), round(count(DISTINCT p_size) / count(*), 6) FROM part""")
def _(spark, d):
    return quality.profile(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"))


@q("iqr_outliers", """WITH b AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS c FROM orders) SELECT 'o_totalprice' AS "column", round(a - 0.5 * (c - a), 6) AS low, round(c + 0.5 * (c - a), 6) AS high,
(SELECT count(*) FROM orders, b WHERE o_totalprice < a - 0.5 * (c - a) OR o_totalprice > c + 0.5 * (c - a)) AS outliers FROM b""")
def _(spark, d):
    return quality.iqr_outliers(table(spark, d, "orders"), ["o_totalprice"], 0.5)


@q("duplicate_rows", "SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) AS distinct_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) AS duplicates FROM lineitem")
def _(spark, d):
    return quality.duplicates(table(spark, d, "lineitem").select("l_orderkey", "l_partkey"))


@q("clean_fill", """WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS size, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS brand FROM part)
SELECT p_partkey, coalesce(size, (SELECT median(size) FROM x)) AS size, coalesce(brand, (SELECT brand FROM x WHERE brand IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, brand LIMIT 1)) AS brand FROM x""")
def _(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_size").cast("double")).alias("size"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand")).alias("brand"))
    return quality.fill_missing(x)


@q("clean_interpolate", """WITH x AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS i, CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice END AS v FROM part), y AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN i END) OVER (ORDER BY i) AS pi, min(CASE WHEN v IS NOT NULL THEN i END) OVER (ORDER BY i DESC) AS ni FROM x)
SELECT y.p_partkey, round(coalesce(y.v, a.v + (b.v - a.v) / (ni - pi) * (y.i - pi)), 4) AS price FROM y LEFT JOIN x a ON a.i = pi LEFT JOIN x b ON b.i = ni""")
def _(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice")).alias("price"))
    return quality.interpolate(x, "price", "p_partkey").withColumn("price", F.round("price", 4))


@q("clean_text", "SELECT p_partkey, lower(trim(p_name)) AS p_name, lower(trim(p_type)) AS p_type FROM part")
def _(spark, d):
    return quality.clean_text(table(spark, d, "part").select("p_partkey", "p_name", "p_type"))


@q("policy_violations", "SELECT 'discount' AS policy, count(*) FILTER (NOT l_discount <= 0.05) AS violations, round(count(*) FILTER (NOT l_discount <= 0.05) / count(*), 6) AS share FROM lineitem UNION ALL SELECT 'tax', count(*) FILTER (NOT l_tax > 0), round(count(*) FILTER (NOT l_tax > 0) / count(*), 6) FROM lineitem")
def _(spark, d):
    return quality.policies(table(spark, d, "lineitem"), {"discount": F.col("l_discount") <= 0.05, "tax": F.col("l_tax") > 0})


@q("convert_transaction", "SELECT CAST(l_orderkey AS VARCHAR) AS edge_id, CAST(l_partkey AS VARCHAR) AS node_id, round(avg(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS weight FROM lineitem")
def _(spark, d):
    return formats.convert(table(spark, d, "lineitem"), "transaction", transaction="l_orderkey", item="l_partkey", weight="l_quantity")


@q("convert_bipartite", "SELECT CAST(l_suppkey AS VARCHAR) AS edge_id, CAST(l_partkey AS VARCHAR) AS node_id, CAST(1.0 AS DOUBLE) AS weight FROM lineitem")
def _(spark, d):
    return formats.convert(table(spark, d, "lineitem"), "bipartite", source="l_partkey", target="l_suppkey")


@q("convert_multilayer", "SELECT 'layer_' || l_returnflag AS edge_id, CAST(l_partkey AS VARCHAR) AS node_id, CAST(1.0 AS DOUBLE) AS weight FROM lineitem")
def _(spark, d):
    return formats.convert(table(spark, d, "lineitem"), "multilayer", node="l_partkey", layer="l_returnflag")


@q("convert_cooccurrence", "SELECT CAST(p_partkey AS VARCHAR) AS edge_id, unnest([p_brand, p_type, CAST(p_size AS VARCHAR)]) AS node_id, CAST(1.0 AS DOUBLE) AS weight FROM part")
def _(spark, d):
    return formats.convert(table(spark, d, "part"), "cooccurrence", id="p_partkey", entities=["p_brand", "p_type", "p_size"])


@q("convert_hierarchical", "SELECT 'hierarchy_' || n_regionkey AS edge_id, CAST(n_nationkey AS VARCHAR) AS node_id, CAST(1.0 AS DOUBLE) AS weight FROM nation UNION SELECT 'hierarchy_' || n_regionkey, CAST(n_regionkey AS VARCHAR), CAST(1.0 AS DOUBLE) FROM nation")
def _(spark, d):
    return formats.convert(table(spark, d, "nation"), "hierarchical", parent="n_regionkey", child="n_nationkey")


@q("merge_union", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation UNION SELECT r_regionkey, r_name, NULL FROM region")
def _(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return formats.merge([a, table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))])


@q("merge_intersection", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation UNION SELECT r_regionkey, r_name FROM region")
def _(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return formats.merge([a, table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))], "intersection")


@q("net_flow", """WITH f AS (SELECT 'n' || s_nationkey AS source, 'n' || c_nationkey AS target, l_quantity AS flow FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey)
SELECT node, inflow, outflow, outflow - inflow AS net FROM (SELECT node, coalesce(i, 0) AS inflow, coalesce(o, 0) AS outflow FROM (SELECT source AS node, sum(flow) AS o FROM f GROUP BY 1) FULL JOIN (SELECT target AS node, sum(flow) AS i FROM f GROUP BY 1) USING (node))""")
def _(spark, d):
    return geometry.net_flow(flows(spark, d))


def flows(spark: SparkSession, d: str) -> DataFrame:
    l, o, c, s = (table(spark, d, n) for n in ("lineitem", "orders", "customer", "supplier"))
    x = l.join(s, F.col("s_suppkey") == F.col("l_suppkey")).join(o, F.col("o_orderkey") == F.col("l_orderkey")).join(c, F.col("c_custkey") == F.col("o_custkey"))
    return x.select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("source"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("target"), F.col("l_quantity").alias("flow"))


@q("bottlenecks", """WITH f AS (SELECT 'n' || s_nationkey AS source, 'n' || c_nationkey AS target, l_quantity AS flow FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey)
SELECT node, inflow, outflow, outflow - inflow AS net FROM (SELECT node, coalesce(i, 0) AS inflow, coalesce(o, 0) AS outflow FROM (SELECT source AS node, sum(flow) AS o FROM f GROUP BY 1) FULL JOIN (SELECT target AS node, sum(flow) AS i FROM f GROUP BY 1) USING (node)) ORDER BY abs(outflow - inflow) DESC, node LIMIT 5""")
def _(spark, d):
    return geometry.bottlenecks(flows(spark, d))


@q("property_covariance", """SELECT x, y, round(c, 4) AS covariance FROM (SELECT unnest([{'x': 'l_quantity', 'y': 'l_quantity', 'c': covar_samp(l_quantity, l_quantity)}, {'x': 'l_quantity', 'y': 'l_discount', 'c': covar_samp(l_quantity, l_discount)}, {'x': 'l_discount', 'y': 'l_discount', 'c': covar_samp(l_discount, l_discount)}], recursive := true) FROM lineitem)""")
def _(spark, d):
    return geometry.covariance(table(spark, d, "lineitem"), ["l_quantity", "l_discount"]).withColumn("covariance", F.round("covariance", 4))


@q("property_outliers")
def _(spark, d):
    o = table(spark, d, "part").withColumn("p_size", F.col("p_size").cast("double"))
    return geometry.property_outliers(o, "p_partkey", ["p_size", "p_retailprice"], 1.8)


# property states of parts: layers are brands


def states(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    e = p.select(F.col("p_partkey").cast("string").alias("entity"), F.col("p_brand").alias("layer"), F.explode(F.create_map(F.lit("type"), F.col("p_type"), F.lit("size"), F.when(F.col("p_size") <= 25, F.col("p_size").cast("string")))).alias("key", "value"))
    return e.where("value IS NOT NULL")


_STATES = "WITH st AS (SELECT CAST(p_partkey AS VARCHAR) AS entity, p_brand AS layer, 'type' AS key, p_type AS value FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_brand, 'size', CAST(p_size AS VARCHAR) FROM part WHERE p_size <= 25) "


@q("cross_layer_index", _STATES + "SELECT value, layer, string_agg(entity, ',' ORDER BY entity) AS entities FROM st WHERE key = 'size' GROUP BY 1, 2")
def _(spark, d):
    return layers.cross_layer_index(states(spark, d), "size").withColumn("entities", F.array_join("entities", ","))


@q("derive_contexts", _STATES + "SELECT key, value, count(*) AS count, round(count(*) / (SELECT count(DISTINCT entity) FROM st), 6) AS confidence FROM st GROUP BY 1, 2 HAVING count(*) >= 2 AND count(*) / (SELECT count(DISTINCT entity) FROM st) >= 0.01")
def _(spark, d):
    return layers.derive_contexts(states(spark, d), 0.01, 2)


@q("property_cooccurrence", _STATES + "SELECT a.key AS k1, b.key AS k2, count(*) AS entities FROM st a JOIN st b USING (entity) WHERE a.key < b.key GROUP BY 1, 2")
def _(spark, d):
    return layers.property_cooccurrence(states(spark, d))


@q("property_coverage", _STATES + "SELECT layer, key, round(count(DISTINCT entity) / any_value(n), 6) AS coverage FROM st JOIN (SELECT layer, count(DISTINCT entity) AS n FROM st GROUP BY 1) USING (layer) GROUP BY 1, 2")
def _(spark, d):
    return layers.property_coverage(states(spark, d))


@q("property_gaps", _STATES + ", x AS (SELECT value AS layer, key FROM st WHERE key = 'size' UNION SELECT layer, key FROM st) SELECT a.layer, b.key FROM (SELECT DISTINCT layer FROM x) a CROSS JOIN (SELECT DISTINCT key FROM x) b WHERE (a.layer, b.key) NOT IN (SELECT (layer, key) FROM x)")
def _(spark, d):
    s = states(spark, d).select("layer", "key", "value")
    x = s.where("key = 'size'").select(F.col("value").alias("layer"), "key").unionByName(s.select("layer", "key"))
    return layers.property_gaps(x)


@q("property_distribution", _STATES + "SELECT layer, key, value, n, rank FROM (SELECT layer, key, value, count(*) AS n, row_number() OVER (PARTITION BY layer, key ORDER BY count(*) DESC, value) AS rank FROM st GROUP BY 1, 2, 3) WHERE rank <= 3")
def _(spark, d):
    return layers.property_distribution(states(spark, d), 3)


@q("tag_clusters", _STATES + "SELECT value AS tag, count(DISTINCT (layer, entity)) AS members, count(DISTINCT layer) AS layers FROM st GROUP BY 1 HAVING count(DISTINCT (layer, entity)) >= 2")
def _(spark, d):
    return layers.tag_clusters(states(spark, d).withColumnRenamed("value", "tag"))


@q("similar_by_tags", _STATES + """, m AS (SELECT DISTINCT value FROM st WHERE entity = '1'), s AS (SELECT entity, count(DISTINCT value) AS n, count(DISTINCT value) FILTER (value IN (SELECT value FROM m)) AS c FROM st WHERE entity <> '1' GROUP BY 1)
SELECT entity, round(c / (n + (SELECT count(*) FROM m) - c), 6) AS jaccard FROM s WHERE c > 0 ORDER BY c / (n + (SELECT count(*) FROM m) - c) DESC, entity LIMIT 10""")
def _(spark, d):
    return layers.similar_by_tags(states(spark, d).withColumnRenamed("value", "tag"), "1")


@q("dominant_state", "SELECT p_brand AS entity, arg_max(p_type, n) AS state FROM (SELECT p_brand, p_type, count(*) * 1000000 - row_number() OVER (PARTITION BY p_brand ORDER BY p_type) AS n FROM part GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    return layers.dominant_state(layers.normalise_states(brand_types(spark, d))).select("entity", "state")


def brand_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("entity"), F.lit("l").alias("layer"), F.col("p_type").alias("state")).agg(F.count("*").cast("double").alias("probability"))


@q("collapsed_states")
def _(spark, d):
    return layers.collapse(brand_types(spark, d))


@q("properties_wide", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS brand, CAST(p_size AS VARCHAR) AS size FROM part")
def _(spark, d):
    p = table(spark, d, "part")
    long = p.select(F.col("p_partkey").cast("string").alias("id"), F.explode(F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))).alias("key", "value"))
    return basic.properties_wide(long, ["brand", "size"])


@q("pricing_summary", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem GROUP BY 1, 2""")
def _(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return g.agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"), F.avg("l_discount").alias("avg_disc"), F.count("*").alias("count_order"))
