"""Levels, layers and beliefs; relations between entities; search over levels; text and keyword queries on the knowledge graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy, layers, learning, paths
from ..plans import knowledge, sparql
from .knowledge import _TREE, PRELUDE, places, tree, triples
from .registry import Registry

REGISTRY = Registry(PRELUDE)
q = REGISTRY.add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def links(spark: SparkSession, d: str) -> DataFrame:
    return places(spark, d).select(F.col("s").alias("a"), F.col("o").alias("b"))


def levels(spark: SparkSession, d: str) -> DataFrame:
    return triples(spark, d).where("p = 'rdf:type'").select(F.col("s").alias("entity"), F.col("o").alias("level"))


_LEVELS = ", lv AS (SELECT s AS entity, o AS level FROM tr WHERE p = 'rdf:type'), ln AS (SELECT s AS a, o AS b FROM tr WHERE p IN ('in_nation', 'in_region')), ll AS (SELECT a, b, x.level AS la, y.level AS lb FROM ln JOIN lv x ON x.entity = a JOIN lv y ON y.entity = b)"


@q("hierarchy_path", _TREE + "SELECT ancestor, CAST(depth AS BIGINT) AS depth FROM up WHERE entity = 'supplier:3'")
def _(spark, d):
    return hierarchy.path_to_root(tree(spark, d), "supplier:3")


@q("hierarchy_subtree", _TREE + "SELECT child, parent FROM tree WHERE child IN (SELECT entity FROM up WHERE ancestor = 'region:2')")
def _(spark, d):
    return hierarchy.subtree(tree(spark, d), "region:2")


@q("hierarchy_metrics", _TREE + """, dp AS (SELECT entity, max(depth) AS depth FROM up GROUP BY 1 UNION ALL SELECT 'world', 0), kids AS (SELECT parent, count(*) AS k FROM tree GROUP BY 1)
SELECT (SELECT count(*) FROM dp) AS entities, (SELECT CAST(max(depth) AS BIGINT) FROM dp) AS depth, (SELECT max(n) FROM (SELECT count(*) AS n FROM dp GROUP BY depth)) AS breadth, (SELECT round(avg(k) / max(k), 6) FROM kids) AS balance""")
def _(spark, d):
    return hierarchy.hierarchy_metrics(tree(spark, d))


@q("cross_level_links", _LEVELS + " SELECT a, b FROM ll WHERE la = 'Customer' AND lb = 'Nation'")
def _(spark, d):
    return hierarchy.cross_level(links(spark, d), levels(spark, d), "Customer", "Nation")


@q("cross_level_totals", _LEVELS + ", v AS (SELECT s AS id, CAST(o AS DOUBLE) AS v FROM tr WHERE p = 'balance') SELECT b AS entity, 'balance' AS key, round(sum(v), 4) AS value FROM ll JOIN v ON id = a WHERE la = 'Customer' AND lb = 'Nation' GROUP BY 1")
def _(spark, d):
    props = triples(spark, d).where("p = 'balance'").select(F.col("s").alias("id"), F.col("p").alias("key"), F.col("o").alias("value"))
    return hierarchy.aggregate_across(links(spark, d), levels(spark, d), props, "Customer", "Nation").withColumn("value", F.round("value", 4))


@q("cross_level_patterns", _LEVELS + " SELECT la AS level_a, lb AS level_b, count(*) AS links, count(DISTINCT a) AS sources, count(DISTINCT b) AS targets FROM ll GROUP BY 1, 2")
def _(spark, d):
    return hierarchy.level_links(links(spark, d), levels(spark, d)).groupBy("level_a", "level_b").agg(F.count("*").alias("links"), F.countDistinct("a").alias("sources"), F.countDistinct("b").alias("targets"))


@q("influence_across_levels", """, seed AS (SELECT 'region:1' AS node, 1.0::DOUBLE AS x), e AS (SELECT s AS a, o AS b FROM tr WHERE p IN ('in_nation', 'in_region') UNION SELECT o, s FROM tr WHERE p IN ('in_nation', 'in_region')), dg AS (SELECT a, count(*) AS d FROM e GROUP BY 1),
s1 AS (SELECT b AS node, 0.5 * sum(x / d) AS x FROM seed JOIN e ON a = node JOIN dg USING (a) GROUP BY 1), s2 AS (SELECT b AS node, 0.5 * sum(x / d) AS x FROM s1 JOIN e ON a = node JOIN dg USING (a) GROUP BY 1)
SELECT node, round(sum(x), 6) AS activation FROM (SELECT * FROM seed UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY 1""")
def _(spark, d):
    seeds = spark.createDataFrame([("region:1", 1.0)], "node string, activation double")
    return knowledge.influence(places(spark, d), seeds, 0.5, 2)


@q("level_centrality", _LEVELS + """, bt AS (SELECT a AS entity, la AS level, b, lb AS other FROM ll UNION ALL SELECT b, lb, a, la FROM ll), g AS (SELECT entity, level, count(DISTINCT b) FILTER (level = other) AS within, count(DISTINCT b) FILTER (level <> other) AS across FROM bt GROUP BY 1, 2)
SELECT lv.entity, lv.level, coalesce(within, 0) AS within, coalesce(across, 0) AS across, round(coalesce(within, 0) / (count(*) OVER (PARTITION BY lv.level) - 1), 6) AS score FROM lv LEFT JOIN g USING (entity, level)""")
def _(spark, d):
    return hierarchy.level_centrality(links(spark, d), levels(spark, d))


_REGIONS = ", zone AS (SELECT 'nation:' || n_nationkey AS entity, 'nation:' || n_regionkey AS parent FROM nation WHERE n_nationkey >= 5)"


@q("level_communities", _REGIONS + ", lv AS (SELECT s AS entity, o AS level FROM tr WHERE p = 'rdf:type'), e AS (SELECT entity AS a, parent AS b FROM zone UNION SELECT parent, entity FROM zone), reach AS (SELECT entity AS a, entity AS b FROM lv UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b) SELECT lv.entity, level, min(b) AS community FROM lv JOIN reach ON a = lv.entity GROUP BY 1, 2")
def _(spark, d):
    zone = read(spark, d, "nation").where("n_nationkey >= 5").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("a"), F.concat(F.lit("nation:"), F.col("n_regionkey").cast("string")).alias("b"))
    return hierarchy.level_communities(zone.unionByName(links(spark, d)), levels(spark, d))


def named(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.lit("place").alias("kind"))
    c = read(spark, d, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"))
    return n.unionByName(c)


_HITS = """, nm AS (SELECT 'nation:' || n_nationkey AS id, n_name AS name, 'place' AS kind, 'Nation' AS level FROM nation UNION ALL SELECT 'customer:' || c_custkey, c_name, c_mktsegment, 'Customer' FROM customer),
hit AS (SELECT id, name, level, kind, CASE WHEN lower(name) = '@' THEN 1.0 WHEN contains(lower(name), '@') THEN 0.8 ELSE 0.0 END + CASE WHEN contains(regexp_extract(lower(id), '([^#/:]*)$', 1), '@') THEN 0.4 ELSE 0.0 END AS score FROM nm)"""


@q("search_levels", _HITS.replace("@", "12") + " SELECT id, name, level, round(CAST(score AS DOUBLE), 6) AS score FROM hit WHERE score > 0 AND kind IN ('place', 'BUILDING')")
def _(spark, d):
    return hierarchy.search_levels(named(spark, d), levels(spark, d), "12", {"kind": ["place", "BUILDING"]})


@q("search_summary", _HITS.replace("@", "1") + " SELECT level, count(*) AS hits, round(CAST(max(score) AS DOUBLE), 6) AS best, round(CAST(avg(score) AS DOUBLE), 6) AS mean FROM hit WHERE score > 0 GROUP BY 1")
def _(spark, d):
    return hierarchy.search_summary(hierarchy.search_levels(named(spark, d), levels(spark, d), "1"))


# layers: an entity's states by layer


def layer_states(spark: SparkSession, d: str) -> DataFrame:
    """Customers' priorities and states by the order status as layer: (entity, layer, key, value)."""
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("entity"), F.col("o_orderstatus").alias("layer")).agg(F.min("o_orderpriority").alias("value"))
    return o.select("entity", "layer", F.lit("priority").alias("key"), "value")


_LAYERS = ", ls AS (SELECT CAST(o_custkey AS VARCHAR) AS entity, o_orderstatus AS layer, 'priority' AS key, min(o_orderpriority) AS value FROM orders GROUP BY 1, 2), lvl(layer, level) AS (VALUES ('F', 0), ('O', 1), ('P', 2))"


def layer_levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("F", 0), ("O", 1), ("P", 2)], "layer string, level int")


@q("layer_propagate_up", _LAYERS + " SELECT entity, ls.layer, level, key, value FROM ls JOIN lvl USING (layer) WHERE level > 0")
def _(spark, d):
    return layers.propagate(layer_states(spark, d), layer_levels(spark), "F")


@q("layer_propagate_down", _LAYERS + " SELECT entity, ls.layer, level, key, value FROM ls JOIN lvl USING (layer) WHERE level < 2")
def _(spark, d):
    return layers.propagate(layer_states(spark, d), layer_levels(spark), "P", up=False)


@q("layer_contradictions", _LAYERS + " SELECT a.entity, a.key, a.layer AS layer1, b.layer AS layer2, a.value AS v1, b.value AS v2 FROM ls a JOIN ls b ON a.entity = b.entity AND a.key = b.key AND a.layer < b.layer AND a.value <> b.value")
def _(spark, d):
    return layers.contradictions(layer_states(spark, d)).select("entity", "key", "layer1", "layer2", "v1", "v2")


def chances(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("entity"), F.lit("l").alias("layer"), F.col("o_orderstatus").alias("state"))
    return g.agg(F.count("*").cast("double").alias("probability"))


_CHANCES = ", ch AS (SELECT o_orderpriority AS entity, o_orderstatus AS state, CAST(count(*) AS DOUBLE) AS p FROM orders GROUP BY 1, 2)"


@q("layer_normalised", _CHANCES + " SELECT entity, 'l' AS layer, state, round(p / sum(p) OVER (PARTITION BY entity), 6) AS probability FROM ch")
def _(spark, d):
    return layers.normalise_states(chances(spark, d))


@q("layer_beliefs", _CHANCES + ", w AS (SELECT entity, state, p * CASE WHEN state = 'F' THEN 0.5 * 0.8 WHEN state = 'O' THEN 0.9 ELSE 1 END AS p FROM ch) SELECT entity, 'l' AS layer, state, round(p / sum(p) OVER (PARTITION BY entity), 6) AS probability FROM w")
def _(spark, d):
    rules = spark.createDataFrame([("l", "F", 0.5), ("l", "F", 0.8), ("l", "O", 0.9)], "layer string, state string, confidence double")
    return layers.beliefs(chances(spark, d), rules).select("entity", "layer", "state", "probability")


@q("layer_observe", _CHANCES + """, known AS (SELECT DISTINCT entity, state FROM ch WHERE entity LIKE '1%' AND state = 'F'), ctx AS (SELECT DISTINCT entity, state FROM ch WHERE state = 'O' AND entity < '4')
SELECT e.entity, 'l' AS layer, coalesce(known.state, ctx.state) AS state FROM (SELECT DISTINCT entity FROM ch WHERE entity < '4') e LEFT JOIN known USING (entity) LEFT JOIN ctx USING (entity)""")
def _(spark, d):
    c = chances(spark, d).select("entity", "layer", "state")
    known, context = c.where("entity LIKE '1%' AND state = 'F'"), c.where("state = 'O' AND entity < '4'")
    return layers.observe(known, context, chances(spark, d).where("entity < '4'"))


@q("layer_similarity", """, v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IN (0, 1)) SELECT round(avg(list_cosine_similarity(a.e[f:t], b.e[f:t])), 6) AS similarity
FROM v a, v b, (VALUES (1, 8), (9, 16)) AS w(f, t) WHERE a.vec_id = 0 AND b.vec_id = 1""")
def _(spark, d):
    v = read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("entity"), F.explode(F.array(*[F.struct(F.lit(f"l{i}").alias("layer"), F.slice("embedding", 8 * i + 1, 8).alias("vector")) for i in (0, 1)])).alias("x"))
    return learning.cross_layer_similarity(v.select("entity", "x.layer", "x.vector"), "0", "1")


@q("layer_anomalies", """, s AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS d, avg(c_nationkey) AS m2, stddev_pop(c_nationkey) AS d2 FROM customer),
z AS (SELECT c_custkey, sqrt((((c_acctbal - m) / d) ** 2 + ((c_nationkey - m2) / d2) ** 2) / 2) AS score FROM customer, s) SELECT c_custkey, round(score, 6) AS score FROM z WHERE score > (SELECT quantile_cont(score, 0.9) FROM z)""")
def _(spark, d):
    return learning.z_anomalies(read(spark, d, "customer"), "c_custkey", ["c_acctbal", "c_nationkey"])


@q("reduced_dimensions", "SELECT count(*) AS rows, count(*) AS of_two, true AS first_is_largest FROM embeddings")
def _(spark, d):
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    r = learning.reduce_dimensions(v).select("vector", F.get("vector", F.lit(0)).alias("x"), F.get("vector", F.lit(1)).alias("y"))
    return r.agg(F.count("*").alias("rows"), F.count_if(F.size("vector") == 2).alias("of_two"), (F.var_pop("x") >= F.var_pop("y")).alias("first_is_largest"))


# relations, terms and learnt links


def relations(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "nation")
    return x.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("source"), F.concat(F.lit("n"), F.col("n_regionkey").cast("string")).alias("target"), F.when(F.col("n_nationkey") % 2 == 0, "near").otherwise("far").alias("type"), (F.col("n_nationkey") / 25.0).alias("strength"), (F.col("n_nationkey") % 3 == 0).alias("bidirectional"))


_RELATIONS = ", rl AS (SELECT 'n' || n_nationkey AS source, 'n' || n_regionkey AS target, CASE WHEN n_nationkey % 2 = 0 THEN 'near' ELSE 'far' END AS type, n_nationkey / 25.0 AS strength, n_nationkey % 3 = 0 AS bi FROM nation)"


@q("entity_relationships", _RELATIONS + """ SELECT target AS other, type, round(CAST(strength AS DOUBLE), 6) AS strength, 'out' AS direction FROM rl WHERE source = 'n2' AND strength >= 0.05
UNION ALL SELECT source, type, round(CAST(strength AS DOUBLE), 6), CASE WHEN bi THEN 'both' ELSE 'in' END FROM rl WHERE target = 'n2' AND strength >= 0.05""")
def _(spark, d):
    return learning.relationships(relations(spark, d), "n2", least=0.05)


@q("business_terms", "SELECT p_brand || ' ' || p_type AS term FROM (SELECT DISTINCT p_brand, p_type FROM part) WHERE contains(lower(p_type), 'econ') OR lower(p_brand) = 'brand#1'")
def _(spark, d):
    p = read(spark, d, "part").select("p_brand", "p_type").distinct()
    terms = p.select(F.concat_ws(" ", "p_brand", "p_type").alias("term"), F.lower("p_type").alias("definition"), F.lit("parts").alias("domain"), F.when(F.col("p_brand") == "Brand#1", F.array(F.lit("econ one"))).otherwise(F.array().cast("array<string>")).alias("synonyms"))
    return learning.search_terms(terms, "ECON", "parts").select("term")


_MISSING = """, ty AS (SELECT s, o AS type FROM tr WHERE p = 'rdf:type' AND s LIKE 'nation:%'), f AS (SELECT s, 'kind' AS p, CASE WHEN CAST(substr(s, 8) AS INT) % 10 = 3 THEN 'sea' ELSE 'land' END AS o FROM ty WHERE CAST(substr(s, 8) AS INT) % 4 <> 0),
r AS (SELECT o, count(*) / (SELECT count(*) FROM f) AS confidence FROM f GROUP BY 1 HAVING count(*) >= 2 AND count(*) / (SELECT count(*) FROM f) >= 0.7)"""


@q("missing_relations", _MISSING + " SELECT ty.s, 'kind' AS p, r.o, round(r.confidence, 6) AS confidence FROM ty, r WHERE ty.s NOT IN (SELECT s FROM f)")
def _(spark, d):
    t = triples(spark, d).where("p = 'rdf:type' AND s LIKE 'nation:%'")
    n = F.substring_index("s", ":", -1).cast("int")
    facts = t.where(n % 4 != 0).select("s", F.lit("kind").alias("p"), F.when(n % 10 == 3, "sea").otherwise("land").alias("o"))
    return learning.missing_by_statistics(t.unionByName(facts))


@q("co_occurring_objects", "SELECT a.o AS a, b.o AS b, count(*) AS subjects FROM (SELECT s, p, o FROM tr) a JOIN tr b ON a.s = b.s WHERE a.p = 'rdfs:subClassOf' AND b.p = 'rdfs:subClassOf' AND a.o < b.o GROUP BY 1, 2 HAVING count(*) >= 1 UNION ALL SELECT 'BUILDING', 'nation:x', count(*) FROM tr WHERE p = 'segment' AND o = 'BUILDING'")
def _(spark, d):
    t = triples(spark, d).where("p IN ('segment', 'rdfs:subClassOf')")
    extra = t.where("p = 'segment' AND o = 'BUILDING'").select("s", "p", F.lit("nation:x").alias("o"))
    both = t.unionByName(extra)
    return learning.co_occurring_objects(both, "segment", 1).unionByName(learning.co_occurring_objects(both, "rdfs:subClassOf", 1))


def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as (kind, id, vector): entities, and a relation that is vector 1 less vector 0."""
    v = read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    one, zero = (v.where(F.col("id") == i).select(F.col("vector").alias(f"v{i}")) for i in ("1", "0"))
    step = one.join(zero).select(F.lit("relation").alias("kind"), F.lit("next").alias("id"), F.zip_with("v1", "v0", lambda a, b: a - b).alias("vector"))
    return v.select(F.lit("entity").alias("kind"), "id", "vector").unionByName(step)


_VECTORS = ", v AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), v0 AS (SELECT e FROM v WHERE id = '0'), v1 AS (SELECT e FROM v WHERE id = '1')"


@q("link_scores", _VECTORS + """ SELECT '2' AS s, 'next' AS p, id AS o, round(-sqrt(list_sum(list_transform(range(1, len(v.e) + 1), lambda i: (x.e[i] + v1.e[i] - v0.e[i] - v.e[i]) * (x.e[i] + v1.e[i] - v0.e[i] - v.e[i])))), 4) AS score
FROM v, v0, v1, (SELECT e FROM v WHERE id = '2') x WHERE id <> '2'""")
def _(spark, d):
    vectors = unit_vectors(spark, d)
    candidates = vectors.where("kind = 'entity' AND id != '2'").select(F.lit("2").alias("s"), F.lit("next").alias("p"), F.col("id").alias("o"))
    return learning.score_links(candidates, vectors).withColumn("score", F.round("score", 4))


@q("nearest_entities", _VECTORS + " SELECT id, round(list_cosine_similarity(v.e, v1.e), 6) AS score FROM v, v1 ORDER BY list_cosine_similarity(v.e, v1.e) DESC, id LIMIT 10")
def _(spark, d):
    vectors = unit_vectors(spark, d)
    return learning.nearest(vectors, vectors.where("id = '1'").first()["vector"])


@q("analogy", _VECTORS + """, x AS (SELECT list_transform(range(1, len(v0.e) + 1), lambda i: v1.e[i] - v0.e[i] + y.e[i]) AS e FROM v0, v1, (SELECT e FROM v WHERE id = '2') y)
SELECT id, round(list_cosine_similarity(v.e, x.e), 6) AS score FROM v, x WHERE id NOT IN ('0', '1', '2') ORDER BY list_cosine_similarity(v.e, x.e) DESC, id LIMIT 5""")
def _(spark, d):
    return learning.analogy(unit_vectors(spark, d).where("kind = 'entity'"), "0", "1", "2")


@q("classified_entities", "SELECT p_partkey AS id, CASE WHEN p_size <= 25 THEN 'small' ELSE 'large' END AS label FROM part WHERE abs(p_size - 25.5) > 3")
def _(spark, d):
    points = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double")).alias("vector"), "p_size")
    labels = points.where("id % 2 = 0").select("id", F.when(F.col("p_size") <= 25, "small").otherwise("large").alias("label"))
    far = points.where("abs(p_size - 25.5) > 3").select("id")
    return learning.classify(points.select("id", "vector"), labels).join(far, "id")


# the query language's parts


@q("kg_match", "SELECT s AS who, o AS place FROM tr WHERE p = 'in_nation'")
def _(spark, d):
    return sparql.match(triples(spark, d), ("?who", "in_nation", "?place"))


@q("kg_join", "SELECT a.s AS c, a.o AS n, b.o AS r FROM tr a JOIN tr b ON a.o = b.s WHERE a.p = 'in_nation' AND b.p = 'in_region'")
def _(spark, d):
    t = triples(spark, d)
    return sparql._join(sparql.match(t, ("?c", "in_nation", "?n")), sparql.match(t, ("?n", "in_region", "?r")))


@q("kg_bindings", "SELECT 'nation:3' AS n, s AS c FROM tr WHERE p = 'in_nation' AND o = 'nation:3'")
def _(spark, d):
    return sparql.execute(triples(spark, d), "SELECT ?n ?c WHERE { ?c in_nation ?n }", {"n": "nation:3"})


@q("kg_modifiers", "SELECT s AS c, CAST(o AS VARCHAR) AS b FROM tr WHERE p = 'balance' ORDER BY s LIMIT 7 OFFSET 2")
def _(spark, d):
    return sparql.execute(triples(spark, d), "SELECT ?c ?b WHERE { ?c balance ?b } ORDER BY ?c LIMIT 7 OFFSET 2")


@q("kg_parse", "SELECT * FROM (VALUES ('SELECT ?a WHERE { ?a p ?b }', true), ('SELECT ?a WHERE { ?a p', false), ('DELETE ?a', false)) AS v(text, valid)")
def _(spark, d):
    texts = ["SELECT ?a WHERE { ?a p ?b }", "SELECT ?a WHERE { ?a p", "DELETE ?a"]
    return spark.createDataFrame([(t, not sparql.validate(t)) for t in texts], "text string, valid boolean")


@q("kg_pushdown", "SELECT s AS c, o AS g FROM tr WHERE p = 'segment' AND o = 'BUILDING'")
def _(spark, d):
    """The constant object reaches the scan, whatever the order of the patterns."""
    return sparql.execute(triples(spark, d), "SELECT ?c ?g WHERE { ?c segment ?g . FILTER(?g = \"BUILDING\") }")


@q("kg_similarity", """, f1 AS (SELECT p || chr(9) || o AS f FROM tr WHERE s = 'customer:1'), f2 AS (SELECT p || chr(9) || o AS f FROM tr WHERE s = 'customer:2'),
n1 AS (SELECT o AS x FROM tr WHERE s = 'customer:1' UNION SELECT s FROM tr WHERE o = 'customer:1'), n2 AS (SELECT o AS x FROM tr WHERE s = 'customer:2' UNION SELECT s FROM tr WHERE o = 'customer:2')
SELECT round(0.5 * (SELECT count(*) FROM (SELECT f FROM f1 INTERSECT SELECT f FROM f2)) / (SELECT count(*) FROM (SELECT f FROM f1 UNION SELECT f FROM f2)) + 0.5 * (SELECT count(*) FROM (SELECT x FROM n1 INTERSECT SELECT x FROM n2)) / (SELECT count(*) FROM (SELECT x FROM n1 UNION SELECT x FROM n2)), 6) AS similarity""")
def _(spark, d):
    return knowledge.semantic_similarity(triples(spark, d), "customer:1", "customer:2")


@q("kg_fused", """, a AS (SELECT s, p, o FROM tr WHERE p = 'in_nation' AND s LIKE 'customer:%'), b AS (SELECT 'client:' || substr(s, 10) AS s, p, o FROM a UNION ALL SELECT 'client:0', 'note', 'client:1'),
y AS (SELECT replace(s, 'client:', 'customer:') AS s, p, replace(o, 'client:', 'customer:') AS o FROM b) SELECT s, p, o, min(graph) AS graph FROM (SELECT *, 'a' AS graph FROM a UNION ALL SELECT *, 'b' FROM y) GROUP BY 1, 2, 3""")
def _(spark, d):
    a = triples(spark, d).where("p = 'in_nation' AND s LIKE 'customer:%'")
    key = F.substring_index("s", ":", -1)
    b = a.select(F.concat(F.lit("client:"), key).alias("s"), "p", "o").unionByName(spark.createDataFrame([("client:0", "note", "client:1")], "s string, p string, o string"))
    return knowledge.fuse(a, b, a.select(F.col("s").alias("a"), F.concat(F.lit("client:"), key).alias("b")))


@q("kg_clustered_matches", _REGIONS + ", e AS (SELECT entity AS a, parent AS b FROM zone UNION SELECT parent, entity FROM zone), reach AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b), c AS (SELECT a AS id, min(b) AS cluster FROM reach GROUP BY 1) SELECT id, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM c")
def _(spark, d):
    zone = read(spark, d, "nation").where("n_nationkey >= 5").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("a"), F.concat(F.lit("nation:"), F.col("n_regionkey").cast("string")).alias("b"))
    return knowledge.cluster_matches(zone)


@q("kg_extracted", "SELECT c_custkey AS doc_id, 'Customer' || c_custkey AS s, 'buys' AS p, 'Segment' || c_mktsegment AS o FROM customer")
def _(spark, d):
    texts = read(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("we know that Customer"), F.col("c_custkey").cast("string"), F.lit(" works with Segment"), F.col("c_mktsegment"), F.lit(", often")).alias("text"))
    return knowledge.extract_triples(texts, {"buys": "works with"})


@q("kg_reified", "SELECT CAST(l_orderkey AS VARCHAR) AS s, 'has_member' AS p, CAST(l_partkey AS VARCHAR) AS o FROM lineitem GROUP BY 1, 3")
def _(spark, d):
    inc = read(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("edge_id"), F.col("l_partkey").cast("string").alias("node_id"))
    return knowledge.to_triples(inc, reify=True)


@q("kg_of_incidences", "SELECT CAST(n_nationkey AS VARCHAR) AS s, 'in' AS p, CAST(n_regionkey AS VARCHAR) AS o FROM nation")
def _(spark, d):
    n = read(spark, d, "nation")
    edge = F.concat_ws("-", F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")).alias("edge_id")
    ends = F.array(*[F.struct(F.lit(i).alias("pos"), F.col(c).cast("string").alias("node_id")) for i, c in enumerate(("n_nationkey", "n_regionkey"))])
    inc = n.select(edge, F.lit("in").alias("edge_type"), F.explode(ends).alias("x")).select("edge_id", "edge_type", "x.pos", "x.node_id")
    return knowledge.triples_of(inc).select("s", "p", "o")


@q("kg_keywords", """SELECT * FROM (VALUES ('find Customer', 'node_search'), ('path from nation:1 to nation:2', 'path_search'), ('how many orders', 'aggregate'), ('pattern where "nation:3"', 'pattern_match')) AS v(text, kind)""")
def _(spark, d):
    texts = ["find Customer", "path from nation:1 to nation:2", "how many orders", 'pattern where "nation:3"']
    return spark.createDataFrame([(t, knowledge.parse_keywords(t)["kind"]) for t in texts], "text string, kind string")


@q("kg_keyword_pattern", "SELECT s, p, o FROM tr WHERE s = 'nation:3' OR o = 'nation:3'")
def _(spark, d):
    return knowledge.run_keywords(triples(spark, d), named(spark, d), 'pattern where "nation:3"', 100_000)


@q("kg_keyword_statistics", "SELECT p, count(*) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM tr GROUP BY 1")
def _(spark, d):
    return knowledge.run_keywords(triples(spark, d), named(spark, d), "how many triples")


@q("kg_federated_pattern", "SELECT s, p, o, min(src) AS _source FROM (SELECT s, p, o, 'a' AS src FROM tr WHERE o = 'region:1' UNION ALL SELECT s, p, o, 'b' FROM tr WHERE p = 'in_region') GROUP BY 1, 2, 3")
def _(spark, d):
    t = triples(spark, d)
    return knowledge.federated_union({"a": knowledge.pattern_match(t, o="region:1"), "b": knowledge.pattern_match(t, p="in_region")})


@q("kg_indexes", """SELECT 'type' AS kind, o AS key, s AS entity FROM tr WHERE p = 'rdf:type' UNION SELECT 'property', p, s FROM tr WHERE p <> 'rdf:type' UNION SELECT 'object', o, s FROM tr WHERE p <> 'rdf:type'""")
def _(spark, d):
    return knowledge.build_indexes(triples(spark, d))


@q("kg_shortest_path", "SELECT 'customer:1' || '>' || a.o || '>' || b.o AS path FROM tr a JOIN tr b ON b.s = a.o AND b.p = 'in_region' WHERE a.s = 'customer:1' AND a.p = 'in_nation'")
def _(spark, d):
    target = triples(spark, d).where("p = 'in_nation' AND s = 'customer:1'").select(F.col("o").alias("s")).join(triples(spark, d).where("p = 'in_region'"), "s").first()["o"]
    return paths.shortest_path(knowledge.edges_of(places(spark, d)), "customer:1", target).select(F.array_join("path", ">").alias("path"))
