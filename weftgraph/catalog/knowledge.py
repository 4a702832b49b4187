"""Knowledge-graph queries over triples made from the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import hierarchy, paths
from ..plans import knowledge, reasoning, sparql
from .registry import Registry

PRELUDE = """
WITH RECURSIVE tr AS (
  SELECT 'customer:' || c_custkey AS s, 'in_nation' AS p, 'nation:' || c_nationkey AS o FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'in_nation', 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'in_region', 'region:' || n_regionkey FROM nation
  UNION ALL SELECT 'order:' || o_orderkey, 'placed_by', 'customer:' || o_custkey FROM orders
  UNION ALL SELECT 'customer:' || c_custkey, 'rdf:type', 'Customer' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'rdf:type', 'Supplier' FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'rdf:type', 'Nation' FROM nation
  UNION ALL SELECT 'region:' || r_regionkey, 'rdf:type', 'Region' FROM region
  UNION ALL SELECT 'customer:' || c_custkey, 'segment', c_mktsegment FROM customer
  UNION ALL SELECT 'nation:' || n_nationkey, 'name', n_name FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'balance', CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) FROM customer
  UNION ALL SELECT 'Customer', 'rdfs:subClassOf', 'Party' UNION ALL SELECT 'Supplier', 'rdfs:subClassOf', 'Party'
  UNION ALL SELECT 'Party', 'rdfs:subClassOf', 'Thing' UNION ALL SELECT 'Nation', 'rdfs:subClassOf', 'Place'
  UNION ALL SELECT 'Region', 'rdfs:subClassOf', 'Place' UNION ALL SELECT 'Place', 'rdfs:subClassOf', 'Thing'
)
"""
REGISTRY = Registry(PRELUDE)
q = REGISTRY.add


def triples(spark: SparkSession, d: str) -> DataFrame:
    t = {n: spark.read.parquet(f"{d}/{n}.parquet") for n in ("customer", "supplier", "nation", "region", "orders")}

    def rows(table, s, key, p, o):
        return t[table].select(F.concat(F.lit(s), F.col(key).cast("string")).alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"))

    ref = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    parts = [
        rows("customer", "customer:", "c_custkey", "in_nation", ref("nation:", "c_nationkey")), rows("supplier", "supplier:", "s_suppkey", "in_nation", ref("nation:", "s_nationkey")),
        rows("nation", "nation:", "n_nationkey", "in_region", ref("region:", "n_regionkey")), rows("orders", "order:", "o_orderkey", "placed_by", ref("customer:", "o_custkey")),
        rows("customer", "customer:", "c_custkey", "rdf:type", F.lit("Customer")), rows("supplier", "supplier:", "s_suppkey", "rdf:type", F.lit("Supplier")),
        rows("nation", "nation:", "n_nationkey", "rdf:type", F.lit("Nation")), rows("region", "region:", "r_regionkey", "rdf:type", F.lit("Region")),
        rows("customer", "customer:", "c_custkey", "segment", F.col("c_mktsegment")), rows("nation", "nation:", "n_nationkey", "name", F.col("n_name")),
        rows("customer", "customer:", "c_custkey", "balance", F.floor("c_acctbal")),
    ]
    classes = [("Customer", "Party"), ("Supplier", "Party"), ("Party", "Thing"), ("Nation", "Place"), ("Region", "Place"), ("Place", "Thing")]
    out = spark.createDataFrame([(a, "rdfs:subClassOf", b) for a, b in classes], "s string, p string, o string")
    for p in parts:
        out = out.unionByName(p)
    return out


def places(spark: SparkSession, d: str) -> DataFrame:
    return triples(spark, d).where(F.col("p").isin("in_region", "in_nation"))


@q("kg_bgp_2hop", "SELECT a.s AS c, b.o AS r FROM tr a JOIN tr b ON a.o = b.s WHERE a.p = 'in_nation' AND b.p = 'in_region'")
def _(spark, d):
    return sparql.execute(triples(spark, d), "SELECT ?c ?r WHERE { ?c in_nation ?n . ?n in_region ?r }")


@q("kg_bgp_star", "SELECT a.s AS c, a.o AS n, b.o AS seg FROM tr a JOIN tr b USING (s) JOIN tr t USING (s) WHERE a.p = 'in_nation' AND b.p = 'segment' AND t.p = 'rdf:type' AND t.o = 'Customer'")
def _(spark, d):
    return sparql.execute(triples(spark, d), "SELECT ?c ?n ?seg WHERE { ?c a Customer ; in_nation ?n ; segment ?seg . }")


@q("kg_optional", "SELECT a.s AS x, b.o AS seg FROM (SELECT s FROM tr WHERE p = 'in_nation') a LEFT JOIN (SELECT s, o FROM tr WHERE p = 'segment') b USING (s)")
def _(spark, d):
    return sparql.execute(triples(spark, d), "SELECT ?x ?seg WHERE { ?x in_nation ?n OPTIONAL { ?x segment ?seg } }")


@q("kg_union", "SELECT s AS x, o AS y FROM tr WHERE p IN ('in_nation', 'in_region')")
def _(spark, d):
    return sparql.execute(triples(spark, d), "SELECT ?x ?y WHERE { { ?x in_nation ?y } UNION { ?x in_region ?y } }")


@q("kg_filter", "SELECT a.s AS c, CAST(a.o AS VARCHAR) AS b FROM tr a JOIN tr g USING (s) WHERE a.p = 'balance' AND g.p = 'segment' AND CAST(a.o AS DOUBLE) > 5000 AND (g.o = 'BUILDING' OR contains(g.o, 'AUTO')) AND g.o <> 'X'")
def _(spark, d):
    return sparql.execute(triples(spark, d), "SELECT ?c ?b WHERE { ?c balance ?b . ?c segment ?g FILTER(?b > 5000 && (?g = \"BUILDING\" || CONTAINS(?g, \"AUTO\"))) FILTER(?g != 'X') }")


@q("kg_filter_functions", "SELECT s AS n, o AS name FROM tr WHERE p = 'name' AND regexp_matches(lower(o), '^[m-z]') AND length(o) >= 5 AND NOT ends_with(o, '1')")
def _(spark, d):
    return sparql.execute(triples(spark, d), "SELECT ?n ?name WHERE { ?n name ?name FILTER(REGEX(?name, \"^[m-z]\", \"i\") && STRLEN(?name) >= 5 && !STRENDS(?name, \"1\")) }")


@q("kg_distinct_order_limit", "SELECT DISTINCT o AS seg FROM tr WHERE p = 'segment' ORDER BY seg DESC LIMIT 3 OFFSET 1")
def _(spark, d):
    return sparql.execute(triples(spark, d), "SELECT DISTINCT ?seg WHERE { ?c segment ?seg } ORDER BY DESC(?seg) LIMIT 3 OFFSET 1")


@q("kg_path_3", """SELECT 'nation:1>' || a.o || '>' || b.s AS path, CAST(2 AS BIGINT) AS hops FROM tr a JOIN tr b ON a.o = b.o AND b.p = 'in_region' WHERE a.s = 'nation:1' AND a.p = 'in_region'
AND b.s = (SELECT max(s) FROM tr WHERE p = 'in_region' AND o = a.o AND s <> 'nation:1')""")
def _(spark, d):
    near = places(spark, d).where("p = 'in_region'")
    region = near.where("s = 'nation:1'").select("o")
    end = near.join(region, "o", "left_semi").where("s != 'nation:1'").agg(F.max("s")).first()[0]
    return knowledge.path_query(places(spark, d), "nation:1", end, 4).select(F.array_join("path", ">").alias("path"), "hops")


@q("kg_neighborhood", "SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM (SELECT 'region:1' AS node, 0 AS depth UNION ALL SELECT s, 1 FROM tr WHERE p = 'in_region' AND o = 'region:1' UNION ALL SELECT a.s, 2 FROM tr a JOIN tr b ON a.o = b.s AND b.p = 'in_region' AND b.o = 'region:1' WHERE a.p = 'in_nation') GROUP BY 1")
def _(spark, d):
    return knowledge.neighborhood(places(spark, d), "region:1", 2)


@q("kg_subgraph", """, near AS (SELECT 'region:1' AS n UNION SELECT s FROM tr WHERE p = 'in_region' AND o = 'region:1') SELECT s, p, o FROM tr WHERE p IN ('in_region', 'in_nation') AND s IN (SELECT n FROM near) AND o IN (SELECT n FROM near)""")
def _(spark, d):
    return knowledge.subgraph(places(spark, d), ["region:1"], 1)


@q("kg_pattern_match", "SELECT s, p, o FROM tr WHERE p = 'in_region' AND o = 'region:2'")
def _(spark, d):
    return knowledge.pattern_match(triples(spark, d), p="in_region", o="region:2")


@q("kg_relation_statistics", "SELECT p, count(*) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM tr GROUP BY 1")
def _(spark, d):
    return knowledge.relation_statistics(triples(spark, d))


@q("kg_ontology", """SELECT class, count(DISTINCT s) AS instances, count(DISTINCT p) AS properties FROM (SELECT t.o AS class, t.s, x.p FROM tr t LEFT JOIN tr x ON x.s = t.s AND x.p <> 'rdf:type' WHERE t.p = 'rdf:type') GROUP BY 1""")
def _(spark, d):
    return knowledge.ontology(triples(spark, d))


@q("kg_schema_patterns", """, ty AS (SELECT s AS id, o AS type FROM tr WHERE p = 'rdf:type') SELECT a.type AS source_type, p, b.type AS target_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY a.type), 6) AS confidence
FROM tr JOIN ty a ON a.id = s JOIN ty b ON b.id = o WHERE p <> 'rdf:type' GROUP BY 1, 2, 3""")
def _(spark, d):
    return knowledge.schema_patterns(triples(spark, d))


@q("kg_property_lookup", "SELECT s FROM tr WHERE p = 'segment' AND o = 'BUILDING'")
def _(spark, d):
    return knowledge.pattern_match(triples(spark, d), p="segment", o="BUILDING").select("s")


@q("kg_functional_conflicts", "SELECT 'functional' AS kind, s, 'supplied_by' AS detail FROM (SELECT 'part:' || l_partkey AS s FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1)")
def _(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet").select(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("s"), F.lit("supplied_by").alias("p"), F.col("l_suppkey").cast("string").alias("o"))
    rule = spark.createDataFrame([("supplied_by", reasoning.TYPE, reasoning.FUNCTIONAL)], "s string, p string, o string")
    return reasoning.inconsistencies(t.unionByName(rule))


@q("kg_closure", ", c AS (SELECT s AS a, o AS b FROM tr WHERE p = 'rdfs:subClassOf' UNION SELECT c.a, t.o FROM c JOIN tr t ON t.s = c.b AND t.p = 'rdfs:subClassOf') SELECT a AS s, 'rdfs:subClassOf' AS p, b AS o FROM c")
def _(spark, d):
    return reasoning.property_closure(triples(spark, d), "rdfs:subClassOf")


@q("kg_subclass_types", ", c AS (SELECT s AS a, o AS b FROM tr WHERE p = 'rdfs:subClassOf' UNION SELECT c.a, t.o FROM c JOIN tr t ON t.s = c.b AND t.p = 'rdfs:subClassOf') SELECT DISTINCT t.s, c.b AS o FROM tr t JOIN c ON c.a = t.o WHERE t.p = 'rdf:type'")
def _(spark, d):
    t = triples(spark, d).where(F.col("p").isin("rdf:type", "rdfs:subClassOf"))
    out = reasoning.infer(t, {"subclass": reasoning.subclass})
    return out.where("rule IS NOT NULL AND p = 'rdf:type'").select("s", "o")


@q("kg_inverse", "SELECT o AS s, 'has_member' AS p, s AS o FROM tr WHERE p = 'in_region'")
def _(spark, d):
    rule = spark.createDataFrame([("in_region", "owl:inverseOf", "has_member")], "s string, p string, o string")
    return reasoning.infer(places(spark, d).where("p = 'in_region'").unionByName(rule), {"inverse": reasoning.inverse}).where("rule IS NOT NULL").select("s", "p", "o")


@q("kg_symmetric", "SELECT b.s, 'near' AS p, a.s AS o FROM tr a JOIN tr b ON a.o = b.o AND a.s < b.s WHERE a.p = 'in_region' AND b.p = 'in_region'")
def _(spark, d):
    n = places(spark, d).where("p = 'in_region'")
    near = n.select(F.col("s").alias("a"), "o").join(n.select(F.col("s").alias("b"), "o"), "o").where("a < b").select(F.col("a").alias("s"), F.lit("near").alias("p"), F.col("b").alias("o"))
    rule = spark.createDataFrame([("near", "rdf:type", "owl:SymmetricProperty")], "s string, p string, o string")
    return reasoning.infer(near.unionByName(rule), {"symmetry": reasoning.symmetry}).where("rule IS NOT NULL").select("s", "p", "o")


@q("kg_domain_range", "SELECT DISTINCT s, 'rdf:type' AS p, 'Buyer' AS o FROM (SELECT o AS s FROM tr WHERE p = 'placed_by') UNION SELECT DISTINCT s, 'rdf:type', 'Document' FROM tr WHERE p = 'placed_by'")
def _(spark, d):
    rule = spark.createDataFrame([("placed_by", "rdfs:domain", "Document"), ("placed_by", "rdfs:range", "Buyer")], "s string, p string, o string")
    t = triples(spark, d).where("p = 'placed_by'").unionByName(rule)
    return reasoning.infer(t, {"domain_range": reasoning.domain_range}).where("rule IS NOT NULL").select("s", "p", "o")


@q("kg_missing_properties", "SELECT s, o AS class, 'segment' AS p FROM tr WHERE p = 'rdf:type' AND o IN ('Customer', 'Supplier') AND s NOT IN (SELECT s FROM tr WHERE p = 'segment')")
def _(spark, d):
    need = spark.createDataFrame([("Customer", "segment"), ("Supplier", "segment")], "class string, p string")
    return knowledge.missing_properties(triples(spark, d), need)


@q("kg_class_depths", """, c AS (SELECT s AS a, o AS b FROM tr WHERE p = 'rdfs:subClassOf' UNION SELECT c.a, t.o FROM c JOIN tr t ON t.s = c.b AND t.p = 'rdfs:subClassOf')
SELECT class, count(DISTINCT up) AS ancestors, count(DISTINCT down) AS descendants, count(DISTINCT up) = 0 AS root, count(DISTINCT down) = 0 AS leaf FROM (SELECT a AS class, b AS up, NULL AS down FROM c UNION ALL SELECT b, NULL, a FROM c) GROUP BY 1""")
def _(spark, d):
    return knowledge.class_depths(triples(spark, d))


@q("semantic_search_score", """SELECT id, name, round(CAST(CASE WHEN lower(name) = 'red widget' THEN 1.0 WHEN contains(lower(name), 'red widget') THEN 0.8 WHEN contains(lower(name), 'red') OR contains(lower(name), 'widget') THEN 0.6 ELSE 0 END
+ CASE WHEN contains(regexp_extract(lower(id), '([^#/:]*)$', 1), 'red widget') THEN 0.4 ELSE 0 END AS DOUBLE), 6) AS score FROM (SELECT 'part:' || p_partkey AS id, p_name AS name FROM part)
WHERE contains(lower(name), 'red') OR contains(lower(name), 'widget')""")
def _(spark, d):
    e = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.lit("part").alias("type"), F.col("p_name").alias("name"))
    return knowledge.search(e, "red widget")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


def first_vector(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in vectors(spark, d).where("vec_id = 0").first()["embedding"]]


_Q0 = "(SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"


@q("vector_topk_cosine", f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS score FROM embeddings, {_Q0} ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) DESC, vec_id LIMIT 10")
def _(spark, d):
    return knowledge.vector_search(vectors(spark, d), first_vector(spark, d), 10)


@q("vector_topk_euclidean", f"SELECT vec_id, round(1 / (1 + list_distance(CAST(embedding AS DOUBLE[]), q)), 6) AS score FROM embeddings, {_Q0} ORDER BY list_distance(CAST(embedding AS DOUBLE[]), q), vec_id LIMIT 10")
def _(spark, d):
    return knowledge.vector_search(vectors(spark, d), first_vector(spark, d), 10, "euclidean")


@q("vector_threshold", f"SELECT vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), q), 6) AS score FROM embeddings, {_Q0} WHERE list_inner_product(CAST(embedding AS DOUBLE[]), q) >= 0.2 ORDER BY list_inner_product(CAST(embedding AS DOUBLE[]), q) DESC, vec_id LIMIT 1000")
def _(spark, d):
    return knowledge.vector_search(vectors(spark, d), first_vector(spark, d), 1000, "dot", 0.2)


@q("vector_batch", """SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score,
row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id < 5) WHERE rank <= 5""")
def _(spark, d):
    v = vectors(spark, d)
    queries = v.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))
    return knowledge.batch_vector_search(v, queries, 5)


@q("entity_bigram_similarity", """, e AS (SELECT DISTINCT p_name AS n FROM part), b AS (SELECT n, list_distinct(list_transform(range(1, CAST(length(n) AS BIGINT)), lambda i: lower(n)[i:i+1])) AS g FROM e)
SELECT x.n AS a, y.n AS b, round(len(list_intersect(x.g, y.g)) / len(list_distinct(list_concat(x.g, y.g))), 6) AS similarity FROM b x JOIN b y ON x.n < y.n WHERE len(list_intersect(x.g, y.g)) / len(list_distinct(list_concat(x.g, y.g))) >= 0.5""")
def _(spark, d):
    e = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("id"), F.lit("t").alias("type"), F.col("p_name").alias("name")).distinct()
    return knowledge.similar_names(e, 0.5)


@q("entity_token_jaccard", """, e AS (SELECT DISTINCT p_name AS n FROM part), b AS (SELECT n, list_distinct(string_split(lower(n), ' ')) AS g FROM e)
SELECT x.n AS a, y.n AS b, round(len(list_intersect(x.g, y.g)) / len(list_distinct(list_concat(x.g, y.g))), 6) AS similarity FROM b x JOIN b y ON x.n < y.n WHERE len(list_intersect(x.g, y.g)) / len(list_distinct(list_concat(x.g, y.g))) >= 0.3""")
def _(spark, d):
    e = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("id"), F.lit("t").alias("type"), F.col("p_name").alias("name")).distinct()
    return knowledge.similar_names(e, 0.3, "tokens")


@q("name_levenshtein", "SELECT a.n_name AS a, b.n_name AS b, round(1 - levenshtein(lower(a.n_name), lower(b.n_name)) / greatest(length(a.n_name), length(b.n_name)), 6) AS similarity FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
def _(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    x, y = n.alias("x"), n.alias("y")
    p = x.join(y, (F.col("x.n_regionkey") == F.col("y.n_regionkey")) & (F.col("x.n_nationkey") < F.col("y.n_nationkey")))
    return p.select(F.col("x.n_name").alias("a"), F.col("y.n_name").alias("b"), S.levenshtein_ratio(F.col("x.n_name"), F.col("y.n_name")).alias("similarity"))


@q("federated_union", "SELECT name, min(src) AS _source FROM (SELECT n_name AS name, 'a' AS src FROM nation UNION ALL SELECT r_name, 'b' FROM region UNION ALL SELECT n_name, 'c' FROM nation) GROUP BY 1")
def _(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("name"))
    r = spark.read.parquet(f"{d}/region.parquet").select(F.col("r_name").alias("name"))
    return knowledge.federated_union({"a": n, "b": r, "c": n})


@q("concepts", """SELECT term, count(*) AS frequency, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{L}{4,}')) AS term FROM documents) GROUP BY 1 HAVING count(*) >= 50""")
def _(spark, d):
    return knowledge.extract_concepts(spark.read.parquet(f"{d}/documents.parquet"), 50)


@q("emails_and_urls", r"""SELECT doc_id, 'email' AS kind, unnest(regexp_extract_all(text, '[\w.+-]+@[\w-]+\.[\w.]+')) AS value FROM documents UNION ALL SELECT doc_id, 'url', unnest(regexp_extract_all(text, 'https?://[^\s"''<>]+')) FROM documents""")
def _(spark, d):
    return knowledge.extract_entities(spark.read.parquet(f"{d}/documents.parquet"), ["email", "url"])


# hierarchies: parts by brand, type and size; nations by region


def tree(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    n = spark.read.parquet(f"{d}/nation.parquet")
    rows = [
        n.select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("child"), F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("parent")),
        n.select(F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("child"), F.lit("world").alias("parent")).distinct(),
        spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("child"), F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string")).alias("parent")),
        p.select(F.concat(F.lit("brand:"), "p_brand").alias("child"), F.lit("world").alias("parent")).distinct(),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


_TREE = """, tree AS (SELECT 'nation:' || n_nationkey AS child, 'region:' || n_regionkey AS parent FROM nation UNION ALL SELECT DISTINCT 'region:' || n_regionkey, 'world' FROM nation
UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION ALL SELECT DISTINCT 'brand:' || p_brand, 'world' FROM part),
up AS (SELECT child AS entity, parent AS ancestor, 1 AS depth FROM tree UNION ALL SELECT up.entity, tree.parent, depth + 1 FROM up JOIN tree ON tree.child = up.ancestor) """


@q("hierarchy_ancestors", _TREE + "SELECT entity, ancestor, CAST(depth AS BIGINT) AS depth FROM up")
def _(spark, d):
    return hierarchy.ancestry(tree(spark, d))


@q("hierarchy_descendants", _TREE + "SELECT entity, CAST(depth AS BIGINT) AS depth FROM up WHERE ancestor = 'region:1'")
def _(spark, d):
    return hierarchy.descendants(tree(spark, d), "region:1")


@q("hierarchy_depths", _TREE + "SELECT entity, CAST(max(depth) AS BIGINT) AS depth FROM up GROUP BY 1 UNION ALL SELECT 'world', 0")
def _(spark, d):
    return hierarchy.depths(tree(spark, d))


@q("hierarchy_leaves", _TREE + "SELECT DISTINCT child AS entity FROM tree WHERE child NOT IN (SELECT parent FROM tree)")
def _(spark, d):
    return hierarchy.leaves(tree(spark, d))


@q("hierarchy_roots", "SELECT 'world' AS entity")
def _(spark, d):
    return hierarchy.roots(tree(spark, d))


@q("hierarchy_siblings", _TREE + "SELECT a.child AS entity, b.child AS sibling FROM tree a JOIN tree b USING (parent) WHERE a.child <> b.child")
def _(spark, d):
    return hierarchy.siblings(tree(spark, d))


@q("hierarchy_rollup", _TREE + """, v AS (SELECT 'supplier:' || s_suppkey AS entity, s_acctbal AS value FROM supplier), x AS (SELECT ancestor AS entity, value FROM v JOIN up USING (entity) UNION ALL SELECT entity, value FROM v)
SELECT entity, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, max(value) AS largest, min(value) AS least, count(*) AS members FROM x GROUP BY 1""")
def _(spark, d):
    v = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("entity"), F.col("s_acctbal").alias("value"))
    return hierarchy.roll_up(tree(spark, d), v).withColumns({"total": F.round("total", 4), "mean": F.round("mean", 4)})


@q("hierarchy_common_ancestor", "SELECT CASE WHEN (SELECT n_regionkey FROM nation WHERE n_nationkey = 1) = (SELECT n_regionkey FROM nation WHERE n_nationkey = 2) THEN 'region:' || (SELECT n_regionkey FROM nation WHERE n_nationkey = 1) ELSE 'world' END AS ancestor")
def _(spark, d):
    return hierarchy.common_ancestor(tree(spark, d), "nation:1", "nation:2")


@q("hierarchy_level_links", """, lv AS (SELECT DISTINCT s AS entity, o AS level FROM tr WHERE p = 'rdf:type'), x AS (SELECT least(a.level, b.level) AS level_a, greatest(a.level, b.level) AS level_b FROM tr JOIN lv a ON a.entity = s JOIN lv b ON b.entity = o WHERE p IN ('in_nation', 'in_region'))
SELECT level_a, level_b, count(*) AS links FROM x GROUP BY ROLLUP (level_a, level_b)""")
def _(spark, d):
    t = triples(spark, d)
    levels = t.where("p = 'rdf:type'").select(F.col("s").alias("entity"), F.col("o").alias("level"))
    return hierarchy.level_connectivity(places(spark, d).select(F.col("s").alias("a"), F.col("o").alias("b")), levels)


@q("lineage_chain", _TREE + "SELECT ancestor AS entity, 'downstream' AS direction, CAST(depth AS BIGINT) AS depth FROM up WHERE entity = 'nation:1' UNION ALL SELECT entity, 'upstream', CAST(depth AS BIGINT) FROM up WHERE ancestor = 'nation:1'")
def _(spark, d):
    links = tree(spark, d).select(F.col("child").alias("source"), F.col("parent").alias("target"))
    return hierarchy.lineage(links, "nation:1")


@q("influence_regions")
def _(spark, d):
    seeds = spark.createDataFrame([("region:1", 1.0)], "node string, activation double")
    return knowledge.influence(places(spark, d), seeds)


@q("spanning_forest_places")
def _(spark, d):
    e = places(spark, d).where("p = 'in_region'").select(F.col("s").alias("a"), F.col("o").alias("b"), F.length("s").cast("double").alias("cost"))
    return paths.spanning_forest(e)
