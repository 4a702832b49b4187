"""Scalar functions of the query language, names, similarities, cleaning, properties and the metadata store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import basic, metadata, quality
from ..session import ratio
from .registry import Registry

PRELUDE = """
WITH RECURSIVE prop AS (
  SELECT 'part:' || p_partkey AS id, 'brand' AS key, p_brand AS value FROM part
  UNION ALL SELECT 'part:' || p_partkey, 'type', p_type FROM part WHERE p_partkey % 4 <> 0
), store AS (
  SELECT 'part:' || p_partkey AS entity_id, p_type AS entity_type, '{"brand":"' || p_brand || '","size":' || p_size || '}' AS metadata FROM part
), two AS (
  SELECT a.c_custkey AS id, a.c_name AS n1, b.c_name AS n2, a.c_mktsegment AS g1, b.c_mktsegment AS g2
  FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1
)
"""
REGISTRY = Registry(PRELUDE)
q = REGISTRY.add
PREFIXES = {"customer": "http://example.org/customer/", "nation": "http://example.org/nation/"}


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Each customer with the next one: (id, n1, n2, g1, g2)."""
    a = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("n1"), F.col("c_mktsegment").alias("g1"))
    b = read(spark, d, "customer").select((F.col("c_custkey") - 1).alias("id"), F.col("c_name").alias("n2"), F.col("c_mktsegment").alias("g2"))
    return a.join(b, "id")


def properties(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").withColumn("id", F.concat(F.lit("part:"), F.col("p_partkey").cast("string")))
    brand = p.select("id", F.lit("brand").alias("key"), F.col("p_brand").alias("value"))
    return brand.unionByName(p.where("p_partkey % 4 != 0").select("id", F.lit("type").alias("key"), F.col("p_type").alias("value")))


def entity_store(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    meta = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")))
    return p.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("entity_id"), F.col("p_type").alias("entity_type"), meta.alias("metadata"))


@q("fn_terms", """SELECT c_custkey AS id, c_custkey % 3 <> 0 AS is_bound, CAST(c_custkey AS VARCHAR) AS str, '' AS lang, 'http://www.w3.org/2001/XMLSchema#string' AS datatype,
'<' || c_name || '>' AS iri FROM customer""")
def _(spark, d):
    name = F.when(F.col("c_custkey") % 3 != 0, F.col("c_name"))
    kinds = (S.bound(name).alias("is_bound"), S.to_str(F.col("c_custkey")).alias("str"), S.lang(name).alias("lang"), S.datatype(name).alias("datatype"), S.iri(F.col("c_name")).alias("iri"))
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), *kinds)


@q("fn_fresh", "SELECT count(*) AS rows, count(*) AS blank_nodes, count(*) AS in_range FROM customer")
def _(spark, d):
    drawn = read(spark, d, "customer").select(S.bnode().alias("b"), S.rand().alias("r"))
    return drawn.agg(F.count("*").alias("rows"), F.count_if(F.col("b").rlike("^_:bn[0-9a-f]{8}$")).alias("blank_nodes"), F.count_if((F.col("r") >= 0) & (F.col("r") < 1)).alias("in_range"))


@q("fn_numbers", """SELECT c_custkey AS id, round(abs(c_acctbal - 5000.5), 6) AS abs, CAST(ceil(c_acctbal - 5000.5) AS BIGINT) AS ceil, CAST(floor(c_acctbal - 5000.5) AS BIGINT) AS floor,
CAST(round_even(c_custkey / 2.0, 0) AS DOUBLE) AS round, 0.0::DOUBLE AS of_text FROM customer""")
def _(spark, d):
    x = F.col("c_acctbal") - 5000.5
    return read(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), S.absolute(x).alias("abs"), S.ceil(x).alias("ceil"), S.floor(x).alias("floor"), S.round_half_even(F.col("c_custkey") / 2.0).alias("round"), S.absolute(F.col("c_name")).alias("of_text")
    )


@q("fn_strings", """SELECT p_partkey AS id, length(p_name) AS strlen, upper(p_name) AS ucase, lower(p_type) AS lcase, contains(p_name, 'ring') AS contains, starts_with(p_name, 'small') AS strstarts,
ends_with(p_name, 'widget') AS strends, regexp_matches(lower(p_type), '^e.*y$') AS regex, false AS bad_regex FROM part""")
def _(spark, d):
    n = F.col("p_name")
    return read(spark, d, "part").select(
        F.col("p_partkey").alias("id"), S.strlen(n).alias("strlen"), S.ucase(n).alias("ucase"), S.lcase(F.col("p_type")).alias("lcase"), S.contains(n, F.lit("ring")).alias("contains"),
        S.strstarts(n, F.lit("small")).alias("strstarts"), S.strends(n, F.lit("widget")).alias("strends"), S.regex(F.col("p_type"), "^e.*y$", "i").alias("regex"), S.regex(n, "(").alias("bad_regex"),
    )


@q("name_soundex", "SELECT id, g1 = g2 AS alike FROM two")
def _(spark, d):
    return neighbours(spark, d).select("id", S.soundex_equal(F.col("g1"), F.col("g2")).alias("alike"))


@q("name_token_jaccard", """SELECT a.p_partkey AS id, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS similarity
FROM (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS t FROM part) a JOIN (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS t FROM part) b ON b.p_partkey = a.p_partkey + 1""")
def _(spark, d):
    p = read(spark, d, "part")
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("n2"))
    return p.join(nxt, "p_partkey").select(F.col("p_partkey").alias("id"), S.token_jaccard(F.col("p_name"), F.col("n2")).alias("similarity"))


_PAIRS = """, v AS (SELECT id, g1 AS x, g2 AS y FROM two UNION ALL SELECT id, n1, n2 FROM two),
b AS (SELECT id, x, y, list_distinct(list_transform(range(1, length(x)), lambda i: substring(lower(x), i, 2))) AS bx, list_distinct(list_transform(range(1, length(y)), lambda i: substring(lower(y), i, 2))) AS yx FROM v),
s AS (SELECT id, CASE WHEN lower(x) = lower(y) THEN 1.0 ELSE len(list_intersect(bx, yx)) / len(list_distinct(list_concat(bx, yx))) END AS s FROM b)"""


@q("property_map_similarity", _PAIRS + " SELECT id, round(avg(s), 6) AS similarity FROM s GROUP BY 1")
def _(spark, d):
    one, two = (F.create_map(F.lit("segment"), F.col(f"g{i}"), F.lit("name"), F.col(f"n{i}")) for i in (1, 2))
    return neighbours(spark, d).select("id", S.map_similarity(one, two).alias("similarity"))


@q("uri_forms", """SELECT c_custkey AS id, 'http://example.org/customer/' || c_custkey AS long, 'customer:' || c_custkey AS short, 'customer:' || c_custkey AS back, CAST(c_custkey AS VARCHAR) AS local,
'customer' AS type FROM customer""")
def _(spark, d):
    short = F.concat(F.lit("customer:"), F.col("c_custkey").cast("string"))
    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), S.expand_uri(short, PREFIXES).alias("long"), short.alias("short"))
    return rows.select("*", S.compress_uri(F.col("long"), PREFIXES).alias("back"), S.local_name(F.col("long")).alias("local"), S.type_of(F.col("short")).alias("type"))


@q("clean_types", "SELECT CAST(sum(c_custkey) AS DOUBLE) AS total, count(DISTINCT c_name) AS names FROM customer")
def _(spark, d):
    raw = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), "c_name")
    return quality.infer_numbers(raw).agg(F.sum("key").alias("total"), F.countDistinct("c_name").alias("names"))


@q("clean_dates", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS orders FROM orders GROUP BY 1")
def _(spark, d):
    raw = read(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("at"), "o_orderstatus")
    return quality.parse_dates(raw).groupBy(F.date_format("at", "yyyy-MM").alias("month")).agg(F.count("*").alias("orders"))


@q("clean_chain", "SELECT count(*) AS rows, count(DISTINCT lower(trim(p_brand))) AS brands, CAST(sum(p_size) AS DOUBLE) AS total FROM (SELECT DISTINCT p_brand, p_size FROM part)")
def _(spark, d):
    raw = read(spark, d, "part").select(F.concat(F.lit(" "), F.col("p_brand")).alias("brand"), F.col("p_size").cast("string").alias("size"))
    return quality.clean(raw, ("distinct", "numbers", "text")).agg(F.count("*").alias("rows"), F.countDistinct("brand").alias("brands"), F.sum("size").alias("total"))


@q("column_kinds", """SELECT * FROM (VALUES ('part.p_name', 'categorical'), ('part.p_size', 'numerical'), ('orders.o_orderdate', 'temporal'), ('events.props', 'json'), ('events.event_type', 'categorical'),
('documents.text', 'text'), ('embeddings.embedding', 'vector')) AS k(column_name, kind)""")
def _(spark, d):
    names = ["part.p_name", "part.p_size", "orders.o_orderdate", "events.props", "events.event_type", "documents.text", "embeddings.embedding"]
    return spark.createDataFrame([(n, quality.column_kind(read(spark, d, n.split(".")[0]), n.split(".")[1])) for n in names], "column_name string, kind string")


@q("property_filter", "SELECT id FROM prop WHERE key = 'brand' AND value = 'Brand#2'")
def _(spark, d):
    return basic.with_property(properties(spark, d), "brand", "Brand#2")


@q("property_nodes", """SELECT CAST(l_orderkey AS VARCHAR) AS edge_id, 'part:' || l_partkey AS node_id, CAST(sum(l_quantity) AS DOUBLE) AS weight FROM lineitem JOIN prop ON id = 'part:' || l_partkey
WHERE key = 'type' AND value = 'ECONOMY' GROUP BY 1, 2""")
def _(spark, d):
    inc = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("edge_id"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("node_id")).agg(F.sum("l_quantity").alias("weight"))
    return basic.filter_by_property(inc, properties(spark, d), "type", "ECONOMY", "node_id")


@q("property_merge", "SELECT id, key, CASE WHEN key = 'brand' AND id LIKE '%7' THEN 'changed' ELSE value END AS value FROM prop UNION ALL SELECT id, 'note', 'new' FROM prop WHERE key = 'brand' AND id LIKE '%7'")
def _(spark, d):
    mine = properties(spark, d)
    sevens = mine.where("key = 'brand' AND id LIKE '%7'").select("id")
    other = sevens.select("id", F.lit("brand").alias("key"), F.lit("changed").alias("value")).unionByName(sevens.select("id", F.lit("note").alias("key"), F.lit("new").alias("value")))
    return basic.merge_properties(mine, other)


@q("property_statistics", "SELECT key, count(DISTINCT id) AS entities, count(DISTINCT value) AS distinct_values, round(count(DISTINCT id) / (SELECT count(DISTINCT id) FROM prop), 6) AS coverage FROM prop GROUP BY 1")
def _(spark, d):
    return basic.property_statistics(properties(spark, d))


@q("metadata_search", "SELECT entity_id, entity_type, metadata FROM store WHERE contains(lower(metadata), 'brand#2\"')")
def _(spark, d):
    return metadata.search_content(entity_store(spark, d), 'Brand#2"')


@q("metadata_counts", "SELECT entity_type, count(*) AS entities FROM store GROUP BY 1")
def _(spark, d):
    return metadata.counts(entity_store(spark, d))


@q("metadata_query", "SELECT entity_id FROM store WHERE entity_type = 'ECONOMY' AND CAST(json_extract_string(metadata, '$.size') AS DOUBLE) = 11 AND contains(json_extract_string(metadata, '$.brand'), '#1')")
def _(spark, d):
    return metadata.query(entity_store(spark, d), {"size": 11, "brand": {"contains": "#1"}}, "ECONOMY").select("entity_id")


@q("metadata_find", "SELECT entity_id, entity_type FROM store WHERE contains(lower(metadata), 'brand#1') OR contains(entity_id, 'brand#1') ORDER BY entity_id LIMIT 20 OFFSET 5")
def _(spark, d):
    return metadata.find(entity_store(spark, d), "brand#1", limit=20, offset=5).select("entity_id", "entity_type")


@q("metadata_upsert", """SELECT entity_id, entity_type, CASE WHEN entity_id LIKE '%3' THEN '{}' ELSE metadata END AS metadata, '2024-01-01 00:00:00' AS created_at,
CASE WHEN entity_id LIKE '%3' THEN '2024-02-02 00:00:00' ELSE '2024-01-01 00:00:00' END AS updated_at, CASE WHEN entity_id LIKE '%3' THEN 2 ELSE 1 END AS version FROM store
UNION ALL SELECT 'part:new', 'NEW', '{}', '2024-02-02 00:00:00', '2024-02-02 00:00:00', 1""")
def _(spark, d):
    at = lambda day: F.lit(f"2024-0{day}-0{day} 00:00:00")
    old = entity_store(spark, d).withColumns({"created_at": at(1), "updated_at": at(1), "version": F.lit(1)})
    new = old.where("entity_id LIKE '%3'").select("entity_id", "entity_type").unionByName(spark.createDataFrame([("part:new", "NEW")], "entity_id string, entity_type string"))
    return metadata.upsert(old, new.withColumns({"metadata": F.lit("{}"), "updated_at": at(2)}))


@q("property_metrics", "SELECT key, round(count(DISTINCT value) / count(*), 6) AS selectivity, max(length(value)) AS longest FROM prop GROUP BY 1")
def _(spark, d):
    p = basic.properties_long(basic.properties_wide(properties(spark, d), ["brand", "type"]), "id")
    return p.groupBy("key").agg(ratio(F.countDistinct("value"), F.count("*")).alias("selectivity"), F.max(F.length("value")).alias("longest"))
