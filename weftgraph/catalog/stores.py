"""Files, graph formats, a SQLite file, pipelines of steps, and event streams that are written, read and replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..hypergraph import Hypergraph, incidence_from
from ..operators import basic, temporal
from ..session import folder
from ..sources import databases, formats
from ..streaming import events as stream
from .graph import PRELUDE as GRAPH
from .graph import early_and_late, orders_over_parts
from .registry import Registry

PRELUDE = (
    GRAPH.rstrip()
    + """, ev AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, CASE event_id % 5 WHEN 0 THEN 'remove_edge' WHEN 1 THEN 'modify_edge' ELSE 'add_edge' END AS event_type, ts, CAST(user_id AS VARCHAR) AS edge_id,
    CASE WHEN event_id % 2 = 0 THEN [event_type] ELSE [event_type, 'k' || (event_id % 7)] END AS nodes, value AS weight FROM events
), fin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY ts DESC, event_id DESC) AS r FROM ev) WHERE r = 1 AND event_type <> 'remove_edge'),
edge_rows AS (SELECT edge_id, unnest(nodes) AS node_id, weight FROM fin)
"""
)
REGISTRY = Registry(PRELUDE)
q = REGISTRY.add


def written(spark: SparkSession, d: str, **options) -> str:
    path = folder(spark, "graph")
    formats.save(Hypergraph(orders_over_parts(spark, d), name="orders"), path, **options)
    return path


@q("saved_and_loaded", "SELECT edge_id, node_id, weight FROM inc")
def _(spark, d):
    return formats.load(spark, written(spark, d, compression="zstd")).incidence


@q("saved_in_parts", "SELECT count(*) AS rows, true AS in_parts FROM inc")
def _(spark, d):
    path = written(spark, d, rows_per_file=500)
    info = formats.file_info(spark, f"{path}/incidence")
    return info.agg(F.sum("rows").alias("rows"), (F.max("rows") <= 500).alias("in_parts"))


@q("saved_as_csv", "SELECT edge_id, node_id, weight FROM inc")
def _(spark, d):
    path = written(spark, d, fmt="csv")
    return formats.load(spark, path, "csv").incidence.withColumn("weight", F.col("weight").cast("double"))


@q("collection", "SELECT 'early' AS graph_id, count(*) AS rows FROM early UNION ALL SELECT 'late', count(*) FROM late")
def _(spark, d):
    path = folder(spark, "collection")
    early, late = early_and_late(spark, d)
    formats.save_collection({"early": Hypergraph(early), "late": Hypergraph(late)}, path)
    return formats.load_collection(spark, path).groupBy("graph_id").agg(F.count("*").alias("rows"))


@q("collection_member", "SELECT edge_id, node_id, weight FROM late")
def _(spark, d):
    path = folder(spark, "collection")
    early, late = early_and_late(spark, d)
    formats.save_collection({"early": Hypergraph(early), "late": Hypergraph(late)}, path)
    return formats.load_collection(spark, path, "late").select("edge_id", "node_id", "weight")


@q("rewritten_files", "SELECT count(*) AS rows, 2 AS files FROM inc")
def _(spark, d):
    source, target = f"{written(spark, d)}/incidence", folder(spark, "rewritten")
    formats.rewrite(spark, source, target, sort_by=["edge_id"], files=2)
    return formats.file_info(spark, target).agg(F.sum("rows").alias("rows"), F.count("*").alias("files"))


@q("scanned_columns", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_linenumber IN (1, 2) AND l_returnflag = 'A'")
def _(spark, d):
    return formats.scan(spark, f"{d}/lineitem.parquet", columns=["l_orderkey", "l_quantity"], filters={"l_linenumber": [1, 2], "l_returnflag": "A"})


@q("scan_description", "SELECT count(*) AS rows, count(DISTINCT l_partkey) AS nodes, count(DISTINCT l_orderkey) AS edges, min(l_quantity) AS least, max(l_quantity) AS most, round(avg(l_quantity), 6) AS mean FROM lineitem")
def _(spark, d):
    x = F.col("l_quantity")
    return formats.scan(spark, f"{d}/lineitem.parquet").agg(F.count("*").alias("rows"), F.countDistinct("l_partkey").alias("nodes"), F.countDistinct("l_orderkey").alias("edges"), F.min(x).alias("least"), F.max(x).alias("most"), F.avg(x).alias("mean"))


@q("scan_slice", "SELECT p_partkey, upper(p_brand) AS brand FROM part ORDER BY p_partkey LIMIT 10 OFFSET 5")
def _(spark, d):
    steps = [lambda t: t.select("p_partkey", "p_brand"), lambda t: t.withColumn("brand", F.upper("p_brand")).drop("p_brand"), lambda t: t.orderBy("p_partkey").offset(5).limit(10)]
    return formats.run_etl(formats.scan(spark, f"{d}/part.parquet"), steps)


@q("etl_with_sink", "SELECT CAST(l_orderkey AS VARCHAR) AS edge_id, CAST(l_partkey AS VARCHAR) AS node_id, CAST(sum(l_quantity) AS DOUBLE) AS weight FROM lineitem WHERE l_quantity > 10 GROUP BY 1, 2")
def _(spark, d):
    path = folder(spark, "etl")
    steps = [lambda t: t.where("l_quantity > 10"), lambda t: incidence_from(t, "l_orderkey", "l_partkey", "l_quantity")]
    formats.run_etl(formats.scan(spark, f"{d}/lineitem.parquet"), steps, lambda t: t.write.parquet(path))
    return spark.read.parquet(path)


@q("from_dictionary", "SELECT * FROM (VALUES ('a', '1', 1.0::DOUBLE), ('a', '2', 1.0), ('b', '2', 1.0)) AS v(edge_id, node_id, weight)")
def _(spark, d):
    return Hypergraph.from_dict(spark, {"a": [1, 2], "b": [2]}).incidence


@q("from_pairs", "SELECT * FROM (VALUES ('a', '1', 0.5::DOUBLE), ('a', '2', 2.0)) AS v(edge_id, node_id, weight)")
def _(spark, d):
    return Hypergraph.from_pairs(spark, [("a", 1), ("a", 2)], [0.5, 2]).incidence


@q("filtered_nodes_and_edges", "SELECT edge_id, node_id, weight FROM inc WHERE CAST(node_id AS BIGINT) % 3 = 0 AND CAST(edge_id AS BIGINT) % 2 = 0")
def _(spark, d):
    h = Hypergraph(orders_over_parts(spark, d))
    return h.filter_nodes(F.col("node_id").cast("long") % 3 == 0).filter_edges(F.col("edge_id").cast("long") % 2 == 0).incidence


def _document(spark, rows: DataFrame) -> str:
    path = folder(spark, "document")
    formats.write_document(rows, path)
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=False).collect())


_FIRST = "SELECT edge_id, node_id, weight FROM inc WHERE CAST(edge_id AS BIGINT) < 40"


def first(spark: SparkSession, d: str) -> DataFrame:
    return orders_over_parts(spark, d, "l_orderkey < 40")


@q("graphml", _FIRST)
def _(spark, d):
    return formats.from_graphml(spark, _document(spark, formats.graphml_rows(first(spark, d)))).select("edge_id", "node_id", "weight")


@q("gexf", _FIRST)
def _(spark, d):
    return formats.from_gexf(spark, _document(spark, formats.gexf_rows(first(spark, d)))).select("edge_id", "node_id", "weight")


@q("gml", """SELECT CAST(3 AS BIGINT) AS part, '  edge [ source "e:' || edge_id || '" target "n:' || node_id || '" weight ' || CAST(CAST(weight AS DOUBLE) AS VARCHAR) || ' ]' AS value FROM inc
UNION ALL SELECT 1, '  node [ label "n:' || node_id || '" ]' FROM deg UNION ALL SELECT 2, '  node [ label "e:' || edge_id || '" ]' FROM siz UNION ALL SELECT 0, 'graph [' UNION ALL SELECT 4, ']'""")
def _(spark, d):
    return formats.gml_rows(orders_over_parts(spark, d))


@q("node_link", "SELECT edge_id, node_id, weight FROM inc")
def _(spark, d):
    return formats.from_node_link(formats.node_link_rows(orders_over_parts(spark, d)))


@q("pair_list", "SELECT edge_id, node_id, weight FROM inc")
def _(spark, d):
    return formats.from_pair_list(formats.pair_list_rows(orders_over_parts(spark, d)))


@q("member_list", "SELECT edge_id, node_id, 1.0::DOUBLE AS weight FROM inc")
def _(spark, d):
    return formats.from_edge_list(formats.edge_list_rows(orders_over_parts(spark, d)))


@q("known_formats", "SELECT * FROM (VALUES ('a.parquet', 'parquet'), ('b.pq', 'parquet'), ('c.jsonl', 'json'), ('d.csv', 'csv')) AS v(path, format)")
def _(spark, d):
    return spark.createDataFrame([(p, formats.format_of(p)) for p in ("a.parquet", "b.pq", "c.jsonl", "d.csv")], "path string, format string")


@q("sqlite_file", "SELECT edge_id, node_id, weight, 'orders' AS graphs, true AS deleted FROM inc WHERE CAST(edge_id AS BIGINT) < 40")
def _(spark, d):
    import os
    import tempfile

    store = databases.SqliteStore(os.path.join(tempfile.mkdtemp(), "graphs.db"))  # the driver's own file, by definition
    store.save(Hypergraph(first(spark, d), name="orders"))
    store.save(Hypergraph(first(spark, d), name="again"))
    deleted = store.delete("again")
    names = databases.list_graphs(spark.createDataFrame([(n,) for n in store.list()], "graph string")).first()["graph"]
    return store.load(spark, "orders").incidence.select("*", F.lit(names).alias("graphs"), F.lit(deleted).alias("deleted"))


@q("parquet_stream", "SELECT edge_id, count(*) AS rows FROM inc GROUP BY 1")
def _(spark, d):
    source = f"{written(spark, d, rows_per_file=3000)}/incidence"
    target, marks = folder(spark, "streamed"), folder(spark, "marks")
    stream.to_table(formats.stream_parquet(spark, source, 4), target, marks).awaitTermination()
    return spark.read.parquet(target).groupBy("edge_id").agg(F.count("*").alias("rows"))


@q("arrow_batches", "SELECT count(*) AS rows, CAST(sum(p_size) AS BIGINT) AS total FROM part")
def _(spark, d):
    parts = [(b.num_rows, sum(b.column("p_size").to_pylist())) for b in formats.in_batches(spark.read.parquet(f"{d}/part.parquet").select("p_size"), 64)]
    return spark.createDataFrame(parts, "n long, s long").agg(F.sum("n").alias("rows"), F.sum("s").alias("total"))


# events


def table_events(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    k = F.col("event_id")
    kind = F.when(k % 5 == 0, "remove_edge").when(k % 5 == 1, "modify_edge").otherwise("add_edge")
    nodes = F.when(k % 2 == 0, F.array("event_type")).otherwise(F.array(F.col("event_type"), F.concat(F.lit("k"), (k % 7).cast("string"))))
    return stream.to_events(e, "event_id", kind, "ts", "user_id", nodes, F.col("value"))


def event_files(spark: SparkSession, d: str, files: int = 3) -> str:
    """The events as JSON files, in order of their ids."""
    path = folder(spark, "events")
    e = table_events(spark, d)
    rows = e.withColumn("_f", F.pmod(F.col("event_id").cast("long"), F.lit(files)))
    texts = stream.to_json(rows.drop("_f").withColumn("ts", F.col("ts")))
    texts.repartition(files).write.text(path)
    return path


def events_by_file(spark: SparkSession, d: str) -> DataFrame:
    return stream.read_files(spark, event_files(spark, d), 1)


@q("event_parse", "SELECT event_type, count(*) AS events, round(sum(weight), 2) AS weight FROM ev GROUP BY 1")
def _(spark, d):
    parsed = stream.parse(stream.to_json(table_events(spark, d)))
    return parsed.groupBy("event_type").agg(F.count("*").alias("events"), F.round(F.sum("weight"), 2).alias("weight"))


@q("event_dead_letters", """SELECT 'no event_id' AS error, count(*) AS texts FROM ev WHERE CAST(event_id AS BIGINT) % 97 = 0 UNION ALL SELECT 'no timestamp', count(*) FROM ev WHERE CAST(event_id AS BIGINT) % 97 = 1""")
def _(spark, d):
    k = F.col("event_id").cast("long") % 97
    broken = table_events(spark, d).withColumns({"ts": F.when(k != 1, F.col("ts")), "event_id": F.when(k != 0, F.col("event_id"))})
    return stream.dead_letters(stream.to_json(broken)).groupBy("error").agg(F.count("*").alias("texts"))


@q("event_edge_view", "SELECT edge_id, node_id, weight FROM edge_rows")
def _(spark, d):
    return stream.edge_view(table_events(spark, d))


@q("event_analytics", "SELECT count(DISTINCT edge_id) AS edges, count(DISTINCT node_id) AS nodes, count(*) AS incidences, round(count(*) / count(DISTINCT edge_id), 6) AS avg_size, (SELECT max(c) FROM (SELECT count(*) AS c FROM edge_rows GROUP BY node_id)) AS max_degree FROM edge_rows")
def _(spark, d):
    return stream.analytics(stream.edge_view(table_events(spark, d)))


@q("event_subscription", "SELECT event_id, event_type FROM ev WHERE list_contains(nodes, 'k3') AND event_type = 'add_edge'")
def _(spark, d):
    return stream.subscribe(table_events(spark, d), node="k3", types=["add_edge"]).select("event_id", "event_type")


@q("event_history", "SELECT event_id, event_type FROM ev WHERE edge_id = '7'")
def _(spark, d):
    return stream.replay(stream.subscribe(table_events(spark, d), edge="7"), "g").select("event_id", "event_type")


@q("event_replay", "SELECT event_id, edge_id FROM ev WHERE event_type IN ('add_edge', 'modify_edge') AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-09 12:00:00'")
def _(spark, d):
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    e = table_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return stream.replay(e, "g", at("2024-01-05 00:00:00"), at("2024-01-09 12:00:00"), ["add_edge", "modify_edge"]).select("event_id", "edge_id")


@q("event_retention", "SELECT count(*) AS events FROM ev WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 DAY")
def _(spark, d):
    e = table_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return stream.retain(e, 10, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).agg(F.count("*").alias("events"))


@q("event_snapshots", "SELECT edge_id AS graph_id, max(CAST(event_id AS BIGINT)) AS version FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY ts DESC, CAST(event_id AS BIGINT) DESC) AS r FROM ev) WHERE r = 1 GROUP BY 1")
def _(spark, d):
    s = table_events(spark, d).select(F.col("edge_id").alias("graph_id"), F.col("event_id").cast("long").alias("version"), "ts", F.to_json("nodes").alias("state"))
    return stream.latest_snapshot(s).select("graph_id", "version")


_DAYS = """, sn AS (SELECT CAST(ts AS DATE) AS ts, CAST(user_id AS VARCHAR) AS edge_id, list_sort(list_distinct(list(event_type))) AS nodes FROM events GROUP BY 1, 2), od AS (SELECT ts, row_number() OVER (ORDER BY ts) AS i FROM (SELECT DISTINCT ts FROM sn)), x AS (SELECT sn.*, i FROM sn JOIN od USING (ts)),
ch AS (SELECT CAST(x.ts AS VARCHAR) AS day, CASE WHEN p.nodes IS NULL THEN 'add_edge' ELSE 'modify_edge' END AS event_type, x.edge_id FROM x LEFT JOIN x p ON p.edge_id = x.edge_id AND p.i = x.i - 1 WHERE p.nodes IS NULL OR p.nodes <> x.nodes
UNION ALL SELECT CAST(od.ts AS VARCHAR), 'remove_edge', p.edge_id FROM x p JOIN od ON od.i = p.i + 1 LEFT JOIN x n ON n.edge_id = p.edge_id AND n.i = p.i + 1 WHERE n.i IS NULL)"""


@q("events_of_snapshots", _DAYS + " SELECT day, event_type, count(*) AS events FROM ch GROUP BY 1, 2")
def _(spark, d):
    t = spark.read.parquet(f"{d}/events.parquet").select(F.to_date("ts").alias("ts"), F.col("user_id").cast("string").alias("edge_id"), F.col("event_type").alias("node_id"), F.lit(1.0).alias("weight"))
    return stream.events_of_snapshots(t).groupBy(F.col("ts").cast("string").alias("day"), "event_type").agg(F.count("*").alias("events"))


@q("inverted_delta", "SELECT 'remove' AS op, edge_id, node_id, weight FROM (SELECT * FROM late EXCEPT ALL SELECT * FROM early) UNION ALL SELECT 'add', edge_id, node_id, weight FROM (SELECT * FROM early EXCEPT ALL SELECT * FROM late)")
def _(spark, d):
    return temporal.invert_delta(temporal.delta(*early_and_late(spark, d)))


# streams that run


@q("stream_ingest", "SELECT event_type, count(*) AS events FROM ev GROUP BY 1")
def _(spark, d):
    target, marks = folder(spark, "ingested"), folder(spark, "marks")
    stream.to_table(events_by_file(spark, d), target, marks).awaitTermination()
    return spark.read.parquet(target).groupBy("event_type").agg(F.count("*").alias("events"))


@q("stream_progress", "SELECT count(*) AS rows, true AS several_batches FROM ev")
def _(spark, d):
    running = stream.to_table(events_by_file(spark, d), folder(spark, "ingested"), folder(spark, "marks"))
    running.awaitTermination()
    p = stream.progress(running)
    return spark.createDataFrame([(p["rows"], p["batches"] >= 2)], "rows long, several_batches boolean")


@q("stream_dead_batches", "SELECT count(*) AS events FROM ev")
def _(spark, d):
    """Every batch of a handler that fails is kept as a dead letter."""
    target = folder(spark, "dead")

    def fails(batch, number):
        raise ValueError("no")

    stream.each_batch(events_by_file(spark, d), fails, folder(spark, "marks"), lambda batch, number, error: batch.withColumn("error", F.lit(error)).write.mode("overwrite").parquet(f"{target}/b{number}")).awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(target).where("error = 'no'").agg(F.count("*").alias("events"))


@q("stream_edge_states", "SELECT edge_id, event_type <> 'remove_edge' AS live FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY ts DESC, event_id DESC) AS r FROM ev) WHERE r = 1")
def _(spark, d):
    target, marks = folder(spark, "states"), folder(spark, "marks")
    stream.to_table(stream.edge_state(stream.read_files(spark, event_files(spark, d, 1))), target, marks).awaitTermination()
    s = spark.read.parquet(target)
    return s.groupBy("edge_id").agg(F.max_by("live", "version").alias("live"))


def _latest(spark: SparkSession, path: str) -> DataFrame:
    n = 0
    while True:
        try:
            df = spark.read.parquet(f"{path}/v{n}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return df
        n += 1


@q("stream_degrees", "SELECT node_id, count(*) AS degree FROM edge_rows GROUP BY 1")
def _(spark, d):
    path = folder(spark, "view")
    stream.running_view(events_by_file(spark, d), path, folder(spark, "marks")).awaitTermination()
    return _latest(spark, f"{path}/degrees")


@q("stream_components", ", mem AS (SELECT DISTINCT edge_id, unnest(nodes) AS node_id FROM ev WHERE event_type <> 'remove_edge'), nb AS (SELECT DISTINCT a.node_id AS a, b.node_id AS b FROM mem a JOIN mem b USING (edge_id)), rc AS (SELECT a, b FROM nb UNION SELECT r.a, n.b FROM rc r JOIN nb n ON n.a = r.b) SELECT a AS node_id, min(b) AS component FROM rc GROUP BY 1")
def _(spark, d):
    path = folder(spark, "components")
    stream.running_components(events_by_file(spark, d), path, folder(spark, "marks")).awaitTermination()
    return _latest(spark, path)
