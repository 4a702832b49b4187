"""Reading and writing hypergraphs: parquet, csv, json, xml graph formats, collections, merges."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..hypergraph import Hypergraph, incidence_from
from ..operators.basic import edge_nodes

_BY_SUFFIX = {"parquet": "parquet", "pq": "parquet", "csv": "csv", "json": "json", "jsonl": "json", "orc": "orc", "avro": "avro"}


def format_of(path: str, fmt: str | None = None) -> str:
    suffix = path.rsplit(".", 1)[-1].lower()
    if fmt is None and suffix not in _BY_SUFFIX:
        raise ValueError(f"unknown format of {path}")
    return fmt or _BY_SUFFIX[suffix]


def scan(spark: SparkSession, path: str | list[str], fmt: str | None = None, columns: list[str] | None = None, filters: dict | None = None, limit: int | None = None, **options) -> DataFrame:
    """A lazy scan; a list filter is IN, a scalar one equality; columns and filters reach the file reader."""
    paths = [path] if isinstance(path, str) else list(path)
    kind = format_of(paths[0], fmt)
    if kind == "csv":
        options = {"header": "true", "inferSchema": "true", **options}
    df = spark.read.format(kind).options(**options).load(paths)
    for c, v in (filters or {}).items():
        df = df.where(F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    if columns:
        df = df.select(*columns)
    return df if limit is None else df.limit(limit)


def save(h: Hypergraph, path: str, fmt: str = "parquet", compression: str | None = None, rows_per_file: int | None = None, mode: str = "overwrite") -> None:
    """A directory with incidence, node_props, edge_props and metadata tables."""
    meta = h.incidence.sparkSession.createDataFrame([(h.name, json.dumps({"name": h.name, "columns": h.incidence.columns}))], "name string, metadata string")
    for name, df in (("incidence", h.incidence), ("node_props", h.node_props), ("edge_props", h.edge_props), ("metadata", meta)):
        if df is None:
            continue
        w = df.write.mode(mode).format(fmt)
        if compression:
            w = w.option("compression", compression)
        if rows_per_file:
            w = w.option("maxRecordsPerFile", rows_per_file)
        if fmt == "csv":
            w = w.option("header", "true")
        w.save(f"{path}/{name}")


def load(spark: SparkSession, path: str, fmt: str = "parquet", columns: list[str] | None = None) -> Hypergraph:
    def part(name):
        try:
            return scan(spark, f"{path}/{name}", fmt)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    inc = part("incidence")
    if inc is None:
        raise FileNotFoundError(path)
    inc = inc.withColumns({"edge_id": F.col("edge_id").cast("string"), "node_id": F.col("node_id").cast("string")})
    meta = part("metadata")
    name = meta.first()["name"] if meta is not None else "hypergraph"
    return Hypergraph(inc.select(*columns) if columns else inc, part("node_props"), part("edge_props"), name)


def save_collection(graphs: dict[str, Hypergraph], path: str, mode: str = "overwrite") -> None:
    """Many hypergraphs as one table partitioned by graph_id, in one job."""
    out = None
    for name, h in graphs.items():
        df = h.incidence.withColumn("graph_id", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    out.write.mode(mode).partitionBy("graph_id").parquet(path)


def load_collection(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if graph is None else df.where(F.col("graph_id") == graph)


def file_info(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, rows) of a parquet path."""
    df = spark.read.parquet(path)
    return df.groupBy(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))


def rewrite(spark: SparkSession, source: str, target: str, compression: str = "zstd", sort_by: list[str] | None = None, files: int | None = None) -> None:
    df = spark.read.parquet(source)
    if files:
        df = df.repartition(files, *(sort_by or []))
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    df.write.mode("overwrite").option("compression", compression).parquet(target)


def merge(parts: list[DataFrame], strategy: str = "union") -> DataFrame:
    """``union`` by name with nulls for missing columns, ``intersection`` on the common columns; distinct rows."""
    if strategy == "intersection":
        common = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
        parts = [p.select(*common) for p in parts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.distinct()


# documents and graph formats


def to_json_rows(inc: DataFrame) -> DataFrame:
    """(value): one JSON document per edge with its members."""
    e = inc.groupBy("edge_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "weight"))).alias("members"))
    return e.select(F.to_json(F.struct("edge_id", "members")).alias("value"))


def from_json_rows(rows: DataFrame) -> DataFrame:
    x = rows.select(F.from_json("value", "edge_id string, members array<struct<node_id: string, weight: double>>").alias("j"))
    return x.select("j.edge_id", F.explode("j.members").alias("m")).select("edge_id", "m.node_id", "m.weight")


def edge_list_rows(inc: DataFrame, separator: str = ",") -> DataFrame:
    """(edge_id, nodes): the member list as one string."""
    return edge_nodes(inc).select("edge_id", F.array_join("nodes", separator).alias("nodes"))


def from_edge_list(rows: DataFrame, separator: str = ",") -> DataFrame:
    return rows.select(F.col("edge_id").cast("string").alias("edge_id"), F.explode(F.split("nodes", separator)).alias("node_id"), F.lit(1.0).alias("weight"))


def _xml(x):
    out = x
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def graphml_rows(inc: DataFrame) -> DataFrame:
    """(part, value): the lines of a bipartite GraphML document in order of (part, value)."""
    spark = inc.sparkSession
    head = spark.createDataFrame([(0, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="kind" for="node" attr.name="kind" attr.type="string"/><key id="weight" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="undirected">'), (4, "</graph></graphml>")], "part int, value string")
    node = lambda c, kind, part: inc.select(F.lit(part).alias("part"), F.concat(F.lit('<node id="'), F.lit(kind[0] + ":"), _xml(F.col(c)), F.lit(f'"><data key="kind">{kind}</data></node>')).alias("value")).distinct()
    link = inc.select(F.lit(3).alias("part"), F.concat(F.lit('<edge source="e:'), _xml(F.col("edge_id")), F.lit('" target="n:'), _xml(F.col("node_id")), F.lit('"><data key="weight">'), F.col("weight").cast("string"), F.lit("</data></edge>")).alias("value"))
    return head.unionByName(node("node_id", "node", 1)).unionByName(node("edge_id", "edge", 2)).unionByName(link)


def gml_rows(inc: DataFrame) -> DataFrame:
    """(part, value): the lines of a bipartite GML document."""
    spark = inc.sparkSession
    quote = lambda c: F.replace(F.col(c), F.lit('"'), F.lit("&quot;"))
    head = spark.createDataFrame([(0, "graph ["), (4, "]")], "part int, value string")
    node = lambda c, kind, part: inc.select(F.lit(part).alias("part"), F.concat(F.lit('  node [ label "'), F.lit(kind + ":"), quote(c), F.lit('" ]')).alias("value")).distinct()
    link = inc.select(F.lit(3).alias("part"), F.concat(F.lit('  edge [ source "e:'), quote("edge_id"), F.lit('" target "n:'), quote("node_id"), F.lit('" weight '), F.col("weight").cast("string"), F.lit(" ]")).alias("value"))
    return head.unionByName(node("node_id", "n", 1)).unionByName(node("edge_id", "e", 2)).unionByName(link)


def gexf_rows(inc: DataFrame) -> DataFrame:
    """(part, value): the lines of a bipartite GEXF document."""
    spark = inc.sparkSession
    head = spark.createDataFrame([(0, '<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="undirected"><nodes>'), (3, "</nodes><edges>"), (5, "</edges></graph></gexf>")], "part int, value string")
    node = lambda c, kind, part: inc.select(F.lit(part).alias("part"), F.concat(F.lit(f'<node id="{kind}:'), _xml(F.col(c)), F.lit('" label="'), _xml(F.col(c)), F.lit('"/>')).alias("value")).distinct()
    link = inc.select(F.lit(4).alias("part"), F.concat(F.lit('<edge source="e:'), _xml(F.col("edge_id")), F.lit('" target="n:'), _xml(F.col("node_id")), F.lit('" weight="'), F.col("weight").cast("string"), F.lit('"/>')).alias("value"))
    return head.unionByName(node("node_id", "n", 1)).unionByName(node("edge_id", "e", 2)).unionByName(link)


def write_document(rows: DataFrame, path: str) -> None:
    """Lines in the order of (part, value), sorted over many files whose names keep the order."""
    rows.orderBy("part", "value").select("value").write.mode("overwrite").text(path)


def from_graphml(spark: SparkSession, text: str) -> DataFrame:
    """Incidences of a bipartite GraphML document."""
    import xml.etree.ElementTree as ET

    root = ET.fromstring(text)
    strip = lambda s: s.split(":", 1)[1] if s[:2] in ("e:", "n:") else s
    rows = []
    for e in root.iter():
        if e.tag.rsplit("}", 1)[-1] == "edge":
            data = [d.text for d in e if d.attrib.get("key") == "weight"]
            rows.append((strip(e.attrib["source"]), strip(e.attrib["target"]), float(data[0]) if data else float(e.attrib.get("weight", 1.0))))
    return spark.createDataFrame(rows, "edge_id string, node_id string, weight double")


def from_gexf(spark: SparkSession, text: str) -> DataFrame:
    return from_graphml(spark, text)


def node_link_rows(inc: DataFrame) -> DataFrame:
    """(value): one JSON text for each node and each link of the bipartite graph, in the fields of the node-link form of graph libraries."""
    node = lambda c, side: inc.select(F.col(c).alias("id"), F.lit(side).alias("bipartite")).distinct().select(F.to_json(F.struct("id", "bipartite")).alias("value"))
    link = inc.select(F.to_json(F.struct(F.col("edge_id").alias("source"), F.col("node_id").alias("target"), "weight")).alias("value"))
    return node("edge_id", 1).unionByName(node("node_id", 0)).unionByName(link)


def from_node_link(rows: DataFrame) -> DataFrame:
    """Incidences of the links among node-link texts (value)."""
    x = rows.select(F.from_json("value", "source string, target string, weight double").alias("j")).where("j.source IS NOT NULL")
    return x.select(F.col("j.source").alias("edge_id"), F.col("j.target").alias("node_id"), F.coalesce("j.weight", F.lit(1.0)).alias("weight"))


def pair_list_rows(inc: DataFrame) -> DataFrame:
    """(value): ``edge node weight`` lines, the plain edge list that graph libraries read; blanks in names become underscores."""
    name = lambda c: F.regexp_replace(c, r"\s", "_")
    return inc.select(F.concat_ws(" ", name("edge_id"), name("node_id"), F.col("weight").cast("string")).alias("value"))


def from_pair_list(rows: DataFrame) -> DataFrame:
    parts = F.split("value", " ")
    return rows.select(F.get(parts, F.lit(0)).alias("edge_id"), F.get(parts, F.lit(1)).alias("node_id"), F.coalesce(F.get(parts, F.lit(2)).try_cast("double"), F.lit(1.0)).alias("weight"))


def stream_parquet(spark: SparkSession, path: str, files_per_trigger: int | None = None, most_triggers: int = 64) -> DataFrame:
    """A parquet folder as a stream, some files at a time.

    ``files_per_trigger`` files, or more where the files that are there would take over ``most_triggers``
    triggers: each costs about the same, however few rows it brings.
    """
    there = spark.read.parquet(path)
    r = spark.readStream.schema(there.schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", max(files_per_trigger, -(-len(there.inputFiles()) // most_triggers)))
    return r.parquet(path)


def in_batches(df: DataFrame, rows: int = 10_000):
    """The rows of a table as Arrow batches, one partition on the driver at a time."""
    import pyarrow as pa

    held, size = [], 0
    for r in df.toLocalIterator(prefetchPartitions=True):
        held.append(r.asDict(recursive=True))
        size += 1
        if size == rows:
            yield pa.RecordBatch.from_pylist(held)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held)


# construction from tables


def convert(df: DataFrame, strategy: str, **columns) -> DataFrame:
    """transaction, bipartite, multilayer, cooccurrence or hierarchical tables to incidences."""
    if strategy in ("transaction", "bipartite"):
        edge, node, weight = (columns.get("transaction", "transaction_id"), columns.get("item", "item_id"), columns.get("weight")) if strategy == "transaction" else (columns.get("target", "target"), columns.get("source", "source"), columns.get("weight"))
        inc = incidence_from(df, edge, node, weight, policy=None)
        means = inc.groupBy("edge_id").agg(F.avg("weight").alias("weight"))
        return inc.drop("weight").join(means, "edge_id").select("edge_id", "node_id", "weight")
    if strategy == "multilayer":
        layer, group = columns.get("layer", "layer"), columns.get("group")
        name = F.concat(F.lit("group_"), F.col(group).cast("string")) if group else F.concat(F.lit("layer_"), F.col(layer).cast("string"))
        return df.select(name.alias("edge_id"), F.col(columns.get("node", "node")).cast("string").alias("node_id"), F.lit(1.0).alias("weight"))
    if strategy == "cooccurrence":
        cells = F.filter(F.array(*[F.col(c).cast("string") for c in columns["entities"]]), lambda x: x.isNotNull() & (F.trim(x) != ""))
        rows = df.select(F.col(columns["id"]).cast("string").alias("edge_id"), cells.alias("m")).where(F.size("m") >= columns.get("threshold", 2))
        return rows.select("edge_id", F.explode("m").alias("node_id"), F.lit(1.0).alias("weight"))
    if strategy == "hierarchical":
        p, c = F.col(columns.get("parent", "parent")).cast("string"), F.col(columns.get("child", "child")).cast("string")
        edge = F.concat(F.lit("hierarchy_"), p)
        return df.select(edge.alias("edge_id"), c.alias("node_id")).unionByName(df.select(edge.alias("edge_id"), p.alias("node_id"))).distinct().withColumn("weight", F.lit(1.0))
    raise ValueError(strategy)


def run_etl(source: DataFrame, steps: list, sink=None) -> DataFrame:
    """Extract, a chain of table functions, and an optional sink (a function of the result)."""
    out = source
    for step in steps:
        out = out.transform(step)
    if sink is not None:
        sink(out)
    return out
