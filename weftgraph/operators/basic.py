"""Degrees, sizes, statistics, lookups, filters and edits of an incidence table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ratio


def node_degrees(inc: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, node_id, degree): distinct edges of each node."""
    return inc.groupBy(*keys, "node_id").agg(F.countDistinct("edge_id").alias("degree"))


def edge_sizes(inc: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, edge_id, size): distinct nodes of each edge."""
    return inc.groupBy(*keys, "edge_id").agg(F.countDistinct("node_id").alias("size"))


def statistics(inc: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts, incidences per edge and node, and the weight's mean, sample deviation, extremes and median."""
    a = inc.groupBy(*keys).agg(
        F.countDistinct("node_id").alias("num_nodes"), F.countDistinct("edge_id").alias("num_edges"), F.count("*").alias("num_incidences"),
        F.avg("weight").alias("weight_mean"), F.stddev_samp("weight").alias("weight_std"), F.min("weight").alias("weight_min"),
        F.max("weight").alias("weight_max"), F.median("weight").alias("weight_median"),
    )
    return a.withColumns({"avg_edge_size": ratio(F.col("num_incidences"), F.col("num_edges")), "avg_node_degree": ratio(F.col("num_incidences"), F.col("num_nodes"))})


def fast_statistics(inc: DataFrame) -> DataFrame:
    """Row-count degrees and sizes: mean, maximum, and density 2 * incidences / (nodes * edges)."""
    d = inc.groupBy("node_id").count().agg(F.count("*").alias("num_nodes"), F.avg("count").alias("avg_degree"), F.max("count").alias("max_degree"))
    s = inc.groupBy("edge_id").count().agg(F.count("*").alias("num_edges"), F.avg("count").alias("avg_size"), F.max("count").alias("max_size"), F.sum("count").alias("num_incidences"))
    return d.join(s).withColumn("density", ratio(2 * F.col("num_incidences"), F.col("num_nodes") * F.col("num_edges")))


def edge_nodes(inc: DataFrame, edges: list | None = None) -> DataFrame:
    """(edge_id, nodes): the sorted distinct nodes of each edge, of the given ones if any."""
    rows = inc if edges is None else inc.where(F.col("edge_id").isin([str(e) for e in edges]))
    return rows.groupBy("edge_id").agg(F.array_sort(F.collect_set("node_id")).alias("nodes"))


def node_edges(inc: DataFrame, nodes: list | None = None) -> DataFrame:
    """(node_id, edges): the sorted distinct edges of each node, of the given ones if any."""
    rows = inc if nodes is None else inc.where(F.col("node_id").isin([str(n) for n in nodes]))
    return rows.groupBy("node_id").agg(F.array_sort(F.collect_set("edge_id")).alias("edges"))


def weight_of(inc: DataFrame, edge: str, node: str) -> DataFrame:
    return inc.where((F.col("edge_id") == edge) & (F.col("node_id") == node)).select("weight").limit(1)


def neighbors(inc: DataFrame, node: str) -> DataFrame:
    """The nodes that share an edge with ``node``."""
    own = inc.where(F.col("node_id") == node).select("edge_id").distinct()
    return inc.join(own, "edge_id", "left_semi").where(F.col("node_id") != node).select("node_id").distinct()


def neighbor_counts(inc: DataFrame) -> DataFrame:
    """(node_id, neighbors): how many other nodes share an edge with each node."""
    pairs = co_nodes(inc).select("a", "b").distinct()
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.groupBy("a").agg(F.count("*").alias("neighbors")).withColumnRenamed("a", "node_id")
    return inc.select("node_id").distinct().join(counted, "node_id", "left").fillna(0, ["neighbors"])


def co_nodes(inc: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, edge_id, a, b, wa, wb): node pairs a < b of each edge; grows with the squares of the edge sizes."""
    rows = inc.groupBy(*keys, "edge_id", "node_id").agg(F.sum("weight").alias("weight"))
    x = rows.select(*keys, "edge_id", F.col("node_id").alias("a"), F.col("weight").alias("wa"))
    y = rows.select(*keys, "edge_id", F.col("node_id").alias("b"), F.col("weight").alias("wb"))
    return x.join(y, [*keys, "edge_id"]).where("a < b")


def co_edges(inc: DataFrame) -> DataFrame:
    """(e, f, shared): edge pairs e < f with their number of shared nodes."""
    rows = inc.select("edge_id", "node_id").distinct()
    x, y = rows.select("node_id", F.col("edge_id").alias("e")), rows.select("node_id", F.col("edge_id").alias("f"))
    return x.join(y, "node_id").where("e < f").groupBy("e", "f").agg(F.count("*").alias("shared"))


def filter_by_weight(inc: DataFrame, least: float = 0.0, most: float | None = None) -> DataFrame:
    rows = inc.where(F.col("weight") >= least)
    return rows if most is None else rows.where(F.col("weight") <= most)


def _within(df: DataFrame, column: str, least: int, most: int | None) -> DataFrame:
    kept = df.where(F.col(column) >= least)
    return kept if most is None else kept.where(F.col(column) <= most)


def nodes_by_degree(inc: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    return _within(node_degrees(inc), "degree", least, most)


def filter_by_degree(inc: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    return inc.join(nodes_by_degree(inc, least, most).select("node_id"), "node_id", "left_semi")


def filter_by_size(inc: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    return inc.join(_within(edge_sizes(inc), "size", least, most).select("edge_id"), "edge_id", "left_semi")


def missing(inc: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The given ids that the hypergraph does not hold."""
    return ids.join(inc.select(column).distinct(), column, "left_anti")


def subgraph(inc: DataFrame, ids: DataFrame, column: str = "node_id", strict: bool = False) -> DataFrame:
    """Incidences whose ``column`` is in ``ids``; with ``strict`` an unknown id is an error."""
    if strict and not missing(inc, ids, column).isEmpty():
        raise ValueError(f"unknown {column}")
    return inc.join(ids.select(column).distinct(), column, "left_semi")


def add_edge(inc: DataFrame, edge: str, nodes: list, weight: float = 1.0) -> DataFrame:
    new = inc.sparkSession.createDataFrame([(str(edge), str(n), float(weight)) for n in nodes], "edge_id string, node_id string, weight double")
    return inc.unionByName(new, allowMissingColumns=True)


def remove_edge(inc: DataFrame, edge: str) -> DataFrame:
    return inc.where(F.col("edge_id") != edge)


def remove_node(inc: DataFrame, node: str, cascade: bool = True) -> DataFrame:
    """With ``cascade`` the node's edges go wholly, else only its incidences."""
    if not cascade:
        return inc.where(F.col("node_id") != node)
    return inc.join(inc.where(F.col("node_id") == node).select("edge_id").distinct(), "edge_id", "left_anti")


def properties_wide(props: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per id, one column per property key, from a long table (id, key, value)."""
    return props.groupBy("id").pivot("key", keys).agg(F.first("value", ignorenulls=True))


def with_property(props: DataFrame, key: str, value=None) -> DataFrame:
    """Ids that have the property, with the given value if there is one."""
    rows = props.where((F.col("key") == key) & F.col("value").isNotNull())
    return (rows if value is None else rows.where(F.col("value") == F.lit(value))).select("id").distinct()


def merge_properties(mine: DataFrame, other: DataFrame, overwrite: bool = True) -> DataFrame:
    """Both long tables; where both have a key, the other's value wins if ``overwrite``."""
    first, second = (other, mine) if overwrite else (mine, other)
    return first.unionByName(second.join(first, ["id", "key"], "left_anti"))


def properties_long(wide: DataFrame, id_column: str = "id") -> DataFrame:
    """(id, key, value): the long table of a wide one; nulls are left out."""
    keys = [c for c in wide.columns if c != id_column]
    cells = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])
    return wide.select(F.col(id_column).alias("id"), F.explode(cells).alias("x")).select("id", "x.key", "x.value").where("value IS NOT NULL")


def filter_by_property(inc: DataFrame, props: DataFrame, key: str, value=None, column: str = "node_id") -> DataFrame:
    """The incidences whose node (or edge) has the property, with the given value if there is one."""
    return inc.join(with_property(props, key, value).withColumnRenamed("id", column), column, "left_semi")


def property_statistics(props: DataFrame) -> DataFrame:
    """(key, entities, distinct_values, coverage): coverage is the share of all entities that have the property."""
    n = F.broadcast(props.agg(F.countDistinct("id").alias("n")))
    g = props.where("value IS NOT NULL").groupBy("key").agg(F.countDistinct("id").alias("entities"), F.countDistinct("value").alias("distinct_values")).join(n)
    return g.select("key", "entities", "distinct_values", ratio(F.col("entities"), F.col("n")).alias("coverage"))
