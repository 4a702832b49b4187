"""Union, intersection and difference of hypergraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .basic import edge_nodes

_COLS = ("edge_id", "node_id", "weight")


def union(a: DataFrame, b: DataFrame, nodes: str = "union", edges: str = "union") -> DataFrame:
    """All incidences; an edge in both keeps both member sets, and a repeated incidence the left weight.

    ``edges``/``nodes`` of left or right keep only the ids that the one side has.
    """
    a, b = a.select(*_COLS), b.select(*_COLS)
    rows = a.withColumn("_o", F.lit(0)).unionByName(b.withColumn("_o", F.lit(1)))
    out = rows.groupBy("edge_id", "node_id").agg(F.min_by("weight", "_o").alias("weight"))
    for column, how in (("edge_id", edges), ("node_id", nodes)):
        if how in ("left", "right"):
            out = out.join((a if how == "left" else b).select(column).distinct(), column, "left_semi")
    return out.select(*_COLS)


def _same_structure(a: DataFrame, b: DataFrame) -> DataFrame:
    return edge_nodes(a).join(edge_nodes(b).withColumnRenamed("nodes", "other"), "edge_id").where("nodes = other").select("edge_id")


def intersection(a: DataFrame, b: DataFrame, mode: str = "edges") -> DataFrame:
    """``edges``: common edge ids with their common members; ``nodes``: a on the common nodes; ``structure``: edges equal in both."""
    a, b = a.select(*_COLS), b.select(*_COLS)
    if mode == "edges":
        return a.join(b.select("edge_id", "node_id").distinct(), ["edge_id", "node_id"], "left_semi").select(*_COLS)
    if mode == "nodes":
        return a.join(b.select("node_id").distinct(), "node_id", "left_semi").select(*_COLS)
    if mode == "structure":
        return a.join(_same_structure(a, b), "edge_id", "left_semi").select(*_COLS)
    raise ValueError(mode)


def difference(a: DataFrame, b: DataFrame, mode: str = "edges") -> DataFrame:
    """``edges``: edge ids that b lacks; ``nodes``: a on the nodes that b lacks; ``structure``: all but edges equal in both."""
    a, b = a.select(*_COLS), b.select(*_COLS)
    if mode == "edges":
        return a.join(b.select("edge_id").distinct(), "edge_id", "left_anti").select(*_COLS)
    if mode == "nodes":
        return a.join(b.select("node_id").distinct(), "node_id", "left_anti").select(*_COLS)
    if mode == "structure":
        return a.join(_same_structure(a, b), "edge_id", "left_anti").select(*_COLS)
    raise ValueError(mode)
