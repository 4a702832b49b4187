"""The canonical table of a hypergraph and the class that holds it.

One row per incidence: ``edge_id STRING, node_id STRING, weight DOUBLE`` and any
further columns. Layers, modalities and snapshots are further key columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INCIDENCE = "edge_id string, node_id string, weight double"


def incidence_from(df: DataFrame, edge: str = "edge_id", node: str = "node_id", weight: str | None = None, keep: tuple[str, ...] = (), policy: str | None = "sum") -> DataFrame:
    """Rename and cast; a missing weight is 1.0.

    ``policy`` merges repeated (edge, node) rows by sum, max, min, mean or first (smallest); None keeps the multiset.
    """
    for c in (edge, node):
        if c not in df.columns:
            raise ValueError(f"column {c} is missing")
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    rows = df.select(F.col(edge).cast("string").alias("edge_id"), F.col(node).cast("string").alias("node_id"), w.alias("weight"), *keep)
    if policy is None:
        return rows
    merge = {"sum": F.sum, "max": F.max, "min": F.min, "mean": F.avg, "first": F.min}[policy]
    return rows.groupBy("edge_id", "node_id", *keep).agg(merge("weight").alias("weight")).select("edge_id", "node_id", "weight", *keep)


@dataclass(frozen=True)
class Hypergraph:
    """Incidences with optional long property tables (id, key, value)."""

    incidence: DataFrame
    node_props: DataFrame | None = None
    edge_props: DataFrame | None = None
    name: str = "hypergraph"

    @staticmethod
    def from_dataframe(df: DataFrame, edge: str = "edge_id", node: str = "node_id", weight: str | None = None, policy: str | None = "sum", name: str = "hypergraph") -> Hypergraph:
        return Hypergraph(incidence_from(df, edge, node, weight, policy=policy), name=name)

    @staticmethod
    def from_dict(spark: SparkSession, edges: dict, name: str = "hypergraph") -> Hypergraph:
        rows = [(str(e), [str(n) for n in nodes]) for e, nodes in edges.items()]
        df = spark.createDataFrame(rows, "edge_id string, nodes array<string>")
        return Hypergraph(df.select("edge_id", F.explode("nodes").alias("node_id"), F.lit(1.0).alias("weight")), name=name)

    @staticmethod
    def from_pairs(spark: SparkSession, pairs: list, weights: list | None = None, name: str = "hypergraph") -> Hypergraph:
        if weights is not None and len(weights) != len(pairs):
            raise ValueError("pairs and weights differ in length")
        rows = [(str(e), str(n), 1.0 if weights is None else float(weights[i])) for i, (e, n) in enumerate(pairs)]
        return Hypergraph(spark.createDataFrame(rows, INCIDENCE), name=name)

    def with_incidence(self, incidence: DataFrame) -> Hypergraph:
        return Hypergraph(incidence, self.node_props, self.edge_props, self.name)

    # operators on the incidence table, as methods

    def nodes(self) -> DataFrame:
        return self.incidence.select("node_id").distinct()

    def edges(self) -> DataFrame:
        return self.incidence.select("edge_id").distinct()

    def degrees(self) -> DataFrame:
        from .operators import basic

        return basic.node_degrees(self.incidence)

    def sizes(self) -> DataFrame:
        from .operators import basic

        return basic.edge_sizes(self.incidence)

    def statistics(self) -> DataFrame:
        from .operators import basic

        return basic.statistics(self.incidence)

    def filter_nodes(self, predicate: Column) -> Hypergraph:
        return self.with_incidence(self.incidence.where(predicate))

    def filter_edges(self, predicate: Column) -> Hypergraph:
        return self.with_incidence(self.incidence.where(predicate))

    def dual(self) -> Hypergraph:
        from .operators import transforms

        return Hypergraph(transforms.dual(self.incidence), self.edge_props, self.node_props, self.name)

    def __or__(self, other: Hypergraph) -> Hypergraph:
        from .operators import setops

        return self.with_incidence(setops.union(self.incidence, other.incidence))

    def __and__(self, other: Hypergraph) -> Hypergraph:
        from .operators import setops

        return self.with_incidence(setops.intersection(self.incidence, other.incidence))

    def __sub__(self, other: Hypergraph) -> Hypergraph:
        from .operators import setops

        return self.with_incidence(setops.difference(self.incidence, other.incidence))
