"""Hypergraphs and graphs derived from a hypergraph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .basic import co_edges, co_nodes, edge_nodes, edge_sizes, node_degrees


def dual(inc: DataFrame) -> DataFrame:
    """Edges become nodes and nodes edges; weights are 1."""
    return inc.select(F.col("node_id").alias("edge_id"), F.col("edge_id").alias("node_id")).distinct().withColumn("weight", F.lit(1.0))


def line_graph(inc: DataFrame, s: int = 1) -> DataFrame:
    """(e, f, shared): edge pairs that share at least ``s`` nodes."""
    return co_edges(inc).where(F.col("shared") >= s)


def adjacency(inc: DataFrame, threshold: int = 1) -> DataFrame:
    """(a, b, shared): node pairs in at least ``threshold`` common edges."""
    return co_nodes(inc).groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= threshold)


def connectivity(inc: DataFrame) -> DataFrame:
    """(a, b, edge_id): ordered pairs of different nodes of each edge."""
    p = co_nodes(inc).select("a", "b", "edge_id")
    return p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "edge_id"))


def k_uniform(inc: DataFrame, k: int) -> DataFrame:
    """Edges of k nodes stay; larger ones become all their k-subsets, ``{edge}_sub_{i}``; smaller ones go.

    The subsets are an ordered k-fold self-join, and i their rank in an edge.
    """
    rows = inc.select("edge_id", "node_id").distinct()
    sizes = edge_sizes(inc).where(F.col("size") >= k)
    rows = rows.join(sizes, "edge_id")
    subsets = rows.select("edge_id", "size", F.col("node_id").alias("n0"))
    for i in range(1, k):
        subsets = subsets.join(rows.select("edge_id", F.col("node_id").alias(f"n{i}")), "edge_id").where(F.col(f"n{i}") > F.col(f"n{i - 1}"))
    names = [f"n{i}" for i in range(k)]
    rank = F.row_number().over(Window.partitionBy("edge_id").orderBy(*names)) - 1
    named = subsets.withColumn("new", F.when(F.col("size") == k, F.col("edge_id")).otherwise(F.concat_ws("_sub_", "edge_id", rank.cast("string"))))
    return named.select(F.col("new").alias("edge_id"), F.explode(F.array(*names)).alias("node_id"), F.lit(1.0).alias("weight"))


def bipartite_projection(inc: DataFrame) -> DataFrame:
    """(side, a, b, shared): node pairs within the lower and the upper half of the degrees (median split, ties by id)."""
    split = Window.orderBy("degree", "node_id")
    sides = node_degrees(inc).withColumn("side", F.when(F.percent_rank().over(split) < 0.5, "low").otherwise("high")).select("node_id", "side")
    rows = inc.join(sides, "node_id")
    return co_nodes(rows, ("side",)).groupBy("side", "a", "b").agg(F.count("*").alias("shared"))


def complement(inc: DataFrame, most_nodes: int = 10) -> DataFrame:
    """(nodes): every non-empty set of nodes that is no edge; for at most ``most_nodes`` nodes."""
    nodes = sorted(r["node_id"] for r in inc.select("node_id").distinct().limit(most_nodes + 1).collect())
    if len(nodes) > most_nodes:
        raise ValueError(f"complement is for at most {most_nodes} nodes")
    names = F.array(*[F.lit(n) for n in nodes]) if nodes else F.array().cast("array<string>")
    masks = inc.sparkSession.range(1, 1 << len(nodes)) if nodes else inc.sparkSession.range(0)
    sets = masks.select(F.filter(names, lambda x, i: F.call_function("shiftright", F.col("id"), i).bitwiseAND(F.lit(1)) == 1).alias("nodes"))
    return sets.join(edge_nodes(inc).select("nodes").distinct(), "nodes", "left_anti")


def tensor_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges ``T_{e}_{f}`` over node pairs ``(m,n)``: a product by definition."""
    x = a.select(F.col("edge_id").alias("e"), F.col("node_id").alias("m")).distinct()
    y = b.select(F.col("edge_id").alias("f"), F.col("node_id").alias("n")).distinct()
    return x.crossJoin(y).select(F.concat_ws("_", F.lit("T"), "e", "f").alias("edge_id"), F.format_string("(%s,%s)", "m", "n").alias("node_id"), F.lit(1.0).alias("weight"))


def contractible(inc: DataFrame) -> DataFrame:
    """(edge_id, size, singleton, pendant, contractible): pendant edges have two nodes, one of degree 1; contractible ones only nodes of degree over 1."""
    rows = inc.select("edge_id", "node_id").distinct().join(node_degrees(inc), "node_id")
    e = rows.groupBy("edge_id").agg(F.count("*").alias("size"), F.min("degree").alias("least"))
    return e.select("edge_id", "size", (F.col("size") == 1).alias("singleton"), ((F.col("size") == 2) & (F.col("least") == 1)).alias("pendant"), ((F.col("size") >= 2) & (F.col("least") > 1)).alias("contractible"))


def clique_graph(inc: DataFrame, min_size: int = 2, most_nodes: int = 2000) -> DataFrame:
    """(clique_id, node_id): maximal cliques of the adjacency graph, one component at a time (at most ``most_nodes`` nodes each)."""
    import pandas as pd

    from .paths import connected_components

    comp = connected_components(inc)
    pairs = adjacency(inc).join(comp.withColumnRenamed("node_id", "a"), "a")

    def cliques(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, set] = {}
        for a, b in zip(pdf["a"], pdf["b"], strict=True):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        if len(near) > most_nodes:
            raise ValueError("component too large for clique listing")
        found, stack = [], [(set(), set(near), set())]
        while stack:
            r, p, x = stack.pop()
            if not p and not x:
                if len(r) >= min_size:
                    found.append(sorted(r))
                continue
            pivot = max(p | x, key=lambda v: len(near[v] & p))
            for v in sorted(p - near[pivot]):
                stack.append((r | {v}, p & near[v], x & near[v]))
                p = p - {v}
                x = x | {v}
        return pd.DataFrame([("|".join(c), n) for c in found for n in c], columns=["clique_id", "node_id"])

    return pairs.groupBy("component").applyInPandas(cliques, "clique_id string, node_id string")


def size_histogram(inc: DataFrame) -> DataFrame:
    return edge_sizes(inc).groupBy("size").agg(F.count("*").alias("edges"))


def homomorphism_possible(a: DataFrame, b: DataFrame, most_nodes: int = 6) -> bool:
    """Whether an injective map of a's nodes sends every edge to an edge: by size histograms, and by search up to ``most_nodes`` nodes."""
    from itertools import permutations

    theirs = size_histogram(b).withColumnRenamed("edges", "theirs")
    if not size_histogram(a).join(theirs, "size", "left").where("edges > coalesce(theirs, 0)").isEmpty():
        return False
    na = sorted(r[0] for r in a.select("node_id").distinct().limit(most_nodes + 1).collect())
    nb = sorted(r[0] for r in b.select("node_id").distinct().limit(most_nodes + 1).collect())
    if len(na) > most_nodes or len(nb) > most_nodes:
        return True
    ea = [set(r["nodes"]) for r in edge_nodes(a).select("nodes").distinct().collect()]  # 2**most_nodes sets at most
    eb = {frozenset(r["nodes"]) for r in edge_nodes(b).select("nodes").distinct().collect()}
    return any(all(frozenset(m[n] for n in e) in eb for e in ea) for p in permutations(nb, len(na)) for m in [dict(zip(na, p, strict=True))])

