"""Centralities: (node_id, score) or (edge_id, score), for any number of graphs by key columns where cheap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, ratio
from .basic import co_nodes, edge_sizes, node_degrees
from .paths import bfs, neighbor_edges


def _scalar(df: DataFrame, **columns) -> DataFrame:
    return df.agg(*[c.alias(n) for n, c in columns.items()])


def degree_rows(inc: DataFrame, normalized: bool = True) -> DataFrame:
    """Row count of each node, divided by the number of edges if there are two or more."""
    d = inc.groupBy("node_id").agg(F.count("*").alias("n"))
    if not normalized:
        return d.select("node_id", F.col("n").cast("double").alias("score"))
    m = F.broadcast(_scalar(inc, m=F.countDistinct("edge_id")))
    return d.join(m).select("node_id", F.when(F.col("m") > 1, F.col("n") / F.col("m")).otherwise(F.col("n").cast("double")).alias("score"))


def edge_degree_rows(inc: DataFrame, normalized: bool = True) -> DataFrame:
    """Row count of each edge, divided by the number of nodes if there are two or more."""
    flipped = inc.select(F.col("node_id").alias("edge_id"), F.col("edge_id").alias("node_id"))
    return degree_rows(flipped, normalized).withColumnRenamed("node_id", "edge_id")


def degree(inc: DataFrame) -> DataFrame:
    """Distinct edges of each node divided by the number of other nodes."""
    n = F.broadcast(_scalar(inc, n=F.countDistinct("node_id")))
    return node_degrees(inc).join(n).select("node_id", ratio(F.col("degree"), F.col("n") - 1).alias("score"))


def s_centrality(inc: DataFrame, s: int = 1, normalized: bool = True) -> DataFrame:
    """Sum over a node's edges of (size - 1)**s; normalised by edges * (largest size - 1)**s."""
    sizes = inc.groupBy("edge_id").agg(F.count("*").alias("size"))
    raw = inc.join(sizes, "edge_id").groupBy("node_id").agg(F.sum(F.pow(F.col("size") - 1, s)).alias("score"))
    if not normalized:
        return raw
    top = F.broadcast(_scalar(sizes, top=F.count("*") * F.pow(F.max("size") - 1, s)))
    return raw.join(top).select("node_id", ratio(F.col("score"), F.col("top")).alias("score"))


def weighted_degree(inc: DataFrame, normalized: bool = False) -> DataFrame:
    """Sum of a node's weights, divided by the largest if normalised."""
    w = inc.groupBy("node_id").agg(F.sum("weight").alias("score"))
    if not normalized:
        return w
    return w.join(F.broadcast(_scalar(w, top=F.max("score")))).select("node_id", ratio(F.col("score"), F.col("top")).alias("score"))


def edge_weighted_degree(inc: DataFrame, function: str = "size", normalized: bool = True) -> DataFrame:
    """Sum over a node's edges of the edge's weight: uniform, size or inverse size; normalised by all edges' weights."""
    sizes = edge_sizes(inc)
    w = {"uniform": F.lit(1.0), "size": F.col("size").cast("double"), "inverse_size": 1.0 / F.col("size")}[function]
    edges = sizes.select("edge_id", w.alias("w"))
    raw = inc.select("edge_id", "node_id").distinct().join(edges, "edge_id").groupBy("node_id").agg(F.sum("w").alias("score"))
    if not normalized:
        return raw
    return raw.join(F.broadcast(_scalar(edges, total=F.sum("w")))).select("node_id", ratio(F.col("score"), F.col("total")).alias("score"))


def edge_importance(inc: DataFrame, kind: str = "size") -> DataFrame:
    """Row count or mean weight of each edge, divided by the largest."""
    e = inc.groupBy("edge_id").agg((F.count("*").cast("double") if kind == "size" else F.avg("weight")).alias("score"))
    return e.join(F.broadcast(_scalar(e, top=F.max("score")))).select("edge_id", ratio(F.col("score"), F.col("top")).alias("score"))


def importance(inc: DataFrame) -> DataFrame:
    """(node_id, weight_centrality, weight_diversity, harmonic): sum; sample deviation * count; count / sum(1/w). Raw values."""
    return inc.groupBy("node_id").agg(
        F.sum("weight").alias("weight_centrality"),
        (F.coalesce(F.stddev_samp("weight"), F.lit(0.0)) * F.count("*")).alias("weight_diversity"),
        ratio(F.count("*").cast("double"), F.sum(F.when(F.col("weight") != 0, 1 / F.col("weight")))).alias("harmonic"),
    )


# distances


def _distance_table(inc: DataFrame) -> DataFrame:
    return bfs(neighbor_edges(inc), inc.select(F.col("node_id").alias("source")).distinct())


def closeness(inc: DataFrame, variant: str = "standard") -> DataFrame:
    """(r-1)/sum(d) * (r-1)/(n-1), r the reachable nodes with the node itself; ``core`` leaves it out of r."""
    n = F.broadcast(_scalar(inc, n=F.countDistinct("node_id")))
    d = _distance_table(inc).groupBy("source").agg(F.count("*").alias("r"), F.sum("depth").alias("s")).join(n)
    r = F.col("r") - (1 if variant == "standard" else 2)
    return d.select(F.col("source").alias("node_id"), (ratio(r, F.col("s")) * ratio(r, F.col("n") - 1)).alias("score"))


def harmonic(inc: DataFrame, normalized: bool = True) -> DataFrame:
    """Sum of 1/d over the other reachable nodes, divided by n - 1."""
    n = F.broadcast(_scalar(inc, n=F.countDistinct("node_id")))
    d = _distance_table(inc).groupBy("source").agg(F.sum(F.when(F.col("depth") > 0, 1.0 / F.col("depth")).otherwise(0.0)).alias("h")).join(n)
    return d.select(F.col("source").alias("node_id"), (ratio(F.col("h"), F.col("n") - 1) if normalized else F.col("h")).alias("score"))


def betweenness(inc: DataFrame, normalized: bool = True, sources: DataFrame | None = None) -> DataFrame:
    """Shortest-path betweenness by level-synchronous passes for all sources at once.

    Dependencies are summed over sources in both directions and scaled by
    2 / ((n-1)(n-2)); a sample of sources is scaled up to all of them.
    """
    edges = cut(neighbor_edges(inc))
    nodes = cut(inc.select("node_id").distinct())
    n = nodes.count()
    starts = nodes.select(F.col("node_id").alias("source")) if sources is None else sources.select("source").distinct()
    share = n / max(1, starts.count())
    seen = cut(starts.select("source", F.col("source").alias("node"), F.lit(0).alias("depth"), F.lit(1.0).alias("sigma")))
    levels, depth = [seen], 0
    while True:
        depth += 1
        step = levels[-1].join(edges, levels[-1]["node"] == edges["a"]).groupBy("source", F.col("b").alias("node")).agg(F.sum("sigma").alias("sigma"))
        new = cut(step.join(seen.select("source", "node"), ["source", "node"], "left_anti").select("source", "node", F.lit(depth).alias("depth"), "sigma"))
        if new.isEmpty():
            break
        levels.append(new)
        seen = cut(seen.unionByName(new))
    delta = levels[-1].select("source", "node", "sigma", F.lit(0.0).alias("delta"))
    total = delta.where("source != node")
    for level in reversed(levels[:-1]):
        child = delta.select("source", F.col("node").alias("w"), F.col("sigma").alias("sw"), "delta")
        back = level.join(edges, level["node"] == edges["a"]).select("source", "node", "sigma", F.col("b").alias("w")).join(child, ["source", "w"])
        gain = back.groupBy("source", "node").agg(F.sum(F.col("sigma") / F.col("sw") * (1 + F.col("delta"))).alias("delta"))
        delta = cut(level.select("source", "node", "sigma").join(gain, ["source", "node"], "left").fillna(0.0, ["delta"]))
        total = total.unionByName(delta.where("source != node"))
    scale = 2.0 / ((n - 1) * (n - 2)) if normalized and n > 2 else 1.0
    # every unordered pair is counted from both ends
    sums = total.groupBy("node").agg(F.sum("delta").alias("s"))
    return nodes.join(sums, nodes["node_id"] == sums["node"], "left").select("node_id", (F.coalesce("s", F.lit(0.0)) * share * scale).alias("score"))


# power iterations


def _converge(state: DataFrame, step, most: int, tol: float, fixed: bool) -> DataFrame:
    for _ in range(most):
        new = cut(step(state))
        if not fixed:
            gap = new.join(state.withColumnRenamed("score", "old"), "node_id").agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0]
            if gap is None or gap < tol:
                return new
        state = new
    return state


def pagerank(inc: DataFrame, alpha: float = 0.85, most: int = 100, tol: float = 1e-6, variant: str = "neighbors", fixed: bool = False, personal: DataFrame | None = None) -> DataFrame:
    """(1-alpha)/n + alpha * sum(pr/degree).

    ``neighbors``: over the 0/1 adjacency; ``multigraph``: by co-occurrence counts, with personalisation
    (node_id, p); ``edge_degree``: each (neighbour, shared edge) passes pr / edges of the neighbour.
    Without ``fixed`` it stops when no score moves by ``tol``.
    """
    if variant == "neighbors":
        e = neighbor_edges(inc).withColumn("w", F.lit(1.0))
        out = e.groupBy("a").agg(F.sum("w").alias("t"))
    else:
        p = co_nodes(inc).groupBy("a", "b").agg(F.count("*").cast("double").alias("w"))
        e = p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
        out = e.groupBy("a").agg(F.sum("w").alias("t")) if variant == "multigraph" else node_degrees(inc).select(F.col("node_id").alias("a"), F.col("degree").cast("double").alias("t"))
    links = cut(e.join(out, "a").select("a", "b", (F.col("w") / F.col("t")).alias("p")))
    nodes = cut(inc.select("node_id").distinct())
    n = max(1, nodes.count())
    base = nodes.withColumn("base", F.lit(1.0 / n))
    if personal is not None:
        total = personal.agg(F.sum("p")).first()[0] or 1.0
        base = nodes.join(personal, "node_id", "left").select("node_id", (F.coalesce("p", F.lit(0.0)) / total).alias("base"))
    base = cut(base)

    def step(state: DataFrame) -> DataFrame:
        flow = state.join(links, state["node_id"] == links["a"]).groupBy(F.col("b").alias("node_id")).agg(F.sum(F.col("score") * F.col("p")).alias("f"))
        return base.join(flow, "node_id", "left").select("node_id", ((1 - alpha) * F.col("base") + alpha * F.coalesce("f", F.lit(0.0))).alias("score"))

    return _converge(nodes.withColumn("score", F.lit(1.0 / n)), step, most, tol, fixed)


def eigenvector(inc: DataFrame, most: int = 100, tol: float = 1e-6, multigraph: bool = False, fixed: bool = False) -> DataFrame:
    """Power iteration on the 0/1 adjacency (L1 norm), or on co-occurrence counts (L2, divided by the largest)."""
    if multigraph:
        p = co_nodes(inc).groupBy("a", "b").agg(F.count("*").cast("double").alias("w"))
        links = cut(p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    else:
        links = cut(neighbor_edges(inc).withColumn("w", F.lit(1.0)))
    nodes = cut(inc.select("node_id").distinct())

    def step(state: DataFrame) -> DataFrame:
        flow = state.join(links, state["node_id"] == links["a"]).groupBy(F.col("b").alias("node_id")).agg(F.sum(F.col("score") * F.col("w")).alias("f"))
        raw = nodes.join(flow, "node_id", "left").select("node_id", F.coalesce("f", F.lit(0.0)).alias("f"))
        norm = F.sqrt(F.sum(F.col("f") * F.col("f"))) if multigraph else F.sum("f")
        return raw.join(F.broadcast(raw.agg(norm.alias("z")))).select("node_id", ratio(F.col("f"), F.col("z")).alias("score"))

    out = _converge(nodes.withColumn("score", F.lit(1.0)), step, most, tol, fixed)
    if multigraph:
        out = out.join(F.broadcast(out.agg(F.max("score").alias("z")))).select("node_id", ratio(F.col("score"), F.col("z")).alias("score"))
    return out


def hits(inc: DataFrame, most: int = 100, tol: float = 1e-6, fixed: bool = False) -> DataFrame:
    """(node_id, authority, hub): authorities from hubs, hubs from the new authorities, each with L2 norm 1."""
    links = cut(neighbor_edges(inc))
    nodes = cut(inc.select("node_id").distinct())

    def pull(state: DataFrame, column: str, to: str) -> DataFrame:
        flow = state.join(links, state["node_id"] == links["a"]).groupBy(F.col("b").alias("node_id")).agg(F.sum(column).alias("f"))
        raw = nodes.join(flow, "node_id", "left").select("node_id", F.coalesce("f", F.lit(0.0)).alias("f"))
        z = raw.agg(F.sqrt(F.sum(F.col("f") * F.col("f"))).alias("z"))
        return raw.join(F.broadcast(z)).select("node_id", ratio(F.col("f"), F.col("z")).alias(to))

    state = nodes.select("node_id", F.lit(1.0).alias("authority"), F.lit(1.0).alias("hub"))
    for _ in range(most):
        authority = cut(pull(state, "hub", "authority"))
        new = cut(authority.join(pull(authority, "authority", "hub"), "node_id"))
        if not fixed:
            gap = new.join(state.select("node_id", F.col("authority").alias("o")), "node_id").agg(F.max(F.abs(F.col("authority") - F.col("o")))).first()[0]
            if gap is None or gap < tol:
                return new
        state = new
    return state


def katz(inc: DataFrame, alpha: float = 0.1, beta: float = 1.0, most: int = 100, tol: float = 1e-6, fixed: bool = False) -> DataFrame:
    """x = beta + alpha * A x over the 0/1 adjacency."""
    links = cut(neighbor_edges(inc))
    nodes = cut(inc.select("node_id").distinct())

    def step(state: DataFrame) -> DataFrame:
        flow = state.join(links, state["node_id"] == links["a"]).groupBy(F.col("b").alias("node_id")).agg(F.sum("score").alias("f"))
        return nodes.join(flow, "node_id", "left").select("node_id", (beta + alpha * F.coalesce("f", F.lit(0.0))).alias("score"))

    return _converge(nodes.withColumn("score", F.lit(0.0)), step, most, tol, fixed)


def ranking(scores: DataFrame, top: int | None = None) -> DataFrame:
    """(node_id, score, rank) in descending order, ties by id."""
    ranked = scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "node_id")))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def comparison(measures: dict[str, DataFrame]) -> DataFrame:
    """(node_id, one column a measure, mean_rank): the mean of the measures' ranks (ties share the least)."""
    out, names = None, list(measures)
    for name, scores in measures.items():
        c = scores.select("node_id", F.col("score").alias(name))
        out = c if out is None else out.join(c, "node_id", "full")
    ranks = [F.rank().over(Window.orderBy(F.desc_nulls_last(n))).alias(f"_{n}") for n in names]
    ranked = out.select("*", *ranks)
    return ranked.select("node_id", *names, (sum(F.col(f"_{n}") for n in names) / len(names)).alias("mean_rank"))


def load(inc: DataFrame, normalized: bool = True) -> DataFrame:
    """(node_id, score): load centrality: every node sends a unit to every other, split evenly among the neighbours one step nearer.

    State is one row for each (target, node); one join a level, from the farthest level back.
    """
    edges = cut(neighbor_edges(inc))
    far = cut(bfs(edges, inc.select(F.col("node_id").alias("source")).distinct()))
    near = far.select("source", F.col("node").alias("to"), F.col("depth").alias("d"))
    steps = far.where("depth > 0").join(edges, far["node"] == edges["a"]).select("source", "node", "depth", F.col("b").alias("to")).join(near, ["source", "to"]).where("d = depth - 1")
    steps = cut(steps.select("source", "node", "depth", "to").withColumn("share", 1 / F.count("*").over(Window.partitionBy("source", "node"))))
    most = far.agg(F.max("depth")).first()[0] or 0
    carried = far.select("source", "node", F.lit(1.0).alias("load"))
    for depth in range(most, 0, -1):
        sent = steps.where(F.col("depth") == depth).join(carried, ["source", "node"]).groupBy("source", F.col("to").alias("node")).agg(F.sum(F.col("load") * F.col("share")).alias("more"))
        carried = cut(carried.join(sent, ["source", "node"], "left").select("source", "node", (F.col("load") + F.coalesce("more", F.lit(0.0))).alias("load")))
    total = carried.where("source != node").groupBy(F.col("node").alias("node_id")).agg(F.sum(F.col("load") - 1).alias("score"))
    every = inc.select("node_id").distinct().join(total, "node_id", "left").select("node_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    if not normalized:
        return every
    n = F.broadcast(every.agg(F.count("*").alias("n")))
    return every.join(n).select("node_id", ratio(F.col("score"), (F.col("n") - 1) * (F.col("n") - 2)).alias("score"))


def incremental_degree(degrees: DataFrame, added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """(node_id, degree) after incidences come and go, from the degrees before and the changes alone."""
    change = added.groupBy("node_id").agg(F.countDistinct("edge_id").alias("by"))
    if removed is not None:
        change = change.unionByName(removed.groupBy("node_id").agg((-F.countDistinct("edge_id")).alias("by"))).groupBy("node_id").agg(F.sum("by").alias("by"))
    x = degrees.join(change, "node_id", "full").select("node_id", (F.coalesce("degree", F.lit(0)) + F.coalesce("by", F.lit(0))).alias("degree"))
    return x.where("degree > 0")
