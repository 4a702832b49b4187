"""Traversal, distances, components, cores and other fixpoints.

Graph inputs are undirected edge tables (a, b) unless said otherwise; those of a
hypergraph come from ``neighbor_edges``. Each loop joins a frontier with the
edges, drops what it has seen, and checkpoints its state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, unit_hash
from .basic import co_nodes


def neighbor_edges(inc: DataFrame) -> DataFrame:
    """(a, b): both directions of every pair of nodes that share an edge."""
    p = co_nodes(inc).select("a", "b").distinct()
    return p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b")))


def both_directions(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()


def connected_components(inc: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node_id, component): the least node id that each node reaches over shared edges.

    Labels pass through the edges of the bipartite incidence table, so no pairs are made.
    """
    rows = cut(inc.select("edge_id", "node_id").distinct())
    state = cut(rows.select("node_id").distinct().withColumn("component", F.col("node_id")))
    for _ in range(most_rounds):
        by_edge = rows.join(state, "node_id").groupBy("edge_id").agg(F.min("component").alias("m"))
        new = rows.join(by_edge, "edge_id").groupBy("node_id").agg(F.min("m").alias("component"))
        # jump: a label's own label
        jump = new.select(F.col("node_id").alias("component"), F.col("component").alias("to"))
        new = cut(new.join(jump, "component").select("node_id", F.least("component", "to").alias("component")))
        changed = not new.join(state.withColumnRenamed("component", "old"), "node_id").where("component != old").isEmpty()
        state = new
        if not changed:
            return state
    raise RuntimeError("components did not settle")


def largest_component(inc: DataFrame) -> DataFrame:
    """The incidences of the component with most nodes (ties: least label)."""
    comp = connected_components(inc)
    top = comp.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return inc.join(comp.join(top, "component", "left_semi").select("node_id"), "node_id", "left_semi")


def bfs(edges: DataFrame, sources: DataFrame, most_depth: int | None = None) -> DataFrame:
    """(source, node, depth): all nodes that each source reaches, over a directed table (a, b).

    ``sources`` is (source). One job per level for all sources at once.
    """
    edges = cut(edges.select("a", "b").distinct())
    seen = cut(sources.select("source").distinct().select("source", F.col("source").alias("node"), F.lit(0).alias("depth")))
    frontier, depth = seen, 0
    while most_depth is None or depth < most_depth:
        depth += 1
        step = frontier.join(edges, frontier["node"] == edges["a"]).select("source", F.col("b").alias("node")).distinct()
        frontier = cut(step.join(seen, ["source", "node"], "left_anti").withColumn("depth", F.lit(depth)).select("source", "node", "depth"))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier))
    return seen


def all_shortest_paths(edges: DataFrame, source: str, target: str | None = None, most_depth: int = 20) -> DataFrame:
    """(node, depth, path): every shortest path from ``source``, to one target if given."""
    spark = edges.sparkSession
    edges = cut(edges.select("a", "b").distinct())
    state = spark.createDataFrame([(source, 0, [source])], "node string, depth int, path array<string>")
    seen, frontier = state, state
    for depth in range(1, most_depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["a"]).select(F.col("b").alias("node"), F.lit(depth).alias("depth"), F.array_append("path", F.col("b")).alias("path"))
        frontier = cut(step.join(seen.select("node").distinct(), "node", "left_anti"))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
        if target is not None and not frontier.where(F.col("node") == target).isEmpty():
            break
    return seen if target is None else seen.where(F.col("node") == target)


def shortest_path(edges: DataFrame, source: str, target: str, most_depth: int = 20) -> DataFrame:
    """(node, depth, path): one shortest path, the least by its ids; no row if there is none."""
    return all_shortest_paths(edges, source, target, most_depth).orderBy("path").limit(1)


def simple_paths(edges: DataFrame, start: str, end: str, most_hops: int = 3) -> DataFrame:
    """(path, hops): all simple paths of at most ``most_hops`` over (a, b), as a chain of joins with a cycle guard."""
    spark = edges.sparkSession
    edges = edges.select("a", "b").distinct()
    state = spark.createDataFrame([([start],)], "path array<string>")
    found = None
    for hop in range(1, most_hops + 1):
        state = state.join(edges, F.element_at("path", -1) == F.col("a")).where(~F.array_contains("path", F.col("b"))).select(F.array_append("path", F.col("b")).alias("path"))
        hits = state.where(F.element_at("path", -1) == end).withColumn("hops", F.lit(hop))
        found = hits if found is None else found.unionByName(hits)
        state = state.where(F.element_at("path", -1) != end)
    return found


def weighted_distances(edges: DataFrame, source: str, most_rounds: int = 200) -> DataFrame:
    """(node, distance): Bellman-Ford rounds over (a, b, cost), all at once until nothing shrinks."""
    spark = edges.sparkSession
    edges = cut(edges.groupBy("a", "b").agg(F.min("cost").alias("cost")))
    state = spark.createDataFrame([(source, 0.0)], "node string, distance double")
    active = state
    for _ in range(most_rounds):
        offers = active.join(edges, active["node"] == edges["a"]).groupBy(F.col("b").alias("node")).agg(F.min(F.col("distance") + F.col("cost")).alias("offer"))
        merged = cut(state.join(offers, "node", "full").select("node", F.least(F.coalesce("distance", "offer"), F.coalesce("offer", "distance")).alias("distance"), (F.col("distance").isNull() | (F.col("offer") < F.col("distance"))).alias("new")))
        active = merged.where("new").select("node", "distance")
        state = merged.select("node", "distance")
        if active.isEmpty():
            return state
    raise RuntimeError("distances did not settle")


def inverse_strength_edges(inc: DataFrame) -> DataFrame:
    """(a, b, cost): cost 1 / sqrt(wa * wb), the least over the shared edges, in both directions."""
    p = co_nodes(inc).where("wa * wb > 0").groupBy("a", "b").agg(F.min(1 / F.sqrt(F.col("wa") * F.col("wb"))).alias("cost"))
    return p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "cost"))


def eccentricities(inc: DataFrame) -> DataFrame:
    """(node_id, eccentricity): the greatest distance to a node of the same component."""
    nodes = inc.select(F.col("node_id").alias("source")).distinct()
    return bfs(neighbor_edges(inc), nodes).groupBy(F.col("source").alias("node_id")).agg(F.max("depth").alias("eccentricity"))


def diameter(inc: DataFrame) -> DataFrame:
    return eccentricities(inc).agg(F.max("eccentricity").alias("diameter"))


def spanning_forest(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b, cost): a minimum spanning forest of (a, b, cost) by Boruvka rounds; ties by (a, b)."""
    e = cut(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cost").groupBy("a", "b").agg(F.min("cost").alias("cost")))
    label = cut(e.select(F.col("a").alias("n")).unionByName(e.select(F.col("b").alias("n"))).distinct().withColumn("c", F.col("n")))
    tree = None
    for _ in range(most_rounds):
        x = e.join(label.select(F.col("n").alias("a"), F.col("c").alias("ca")), "a").join(label.select(F.col("n").alias("b"), F.col("c").alias("cb")), "b").where("ca != cb")
        ends = x.select(F.col("ca").alias("c"), F.struct("cost", "a", "b").alias("e")).unionByName(x.select(F.col("cb").alias("c"), F.struct("cost", "a", "b").alias("e")))
        best = cut(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct())
        if best.isEmpty():
            break
        tree = best if tree is None else cut(tree.unionByName(best))
        inc = tree.select(F.concat_ws("|", "a", "b").alias("edge_id"), F.explode(F.array("a", "b")).alias("node_id"))
        comp = connected_components(inc).select(F.col("node_id").alias("n"), F.col("component").alias("c2"))
        label = cut(label.join(comp, "n", "left").select("n", F.coalesce("c2", "n").alias("c")))
    empty = e.where("false")
    return (empty if tree is None else tree).select("a", "b", "cost")


def reachable(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(connected): 1.0 or 0.0, the flow value of the reference's placeholder max-flow and min-cut."""
    start = edges.sparkSession.createDataFrame([(source,)], "source string")
    hit = bfs(edges, start).where(F.col("node") == target)
    return hit.agg(F.when(F.count("*") > 0, 1.0).otherwise(0.0).alias("connected"))


def random_walks(inc: DataFrame, starts: DataFrame, steps: int = 100, seed: int = 1) -> DataFrame:
    """(walk, step, node_id): from each start a uniform edge, then a uniform other member; stops when stuck.

    ``starts`` is (walk, node_id). Draws hash (seed, walk, step), so partitioning does not matter.
    """
    rows = cut(inc.select("edge_id", "node_id").distinct())
    state = starts.select("walk", F.lit(0).alias("step"), "node_id")
    path, here = state, state
    for step in range(1, steps + 1):
        edge = here.join(rows, "node_id").withColumn("d", F.xxhash64(F.lit(seed), "walk", F.lit(step), "edge_id")).groupBy("walk", "node_id").agg(F.min_by("edge_id", "d").alias("edge_id"))
        to = edge.withColumnRenamed("node_id", "at").join(rows, "edge_id").where("node_id != at").withColumn("d", F.xxhash64(F.lit(seed + 1), "walk", F.lit(step), "node_id"))
        here = cut(to.groupBy("walk").agg(F.min_by("node_id", "d").alias("node_id")).select("walk", F.lit(step).alias("step"), "node_id"))
        if here.isEmpty():
            break
        path = path.unionByName(here)
    return path


def k_core(inc: DataFrame, most_k: int = 1000) -> DataFrame:
    """(node_id, core): the largest k such that the node stays when nodes in fewer than k edges with two live nodes are peeled."""
    rows = cut(inc.select("edge_id", "node_id").distinct())
    core = rows.select("node_id").distinct().withColumn("core", F.lit(0))
    for k in range(1, most_k + 1):
        while True:
            live = rows.groupBy("edge_id").count().where("count >= 2").select("edge_id")
            rows2 = rows.join(live, "edge_id", "left_semi")
            stay = rows2.groupBy("node_id").count().where(F.col("count") >= k).select("node_id")
            kept = cut(rows2.join(stay, "node_id", "left_semi"))
            same = kept.count() == rows.count()
            rows = kept
            if same:
                break
        if rows.isEmpty():
            return core
        core = cut(core.join(rows.select("node_id").distinct().withColumn("k", F.lit(k)), "node_id", "left").select("node_id", F.coalesce("k", "core").alias("core")))
    return core


def depth_first(inc: DataFrame, start: str, most_depth: int | None = None, most_edges: int = 1_000_000) -> list[str]:
    """Preorder, neighbours in id order. Sequential by definition: on the driver, up to ``most_edges`` pairs."""
    pairs = neighbor_edges(inc).limit(most_edges + 1).collect()
    if len(pairs) > most_edges:
        raise ValueError("too many edges for a depth-first order")
    near: dict[str, list] = {}
    for r in pairs:
        near.setdefault(r["a"], []).append(r["b"])
    order, seen, stack = [], set(), [(start, 0)]
    while stack:
        node, depth = stack.pop()
        if node in seen:
            continue
        seen.add(node)
        order.append(node)
        if most_depth is None or depth < most_depth:
            stack += [(n, depth + 1) for n in sorted(near.get(node, []), reverse=True) if n not in seen]
    return order


def cycles(edges: DataFrame, most_length: int = 4) -> DataFrame:
    """(cycle): simple cycles of 3 to ``most_length`` nodes over undirected (a, b), each once: least node first, then the lesser neighbour."""
    e = both_directions(edges)
    state = e.where("a < b").select(F.array("a", "b").alias("path"))
    found = None
    for _ in range(3, most_length + 1):
        state = state.join(e, F.element_at("path", -1) == F.col("a")).where((F.col("b") > F.get("path", F.lit(0))) & ~F.array_contains("path", F.col("b"))).select(F.array_append("path", F.col("b")).alias("path"))
        closed = state.join(e, (F.element_at("path", -1) == F.col("a")) & (F.get("path", F.lit(0)) == F.col("b")), "left_semi").where(F.get("path", F.lit(1)) < F.element_at("path", -1))
        found = closed if found is None else found.unionByName(closed)
    return found.withColumnRenamed("path", "cycle")


def sample_nodes(inc: DataFrame, n: int, how: str = "random", seed: int = 1) -> DataFrame:
    """(node_id): ``n`` nodes, uniformly, by degree, or stratified over the degree quartiles."""
    d = inc.groupBy("node_id").agg(F.countDistinct("edge_id").alias("degree")).withColumn("u", unit_hash(seed, F.col("node_id")))
    if how == "random":
        return d.orderBy("u", "node_id").limit(n).select("node_id")
    if how == "degree":
        return d.orderBy(F.pow("u", 1 / F.col("degree")).desc(), "node_id").limit(n).select("node_id")
    if how == "stratified":
        cuts = d.agg(F.percentile("degree", [0.25, 0.5, 0.75]).alias("q")).first()["q"] or [0, 0, 0]
        stratum = sum((F.col("degree") > q).cast("int") for q in cuts)
        ranked = d.withColumn("r", F.row_number().over(Window.partitionBy(stratum).orderBy("u", "node_id")))
        return ranked.orderBy("r", "u").limit(n).select("node_id")
    if how == "adaptive":
        s = d.agg(F.stddev_pop("degree").alias("s"), F.avg("degree").alias("m")).first()
        return sample_nodes(inc, n, "degree" if s["s"] is not None and s["s"] > 0.8 * s["m"] else "stratified", seed)
    raise ValueError(how)
