"""Motifs, recurring patterns, similarity, anomalies, correlations and features."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ratio
from .basic import co_edges, co_nodes, edge_sizes, node_degrees


def motifs(inc: DataFrame, k: int = 2, least: int = 2, most: int | None = None) -> DataFrame:
    """(n0.., frequency): k-subsets of nodes that are together in at least ``least`` edges; the top ``most`` of them if given."""
    rows = inc.select("edge_id", "node_id").distinct()
    sets = rows.select("edge_id", F.col("node_id").alias("n0"))
    for i in range(1, k):
        sets = sets.join(rows.select("edge_id", F.col("node_id").alias(f"n{i}")), "edge_id").where(F.col(f"n{i}") > F.col(f"n{i - 1}"))
    names = [f"n{i}" for i in range(k)]
    out = sets.groupBy(*names).agg(F.count("*").alias("frequency")).where(F.col("frequency") >= least)
    return out if most is None else out.orderBy(F.desc("frequency"), *names).limit(most)


def frequent_values(counts: DataFrame, column: str, support: float = 0.1) -> DataFrame:
    """(value, count, support) of values that at least the given share of rows has."""
    total = F.broadcast(counts.agg(F.count("*").alias("total")))
    g = counts.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))
    return g.join(total).withColumn("support", F.col("count") / F.col("total")).where(F.col("support") >= support).drop("total")


def frequent_sizes(inc: DataFrame, support: float = 0.1) -> DataFrame:
    return frequent_values(edge_sizes(inc), "size", support)


def frequent_degrees(inc: DataFrame, support: float = 0.1) -> DataFrame:
    return frequent_values(node_degrees(inc), "degree", support)


def weight_quartiles(inc: DataFrame) -> DataFrame:
    """(bin, count): weights by quartile; a value on a boundary belongs to the lower bin."""
    q = F.broadcast(inc.agg(F.percentile("weight", [0.25, 0.5, 0.75]).alias("q")))
    place = F.when(F.col("weight") <= F.get("q", F.lit(0)), 1).when(F.col("weight") <= F.get("q", F.lit(1)), 2).when(F.col("weight") <= F.get("q", F.lit(2)), 3).otherwise(4)
    return inc.join(q).groupBy(place.alias("bin")).agg(F.count("*").alias("count"))


def power_fit(inc: DataFrame, sizes: tuple[int, ...] = (2, 3), least: int = 1) -> DataFrame:
    """(k, motifs, slope, r2): a log-log line through the frequencies of each motif size by rank."""
    out = None
    for k in sizes:
        m = motifs(inc, k, least)
        ranked = m.groupBy("frequency").agg(F.count("*").alias("n")).select(F.log("frequency").alias("x"), F.log("n").alias("y"), "n")
        row = ranked.agg(F.sum("n").alias("motifs"), F.regr_slope("y", "x").alias("slope"), F.regr_r2("y", "x").alias("r2")).select(F.lit(k).alias("k"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def edge_jaccard(inc: DataFrame, least: float = 0.0, most_paired: int = 32) -> DataFrame:
    """(e, f, shared, jaccard) of edge pairs that share a node, e < f as strings; with ``least``, those of at least that Jaccard.

    With ``least``, only pairs of edges so small that one shared node may do are joined by single nodes. All others
    need two, and are joined by pairs of nodes: s shared nodes are met as s (s - 1) / 2 pairs. Edges of over
    ``most_paired`` nodes have too many pairs, and are joined by single nodes with those of a size that may do.
    """
    if least > 0:
        return _edge_jaccard_least(inc, least, most_paired)
    sizes = edge_sizes(inc)
    p = co_edges(inc).join(sizes.select(F.col("edge_id").alias("e"), F.col("size").alias("se")), "e").join(sizes.select(F.col("edge_id").alias("f"), F.col("size").alias("sf")), "f")
    return p.select("e", "f", "shared", (F.col("shared") / (F.col("se") + F.col("sf") - F.col("shared"))).alias("jaccard")).where(F.col("jaccard") >= least)


def _edge_jaccard_least(inc: DataFrame, least: float, most_paired: int) -> DataFrame:
    # ids keep their type up to the end: numbers take less in shuffles than their strings
    sets = inc.select("edge_id", "node_id").where("edge_id IS NOT NULL").repartition("edge_id").groupBy("edge_id")
    sets = sets.agg(F.array_sort(F.collect_set("node_id")).alias("nodes"), F.max(F.col("node_id").isNull().cast("int")).alias("null"))
    size = F.size("nodes") + F.col("null")  # a null node is a member that is shared with nobody
    paired = F.when(size <= most_paired, F.col("nodes")).otherwise(F.slice("nodes", 1, F.lit(0)))
    single = (F.lit(1) / F.col("size") >= least) | (F.col("size") + 1 >= least * most_paired)
    rows = sets.select("edge_id", size.alias("size"), paired.alias("paired"), F.posexplode("nodes").alias("at", "a"))
    rows = rows.select("a", "edge_id", "size", F.slice("paired", F.col("at") + 2, F.size("paired")).alias("rest"))
    rows = rows.where(single | (F.size("rest") > 0)).repartition("a")
    # one row for each pair of nodes, and one without b where a alone may do; what stands alone is dropped where it is
    lone = F.when(single, F.array(F.lit(None))).otherwise(F.slice("rest", 1, F.lit(0)))
    keys = rows.select("a", "edge_id", "size", F.explode(F.concat(lone, "rest")).alias("b"))
    keys = keys.withColumn("times", F.count("*").over(Window.partitionBy("a", "b"))).where("times > 1")
    # the same projection on both sides, so that its exchange is reused
    x, y = (keys.select(F.col("a").alias(f"a_{i}"), F.col("b").alias(f"b_{i}"), F.col("edge_id").alias(i), F.col("size").alias(f"s{i}")) for i in "xy")
    alone = (F.lit(1) / (F.col("sx") + F.col("sy") - 1) >= least) | (F.greatest("sx", "sy") > most_paired)
    met = x.join(y, (F.col("a_x") == F.col("a_y")) & F.col("b_x").eqNullSafe(F.col("b_y")) & (F.col("x") < F.col("y"))).where(F.col("b_x").isNull() == alone)
    shared = F.when(alone, F.col("met")).otherwise(F.round((1 + F.sqrt(1 + 8 * F.col("met"))) / 2).cast("long"))
    p = met.groupBy("x", "y", "sx", "sy").agg(F.count("*").alias("met")).withColumn("shared", shared)
    p = p.withColumn("jaccard", F.col("shared") / (F.col("sx") + F.col("sy") - F.col("shared"))).where(F.col("jaccard") >= least)
    x, y = F.col("x").cast("string"), F.col("y").cast("string")
    return p.select(F.least(x, y).alias("e"), F.greatest(x, y).alias("f"), "shared", "jaccard")


def node_similarity(inc: DataFrame, metric: str = "jaccard", least: float = 0.0) -> DataFrame:
    """(a, b, shared, similarity) of node pairs that share an edge: Jaccard or cosine of their edge sets."""
    d = node_degrees(inc)
    p = co_nodes(inc).groupBy("a", "b").agg(F.count("*").alias("shared"))
    p = p.join(d.select(F.col("node_id").alias("a"), F.col("degree").alias("da")), "a").join(d.select(F.col("node_id").alias("b"), F.col("degree").alias("db")), "b")
    s = F.col("shared") / (F.col("da") + F.col("db") - F.col("shared")) if metric == "jaccard" else F.col("shared") / F.sqrt(F.col("da") * F.col("db"))
    return p.select("a", "b", "shared", s.alias("similarity")).where(F.col("similarity") >= least)


def average_edge_overlap(inc: DataFrame) -> DataFrame:
    """(average): the mean Jaccard over all pairs of edges, disjoint ones included."""
    m = edge_sizes(inc).agg(F.count("*").alias("m"))
    s = edge_jaccard(inc).agg(F.coalesce(F.sum("jaccard"), F.lit(0.0)).alias("s"))
    return m.join(s).select(ratio(F.col("s"), F.col("m") * (F.col("m") - 1) / 2).alias("average"))


def outliers(values: DataFrame, id_column: str, column: str, sensitivity: float = 2.0) -> DataFrame:
    """(id, value, z, kind): rows further than ``sensitivity`` population deviations from the mean."""
    stats = F.broadcast(values.agg(F.avg(column).alias("mu"), F.stddev_pop(column).alias("sd")))
    z = values.join(stats).withColumn("z", ratio(F.col(column) - F.col("mu"), F.col("sd")))
    return z.where(F.abs("z") > sensitivity).select(id_column, F.col(column).cast("double").alias("value"), "z", F.when(F.col("z") > 0, "high").otherwise("low").alias("kind"))


def outlier_nodes(inc: DataFrame, sensitivity: float = 2.0) -> DataFrame:
    return outliers(node_degrees(inc), "node_id", "degree", sensitivity)


def outlier_edges(inc: DataFrame, sensitivity: float = 2.0) -> DataFrame:
    return outliers(edge_sizes(inc), "edge_id", "size", sensitivity)


def weight_anomalies(inc: DataFrame, sensitivity: float = 2.0) -> DataFrame:
    rows = inc.select(F.concat_ws("|", "edge_id", "node_id").alias("incidence"), "weight")
    return outliers(rows, "incidence", "weight", sensitivity)


def diverse_participation(inc: DataFrame) -> DataFrame:
    """(node_id, variance): the population variance of the sizes of a node's edges."""
    rows = inc.select("edge_id", "node_id").distinct().join(edge_sizes(inc), "edge_id")
    return rows.groupBy("node_id").agg(F.var_pop("size").alias("variance"))


def correlations(stats: DataFrame, columns: list[str], least: float = 0.0, method: str = "pearson") -> DataFrame:
    """(x, y, correlation) of every pair of columns; Spearman correlates average ranks."""
    df = stats.select(*[F.col(c).cast("double").alias(c) for c in columns])
    if method == "spearman":
        ranks = []
        for c in columns:
            w = Window.orderBy(c)
            ties = F.count("*").over(Window.partitionBy(c))
            ranks.append((F.rank().over(w) + (ties - 1) / 2.0).alias(c))
        df = df.select(*ranks)
    pairs = list(combinations(columns, 2))
    wide = df.agg(*[F.corr(x, y).alias(f"c{i}") for i, (x, y) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"c{i}").alias("correlation")) for i, (x, y) in enumerate(pairs)])
    return wide.select(F.explode(rows).alias("r")).select("r.*").where(F.abs("correlation") >= least)


def node_statistics(inc: DataFrame) -> DataFrame:
    return inc.groupBy("node_id").agg(F.avg("weight").alias("w_mean"), F.coalesce(F.stddev_samp("weight"), F.lit(0.0)).alias("w_std"), F.sum("weight").alias("w_sum"), F.count("*").alias("n"))


def edge_statistics(inc: DataFrame) -> DataFrame:
    return inc.groupBy("edge_id").agg(F.avg("weight").alias("w_mean"), F.coalesce(F.stddev_samp("weight"), F.lit(0.0)).alias("w_std"), F.sum("weight").alias("w_sum"), F.max("weight").alias("w_max"), F.min("weight").alias("w_min"), F.count("*").alias("size"))


def node_features(inc: DataFrame) -> DataFrame:
    """(node_id, degree, avg_size, max_size, min_size, std_size) of the incident edges."""
    rows = inc.select("edge_id", "node_id").distinct().join(edge_sizes(inc), "edge_id")
    return rows.groupBy("node_id").agg(F.count("*").alias("degree"), F.avg("size").alias("avg_size"), F.max("size").alias("max_size"), F.min("size").alias("min_size"), F.stddev_pop("size").alias("std_size"))


def edge_features(inc: DataFrame) -> DataFrame:
    """(edge_id, size, weight, avg_degree, max_degree, min_degree, std_degree) of the members."""
    rows = inc.groupBy("edge_id", "node_id").agg(F.sum("weight").alias("weight")).join(node_degrees(inc), "node_id")
    return rows.groupBy("edge_id").agg(F.count("*").alias("size"), F.avg("weight").alias("weight"), F.avg("degree").alias("avg_degree"), F.max("degree").alias("max_degree"), F.min("degree").alias("min_degree"), F.stddev_pop("degree").alias("std_degree"))


def global_features(inc: DataFrame) -> DataFrame:
    d = node_degrees(inc).agg(F.count("*").alias("num_nodes"), F.avg("degree").alias("avg_degree"))
    s = edge_sizes(inc).agg(F.count("*").alias("num_edges"), F.avg("size").alias("avg_size"))
    return d.join(s).withColumn("density", ratio(F.col("num_edges"), F.col("num_nodes") * (F.col("num_nodes") - 1) / 2))


def density(inc: DataFrame) -> DataFrame:
    """(density): edges / (2**n - n - 1)."""
    c = inc.agg(F.countDistinct("node_id").cast("double").alias("n"), F.countDistinct("edge_id").alias("m"))
    return c.select(ratio(F.col("m"), F.pow(F.lit(2.0), "n") - F.col("n") - 1).alias("density"))


def weighted_pairs(inc: DataFrame, threshold: float | None = None) -> DataFrame:
    """(a, b, strength, shared): sum of sqrt(wa * wb) over the shared edges."""
    rows = inc if threshold is None else inc.where(F.col("weight") >= threshold)
    return co_nodes(rows).groupBy("a", "b").agg(F.sum(F.sqrt(F.col("wa") * F.col("wb"))).alias("strength"), F.count("*").alias("shared"))


def weighted_degree_summary(inc: DataFrame) -> DataFrame:
    w = inc.groupBy("node_id").agg(F.sum("weight").alias("w"))
    return w.agg(F.avg("w").alias("mean"), F.stddev_pop("w").alias("std"), F.min("w").alias("min"), F.max("w").alias("max"), F.median("w").alias("median"), F.sum("w").alias("total"), F.count("*").alias("nodes"))


def weighted_degree_histogram(inc: DataFrame) -> DataFrame:
    """(bin, count): min(50, max(10, floor(sqrt(n)))) equal bins of the weighted degrees; the last is closed."""
    w = inc.groupBy("node_id").agg(F.sum("weight").alias("w"))
    stats = F.broadcast(w.agg(F.min("w").alias("lo"), F.max("w").alias("hi"), F.least(F.lit(50), F.greatest(F.lit(10), F.floor(F.sqrt(F.count("*"))))).alias("bins")))
    place = F.least(F.col("bins") - 1, F.floor(ratio((F.col("w") - F.col("lo")) * F.col("bins"), F.col("hi") - F.col("lo"))))
    return w.join(stats).groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("count"))


def weighted_clustering(inc: DataFrame) -> DataFrame:
    """(node_id, coefficient) on the pair graph: mean of (w_uv w_vw w_uw)**(1/3) / max weight over a node's neighbour pairs.

    Triangles are listed once, from the node of least (degree, id).
    """
    p = weighted_pairs(inc).select("a", "b", "strength")
    both = p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "strength"))
    deg = both.groupBy("a").agg(F.count("*").alias("d"))
    top = F.broadcast(p.agg(F.max("strength").alias("top")))
    o = p.join(deg.select("a", F.col("d").alias("da")), "a").join(deg.select(F.col("a").alias("b"), F.col("d").alias("db")), "b")
    swap = (F.col("da") > F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") > F.col("b")))
    o = o.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("u"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("v"), "strength")
    x, y = o.select("u", F.col("v").alias("v1"), F.col("strength").alias("s1")), o.select("u", F.col("v").alias("v2"), F.col("strength").alias("s2"))
    wedge = x.join(y, "u").where("v1 < v2")
    closed = wedge.join(p.select(F.col("a").alias("v1"), F.col("b").alias("v2"), F.col("strength").alias("s3")), ["v1", "v2"]).join(top)
    value = F.pow(F.col("s1") * F.col("s2") * F.col("s3"), 1.0 / 3) / F.col("top")
    per = closed.select(F.explode(F.array("u", "v1", "v2")).alias("node_id"), value.alias("t")).groupBy("node_id").agg(F.sum("t").alias("t"))
    nodes = inc.select("node_id").distinct().join(deg.withColumnRenamed("a", "node_id"), "node_id", "left").join(per, "node_id", "left")
    return nodes.select("node_id", ratio(2 * F.coalesce("t", F.lit(0.0)), F.col("d") * (F.col("d") - 1)).alias("coefficient"))


def structural_summary(inc: DataFrame) -> DataFrame:
    """(nodes, edges, pairs, pair_density): node pairs that share an edge, and their share of all pairs."""
    counts = inc.agg(F.countDistinct("node_id").alias("nodes"), F.countDistinct("edge_id").alias("edges"))
    pairs = co_nodes(inc).select("a", "b").distinct().agg(F.count("*").alias("pairs"))
    return counts.join(pairs).select("nodes", "edges", "pairs", ratio(2 * F.col("pairs"), F.col("nodes") * (F.col("nodes") - 1)).alias("pair_density"))
