"""Communities, their quality, spectral forms and contagion."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, ratio, unit_hash
from .basic import co_nodes, edge_sizes, node_degrees
from .paths import connected_components, neighbor_edges


def label_propagation(inc: DataFrame, rounds: int = 10, weighted: bool = True) -> DataFrame:
    """(node_id, community): every round each node takes the heaviest label among its neighbours and itself; ties to the least label.

    A node's own label weighs as much as its strongest link, so that two nodes do not swap labels for ever.
    """
    p = co_nodes(inc).groupBy("a", "b").agg(F.sum(F.sqrt(F.col("wa") * F.col("wb"))).alias("w") if weighted else F.count("*").cast("double").alias("w"))
    links = cut(p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    strongest = cut(links.groupBy("a").agg(F.max("w").alias("own")))
    state = cut(inc.select("node_id").distinct().withColumn("community", F.col("node_id")))
    for _ in range(rounds):
        votes = state.join(links, state["node_id"] == links["a"]).select(F.col("b").alias("node_id"), "community", "w")
        own = state.join(strongest, state["node_id"] == strongest["a"], "left").select("node_id", "community", F.coalesce("own", F.lit(1.0)).alias("w"))
        tally = votes.unionByName(own).groupBy("node_id", "community").agg(F.round(F.sum("w"), 9).alias("w"))
        best = Window.partitionBy("node_id").orderBy(F.desc("w"), "community")
        new = cut(tally.withColumn("r", F.row_number().over(best)).where("r = 1").select("node_id", "community"))
        moved = not new.join(state.withColumnRenamed("community", "old"), "node_id").where("community != old").isEmpty()
        state = new
        if not moved:
            break
    return state


def greedy_jaccard(inc: DataFrame, threshold: float = 0.3, most_nodes: int = 20_000, most_pairs: int = 2_000_000) -> DataFrame:
    """(node_id, community): in id order each unplaced node opens a community and takes the unplaced nodes of edge-set Jaccard over the threshold.

    Sequential by definition: similar pairs come to the driver, at most ``most_pairs`` of at most ``most_nodes`` nodes.
    """
    from .patterns import node_similarity

    nodes = [r[0] for r in inc.select("node_id").distinct().orderBy("node_id").limit(most_nodes + 1).collect()]
    if len(nodes) > most_nodes:
        raise ValueError("too many nodes for a greedy order")
    near: dict[str, list] = {}
    pairs = node_similarity(inc).where(F.col("similarity") > threshold).limit(most_pairs + 1).collect()
    if len(pairs) > most_pairs:
        raise ValueError("too many similar pairs for a greedy order")
    for r in pairs:
        near.setdefault(r["a"], []).append(r["b"])
        near.setdefault(r["b"], []).append(r["a"])
    placed: dict[str, str] = {}
    for n in nodes:
        if n not in placed:
            placed[n] = n
            for m in near.get(n, []):
                placed.setdefault(m, n)
    return inc.sparkSession.createDataFrame(sorted(placed.items()), "node_id string, community string")


def edge_modularity(inc: DataFrame, communities: DataFrame | None = None) -> DataFrame:
    """(modularity): mean over edges of the share of member pairs inside one community; communities default to components."""
    comm = connected_components(inc).withColumnRenamed("component", "community") if communities is None else communities
    rows = inc.select("edge_id", "node_id").distinct().join(comm, "node_id")
    k = rows.groupBy("edge_id", "community").agg(F.count("*").alias("k"))
    e = k.groupBy("edge_id").agg(F.sum("k").alias("s"), F.sum(F.col("k") * (F.col("k") - 1)).alias("inside"))
    return e.where("s > 1").agg(F.coalesce(F.avg(F.col("inside") / (F.col("s") * (F.col("s") - 1))), F.lit(0.0)).alias("modularity"))


def newman_modularity(inc: DataFrame, communities: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(modularity) of the pair graph weighted by co-occurrence."""
    p = co_nodes(inc).groupBy("a", "b").agg(F.count("*").alias("w"))
    x = p.join(communities.select(F.col("node_id").alias("a"), F.col("community").alias("ca")), "a").join(communities.select(F.col("node_id").alias("b"), F.col("community").alias("cb")), "b")
    inside = x.agg(F.sum("w").alias("m"), F.coalesce(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w"))), F.lit(0)).alias("inside"))
    ends = x.select(F.col("ca").alias("c"), "w").unionByName(x.select(F.col("cb").alias("c"), "w")).groupBy("c").agg(F.sum("w").alias("d"))
    return inside.join(ends.agg(F.sum(F.col("d").cast("double") * F.col("d")).alias("dd"))).select((ratio(F.col("inside"), F.col("m")) - resolution * ratio(F.col("dd"), 4.0 * F.col("m") * F.col("m"))).alias("modularity"))


def quality(inc: DataFrame, communities: DataFrame) -> DataFrame:
    """(communities, coverage, conductance, size_mean, size_std, size_max, size_min); coverage is the share of edges inside one community."""
    e = inc.join(communities, "node_id").groupBy("edge_id").agg(F.countDistinct("community").alias("c"))
    cover = e.agg(ratio(F.count_if(F.col("c") == 1), F.count("*")).alias("coverage"))
    sizes = communities.groupBy("community").agg(F.count("*").alias("n")).agg(F.count("*").alias("communities"), F.avg("n").alias("size_mean"), F.stddev_pop("n").alias("size_std"), F.max("n").alias("size_max"), F.min("n").alias("size_min"))
    return cover.join(sizes).select("communities", "coverage", (1 - F.col("coverage")).alias("conductance"), "size_mean", "size_std", "size_max", "size_min")


def overlapping(inc: DataFrame, k: int = 10, alpha: float = 0.5, rounds: int = 20, seed: int = 42) -> DataFrame:
    """(node_id, community, membership) over 1/k: seeded random memberships that diffuse over the pair graph, renormalised each round."""
    links = neighbor_edges(inc)
    links = cut(links.join(links.groupBy("a").agg(F.count("*").alias("d")), "a"))
    nodes = inc.select("node_id").distinct()
    start = nodes.withColumn("community", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("p", unit_hash(seed, F.col("node_id"), F.col("community")))
    norm = lambda df: df.withColumn("p", ratio(F.col("p"), F.sum("p").over(Window.partitionBy("node_id"))))
    state = cut(norm(start))
    for _ in range(rounds):
        pull = state.join(links, state["node_id"] == links["b"]).groupBy(F.col("a").alias("node_id"), "community").agg(F.sum(F.col("p") / F.col("d")).alias("q"))
        state = cut(norm(state.join(pull, ["node_id", "community"], "left").select("node_id", "community", (alpha * F.col("p") + (1 - alpha) * F.coalesce("q", F.col("p"))).alias("p"))))
    return state.where(F.col("p") > 1.0 / k).withColumnRenamed("p", "membership")


def consensus(runs: DataFrame, share: float = 0.5) -> DataFrame:
    """(node_id, community): components of the node pairs that at least ``share`` of the runs (run, node_id, community) put together."""
    n = runs.select("run").distinct().count()
    groups = runs.select(F.concat_ws("|", F.col("run").cast("string"), "community").alias("edge_id"), "node_id", F.lit(1.0).alias("weight"))
    together = co_nodes(groups).groupBy("a", "b").agg(F.count("*").alias("c")).where(F.col("c") >= share * n)
    inc = together.select(F.concat_ws("|", "a", "b").alias("edge_id"), F.explode(F.array("a", "b")).alias("node_id"))
    comp = connected_components(inc)
    return runs.select("node_id").distinct().join(comp, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("community"))


# Laplacians and spectra


def node_adjacency(inc: DataFrame) -> DataFrame:
    """(i, j, value): 1/(size-1) for each shared edge, both directions."""
    p = co_nodes(inc).join(edge_sizes(inc), "edge_id").groupBy("a", "b").agg(F.sum(1.0 / (F.col("size") - 1)).alias("value"))
    return p.select(F.col("a").alias("i"), F.col("b").alias("j"), "value").unionByName(p.select(F.col("b").alias("i"), F.col("a").alias("j"), "value"))


def laplacian(adjacency: DataFrame, nodes: DataFrame, normalized: bool = True) -> DataFrame:
    """(i, j, value): D - A, or I - D^-1/2 A D^-1/2 with the diagonal 1 where a node has a degree."""
    d = adjacency.groupBy("i").agg(F.sum("value").alias("d"))
    ids = nodes.select(F.col(nodes.columns[0]).alias("i")).join(d, "i", "left").select("i", F.coalesce("d", F.lit(0.0)).alias("d"))
    off = adjacency.join(ids.withColumnRenamed("d", "di"), "i").join(ids.select(F.col("i").alias("j"), F.col("d").alias("dj")), "j")
    value = -F.col("value") / F.sqrt(F.col("di") * F.col("dj")) if normalized else -F.col("value")
    diag = ids.select("i", F.col("i").alias("j"), (F.when(F.col("d") > 0, 1.0).otherwise(0.0) if normalized else F.col("d")).alias("value"))
    return diag.unionByName(off.select("i", "j", value.alias("value")))


def edge_adjacency(inc: DataFrame) -> DataFrame:
    """(i, j, value): 1/(degree-1) for each shared node of two edges, both directions."""
    rows = inc.select("edge_id", "node_id").distinct().join(node_degrees(inc), "node_id")
    x, y = rows.select("node_id", "degree", F.col("edge_id").alias("i")), rows.select("node_id", F.col("edge_id").alias("j"))
    return x.join(y, "node_id").where("i != j").groupBy("i", "j").agg(F.sum(1.0 / (F.col("degree") - 1)).alias("value"))


def _dense(matrix: DataFrame, most: int):
    rows = matrix.limit(most * most + 1).collect()
    ids = sorted({r["i"] for r in rows} | {r["j"] for r in rows})
    if len(ids) > most:
        raise ValueError(f"a dense spectrum is for at most {most} rows")
    at = {x: n for n, x in enumerate(ids)}
    m = np.zeros((len(ids), len(ids)))
    for r in rows:
        m[at[r["i"]], at[r["j"]]] += r["value"]
    return ids, m


def spectrum(matrix: DataFrame, most: int = 2000):
    """(ids, eigenvalues ascending, eigenvectors as columns) of a symmetric (i, j, value); each vector's largest entry is positive."""
    ids, m = _dense(matrix, most)
    w, v = np.linalg.eigh((m + m.T) / 2)
    if len(ids):
        v = v * np.where(v[np.abs(v).argmax(0), np.arange(len(ids))] < 0, -1, 1)
    return ids, w, v


def spectral_embedding(inc: DataFrame, k: int = 2) -> DataFrame:
    """(node_id, vector): eigenvectors 1..k of the normalised node Laplacian."""
    ids, _, v = spectrum(laplacian(node_adjacency(inc), inc.select("node_id").distinct()))
    return inc.sparkSession.createDataFrame([(n, [float(x) for x in v[i, 1 : k + 1]]) for i, n in enumerate(ids)], "node_id string, vector array<double>")


def algebraic_connectivity(inc: DataFrame) -> float:
    _, w, _ = spectrum(laplacian(node_adjacency(inc), inc.select("node_id").distinct(), normalized=False))
    return float(w[1]) if len(w) > 1 else 0.0


def kmeans(points: DataFrame, k: int, seed: int = 1, id_column: str = "node_id") -> DataFrame:
    """(id, community) of (id, vector array<double>) by Spark's k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    df = points.withColumn("features", array_to_vector("vector"))
    return KMeans(k=k, seed=seed).fit(df).transform(df).select(id_column, F.col("prediction").cast("string").alias("community"))


def spectral_clustering(inc: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """(node_id, community): power-iteration clustering on the pair graph weighted sqrt(wa * wb); any size."""
    from pyspark.ml.clustering import PowerIterationClustering

    ids = inc.select("node_id").distinct().withColumn("id", F.xxhash64("node_id"))
    p = co_nodes(inc).groupBy("a", "b").agg(F.sum(F.sqrt(F.col("wa") * F.col("wb"))).alias("w"))
    g = p.select(F.xxhash64("a").alias("src"), F.xxhash64("b").alias("dst"), "w")
    out = PowerIterationClustering(k=k, maxIter=20, weightCol="w").assignClusters(g)
    return ids.join(out, "id").select("node_id", F.col("cluster").cast("string").alias("community"))


def transition_matrix(inc: DataFrame) -> DataFrame:
    """(i, j, value): an edge of i by its weight there, then a member of it by weight: the walk that chooses edges and nodes."""
    b = inc.groupBy("edge_id", "node_id").agg(F.sum("weight").alias("w"))
    dv = b.groupBy("node_id").agg(F.sum("w").alias("dv"))
    de = b.groupBy("edge_id").agg(F.sum("w").alias("de"))
    left = b.join(dv, "node_id").select("edge_id", F.col("node_id").alias("i"), (F.col("w") / F.col("dv")).alias("p"))
    right = b.join(de, "edge_id").select("edge_id", F.col("node_id").alias("j"), (F.col("w") / F.col("de")).alias("q"))
    return left.join(right, "edge_id").groupBy("i", "j").agg(F.sum(F.col("p") * F.col("q")).alias("value"))


def stationary(transition: DataFrame, most: int = 200, tol: float = 1e-9) -> DataFrame:
    """(node_id, score): the stationary distribution by power iteration."""
    p = cut(transition)
    nodes = cut(p.select(F.col("i").alias("node_id")).distinct())
    state = nodes.withColumn("score", F.lit(1.0 / max(1, nodes.count())))
    for _ in range(most):
        new = cut(state.join(p, state["node_id"] == p["i"]).groupBy(F.col("j").alias("node_id")).agg(F.sum(F.col("score") * F.col("value")).alias("score")))
        gap = new.join(state.withColumnRenamed("score", "old"), "node_id").agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0]
        state = new
        if gap is None or gap < tol:
            break
    return state


# contagion


def majority(infected: Column, members: Column) -> Column:
    return infected > members / 2


def at_least(share: float):
    return lambda infected, members: infected / members >= share


def contagion(inc: DataFrame, infected: DataFrame, steps: int, tau: float = 0.1, gamma: float = 0.1, kind: str = "individual", activation=majority, recover_to: str = "R", seed: int = 1) -> DataFrame:
    """(step, state, nodes): S/I/R counts of a discrete process; ``recover_to`` S gives SIS.

    individual: a susceptible node with an infected neighbour falls ill with probability tau;
    collective: each activated edge infects its susceptible members with probability tau.
    Draws hash (seed, step, node, edge), so reruns agree on any partitioning.
    """
    rows = cut(inc.select("edge_id", "node_id").distinct())
    ill = infected.select("node_id").distinct().withColumn("i", F.lit("I"))
    state = cut(rows.select("node_id").distinct().join(ill, "node_id", "left").select("node_id", F.coalesce("i", F.lit("S")).alias("state")))
    history = state.groupBy("state").agg(F.count("*").alias("nodes")).select(F.lit(0).alias("step"), "state", "nodes")
    for step in range(1, steps + 1):
        by_edge = rows.join(state, "node_id").groupBy("edge_id").agg(F.count_if(F.col("state") == "I").alias("ill"), F.count("*").alias("members"))
        live = by_edge.where(F.col("ill") > 0) if kind == "individual" else by_edge.where(activation(F.col("ill"), F.col("members")))
        touched = rows.join(live.select("edge_id"), "edge_id", "left_semi")
        if kind == "individual":
            hit = touched.select("node_id").distinct().where(unit_hash(seed, F.lit(step), F.col("node_id")) < tau)
        else:
            hit = touched.where(unit_hash(seed, F.lit(step), F.col("node_id"), F.col("edge_id")) < tau).select("node_id").distinct()
        heals = unit_hash(seed + 1, F.lit(step), F.col("node_id")) < gamma
        new = state.join(hit.withColumn("hit", F.lit(True)), "node_id", "left").select(
            "node_id",
            F.when((F.col("state") == "S") & F.coalesce("hit", F.lit(False)), "I").when((F.col("state") == "I") & heals, recover_to).otherwise(F.col("state")).alias("state"),
        )
        state = cut(new)
        history = history.unionByName(state.groupBy("state").agg(F.count("*").alias("nodes")).select(F.lit(step).alias("step"), "state", "nodes"))
    return history


def contagion_summary(histories: list[DataFrame]) -> DataFrame:
    """(step, state, mean, std, min, max) over runs."""
    out = None
    for run, h in enumerate(histories):
        r = h.withColumn("run", F.lit(run))
        out = r if out is None else out.unionByName(r)
    return out.groupBy("step", "state").agg(F.avg("nodes").alias("mean"), F.stddev_pop("nodes").alias("std"), F.min("nodes").alias("min"), F.max("nodes").alias("max"))



# clusterings of many kinds


def similarity_components(pairs: DataFrame, ids: DataFrame, least: float, id_column: str = "node_id") -> DataFrame:
    """(id, community): components of the pairs (a, b, similarity) that are at least so alike: single linkage cut at one height, any size."""
    alike = pairs.where(F.col("similarity") >= least)
    inc = alike.select(F.concat_ws("|", "a", "b").alias("edge_id"), F.explode(F.array("a", "b")).alias("node_id"))
    comp = connected_components(inc).withColumnRenamed("node_id", id_column)
    return ids.select(id_column).distinct().join(comp, id_column, "left").select(id_column, F.coalesce("component", id_column).alias("community"))


def single_linkage(inc: DataFrame, least: float = 0.5) -> DataFrame:
    """(node_id, community): nodes joined by chains of edge-set Jaccard of at least ``least``."""
    from .patterns import node_similarity

    return similarity_components(node_similarity(inc), inc.select("node_id"), least)


def edge_communities(inc: DataFrame, least: float = 0.3) -> DataFrame:
    """(edge_id, community): edges joined by chains of member-set Jaccard of at least ``least``."""
    from .patterns import edge_jaccard

    pairs = edge_jaccard(inc).select(F.col("e").alias("a"), F.col("f").alias("b"), F.col("jaccard").alias("similarity"))
    return similarity_components(pairs, inc.select("edge_id"), least, "edge_id")


def agglomerative(inc: DataFrame, k: int, linkage: str = "average", metric: str = "jaccard", most_nodes: int = 2000) -> DataFrame:
    """(node_id, community): bottom-up merging of incidence rows to ``k`` clusters, named by their least node.

    ``linkage`` is single, complete, average or ward; ``metric`` jaccard or euclidean (ward:
    euclidean). All distances are held at once, so at most ``most_nodes`` nodes; for more,
    ``single_linkage`` cuts the same tree at a height. Ties merge the least names first.
    """
    rows = inc.groupBy("node_id").agg(F.sort_array(F.collect_set("edge_id")).alias("e")).orderBy("node_id").limit(most_nodes + 1).collect()
    if len(rows) > most_nodes:
        raise ValueError(f"agglomerative clustering is for at most {most_nodes} nodes")
    names = [r["node_id"] for r in rows]
    column = {e: i for i, e in enumerate(sorted({e for r in rows for e in r["e"]}))}
    x = np.zeros((len(rows), len(column)))
    for i, r in enumerate(rows):
        x[i, [column[e] for e in r["e"]]] = 1
    both, own = x @ x.T, x.sum(1)
    if metric == "euclidean" or linkage == "ward":
        d = np.maximum(own[:, None] + own[None, :] - 2 * both, 0)
        d = d if linkage == "ward" else np.sqrt(d)
    else:
        d = 1 - both / np.maximum(own[:, None] + own[None, :] - both, 1)
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(len(rows)), np.arange(len(rows))
    for _ in range(max(0, len(rows) - k)):
        i, j = divmod(int(d.argmin()), len(rows))
        i, j = min(i, j), max(i, j)
        a, b = d[i], d[j]
        if linkage == "single":
            new = np.minimum(a, b)
        elif linkage == "complete":
            new = np.where(np.isinf(a) | np.isinf(b), np.inf, np.maximum(a, b))
        elif linkage == "average":
            new = (size[i] * a + size[j] * b) / (size[i] + size[j])
        else:
            with np.errstate(invalid="ignore"):
                new = ((size[i] + size) * a + (size[j] + size) * b - size * d[i, j]) / (size[i] + size[j] + size)
            new = np.where(np.isinf(a) | np.isinf(b), np.inf, new)
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
    return inc.sparkSession.createDataFrame([(n, names[label[i]]) for i, n in enumerate(names)], "node_id string, community string")


def multi_resolution(inc: DataFrame, levels: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """(resolution, node_id, community): single linkage cut at each height, from one table of similarities."""
    from .patterns import node_similarity

    pairs, nodes, out = cut(node_similarity(inc, least=min(levels))), cut(inc.select("node_id").distinct()), None
    for level in levels:
        part = similarity_components(pairs, nodes, level).select(F.lit(float(level)).alias("resolution"), "node_id", "community")
        out = part if out is None else out.unionByName(part)
    return out


def adaptive_method(inc: DataFrame, most_dense: int = 2000) -> str:
    """Which clustering suits: agglomerative for few nodes, label propagation for dense graphs, else components by similarity."""
    s = inc.agg(F.countDistinct("node_id").alias("n"), F.countDistinct("edge_id").alias("m"), F.count("*").alias("k")).first()
    if s["n"] <= min(most_dense, 200):
        return "agglomerative"
    return "label_propagation" if s["k"] / max(1, s["m"]) <= 10 and s["k"] / max(1, s["n"]) >= 3 else "single_linkage"


def adaptive_communities(inc: DataFrame, k: int = 5, least: float = 0.3) -> DataFrame:
    """(method, node_id, community) by the method that ``adaptive_method`` names."""
    method = adaptive_method(inc)
    run = {"agglomerative": lambda: agglomerative(inc, k), "label_propagation": lambda: label_propagation(inc), "single_linkage": lambda: single_linkage(inc, least)}[method]
    return run().select(F.lit(method).alias("method"), "node_id", "community")


def clustering_analysis(inc: DataFrame, clusterings: dict) -> DataFrame:
    """(algorithm, communities, coverage, conductance, size_mean, size_std, size_max, size_min, modularity) of each named function of the incidences."""
    out = None
    for name, run in clusterings.items():
        found = cut(run(inc).select("node_id", "community"))
        row = quality(inc, found).join(edge_modularity(inc, found)).select(F.lit(name).alias("algorithm"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def evaluate(inc: DataFrame, communities: DataFrame) -> DataFrame:
    """(communities, coverage, conductance, sizes, modularity, newman) of one clustering."""
    newman = newman_modularity(inc, communities).withColumnRenamed("modularity", "newman")
    return quality(inc, communities).join(edge_modularity(inc, communities)).join(newman)
