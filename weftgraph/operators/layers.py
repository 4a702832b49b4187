"""Layers, contexts, probabilistic states, modalities and property indexes.

Incidences carry ``layer`` or ``modality``; entity states are (entity, layer, key, value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ratio, unit_hash


def modal_bridges(inc: DataFrame, modalities: int = 2, connections: int = 1) -> DataFrame:
    """(node_id, modalities, connections): nodes in at least so many modalities, each with at least so many incidences."""
    per = inc.groupBy("node_id", "modality").agg(F.count("*").alias("c")).where(F.col("c") >= connections)
    return per.groupBy("node_id").agg(F.count("*").alias("modalities"), F.sum("c").alias("connections")).where(F.col("modalities") >= modalities)


def _members(inc: DataFrame) -> DataFrame:
    return inc.select("node_id", "modality").distinct()


def modality_cooccurrence(inc: DataFrame, support: int = 1) -> DataFrame:
    """(m1, m2, nodes): how many nodes two modalities share."""
    x, y = _members(inc).withColumnRenamed("modality", "m1"), _members(inc).withColumnRenamed("modality", "m2")
    return x.join(y, "node_id").where("m1 < m2").groupBy("m1", "m2").agg(F.count("*").alias("nodes")).where(F.col("nodes") >= support)


def modality_transitions(inc: DataFrame, support: int = 1) -> DataFrame:
    """(m1, m2, nodes): neighbours in the sorted list of each node's modalities."""
    w = Window.partitionBy("node_id").orderBy("modality")
    t = _members(inc).select(F.col("modality").alias("m1"), F.lead("modality").over(w).alias("m2")).where("m2 IS NOT NULL")
    return t.groupBy("m1", "m2").agg(F.count("*").alias("nodes")).where(F.col("nodes") >= support)


def modal_correlation(inc: DataFrame) -> DataFrame:
    """(m1, m2, jaccard, overlap, cosine) of the node sets of every pair of modalities."""
    sizes = _members(inc).groupBy("modality").agg(F.count("*").alias("n"))
    pairs = sizes.select(F.col("modality").alias("m1"), F.col("n").alias("n1")).join(F.broadcast(sizes.select(F.col("modality").alias("m2"), F.col("n").alias("n2"))), F.col("m1") < F.col("m2"))
    x = pairs.join(modality_cooccurrence(inc), ["m1", "m2"], "left").withColumn("c", F.coalesce("nodes", F.lit(0)))
    return x.select("m1", "m2", ratio(F.col("c"), F.col("n1") + F.col("n2") - F.col("c")).alias("jaccard"), ratio(F.col("c"), F.least("n1", "n2")).alias("overlap"), ratio(F.col("c"), F.sqrt(F.col("n1") * F.col("n2"))).alias("cosine"))


def cross_modal_centrality(inc: DataFrame, weights: dict[str, float] | None = None, how: str = "weighted_average") -> DataFrame:
    """(node_id, score): the degree in each modality, combined by weighted_average, average, max, min or sum."""
    d = inc.groupBy("node_id", "modality").agg(F.countDistinct("edge_id").cast("double").alias("d"))
    w = F.lit(1.0)
    for m, x in (weights or {}).items():
        w = F.when(F.col("modality") == m, F.lit(float(x))).otherwise(w)
    agg = {"weighted_average": ratio(F.sum(F.col("d") * F.col("w")), F.sum("w")), "average": F.avg("d"), "max": F.max("d"), "min": F.min("d"), "sum": F.sum("d")}[how]
    return d.withColumn("w", w).groupBy("node_id").agg(agg.alias("score"))


def inter_modal(inc: DataFrame, a: str, b: str) -> DataFrame:
    """(node_id, degree_a, degree_b) of the nodes of both modalities."""
    d = inc.groupBy("node_id", "modality").agg(F.countDistinct("edge_id").alias("d"))
    x = d.where(F.col("modality") == a).select("node_id", F.col("d").alias("degree_a"))
    return x.join(d.where(F.col("modality") == b).select("node_id", F.col("d").alias("degree_b")), "node_id")


def implicit_links(inc: DataFrame, source: str, target: str, bridges: list[str] | None = None) -> DataFrame:
    """(source_edge, target_edge, shared): edges of two modalities joined over shared nodes, that must be in a bridging modality if any are given."""
    rows = inc
    if bridges:
        rows = inc.join(inc.where(F.col("modality").isin(bridges)).select("node_id").distinct(), "node_id", "left_semi")
    s = rows.where(F.col("modality") == source).select("node_id", F.col("edge_id").alias("source_edge")).distinct()
    t = rows.where(F.col("modality") == target).select("node_id", F.col("edge_id").alias("target_edge")).distinct()
    return s.join(t, "node_id").groupBy("source_edge", "target_edge").agg(F.count("*").alias("shared"))


def modal_diversity(inc: DataFrame) -> DataFrame:
    """(node_id, diversity): entropy of the degree shares over log2 of the node's modalities, times its share of all modalities."""
    total = F.broadcast(inc.agg(F.countDistinct("modality").alias("all")))
    d = inc.groupBy("node_id", "modality").agg(F.count("*").alias("d"))
    p = F.col("d") / F.sum("d").over(Window.partitionBy("node_id"))
    g = d.select("node_id", p.alias("p")).groupBy("node_id").agg(F.sum(-F.col("p") * F.log2("p")).alias("h"), F.count("*").alias("k")).join(total)
    return g.select("node_id", (ratio(F.col("h"), F.log2("k")) * F.col("k") / F.col("all")).alias("diversity"))


def with_prefixes(parts: dict[str, DataFrame]) -> DataFrame:
    """Incidences of several modalities in one table; ids get the modality's prefix on edges only, so nodes meet."""
    out = None
    for m, df in parts.items():
        x = df.select(F.concat_ws("_E_", F.lit(m), "edge_id").alias("edge_id"), "node_id", "weight", F.lit(m).alias("modality"))
        out = x if out is None else out.unionByName(x)
    return out


# property indexes over (entity, layer, key, value)


def cross_layer_index(states: DataFrame, key: str) -> DataFrame:
    """(value, layer, entities) of one property."""
    return states.where(F.col("key") == key).groupBy("value", "layer").agg(F.array_sort(F.collect_set("entity")).alias("entities"))


def derive_contexts(states: DataFrame, confidence: float = 0.7, support: int = 2) -> DataFrame:
    """(key, value, count, confidence): values that enough entities hold."""
    n = F.broadcast(states.agg(F.countDistinct("entity").alias("n")))
    g = states.groupBy("key", "value").agg(F.countDistinct("entity").alias("count")).join(n)
    return g.select("key", "value", "count", ratio(F.col("count"), F.col("n")).alias("confidence")).where((F.col("count") >= support) & (F.col("confidence") >= confidence))


def property_cooccurrence(states: DataFrame) -> DataFrame:
    """(k1, k2, entities)."""
    r = states.select("entity", "key").distinct()
    return r.withColumnRenamed("key", "k1").join(r.withColumnRenamed("key", "k2"), "entity").where("k1 < k2").groupBy("k1", "k2").agg(F.count("*").alias("entities"))


def property_coverage(states: DataFrame) -> DataFrame:
    """(layer, key, coverage): the share of a layer's entities that have the property."""
    n = states.groupBy("layer").agg(F.countDistinct("entity").alias("n"))
    return states.groupBy("layer", "key").agg(F.countDistinct("entity").alias("c")).join(n, "layer").select("layer", "key", ratio(F.col("c"), F.col("n")).alias("coverage"))


def property_gaps(states: DataFrame, most_keys: int = 100_000) -> DataFrame:
    """(layer, key) that never occur together: over the distinct layers and at most ``most_keys`` distinct keys."""
    keys = states.select("key").distinct()
    if keys.limit(most_keys + 1).count() > most_keys:
        raise ValueError(f"more than {most_keys} keys")
    every = states.select("layer").distinct().join(F.broadcast(keys))
    return every.join(states.select("layer", "key").distinct(), ["layer", "key"], "left_anti")


def property_distribution(states: DataFrame, top: int = 10) -> DataFrame:
    """(layer, key, value, n, rank): the most frequent values."""
    g = states.groupBy("layer", "key", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("layer", "key").orderBy(F.desc("n"), "value")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def tag_clusters(tags: DataFrame, least: int = 2) -> DataFrame:
    """(tag, members, layers) of (entity, layer, tag)."""
    return tags.groupBy("tag").agg(F.countDistinct("layer", "entity").alias("members"), F.countDistinct("layer").alias("layers")).where(F.col("members") >= least)


def similar_by_tags(tags: DataFrame, entity: str, top: int = 10) -> DataFrame:
    """(entity, jaccard) of the tag sets, over 0."""
    t = tags.select("entity", "tag").distinct()
    mine = t.where(F.col("entity") == entity).select("tag")
    n = F.broadcast(mine.agg(F.count("*").alias("mine")))
    sizes = t.groupBy("entity").agg(F.count("*").alias("n"))
    s = t.where(F.col("entity") != entity).join(F.broadcast(mine), "tag").groupBy("entity").agg(F.count("*").alias("c")).join(sizes, "entity").join(n)
    return s.select("entity", ratio(F.col("c"), F.col("n") + F.col("mine") - F.col("c")).alias("jaccard")).orderBy(F.desc("jaccard"), "entity").limit(top)


# probabilistic states (entity, layer, state, probability)


def normalise_states(q: DataFrame) -> DataFrame:
    return q.withColumn("probability", ratio(F.col("probability"), F.sum("probability").over(Window.partitionBy("entity", "layer"))))


def dominant_state(q: DataFrame) -> DataFrame:
    w = Window.partitionBy("entity", "layer").orderBy(F.desc("probability"), "state")
    return q.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("entity", "layer", "state", "probability")


def collapse(q: DataFrame, seed: int = 1) -> DataFrame:
    """(entity, layer, state): one state drawn by probability; the draw hashes (seed, entity, layer)."""
    w = Window.partitionBy("entity", "layer").orderBy("state").rowsBetween(Window.unboundedPreceding, 0)
    c = normalise_states(q).withColumn("_c", F.sum("probability").over(w)).withColumn("_u", unit_hash(seed, F.col("entity"), F.col("layer")))
    return c.where("_c > _u OR abs(_c - 1) < 1e-12").groupBy("entity", "layer").agg(F.min_by("state", F.struct("_c", "state")).alias("state"))


def observe(states: DataFrame, contexts: DataFrame, q: DataFrame, seed: int = 1) -> DataFrame:
    """(entity, layer, state): the layer's own state, else an applicable context's, else a drawn one."""
    a = states.select("entity", "layer", F.col("state").alias("s1"))
    b = contexts.select("entity", "layer", F.col("state").alias("s2"))
    c = collapse(q, seed).withColumnRenamed("state", "s3")
    x = a.join(b, ["entity", "layer"], "full").join(c, ["entity", "layer"], "full")
    return x.select("entity", "layer", F.coalesce("s1", "s2", "s3").alias("state"))


def propagate(states: DataFrame, levels: DataFrame, start: str, up: bool = True) -> DataFrame:
    """(entity, layer, level, key, value): an entity's states in the layers above (or below) ``start`` by (layer, level)."""
    at = F.broadcast(levels.where(F.col("layer") == start).select(F.col("level").alias("_l")))
    x = states.join(F.broadcast(levels), "layer").join(at)
    return x.where(F.col("level") > F.col("_l") if up else F.col("level") < F.col("_l")).select("entity", "layer", "level", "key", "value")


def contradictions(states: DataFrame) -> DataFrame:
    """(entity, key, layer1, layer2, v1, v2): different values of one property in two layers."""
    x = states.select("entity", "key", F.col("layer").alias("layer1"), F.col("value").alias("v1"))
    y = states.select("entity", "key", F.col("layer").alias("layer2"), F.col("value").alias("v2"))
    return x.join(y, ["entity", "key"]).where("layer1 < layer2 AND v1 != v2")


def beliefs(q: DataFrame, rules: DataFrame) -> DataFrame:
    """States whose (layer, state) a rule (layer, state, confidence) names are multiplied by its confidence, then renormalised."""
    f = rules.groupBy("layer", "state").agg(F.exp(F.sum(F.log("confidence"))).alias("f"))
    return normalise_states(q.join(f, ["layer", "state"], "left").select("entity", "layer", "state", (F.col("probability") * F.coalesce("f", F.lit(1.0))).alias("probability")))
