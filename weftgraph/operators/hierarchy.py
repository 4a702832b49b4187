"""Hierarchies (child, parent), levels (entity, level), cross-level queries and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ratio


def ancestry(tree: DataFrame, most_depth: int = 100) -> DataFrame:
    """(entity, ancestor, depth): every entity with each ancestor, nearest depth first found; cycles end at their start."""
    base = cut(tree.where("parent IS NOT NULL").select("child", "parent").distinct())
    known = new = base.select(F.col("child").alias("entity"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    for depth in range(2, most_depth + 1):
        step = new.join(base, new["ancestor"] == base["child"]).select("entity", F.col("parent").alias("ancestor"), F.lit(depth).alias("depth")).where("entity != ancestor").distinct()
        new = cut(step.join(known, ["entity", "ancestor"], "left_anti"))
        if new.isEmpty():
            return known
        known = cut(known.unionByName(new))
    return known


def descendants(tree: DataFrame, root: str) -> DataFrame:
    return ancestry(tree).where(F.col("ancestor") == root).select("entity", "depth")


def path_to_root(tree: DataFrame, entity: str) -> DataFrame:
    return ancestry(tree).where(F.col("entity") == entity).select("ancestor", "depth").orderBy("depth")


def siblings(tree: DataFrame) -> DataFrame:
    """(entity, sibling): different children of one parent."""
    x, y = tree.select("parent", F.col("child").alias("entity")), tree.select("parent", F.col("child").alias("sibling"))
    return x.join(y, "parent").where("entity != sibling").select("entity", "sibling").distinct()


def depths(tree: DataFrame) -> DataFrame:
    """(entity, depth): steps to the top; roots have 0."""
    all_ids = tree.select(F.col("child").alias("entity")).unionByName(tree.select(F.col("parent").alias("entity"))).where("entity IS NOT NULL").distinct()
    d = ancestry(tree).groupBy("entity").agg(F.max("depth").alias("depth"))
    return all_ids.join(d, "entity", "left").fillna(0, ["depth"])


def leaves(tree: DataFrame) -> DataFrame:
    return tree.select(F.col("child").alias("entity")).distinct().join(tree.select(F.col("parent").alias("entity")).distinct(), "entity", "left_anti")


def roots(tree: DataFrame) -> DataFrame:
    return tree.where("parent IS NOT NULL").select(F.col("parent").alias("entity")).distinct().join(tree.where("parent IS NOT NULL").select(F.col("child").alias("entity")).distinct(), "entity", "left_anti")


def common_ancestor(tree: DataFrame, a: str, b: str) -> DataFrame:
    """(ancestor): the nearest to b that is also above a, either of them included."""
    up = ancestry(tree)
    mine = lambda x: up.where(F.col("entity") == x).select("ancestor", "depth").unionByName(tree.sparkSession.createDataFrame([(x, 0)], "ancestor string, depth int"))
    return mine(b).join(mine(a).select("ancestor"), "ancestor", "left_semi").orderBy("depth").limit(1).select("ancestor")


def hierarchy_metrics(tree: DataFrame) -> DataFrame:
    """(entities, depth, breadth, balance): the deepest level, the widest, and the mean over the largest number of children."""
    d = depths(tree)
    per = d.groupBy("depth").agg(F.count("*").alias("n"))
    kids = tree.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("k")).agg(ratio(F.avg("k"), F.max("k")).alias("balance"))
    return per.agg(F.sum("n").alias("entities"), F.max("depth").alias("depth"), F.max("n").alias("breadth")).join(kids)


def roll_up(tree: DataFrame, values: DataFrame) -> DataFrame:
    """(entity, total, mean, largest, least, members) of (entity, value) over an entity and all below it."""
    up = ancestry(tree).select("entity", "ancestor")
    own = values.select("entity", F.col("entity").alias("ancestor")).distinct()
    x = values.join(up.unionByName(own), "entity")
    return x.groupBy(F.col("ancestor").alias("entity")).agg(F.sum("value").alias("total"), F.avg("value").alias("mean"), F.max("value").alias("largest"), F.min("value").alias("least"), F.count("*").alias("members"))


def level_links(edges: DataFrame, levels: DataFrame) -> DataFrame:
    """(a, b, level_a, level_b) of edges (a, b) with the ends' levels."""
    x = edges.join(levels.select(F.col("entity").alias("a"), F.col("level").alias("level_a")), "a")
    return x.join(levels.select(F.col("entity").alias("b"), F.col("level").alias("level_b")), "b").select("a", "b", "level_a", "level_b")


def cross_level(edges: DataFrame, levels: DataFrame, source: str, target: str) -> DataFrame:
    x = level_links(edges, levels)
    straight = x.where((F.col("level_a") == source) & (F.col("level_b") == target)).select("a", "b")
    return straight.unionByName(x.where((F.col("level_a") == target) & (F.col("level_b") == source)).select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def level_connectivity(edges: DataFrame, levels: DataFrame) -> DataFrame:
    """(level_a, level_b, links): levels in order, totals of one level and of all as nulls (a rollup)."""
    x = level_links(edges, levels).select(F.least("level_a", "level_b").alias("level_a"), F.greatest("level_a", "level_b").alias("level_b"))
    return x.rollup("level_a", "level_b").agg(F.count("*").alias("links"))


def aggregate_across(edges: DataFrame, levels: DataFrame, props: DataFrame, source: str, target: str, how: str = "sum") -> DataFrame:
    """(entity, key, value): for each target entity the numeric properties (id, key, value) of the linked source entities."""
    x = cross_level(edges, levels, source, target).join(props.select(F.col("id").alias("a"), "key", F.col("value").try_cast("double").alias("v")), "a")
    agg = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min, "count": F.count}[how]
    return x.groupBy(F.col("b").alias("entity"), "key").agg(agg("v").alias("value"))


def lineage(links: DataFrame, entity: str, direction: str = "both", most_depth: int = 10) -> DataFrame:
    """(entity, direction, depth): upstream and downstream of (source, target) links, at most ``most_depth`` steps."""
    from .paths import bfs

    start = links.sparkSession.createDataFrame([(entity,)], "source string")
    down = links.select(F.col("source").alias("a"), F.col("target").alias("b"))
    up = down.select(F.col("b").alias("a"), F.col("a").alias("b"))
    out = None
    for name, e in (("downstream", down), ("upstream", up)):
        if direction in ("both", name):
            r = bfs(e, start, most_depth).where("depth > 0").select(F.col("node").alias("entity"), F.lit(name).alias("direction"), "depth")
            out = r if out is None else out.unionByName(r)
    return out


def subtree(tree: DataFrame, root: str) -> DataFrame:
    """(child, parent): the links below an entity."""
    below = descendants(tree, root).select(F.col("entity").alias("child"))
    return tree.join(below, "child", "left_semi").select("child", "parent")


def level_centrality(edges: DataFrame, levels: DataFrame) -> DataFrame:
    """(entity, level, within, across, score): links inside and out of an entity's level; score is the share of its level's other entities it links to."""
    x = level_links(edges, levels)
    both = x.select(F.col("a").alias("entity"), F.col("level_a").alias("level"), "b", F.col("level_b").alias("other")).unionByName(x.select(F.col("b").alias("entity"), F.col("level_b").alias("level"), F.col("a").alias("b"), F.col("level_a").alias("other")))
    g = both.groupBy("entity", "level").agg(F.countDistinct(F.when(F.col("level") == F.col("other"), F.col("b"))).alias("within"), F.countDistinct(F.when(F.col("level") != F.col("other"), F.col("b"))).alias("across"))
    n = levels.groupBy("level").agg(F.countDistinct("entity").alias("n"))
    every = levels.select("entity", "level").distinct().join(g, ["entity", "level"], "left").fillna(0, ["within", "across"]).join(F.broadcast(n), "level")
    return every.select("entity", "level", "within", "across", ratio(F.col("within"), F.col("n") - 1).alias("score"))


def level_communities(edges: DataFrame, levels: DataFrame) -> DataFrame:
    """(entity, level, community): components of each level's own links."""
    from .paths import connected_components

    own = level_links(edges, levels).where("level_a = level_b")
    inc = own.select(F.concat_ws("|", "a", "b").alias("edge_id"), F.explode(F.array("a", "b")).alias("node_id"))
    comp = connected_components(inc).withColumnRenamed("node_id", "entity")
    return levels.select("entity", "level").distinct().join(comp, "entity", "left").select("entity", "level", F.coalesce("component", "entity").alias("community"))


def search_levels(entities: DataFrame, levels: DataFrame, text: str, filters: dict | None = None, only: list[str] | None = None) -> DataFrame:
    """(id, name, level, score): the search of names, in chosen levels, of entities whose columns have the filters' values."""
    from ..plans.knowledge import search

    for column, value in (filters or {}).items():
        entities = entities.where(F.col(column).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
    hits = search(entities, text).join(levels.select(F.col("entity").alias("id"), "level"), "id")
    return (hits if only is None else hits.where(F.col("level").isin(only))).select("id", "name", "level", "score")


def search_summary(hits: DataFrame) -> DataFrame:
    """(level, hits, best, mean) of ``search_levels``."""
    return hits.groupBy("level").agg(F.count("*").alias("hits"), F.max("score").alias("best"), F.avg("score").alias("mean"))
