"""Snapshots, evolution, as-of lookups, sessions and periodicity.

A temporal hypergraph is an incidence table with a snapshot column ``ts``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ratio


def snapshot_index(t: DataFrame) -> DataFrame:
    """(ts, i): snapshots in order, from 0. One row each."""
    return t.select("ts").distinct().withColumn("i", F.row_number().over(Window.orderBy("ts")) - 1)


def degree_evolution(t: DataFrame) -> DataFrame:
    """(ts, node_id, degree, share): row count of a node, and divided by the snapshot's edges."""
    m = t.groupBy("ts").agg(F.countDistinct("edge_id").alias("m"))
    d = t.groupBy("ts", "node_id").agg(F.count("*").alias("degree"))
    return d.join(m, "ts").select("ts", "node_id", "degree", ratio(F.col("degree"), F.col("m")).alias("share"))


def s_centrality_evolution(t: DataFrame, s: int = 1) -> DataFrame:
    sizes = t.groupBy("ts", "edge_id").agg(F.count("*").alias("size"))
    top = sizes.groupBy("ts").agg((F.count("*") * F.pow(F.max("size") - 1, s)).alias("top"))
    raw = t.join(sizes, ["ts", "edge_id"]).groupBy("ts", "node_id").agg(F.sum(F.pow(F.col("size") - 1, s)).alias("raw"))
    return raw.join(top, "ts").select("ts", "node_id", ratio(F.col("raw"), F.col("top")).alias("score"))


def growth(t: DataFrame, smoothing: int = 1) -> DataFrame:
    """(ts, num_nodes, num_edges, avg_size, density, node_growth, edge_growth[, smoothed]): change over the snapshot before, 0 for the first."""
    g = t.groupBy("ts").agg(F.countDistinct("node_id").alias("num_nodes"), F.countDistinct("edge_id").alias("num_edges"), F.count("*").alias("rows"))
    w = Window.orderBy("ts")
    change = lambda c: F.coalesce(ratio(F.col(c) - F.lag(c).over(w), F.lag(c).over(w)), F.lit(0.0))
    g = g.select("ts", "num_nodes", "num_edges", ratio(F.col("rows"), F.col("num_edges")).alias("avg_size"), ratio(F.col("rows"), F.col("num_nodes") * F.col("num_edges")).alias("density"), change("num_nodes").alias("node_growth"), change("num_edges").alias("edge_growth"))
    if smoothing > 1:
        k = w.rowsBetween(1 - smoothing, 0)
        for c in ("node_growth", "edge_growth"):
            g = g.withColumn(f"{c}_smoothed", F.when(F.count(c).over(k) == smoothing, F.avg(c).over(k)))
    return g


def persistence(t: DataFrame, entity: str = "node_id") -> DataFrame:
    """(entity, first, last, appearances, lifespan, persistence, intermittency): shares of the snapshots in its lifespan and of all."""
    idx = snapshot_index(t)
    n = F.broadcast(idx.agg(F.count("*").alias("n")))
    p = t.select("ts", entity).distinct().join(F.broadcast(idx), "ts").groupBy(entity).agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count("*").alias("appearances"))
    p = p.join(n).withColumn("lifespan", F.col("last") - F.col("first") + 1)
    return p.select(entity, "first", "last", "appearances", "lifespan", (F.col("appearances") / F.col("n")).alias("persistence"), (1 - F.col("appearances") / F.col("lifespan")).alias("intermittency"))


def snapshot_jaccard(t: DataFrame, entity: str = "edge_id", window: int = 2) -> DataFrame:
    """(i, j, jaccard): similarity of the entity sets of snapshots less than ``window`` apart."""
    idx = snapshot_index(t)
    rows = t.select("ts", entity).distinct().join(F.broadcast(idx), "ts").select("i", entity)
    sizes = rows.groupBy("i").agg(F.count("*").alias("n"))
    near = rows.select("i", entity, F.explode(F.sequence(F.col("i") + 1, F.col("i") + window - 1)).alias("j")) if window > 1 else rows.limit(0).withColumn("j", F.col("i"))
    shared = near.join(rows.select(F.col("i").alias("j"), entity), ["j", entity]).groupBy("i", "j").agg(F.count("*").alias("shared"))
    pairs = sizes.select("i", F.col("n").alias("ni"), F.explode(F.sequence(F.col("i") + 1, F.col("i") + window - 1)).alias("j")).join(sizes.select(F.col("i").alias("j"), F.col("n").alias("nj")), "j")
    return pairs.join(shared, ["i", "j"], "left").select("i", "j", (F.coalesce("shared", F.lit(0)) / (F.col("ni") + F.col("nj") - F.coalesce("shared", F.lit(0)))).alias("jaccard"))


def stability(t: DataFrame, window: int = 3, entity: str = "edge_id") -> DataFrame:
    """(middle, stability): the mean pairwise similarity inside every run of ``window`` snapshots, by its middle one's index."""
    p = snapshot_jaccard(t, entity, window)
    last = F.broadcast(snapshot_index(t).agg(F.max("i").alias("last")))
    starts = p.select("jaccard", F.explode(F.sequence(F.col("j") - window + 1, F.col("i"))).alias("start")).join(last)
    inside = starts.where((F.col("start") >= 0) & (F.col("start") + window - 1 <= F.col("last")))
    return inside.groupBy("start").agg(F.avg("jaccard").alias("stability")).select((F.col("start") + window // 2).alias("middle"), "stability")


def size_motifs(t: DataFrame, sizes: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """(ts, k, edges, share): the number and share of edges of each size."""
    s = t.groupBy("ts", "edge_id").agg(F.countDistinct("node_id").alias("k"))
    total = s.groupBy("ts").agg(F.count("*").alias("total"))
    ks = total.withColumn("k", F.explode(F.array(*[F.lit(k).cast("long") for k in sizes])))
    n = s.groupBy("ts", "k").agg(F.count("*").alias("edges"))
    return ks.join(n, ["ts", "k"], "left").select("ts", "k", F.coalesce("edges", F.lit(0)).alias("edges"), ratio(F.coalesce("edges", F.lit(0)), F.col("total")).alias("share"))


def edge_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(overlap): the mean over all edges of either side of the Jaccard of their members."""
    x = a.select("edge_id", "node_id").distinct().withColumn("l", F.lit(1))
    y = b.select("edge_id", "node_id").distinct().withColumn("r", F.lit(1))
    both = x.join(y, ["edge_id", "node_id"], "full").groupBy("edge_id").agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"), F.count("*").alias("either"))
    return both.agg(F.coalesce(F.avg(F.col("both") / F.col("either")), F.lit(0.0)).alias("overlap"))


def set_jaccard(a: DataFrame, b: DataFrame, entity: str) -> DataFrame:
    """(jaccard) of the two sides' sets of ids."""
    x = a.select(entity).distinct().withColumn("l", F.lit(1))
    y = b.select(entity).distinct().withColumn("r", F.lit(1))
    return x.join(y, entity, "full").agg(ratio(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()), F.count("*")).alias("jaccard"))


# views over versions and events


def as_of(states: DataFrame, at, keys: tuple[str, ...] = ("entity_id",), ts: str = "ts", order: tuple[str, ...] = ()) -> DataFrame:
    """The latest state of every key at or before ``at``; ties by ``order``, descending."""
    w = Window.partitionBy(*keys).orderBy(F.desc(ts), *[F.desc(c) for c in order])
    return states.where(F.col(ts) <= at).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def as_of_join(left: DataFrame, right: DataFrame, keys: tuple[str, ...], ts: str, right_ts: str) -> DataFrame:
    """Every left row with the right row of its keys that has the greatest ``right_ts`` <= ``ts``.

    One sort by (keys, time) over the union of both sides carries the last right row forward, so no pairs are made.
    """
    payload = [c for c in right.columns if c not in keys]
    l = left.withColumn("_t", F.col(ts)).withColumn("_side", F.lit(1)).withColumn("_p", F.lit(None).cast(right.select(F.struct(*payload)).schema[0].dataType))
    r = right.select(*keys, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.struct(*payload).alias("_p"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_last", F.last("_p", ignorenulls=True).over(w)).where("_side = 1")
    return carried.select(*left.columns, *[F.col(f"_last.{c}").alias(c if c not in left.columns else f"right_{c}") for c in payload])


def in_range(t: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    return t.where(F.col(ts).between(start, end))


def overlaps(a_start, a_end, b_start, b_end):
    """Whether two closed intervals share a point."""
    return ~((a_end < b_start) | (a_start > b_end))


def view(t: DataFrame, how: str = "union") -> DataFrame:
    """One hypergraph of all snapshots: ``union`` keeps each incidence's last row, ``intersection`` edges of every snapshot with their last members, ``latest`` the last snapshot."""
    if how == "latest":
        return t.join(F.broadcast(t.agg(F.max("ts").alias("ts"))), "ts").drop("ts")
    last = Window.partitionBy("edge_id", "node_id").orderBy(F.desc("ts"))
    if how == "union":
        return t.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "ts")
    if how == "intersection":
        n = F.broadcast(t.agg(F.countDistinct("ts").alias("n")))
        edges = t.groupBy("edge_id").agg(F.countDistinct("ts").alias("c"), F.max("ts").alias("ts")).join(n).where("c = n").select("edge_id", "ts")
        return t.join(edges, ["edge_id", "ts"]).drop("ts")
    raise ValueError(how)


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(op, edge_id, node_id, weight): incidences added and removed."""
    cols = ["edge_id", "node_id", "weight"]
    o, n = old.select(*cols), new.select(*cols)
    return n.exceptAll(o).select(F.lit("add").alias("op"), *cols).unionByName(o.exceptAll(n).select(F.lit("remove").alias("op"), *cols))


def invert_delta(d: DataFrame) -> DataFrame:
    return d.withColumn("op", F.when(F.col("op") == "add", "remove").otherwise("add"))


def evolution_metrics(t: DataFrame) -> DataFrame:
    """(metric, mean, std): population statistics of the changes of nodes, edges and rows from snapshot to snapshot."""
    g = t.groupBy("ts").agg(F.countDistinct("node_id").alias("nodes"), F.countDistinct("edge_id").alias("edges"), F.count("*").alias("rows"))
    w = Window.orderBy("ts")
    names = ("nodes", "edges", "rows")
    d = g.select(*[(F.col(c) - F.lag(c).over(w)).alias(c) for c in names])
    long = d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in names])).alias("x")).select("x.*").where("v IS NOT NULL")
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def periodicity(series: DataFrame, least: int = 2, most: int = 9, below: float = 2.0) -> DataFrame:
    """(period, difference): periods whose mean |x_i - x_{i+p}| of (i, value) is under ``below``."""
    out = series.select("i", "value", F.explode(F.sequence(F.lit(least), F.lit(most))).alias("period"))
    other = series.select(F.col("i").alias("j"), F.col("value").alias("w"))
    p = out.join(other, F.col("j") == F.col("i") + F.col("period"))
    return p.groupBy("period").agg(F.avg(F.abs(F.col("value") - F.col("w"))).alias("difference")).where(F.col("difference") < below)


# events


def seconds_of(ts: str):
    """Seconds since 1970 as the clock shows them, whatever the session's time zone."""
    return F.unix_date(F.to_date(ts)) * 86400.0 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.date_part(F.lit("SECOND"), F.col(ts)).cast("double")


def timeline(events: DataFrame, entity: str, value, start=None, end=None, operations: list | None = None, limit: int | None = None) -> DataFrame:
    out = events.where(F.col(entity) == value)
    if start is not None:
        out = out.where(F.col("ts") >= start)
    if end is not None:
        out = out.where(F.col("ts") <= end)
    if operations is not None:
        out = out.where(F.col("operation").isin(operations))
    out = out.orderBy(F.desc("ts"))
    return out if limit is None else out.limit(limit)


def bursts(events: DataFrame, key: str, gap_seconds: int = 300, least: int = 2) -> DataFrame:
    """(key, session, start, end, events): runs of events no more than ``gap_seconds`` apart, of at least ``least`` events."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    seconds = seconds_of("ts")
    gap = seconds - F.lag(seconds).over(w)
    s = events.withColumn("_new", F.when(gap.isNull() | (gap > gap_seconds), 1).otherwise(0))
    s = s.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(key, "session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("events")).where(F.col("events") >= least)


def periodic(events: DataFrame, keys: tuple[str, ...], least: int = 3, below: float = 0.3) -> DataFrame:
    """(keys, gaps, mean_gap, variation): keys whose gaps between events vary by less than ``below`` of their mean (population)."""
    w = Window.partitionBy(*keys).orderBy("ts", "event_id")
    seconds = seconds_of("ts")
    g = events.withColumn("gap", seconds - F.lag(seconds).over(w)).groupBy(*keys).agg(F.count("*").alias("events"), F.count("gap").alias("gaps"), F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("sd"))
    return g.where((F.col("events") >= least) & (F.col("mean_gap") > 0)).withColumn("variation", F.col("sd") / F.col("mean_gap")).where(F.col("variation") < below).drop("sd", "events")


def gap_statistics(events: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return periodic(events, keys, 2, float("inf"))


def sequences(events: DataFrame, key: str, operation: str, least: int = 2) -> DataFrame:
    """(key, operations, length): the operations of each key in time order; a key's events are gathered in one row."""
    s = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.col(operation).alias("op")))).alias("x"))
    return s.select(key, F.transform("x", lambda v: v["op"]).alias("operations"), F.size("x").alias("length")).where(F.col("length") >= least)


def transitions(events: DataFrame, key: str, operation: str) -> DataFrame:
    """(a, b, n): how often operation b follows a within a key."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    return events.select(F.col(operation).alias("a"), F.lead(operation).over(w).alias("b")).where("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"))


def seasonality(series: DataFrame, lag: int = 7, least: int = 14, above: float = 0.5) -> DataFrame:
    """(n, autocorrelation, seasonal) of (i, value) at the lag."""
    w = Window.orderBy("i")
    mu = F.broadcast(series.agg(F.avg("value").alias("mu"), F.count("*").alias("n")))
    d = series.join(mu).select("n", (F.col("value") - F.col("mu")).alias("d"), (F.lag("value", lag).over(w) - F.col("mu")).alias("p"))
    a = d.agg(F.max("n").alias("n"), ratio(F.sum(F.col("d") * F.col("p")), F.sum(F.col("d") * F.col("d"))).alias("autocorrelation"))
    return a.withColumn("seasonal", (F.col("n") >= least) & (F.abs("autocorrelation") > above))


def trend(series: DataFrame) -> DataFrame:
    """(slope, intercept, r2) of (i, value)."""
    return series.agg(F.regr_slope("value", "i").alias("slope"), F.regr_intercept("value", "i").alias("intercept"), F.regr_r2("value", "i").alias("r2"))


def forecast(series: DataFrame, steps: int) -> DataFrame:
    """(i, value, low, high): the trend line ``steps`` on, with 1.96 residual deviations."""
    fit = series.agg(F.regr_slope("value", "i").alias("s"), F.regr_intercept("value", "i").alias("b"), F.max("i").alias("last"))
    res = series.join(F.broadcast(fit)).agg(F.coalesce(F.stddev_samp(F.col("value") - F.col("s") * F.col("i") - F.col("b")), F.lit(0.0)).alias("sd"))
    ahead = fit.join(res).withColumn("i", F.explode(F.sequence(F.col("last") + 1, F.col("last") + steps)))
    v = F.col("s") * F.col("i") + F.col("b")
    return ahead.select("i", v.alias("value"), (v - 1.96 * F.col("sd")).alias("low"), (v + 1.96 * F.col("sd")).alias("high"))
