"""Graph events as Structured Streaming: parsing, deduplication, windows, an edge view, dead letters, replay.

The transformations take batch DataFrames just as well.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT = "event_id string, event_type string, ts timestamp, graph_id string, edge_id string, nodes array<string>, weight double, source string"


def read_files(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the JSON files that appear in a directory."""
    r = spark.readStream.schema(EVENT)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.json(path)


def read_kafka(spark: SparkSession, servers: str, topic: str, per_trigger: int | None = None) -> DataFrame:
    """A stream of JSON events from a topic; ``per_trigger`` bounds a batch, which is the back-pressure."""
    r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    if per_trigger:
        r = r.option("maxOffsetsPerTrigger", per_trigger)
    return parse(r.load().select(F.col("value").cast("string").alias("value")))


def parse(raw: DataFrame) -> DataFrame:
    """Events of JSON texts (value); a missing type is add_edge; texts that do not parse are left to ``dead_letters``."""
    e = raw.select(F.from_json("value", EVENT).alias("e")).select("e.*")
    return e.where("event_id IS NOT NULL AND ts IS NOT NULL").withColumn("event_type", F.coalesce("event_type", F.lit("add_edge")))


def dead_letters(raw: DataFrame) -> DataFrame:
    """(value, error) of the texts that ``parse`` leaves out."""
    e = F.from_json("value", EVENT)
    return raw.where(e["event_id"].isNull() | e["ts"].isNull()).select("value", F.when(e["event_id"].isNull(), "no event_id").otherwise("no timestamp").alias("error"))


def deduplicate(events: DataFrame, within: str = "5 seconds") -> DataFrame:
    """Each event id once; on a stream state is kept for ``within`` of event time, on a batch the first by time stays."""
    if events.isStreaming:
        return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(["event_id"])
    w = Window.partitionBy("event_id").orderBy("ts")
    return events.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def tumbling(events: DataFrame, size: str, late: str = "10 minutes", keys: tuple[str, ...] = ("event_type",), slide: str | None = None) -> DataFrame:
    """(start, end, keys, events): counts in tumbling or, with ``slide``, sliding windows."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return e.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "events")


def sessions(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes", key: str = "source") -> DataFrame:
    """(key, start, end, events) of runs of events less than ``gap`` apart."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("events"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def edge_view(events: DataFrame) -> DataFrame:
    """(edge_id, node_id, weight): the hypergraph after a batch of events: each edge's last add or modify, unless a removal follows."""
    w = Window.partitionBy("edge_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = events.where(F.col("event_type").isin("add_edge", "modify_edge", "remove_edge")).withColumn("_r", F.row_number().over(w)).where("_r = 1 AND event_type != 'remove_edge'")
    return last.select("edge_id", F.explode("nodes").alias("node_id"), F.coalesce("weight", F.lit(1.0)).alias("weight"))


def edge_state(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(edge_id, nodes, weight, live, version): a stream of each edge's state after every batch that touches it.

    State is one row an edge, kept by key; an event older than the state is ignored.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        nodes, weight, live, version, at, last = state.get if state.exists else ([], 1.0, False, 0, pd.Timestamp(0).to_pydatetime(), "")
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        for r in rows.itertuples(index=False):
            if (r.ts.to_pydatetime(), r.event_id) <= (at, last):
                continue
            at, last, version = r.ts.to_pydatetime(), r.event_id, version + 1
            live = r.event_type != "remove_edge"
            if live:
                nodes, weight = [str(n) for n in r.nodes], 1.0 if pd.isna(r.weight) else float(r.weight)
        state.update((list(nodes), float(weight), bool(live), int(version), at, last))
        yield pd.DataFrame({"edge_id": [key[0]], "nodes": [list(nodes)], "weight": [weight], "live": [live], "version": [version]})

    e = events.where(F.col("event_type").isin("add_edge", "modify_edge", "remove_edge"))
    return e.groupBy("edge_id").applyInPandasWithState(
        step, "edge_id string, nodes array<string>, weight double, live boolean, version long",
        "nodes array<string>, weight double, live boolean, version long, at timestamp, last string", "append", GroupStateTimeout.NoTimeout,
    )


def to_table(stream: DataFrame, path: str, checkpoint: str, dead: DataFrame | None = None, trigger: dict | None = None):
    """Append a stream to parquet files, exactly once by its checkpoint."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return w.trigger(**(trigger or {"availableNow": True})).start()


def each_batch(stream: DataFrame, handler, checkpoint: str, dead_letter=None, trigger: dict | None = None):
    """Run ``handler(batch, id)`` on every batch; a failing batch goes to ``dead_letter(batch, id, error)`` if there is one."""

    def run(batch: DataFrame, batch_id: int) -> None:
        try:
            handler(batch, batch_id)
        except Exception as e:
            if dead_letter is None:
                raise
            dead_letter(batch, batch_id, str(e))

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def replay(events: DataFrame, graph_id: str | None = None, start=None, end=None, types: list[str] | None = None) -> DataFrame:
    """Stored events in order."""
    out = events if graph_id is None else events.where(F.col("graph_id") == graph_id)
    if start is not None:
        out = out.where(F.col("ts") >= start)
    if end is not None:
        out = out.where(F.col("ts") <= end)
    if types is not None:
        out = out.where(F.col("event_type").isin(types))
    return out.orderBy("ts", "event_id")


def events_of_snapshots(t: DataFrame) -> DataFrame:
    """add_edge and remove_edge events between the snapshots of (ts, edge_id, node_id, weight)."""
    edges = t.groupBy("ts", "edge_id").agg(F.array_sort(F.collect_set("node_id")).alias("nodes"), F.max("weight").alias("weight"))
    order = t.select("ts").distinct().withColumn("i", F.row_number().over(Window.orderBy("ts")))
    x = edges.join(F.broadcast(order), "ts")
    nxt = x.select(F.col("edge_id"), (F.col("i") + 1).alias("i"), F.col("nodes").alias("old"))
    changed = x.join(nxt, ["edge_id", "i"], "left").where("old IS NULL OR old != nodes")
    adds = changed.select("ts", F.when(F.col("old").isNull(), "add_edge").otherwise("modify_edge").alias("event_type"), "edge_id", "nodes", "weight")
    gone = nxt.join(x.select("edge_id", "i"), ["edge_id", "i"], "left_anti").join(order, "i").select("ts", F.lit("remove_edge").alias("event_type"), "edge_id", F.array().cast("array<string>").alias("nodes"), F.lit(0.0).alias("weight"))
    return adds.unionByName(gone)


def retain(events: DataFrame, days: int, now) -> DataFrame:
    return events.where(F.col("ts") >= F.lit(now) - F.expr(f"INTERVAL {int(days)} DAYS"))


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """(graph_id, version, ts, state): the newest snapshot of every graph."""
    w = Window.partitionBy("graph_id").orderBy(F.desc("ts"), F.desc("version"))
    return snapshots.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def subscribe(events: DataFrame, edge: str | None = None, node: str | None = None, types: list[str] | None = None) -> DataFrame:
    """The events of one edge, of edges that hold one node, or of some types."""
    out = events if edge is None else events.where(F.col("edge_id") == edge)
    if node is not None:
        out = out.where(F.array_contains("nodes", node))
    return out if types is None else out.where(F.col("event_type").isin(types))


def to_events(rows: DataFrame, event_id: str, event_type, ts: str, edge: str, nodes, weight=None, graph_id: str = "g", source: str = "table") -> DataFrame:
    """Rows of a table as events; ``event_type``, ``nodes`` and ``weight`` are columns."""
    return rows.select(
        F.col(event_id).cast("string").alias("event_id"), event_type.alias("event_type"), F.col(ts).cast("timestamp").alias("ts"), F.lit(graph_id).alias("graph_id"),
        F.col(edge).cast("string").alias("edge_id"), nodes.alias("nodes"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("weight"), F.lit(source).alias("source"),
    )


def to_json(events: DataFrame) -> DataFrame:
    """(value): one JSON text an event, as ``parse`` reads them."""
    return events.select(F.to_json(F.struct(*[F.col(c) for c in events.columns]), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("value"))


def running_view(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Keep an edge view and the nodes' degrees up to date: one version of ``edges`` and ``degrees`` below ``path`` for each batch.

    A batch touches only its own edges: their old and new members change the
    degrees, which are not counted again. A batch that runs twice writes its
    version again from the one before.
    """
    from ..operators.basic import node_degrees
    from ..operators.centrality import incremental_degree

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        w = Window.partitionBy("edge_id").orderBy(F.desc("ts"), F.desc("event_id"))
        last = batch.where(F.col("event_type").isin("add_edge", "modify_edge", "remove_edge")).withColumn("_r", F.row_number().over(w)).where("_r = 1")
        last = last.select("edge_id", "nodes", F.coalesce("weight", F.lit(1.0)).alias("weight"), "ts", "event_id", (F.col("event_type") != "remove_edge").alias("live"))
        members = lambda edges: edges.where("live").select("edge_id", F.explode("nodes").alias("node_id"))
        if number == 0:
            edges, degrees = last, node_degrees(members(last))
        else:
            old = spark.read.parquet(f"{path}/edges/v{number - 1}")
            newer = last.join(old.select("edge_id", F.col("ts").alias("_t"), F.col("event_id").alias("_e")), "edge_id", "left").where("_t IS NULL OR struct(ts, event_id) > struct(_t, _e)").drop("_t", "_e")
            gone = old.join(newer.select("edge_id"), "edge_id", "left_semi")
            edges = old.join(newer.select("edge_id"), "edge_id", "left_anti").unionByName(newer)
            degrees = incremental_degree(spark.read.parquet(f"{path}/degrees/v{number - 1}"), members(newer), members(gone))
        edges.write.mode("overwrite").parquet(f"{path}/edges/v{number}")
        degrees.write.mode("overwrite").parquet(f"{path}/degrees/v{number}")

    return each_batch(stream, step, checkpoint, trigger=trigger)


def running_components(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Keep components of added edges up to date: one version of (node_id, component) below ``path`` for each batch.

    A batch's edges join the labels of their nodes, so only labels that it touches are worked on.
    """
    from ..operators.paths import connected_components

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.where(F.col("event_type") != "remove_edge").select("edge_id", F.explode("nodes").alias("node_id")).distinct()
        if number == 0:
            connected_components(rows).write.mode("overwrite").parquet(f"{path}/v0")
            return
        old = spark.read.parquet(f"{path}/v{number - 1}")
        named = rows.join(old, "node_id", "left").select("edge_id", "node_id", F.coalesce("component", "node_id").alias("label"))
        joined = connected_components(named.select("edge_id", F.col("label").alias("node_id"))).select(F.col("node_id").alias("label"), F.col("component").alias("to"))
        fresh = named.select("node_id", F.col("label").alias("component")).distinct().join(old.select("node_id"), "node_id", "left_anti")
        every = old.unionByName(fresh)
        every = every.join(joined, every["component"] == joined["label"], "left").select("node_id", F.coalesce("to", "component").alias("component"))
        every.write.mode("overwrite").parquet(f"{path}/v{number}")

    return each_batch(stream, step, checkpoint, trigger=trigger)


def progress(query) -> dict:
    """Batches, rows and rates of a streaming query so far."""
    seen = query.recentProgress
    return {"batches": len(seen), "rows": sum(p["numInputRows"] for p in seen), "rows_per_second": seen[-1]["processedRowsPerSecond"] if seen else 0.0}


def analytics(view: DataFrame) -> DataFrame:
    """(edges, nodes, incidences, avg_size, max_degree) of an edge view."""
    sizes = view.groupBy("edge_id").agg(F.count("*").alias("size"))
    degrees = view.groupBy("node_id").agg(F.countDistinct("edge_id").alias("degree"))
    e = sizes.agg(F.count("*").alias("edges"), F.coalesce(F.sum("size"), F.lit(0)).alias("incidences"), F.avg("size").alias("avg_size"))
    return e.join(degrees.agg(F.count("*").alias("nodes"), F.max("degree").alias("max_degree"))).select("edges", "nodes", "incidences", "avg_size", "max_degree")
