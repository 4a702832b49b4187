"""Entity metadata with versions and JSON content, and audit queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(store: DataFrame, new: DataFrame) -> DataFrame:
    """Latest rows of (entity_id, entity_type, metadata, created_at, updated_at, version): a new row keeps created_at and adds one to the version; of repeated new rows the last counts."""
    last = Window.partitionBy("entity_id").orderBy(F.desc("updated_at"))
    n = new.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
    old = store.select("entity_id", F.col("created_at").alias("_c"), F.col("version").alias("_v"))
    merged = n.join(old, "entity_id", "left").select("entity_id", "entity_type", "metadata", F.coalesce("_c", "updated_at").alias("created_at"), "updated_at", (F.coalesce("_v", F.lit(0)) + 1).cast("int").alias("version"))
    return store.join(n.select("entity_id"), "entity_id", "left_anti").select(*merged.columns).unionByName(merged)


def query(store: DataFrame, filters: dict, entity_type: str | None = None) -> DataFrame:
    """AND of {key: value}, {key: {"equals": v}} and {key: {"contains": v}} over the JSON text; numbers compare as numbers."""
    out = store if entity_type is None else store.where(F.col("entity_type") == entity_type)
    for key, want in filters.items():
        got = F.get_json_object("metadata", f"$.{key}")
        kind, value = next(iter(want.items())) if isinstance(want, dict) else ("equals", want)
        if kind == "contains":
            out = out.where(F.contains(got, F.lit(str(value))))
        elif isinstance(value, bool):
            out = out.where(got == str(value).lower())
        elif isinstance(value, (int, float)):
            out = out.where(got.try_cast("double") == float(value))
        else:
            out = out.where(got == str(value))
    return out


def search_content(store: DataFrame, term: str) -> DataFrame:
    return store.where(F.contains(F.lower("metadata"), F.lit(term.lower())))


def counts(store: DataFrame) -> DataFrame:
    return store.groupBy("entity_type").agg(F.count("*").alias("entities"))


def find(entities: DataFrame, text: str | None = None, entity_type: str | None = None, properties: dict | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    out = query(entities, properties or {}, entity_type)
    if text:
        out = out.where(F.contains(F.lower("metadata"), F.lit(text.lower())) | F.contains(F.lower("entity_id"), F.lit(text.lower())))
    return out.orderBy("entity_id").offset(offset).limit(limit)


# audit and event queries


def query_events(events: DataFrame, equal: dict | None = None, any_of: dict | None = None, start=None, end=None, descending: bool = False, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Conjunctive filters, closed time range, order by time and id, then offset, then limit."""
    out = events
    for c, v in (equal or {}).items():
        out = out.where(F.col(c) == v)
    for c, vs in (any_of or {}).items():
        out = out.where(F.col(c).isin(list(vs)))
    if start is not None:
        out = out.where(F.col("ts") >= start)
    if end is not None:
        out = out.where(F.col("ts") <= end)
    out = out.orderBy(F.desc("ts") if descending else F.asc("ts"), "event_id")
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def audit_cube(events: DataFrame, dimensions: list[str], value: str) -> DataFrame:
    """All grouping sets of the dimensions: counts, users and sums."""
    return events.cube(*dimensions).agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.sum(value).alias("total"))


def top_users(events: DataFrame, n: int = 10) -> DataFrame:
    return events.groupBy("user_id").agg(F.count("*").alias("events")).orderBy(F.desc("events"), "user_id").limit(n)


def daily(events: DataFrame, key: str | None = None) -> DataFrame:
    keys = [F.to_date("ts").alias("day")] + ([F.col(key)] if key else [])
    return events.groupBy(*keys).agg(F.count("*").alias("events"))


def deviations(current: DataFrame, baseline: DataFrame, share: float = 0.3, least: int = 10) -> DataFrame:
    """(metric, value, expected): metrics (metric, value) further from the baseline than the larger of a share and a count."""
    x = current.join(F.broadcast(baseline.select("metric", F.col("value").alias("expected"))), "metric")
    return x.where(F.abs(F.col("value") - F.col("expected")) > F.greatest(F.lit(float(least)), share * F.col("expected"))).select("metric", "value", "expected")
