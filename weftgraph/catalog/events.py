"""Temporal queries on the events table: daily hypergraphs of users (edges) over event types (nodes), sessions, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry, layers, metadata, temporal
from ..streaming import events as stream
from .registry import Registry

PRELUDE = """
WITH RECURSIVE ev AS (SELECT event_id, ts, user_id, event_type, value, props, CAST(ts AS DATE) AS day FROM events),
t AS (SELECT day AS ts, CAST(user_id AS VARCHAR) AS edge_id, event_type AS node_id, count(*) AS weight FROM ev GROUP BY 1, 2, 3),
snap AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i FROM (SELECT DISTINCT ts FROM t)),
daily AS (SELECT i, n AS value FROM snap JOIN (SELECT day AS ts, CAST(count(*) AS DOUBLE) AS n FROM ev GROUP BY 1) USING (ts))
"""
REGISTRY = Registry(PRELUDE)
q = REGISTRY.add


def clock(text: str):
    return F.lit(text).cast("timestamp_ntz")


def shown(column: str, name: str):
    """A timestamp's digits, which no time zone changes."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


def raw(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    g = raw(spark, d).groupBy(F.to_date("ts").alias("ts"), F.col("user_id").cast("string").alias("edge_id"), F.col("event_type").alias("node_id"))
    return g.agg(F.count("*").cast("double").alias("weight"))


def daily_series(spark: SparkSession, d: str) -> DataFrame:
    n = raw(spark, d).groupBy(F.to_date("ts").alias("ts")).agg(F.count("*").cast("double").alias("value"))
    return temporal.snapshot_index(n).join(n, "ts").select("i", "value")


@q("temporal_degree_evolution", "SELECT CAST(ts AS VARCHAR) AS ts, node_id, count(*) AS degree, round(count(*) / (SELECT count(DISTINCT edge_id) FROM t x WHERE x.ts = t.ts), 6) AS share FROM t GROUP BY ts, node_id")
def _(spark, d):
    return temporal.degree_evolution(snapshots(spark, d)).withColumn("ts", F.col("ts").cast("string"))


@q("temporal_s_centrality", """, s AS (SELECT ts, edge_id, count(*) AS size FROM t GROUP BY 1, 2), top AS (SELECT ts, count(*) * (max(size) - 1) AS top FROM s GROUP BY 1)
SELECT CAST(ts AS VARCHAR) AS ts, node_id, round(sum(size - 1) / any_value(top), 6) AS score FROM t JOIN s USING (ts, edge_id) JOIN top USING (ts) GROUP BY 1, 2""")
def _(spark, d):
    return temporal.s_centrality_evolution(snapshots(spark, d)).withColumn("ts", F.col("ts").cast("string"))


_GROWTH = """, g AS (SELECT ts, count(DISTINCT node_id) AS num_nodes, count(DISTINCT edge_id) AS num_edges, count(*) AS n FROM t GROUP BY 1),
h AS (SELECT *, coalesce((num_nodes - lag(num_nodes) OVER w) / lag(num_nodes) OVER w, 0) AS ng, coalesce((num_edges - lag(num_edges) OVER w) / lag(num_edges) OVER w, 0) AS eg FROM g WINDOW w AS (ORDER BY ts))"""


@q("growth", _GROWTH + " SELECT CAST(ts AS VARCHAR) AS ts, num_nodes, num_edges, round(n / num_edges, 6) AS avg_size, round(n / (num_nodes * num_edges), 6) AS density, round(ng, 6) AS node_growth, round(eg, 6) AS edge_growth FROM h")
def _(spark, d):
    return temporal.growth(snapshots(spark, d)).withColumn("ts", F.col("ts").cast("string"))


@q("growth_smoothed", _GROWTH + """ SELECT CAST(ts AS VARCHAR) AS ts, round(CASE WHEN count(*) OVER k = 3 THEN avg(ng) OVER k END, 6) AS node_growth_smoothed, round(CASE WHEN count(*) OVER k = 3 THEN avg(eg) OVER k END, 6) AS edge_growth_smoothed
FROM h WINDOW k AS (ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    return temporal.growth(snapshots(spark, d), 3).select(F.col("ts").cast("string").alias("ts"), "node_growth_smoothed", "edge_growth_smoothed")


@q("persistence", """SELECT edge_id, min(i) AS first, max(i) AS last, count(*) AS appearances, max(i) - min(i) + 1 AS lifespan, round(count(*) / (SELECT count(*) FROM snap), 6) AS persistence,
round(1 - count(*) / (max(i) - min(i) + 1), 6) AS intermittency FROM (SELECT DISTINCT ts, edge_id FROM t) JOIN snap USING (ts) GROUP BY 1""")
def _(spark, d):
    return temporal.persistence(snapshots(spark, d), "edge_id")


_JACCARD = """, m AS (SELECT DISTINCT i, edge_id FROM t JOIN snap USING (ts)), c AS (SELECT i, count(*) AS n FROM m GROUP BY 1),
p AS (SELECT a.i, b.i AS j, a.n AS ni, b.n AS nj, (SELECT count(*) FROM m x JOIN m y USING (edge_id) WHERE x.i = a.i AND y.i = b.i) AS s FROM c a JOIN c b ON b.i > a.i AND b.i < a.i + {w})"""


@q("snapshot_jaccard", _JACCARD.format(w=2) + " SELECT i, j, round(s / (ni + nj - s), 6) AS jaccard FROM p")
def _(spark, d):
    return temporal.snapshot_jaccard(snapshots(spark, d))


@q("stability_jaccard", _JACCARD.format(w=3) + """ SELECT k + 1 AS middle, round(avg(s / (ni + nj - s)), 6) AS stability FROM (SELECT i AS k FROM snap WHERE i + 2 <= (SELECT max(i) FROM snap)) JOIN p ON i >= k AND j <= k + 2 GROUP BY k""")
def _(spark, d):
    return temporal.stability(snapshots(spark, d))


@q("temporal_motifs", """, s AS (SELECT ts, edge_id, count(DISTINCT node_id) AS k FROM t GROUP BY 1, 2) SELECT CAST(ts AS VARCHAR) AS ts, kk AS k, count(*) FILTER (k = kk) AS edges, round(count(*) FILTER (k = kk) / count(*), 6) AS share
FROM s, (SELECT CAST(unnest([2, 3, 4]) AS BIGINT) AS kk) GROUP BY 1, 2""")
def _(spark, d):
    return temporal.size_motifs(snapshots(spark, d)).withColumn("ts", F.col("ts").cast("string"))


@q("snapshot_edge_overlap", """, a AS (SELECT edge_id, node_id FROM t JOIN snap USING (ts) WHERE i = 0), b AS (SELECT edge_id, node_id FROM t JOIN snap USING (ts) WHERE i = 1)
SELECT round(avg(o), 6) AS overlap FROM (SELECT edge_id, count(*) FILTER (x AND y) / count(*) AS o FROM (SELECT edge_id, node_id, bool_or(x) AS x, bool_or(y) AS y FROM (SELECT *, true AS x, false AS y FROM a UNION ALL SELECT *, false, true FROM b) GROUP BY 1, 2) GROUP BY 1)""")
def _(spark, d):
    t = snapshots(spark, d).join(F.broadcast(temporal.snapshot_index(snapshots(spark, d))), "ts")
    return temporal.edge_overlap(t.where("i = 0"), t.where("i = 1"))


@q("snapshot_asof", """SELECT user_id, event_id, event_type, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM ev WHERE ts <= TIMESTAMP '2024-01-15 00:00:00') WHERE r = 1""")
def _(spark, d):
    return temporal.as_of(raw(spark, d), clock("2024-01-15 00:00:00"), ("user_id",), order=("event_id",)).select("user_id", "event_id", "event_type", "value")


@q("asof_join_purchases", """SELECT a.event_id, a.user_id, b.event_id AS before_id FROM (SELECT * FROM ev WHERE event_type = (SELECT max(event_type) FROM ev)) a ASOF LEFT JOIN
(SELECT user_id, ts, max(event_id) AS event_id FROM ev WHERE event_type = (SELECT min(event_type) FROM ev) GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def _(spark, d):
    e = raw(spark, d)
    ends = e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi")).first()
    left = e.where(F.col("event_type") == ends["hi"]).select("event_id", "user_id", "ts")
    right = e.where(F.col("event_type") == ends["lo"]).groupBy("user_id", F.col("ts").alias("t")).agg(F.max("event_id").alias("before_id"))
    return temporal.as_of_join(left, right, ("user_id",), "ts", "t").select("event_id", "user_id", "before_id")


@q("interval_snapshots", "SELECT CAST(ts AS VARCHAR) AS ts, edge_id, node_id, CAST(weight AS DOUBLE) AS weight FROM t WHERE ts BETWEEN DATE '2024-01-05' AND DATE '2024-01-10'")
def _(spark, d):
    return temporal.in_range(snapshots(spark, d), F.lit("2024-01-05").cast("date"), F.lit("2024-01-10").cast("date")).withColumn("ts", F.col("ts").cast("string"))


@q("temporal_view_union", "SELECT edge_id, node_id, CAST(arg_max(weight, ts) AS DOUBLE) AS weight FROM t GROUP BY 1, 2")
def _(spark, d):
    return temporal.view(snapshots(spark, d)).select("edge_id", "node_id", "weight")


@q("temporal_view_intersection", """, e AS (SELECT edge_id, max(ts) AS ts FROM t GROUP BY 1 HAVING count(DISTINCT ts) = (SELECT count(DISTINCT ts) FROM t)) SELECT edge_id, node_id, CAST(weight AS DOUBLE) AS weight FROM t JOIN e USING (edge_id, ts)""")
def _(spark, d):
    return temporal.view(snapshots(spark, d), "intersection").select("edge_id", "node_id", "weight")


@q("temporal_view_latest", "SELECT edge_id, node_id, CAST(weight AS DOUBLE) AS weight FROM t WHERE ts = (SELECT max(ts) FROM t)")
def _(spark, d):
    return temporal.view(snapshots(spark, d), "latest").select("edge_id", "node_id", "weight")


@q("snapshot_delta", """, o AS (SELECT edge_id, node_id, weight FROM t JOIN snap USING (ts) WHERE i = 0), n AS (SELECT edge_id, node_id, weight FROM t JOIN snap USING (ts) WHERE i = 1)
SELECT 'add' AS op, edge_id, node_id, CAST(weight AS DOUBLE) AS weight FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o) UNION ALL SELECT 'remove', edge_id, node_id, CAST(weight AS DOUBLE) FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n)""")
def _(spark, d):
    t = snapshots(spark, d).join(F.broadcast(temporal.snapshot_index(snapshots(spark, d))), "ts")
    return temporal.invert_delta(temporal.delta(t.where("i = 1"), t.where("i = 0")))


@q("evolution_metrics", """, g AS (SELECT ts, count(DISTINCT node_id) AS nodes, count(DISTINCT edge_id) AS edges, count(*) AS n FROM t GROUP BY 1), l AS (SELECT nodes - lag(nodes) OVER w AS nodes, edges - lag(edges) OVER w AS edges, n - lag(n) OVER w AS n FROM g WINDOW w AS (ORDER BY ts))
SELECT 'nodes' AS metric, round(avg(nodes), 6) AS mean, round(stddev_pop(nodes), 6) AS std FROM l UNION ALL SELECT 'edges', round(avg(edges), 6), round(stddev_pop(edges), 6) FROM l UNION ALL SELECT 'rows', round(avg(n), 6), round(stddev_pop(n), 6) FROM l""")
def _(spark, d):
    return temporal.evolution_metrics(snapshots(spark, d))


@q("periodicity", "SELECT p AS period, round(avg(abs(a.value - b.value)), 6) AS difference FROM daily a, (SELECT CAST(unnest(range(2, 10)) AS BIGINT) AS p) JOIN daily b ON b.i = a.i + p GROUP BY 1 HAVING avg(abs(a.value - b.value)) < 1000")
def _(spark, d):
    return temporal.periodicity(daily_series(spark, d), below=1000)


@q("burst_sessions", """, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOURS THEN 0 ELSE 1 END AS n FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS "end" FROM s GROUP BY 1, 2 HAVING count(*) >= 2""")
def _(spark, d):
    b = temporal.bursts(raw(spark, d), "user_id", 6 * 3600)
    return b.select("user_id", "session", "events", shown("start", "start"), shown("end", "end"))


@q("periodic_access", """, g AS (SELECT user_id, event_type, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS gap FROM ev)
SELECT user_id, event_type, count(gap) AS gaps, round(avg(gap), 3) AS mean_gap, round(stddev_pop(gap) / avg(gap), 6) AS variation FROM g GROUP BY 1, 2 HAVING count(*) >= 3 AND avg(gap) > 0 AND stddev_pop(gap) / avg(gap) < 0.9""")
def _(spark, d):
    return temporal.periodic(raw(spark, d), ("user_id", "event_type"), 3, 0.9).withColumn("mean_gap", F.round("mean_gap", 3))


@q("op_sequences", "SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS operations, count(*) AS length FROM ev GROUP BY 1 HAVING count(*) >= 2")
def _(spark, d):
    return temporal.sequences(raw(spark, d), "user_id", "event_type").withColumn("operations", F.array_join("operations", ">"))


@q("op_transitions", "SELECT a, b, count(*) AS n FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM ev) WHERE b IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return temporal.transitions(raw(spark, d), "user_id", "event_type")


@q("entity_timeline", "SELECT event_id, event_type FROM ev WHERE user_id = 1 AND ts >= TIMESTAMP '2024-01-10 00:00:00' ORDER BY ts DESC LIMIT 20")
def _(spark, d):
    e = raw(spark, d).withColumnRenamed("event_type", "operation")
    return temporal.timeline(e, "user_id", 1, start=clock("2024-01-10 00:00:00"), limit=20).select("event_id", F.col("operation").alias("event_type"))


@q("seasonality", """, m AS (SELECT avg(value) AS mu, count(*) AS n FROM daily), x AS (SELECT i, value - mu AS d, lag(value, 7) OVER (ORDER BY i) - mu AS p FROM daily, m)
SELECT (SELECT n FROM m) AS n, round(sum(d * p) / sum(d * d), 6) AS autocorrelation, (SELECT n FROM m) >= 14 AND abs(sum(d * p) / sum(d * d)) > 0.5 AS seasonal FROM x""")
def _(spark, d):
    return temporal.seasonality(daily_series(spark, d))


@q("trend", "SELECT round(regr_slope(value, i), 6) AS slope, round(regr_intercept(value, i), 6) AS intercept, round(regr_r2(value, i), 6) AS r2 FROM daily")
def _(spark, d):
    return temporal.trend(daily_series(spark, d))


@q("forecast", """, f AS (SELECT regr_slope(value, i) AS s, regr_intercept(value, i) AS b, max(i) AS last FROM daily), r AS (SELECT stddev_samp(value - s * i - b) AS sd FROM daily, f)
SELECT last + k AS i, round(s * (last + k) + b, 6) AS value, round(s * (last + k) + b - 1.96 * sd, 6) AS low, round(s * (last + k) + b + 1.96 * sd, 6) AS high FROM f, r, (SELECT CAST(unnest(range(1, 6)) AS BIGINT) AS k)""")
def _(spark, d):
    return temporal.forecast(daily_series(spark, d), 5)


@q("event_query", "SELECT event_id, user_id, event_type FROM ev WHERE event_type IN ('click', 'view', 'purchase') AND ts BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' ORDER BY ts DESC, event_id LIMIT 25 OFFSET 5")
def _(spark, d):
    return metadata.query_events(raw(spark, d), any_of={"event_type": ["click", "view", "purchase"]}, start=clock("2024-01-03 00:00:00"), end=clock("2024-01-20 00:00:00"), descending=True, offset=5, limit=25).select("event_id", "user_id", "event_type")


@q("event_dedupe", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM ev) WHERE r = 1")
def _(spark, d):
    e = raw(spark, d).withColumnRenamed("event_id", "n").withColumn("event_id", F.concat_ws("|", F.col("user_id").cast("string"), "event_type"))
    first = e.groupBy("event_id", "ts").agg(F.min("n").alias("n"))
    return stream.deduplicate(first).select(F.split_part("event_id", F.lit("|"), F.lit(1)).cast("long").alias("user_id"), F.split_part("event_id", F.lit("|"), F.lit(2)).alias("event_type"), F.col("n").alias("event_id"))


@q("latest_event_per_user", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM ev GROUP BY 1")
def _(spark, d):
    return raw(spark, d).groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@q("tumbling_counts", "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S.%f') AS start, event_type, count(*) AS events FROM ev GROUP BY 1, 2")
def _(spark, d):
    w = stream.tumbling(raw(spark, d), "1 day")
    return w.select(shown("start", "start"), "event_type", "events")


@q("sliding_counts", """SELECT strftime(time_bucket(INTERVAL 1 DAY, ts) - k * INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S.%f') AS start, event_type, count(*) AS events FROM ev, (SELECT CAST(unnest([0, 1]) AS INTEGER) AS k) GROUP BY 1, 2""")
def _(spark, d):
    w = stream.tumbling(raw(spark, d), "2 days", slide="1 day")
    return w.select(shown("start", "start"), "event_type", "events")


@q("session_windows", """, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS n FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS events FROM s GROUP BY user_id, session""")
def _(spark, d):
    w = stream.sessions(raw(spark, d), "6 hours", key="user_id")
    return w.select("user_id", shown("start", "start"), "events")


@q("audit_cube", "SELECT event_type, CAST(user_id % 5 AS BIGINT) AS bucket, count(*) AS events, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM ev GROUP BY CUBE (event_type, bucket)")
def _(spark, d):
    e = raw(spark, d).withColumn("bucket", F.col("user_id") % 5)
    return metadata.audit_cube(e, ["event_type", "bucket"], "value").withColumn("total", F.round("total", 4))


@q("audit_top_users", "SELECT user_id, count(*) AS events FROM ev GROUP BY 1 ORDER BY events DESC, user_id LIMIT 10")
def _(spark, d):
    return metadata.top_users(raw(spark, d))


@q("audit_daily", "SELECT CAST(day AS VARCHAR) AS day, event_type, count(*) AS events FROM ev GROUP BY 1, 2")
def _(spark, d):
    return metadata.daily(raw(spark, d), "event_type").withColumn("day", F.col("day").cast("string"))


@q("json_property_query", "SELECT event_id FROM ev WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) = 3")
def _(spark, d):
    e = raw(spark, d).select("event_id", F.col("props").alias("metadata"), F.col("event_type").alias("entity_type"))
    return metadata.query(e, {"k": 3}).select("event_id")


@q("turning_angles", """SELECT i, round(atan(n - value) - atan(value - p), 6) AS angle FROM (SELECT i, value, lag(value) OVER (ORDER BY i) AS p, lead(value) OVER (ORDER BY i) AS n FROM daily) WHERE p IS NOT NULL AND n IS NOT NULL""")
def _(spark, d):
    return geometry.turning_angles(daily_series(spark, d))


@q("cycles_by_spectrum")
def _(spark, d):
    e = raw(spark, d).groupBy("event_type", F.to_date("ts").alias("ts")).agg(F.count("*").cast("double").alias("value"))
    idx = temporal.snapshot_index(e)
    return geometry.cycles_by_spectrum(idx.join(e, "ts").select("event_type", "i", "value"), "event_type", confidence=0.05)


# modalities: event types


def modal(spark: SparkSession, d: str) -> DataFrame:
    """Days (edges) over users (nodes), one modality an event type."""
    g = raw(spark, d).groupBy(F.to_date("ts").cast("string").alias("edge_id"), F.col("user_id").cast("string").alias("node_id"), F.col("event_type").alias("modality"))
    return g.agg(F.count("*").cast("double").alias("weight"))


_MODAL = ", m AS (SELECT DISTINCT CAST(day AS VARCHAR) AS edge_id, CAST(user_id AS VARCHAR) AS node_id, event_type AS modality FROM ev), mm AS (SELECT DISTINCT node_id, modality FROM m) "


@q("modal_bridges", _MODAL + "SELECT node_id, count(*) AS modalities, CAST(sum(c) AS BIGINT) AS connections FROM (SELECT node_id, modality, count(*) AS c FROM m GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1 HAVING count(*) >= 2")
def _(spark, d):
    return layers.modal_bridges(modal(spark, d), 2, 2)


@q("modality_cooccurrence", _MODAL + "SELECT a.modality AS m1, b.modality AS m2, count(*) AS nodes FROM mm a JOIN mm b USING (node_id) WHERE a.modality < b.modality GROUP BY 1, 2")
def _(spark, d):
    return layers.modality_cooccurrence(modal(spark, d))


@q("modal_transitions", _MODAL + "SELECT m1, m2, count(*) AS nodes FROM (SELECT modality AS m1, lead(modality) OVER (PARTITION BY node_id ORDER BY modality) AS m2 FROM mm) WHERE m2 IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return layers.modality_transitions(modal(spark, d))


@q("modal_correlation", _MODAL + """, s AS (SELECT modality, count(*) AS n FROM mm GROUP BY 1), c AS (SELECT a.modality AS m1, b.modality AS m2, a.n AS n1, b.n AS n2, (SELECT count(*) FROM mm x JOIN mm y USING (node_id) WHERE x.modality = a.modality AND y.modality = b.modality) AS c FROM s a JOIN s b ON a.modality < b.modality)
SELECT m1, m2, round(c / (n1 + n2 - c), 6) AS jaccard, round(c / least(n1, n2), 6) AS overlap, round(c / sqrt(n1 * n2), 6) AS cosine FROM c""")
def _(spark, d):
    return layers.modal_correlation(modal(spark, d))


@q("cross_modal_centrality", _MODAL + "SELECT node_id, round(avg(d), 6) AS score FROM (SELECT node_id, modality, count(*) AS d FROM m GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    return layers.cross_modal_centrality(modal(spark, d))


@q("modal_diversity", _MODAL + """SELECT node_id, round(CASE WHEN count(*) > 1 THEN sum(-p * log2(p)) / log2(count(*)) ELSE 0 END * count(*) / (SELECT count(DISTINCT modality) FROM m), 6) AS diversity
FROM (SELECT node_id, d / sum(d) OVER (PARTITION BY node_id) AS p FROM (SELECT node_id, modality, count(*) AS d FROM m GROUP BY 1, 2)) GROUP BY 1""")
def _(spark, d):
    return layers.modal_diversity(modal(spark, d))


@q("inter_modal", _MODAL + """SELECT node_id, a.d AS degree_a, b.d AS degree_b FROM (SELECT node_id, count(*) AS d FROM m WHERE modality = (SELECT min(modality) FROM m) GROUP BY 1) a JOIN (SELECT node_id, count(*) AS d FROM m WHERE modality = (SELECT max(modality) FROM m) GROUP BY 1) b USING (node_id)""")
def _(spark, d):
    inc = modal(spark, d)
    ends = inc.agg(F.min("modality").alias("lo"), F.max("modality").alias("hi")).first()
    return layers.inter_modal(inc, ends["lo"], ends["hi"])
