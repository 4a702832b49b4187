"""Closed forms of the geometric operators: metrics of properties, flows and time series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ratio


def covariance(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, covariance): sample covariances of all pairs, one pass."""
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i:]]
    wide = df.agg(*[F.covar_samp(x, y).alias(f"c{i}") for i, (x, y) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"c{i}").alias("covariance")) for i, (x, y) in enumerate(pairs)])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def metric(df: DataFrame, columns: list[str], weights: dict | None = None, epsilon: float = 1e-6) -> np.ndarray:
    """The property metric: covariances scaled by the weights, plus epsilon on the diagonal; one small matrix on the driver."""
    at = {c: i for i, c in enumerate(columns)}
    m = np.zeros((len(columns), len(columns)))
    for r in covariance(df, columns).collect():
        m[at[r["x"]], at[r["y"]]] = m[at[r["y"]], at[r["x"]]] = r["covariance"] or 0.0
    w = np.array([float((weights or {}).get(c, 1.0)) for c in columns])
    return m * w[:, None] * w[None, :] + epsilon * np.eye(len(columns))


def mahalanobis(df: DataFrame, columns: list[str], inverse: np.ndarray, center: list[float]):
    """sqrt(d' M^-1 d) of each row to a centre, as an expression with the matrix as literals."""
    d = [F.col(c).cast("double") - F.lit(float(x)) for c, x in zip(columns, center, strict=True)]
    total = sum(F.lit(float(inverse[i, j])) * d[i] * d[j] for i in range(len(d)) for j in range(len(d)))
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def property_outliers(df: DataFrame, id_column: str, columns: list[str], z: float = 3.0) -> DataFrame:
    """(id, distance, z): rows whose distance to the mean is a z-score outlier."""
    inv = np.linalg.inv(metric(df, columns))
    mean = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    d = df.select(id_column, mahalanobis(df, columns, inv, [mean[c] or 0.0 for c in columns]).alias("distance"))
    stats = F.broadcast(d.agg(F.avg("distance").alias("mu"), F.stddev_pop("distance").alias("sd")))
    return d.join(stats).select(id_column, "distance", ratio(F.col("distance") - F.col("mu"), F.col("sd")).alias("z")).where(F.abs("z") > z)


def net_flow(flows: DataFrame) -> DataFrame:
    """(node, inflow, outflow, net) of (source, target, flow)."""
    o = flows.groupBy(F.col("source").alias("node")).agg(F.sum("flow").alias("outflow"))
    i = flows.groupBy(F.col("target").alias("node")).agg(F.sum("flow").alias("inflow"))
    x = o.join(i, "node", "full").select("node", F.coalesce("inflow", F.lit(0.0)).alias("inflow"), F.coalesce("outflow", F.lit(0.0)).alias("outflow"))
    return x.withColumn("net", F.col("outflow") - F.col("inflow"))


def bottlenecks(flows: DataFrame, k: int = 5) -> DataFrame:
    return net_flow(flows).orderBy(F.desc(F.abs("net")), "node").limit(k)


def turning_angles(series: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, i, angle): the angle between the steps into and out of each point of (i, value)."""
    w = Window.partitionBy(*keys).orderBy("i")
    a = F.atan2(F.col("value") - F.lag("value").over(w), F.lit(1.0))
    b = F.atan2(F.lead("value").over(w) - F.col("value"), F.lit(1.0))
    return series.select(*keys, "i", (b - a).alias("angle")).where("angle IS NOT NULL")


def curvature_anomalies(series: DataFrame, keys: tuple[str, ...] = (), threshold: float = 2.0) -> DataFrame:
    """(keys, i, angle, z): points whose angle is further than ``threshold`` deviations from the mean of its series."""
    t = turning_angles(series, keys)
    w = Window.partitionBy(*keys)
    z = ratio(F.col("angle") - F.avg("angle").over(w), F.stddev_pop("angle").over(w))
    return t.withColumn("z", z).where(F.abs("z") > threshold)


def cycles_by_spectrum(series: DataFrame, key: str, least: int = 2, confidence: float = 0.6) -> DataFrame:
    """(key, period, share): the strongest Fourier period of each series of (key, i, value), if its share of the power is enough."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("i")["value"].to_numpy(float)
        power = np.abs(np.fft.rfft(x - x.mean())) ** 2
        power[0] = 0
        total = power.sum()
        if len(x) < 2 * least or total == 0:
            return pd.DataFrame({key: [], "period": [], "share": []})
        best = int(power.argmax())
        period, share = len(x) / best, power[best] / total
        keep = period >= least and share >= confidence
        return pd.DataFrame({key: pdf[key].iloc[:1] if keep else [], "period": [period] if keep else [], "share": [share] if keep else []})

    kind = series.schema[key].dataType.simpleString()
    return series.groupBy(key).applyInPandas(run, f"{key} {kind}, period double, share double")


def node_curvature(coordinates: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, curvature): the angle defect at each node of (id, vector): 2 pi less the angles between its neighbours in turn, over their number.

    Neighbours go in id order and close to a ring; nodes with fewer than two have curvature 0.
    """
    from ..functions import scalars as S

    minus = lambda x, y: F.zip_with(x, y, lambda p, q: p - q)
    at = coordinates.select(F.col("id").alias("a"), F.col("vector").alias("va"))
    to = coordinates.select(F.col("id").alias("b"), F.col("vector").alias("vb"))
    spokes = edges.select("a", "b").distinct().join(at, "a").join(to, "b").select("a", "b", minus(F.col("vb"), F.col("va")).alias("v"))
    ring = Window.partitionBy("a").orderBy("b")
    whole = Window.partitionBy("a").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turned = spokes.withColumn("w", F.coalesce(F.lead("v").over(ring), F.first("v").over(whole)))
    length = S.norm(F.col("v")) * S.norm(F.col("w")) + 1e-10
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), S.dot(F.col("v"), F.col("w")) / length)))
    per = turned.select("a", angle.alias("t")).groupBy("a").agg(F.sum("t").alias("t"), F.count("*").alias("n"))
    bent = per.select(F.col("a").alias("id"), F.when(F.col("n") >= 2, (2 * F.lit(np.pi) - F.col("t")) / F.col("n")).otherwise(0.0).alias("curvature"))
    return coordinates.select("id").join(bent, "id", "left").select("id", F.coalesce("curvature", F.lit(0.0)).alias("curvature"))


def curvature_outliers(curvatures: DataFrame, threshold: float = 2.0, how: str = "zscore") -> DataFrame:
    """(id, curvature, z) of nodes whose curvature is an outlier by z-score, or by size with ``how`` absolute."""
    stats = F.broadcast(curvatures.agg(F.avg("curvature").alias("m"), F.stddev_pop("curvature").alias("s")))
    x = curvatures.join(stats).select("id", "curvature", ratio(F.col("curvature") - F.col("m"), F.col("s")).alias("z"))
    return x.where((F.abs("z") if how == "zscore" else F.abs("curvature")) > threshold)


def geodesic(coordinates: DataFrame, a: str, b: str) -> DataFrame:
    """(distance) between two nodes of (id, vector), straight through the coordinates."""
    from ..functions import scalars as S

    x = coordinates.where(F.col("id") == a).select(F.col("vector").alias("va"))
    return x.join(coordinates.where(F.col("id") == b).select(F.col("vector").alias("vb"))).select(S.euclidean(F.col("va"), F.col("vb")).alias("distance"))


def geodesic_forecast(series: DataFrame, steps: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, i, value): the series (i, value) carried on along its last direction and half its last change of direction."""
    w = Window.partitionBy(*keys).orderBy(F.desc("i"))
    last = series.withColumn("r", F.row_number().over(w)).where("r <= 3")
    pick = lambda r: F.max(F.when(F.col("r") == r, F.col("value")))
    ends = last.groupBy(*keys).agg(F.max("i").alias("top"), pick(1).alias("x"), pick(2).alias("y"), pick(3).alias("z"))
    slope, bend = F.col("x") - F.col("y"), F.coalesce((F.col("x") - 2 * F.col("y") + F.col("z")) / 2, F.lit(0.0))
    ahead = ends.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    return ahead.select(*keys, (F.col("top") + F.col("k")).alias("i"), (F.col("x") + F.coalesce(slope, F.lit(0.0)) * F.col("k") + bend * F.col("k")).alias("value"))
