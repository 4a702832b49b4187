"""Data-quality rules, assessment, cleaning and policies."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..session import cut, ratio


@dataclass(frozen=True)
class Rule:
    """kind: not_null, unique, pattern, range, enum, foreign_key or custom; ``arg`` by kind."""

    name: str
    kind: str
    column: str
    arg: object = None
    threshold: float = 1.0


def _share(rule: Rule) -> Column:
    c, n = F.col(rule.column), F.count("*")
    if rule.kind == "unique":
        return ratio(F.countDistinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0)), n)
    if rule.kind == "not_null":
        ok = c.isNotNull()
    elif rule.kind == "pattern":
        ok = F.coalesce(c.cast("string").rlike(rule.arg), F.lit(False))
    elif rule.kind == "range":
        ok = F.coalesce(c.between(*rule.arg), F.lit(False))
    elif rule.kind == "enum":
        ok = F.coalesce(c.isin(list(rule.arg)), F.lit(False))
    elif rule.kind == "custom":
        ok = F.coalesce(rule.arg(c), F.lit(False))
    else:
        raise ValueError(rule.kind)
    return ratio(F.count_if(ok), n)


def evaluate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, kind, column, score, status): one pass for all rules; status pass, warn (0.8 of the threshold) or fail.

    A foreign_key's ``arg`` is (table, column): the share of non-null values that it holds.
    """
    plain = [r for r in rules if r.kind != "foreign_key"]
    out = None
    if plain:
        wide = df.agg(*[_share(r).alias(f"r{i}") for i, r in enumerate(plain)])
        rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(r.column).alias("column"), F.col(f"r{i}").cast("double").alias("score"), F.lit(float(r.threshold)).alias("threshold")) for i, r in enumerate(plain)])
        out = wide.select(F.explode(rows).alias("x")).select("x.*")
    for r in rules:
        if r.kind == "foreign_key":
            table, column = r.arg
            keys = table.select(F.col(column).alias("_k")).distinct().withColumn("_hit", F.lit(1))
            s = df.where(F.col(r.column).isNotNull()).join(keys, F.col(r.column) == F.col("_k"), "left").agg(ratio(F.count("_hit"), F.count("*")).cast("double").alias("score"))
            row = s.select(F.lit(r.name).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(r.column).alias("column"), "score", F.lit(float(r.threshold)).alias("threshold"))
            out = row if out is None else out.unionByName(row)
    status = F.when(F.col("score") >= F.col("threshold"), "pass").when(F.col("score") >= 0.8 * F.col("threshold"), "warn").otherwise("fail")
    return out.select("rule", "kind", "column", "score", status.alias("status"))


def profile(df: DataFrame) -> DataFrame:
    """(column, nulls, distinct, completeness, uniqueness) of every column in one pass."""
    wide = df.agg(F.count("*").alias("n"), *[F.struct(F.count_if(F.col(c).isNull()).alias("nulls"), F.countDistinct(c).alias("d")).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`.nulls").alias("nulls"), F.col(f"`{c}`.d").alias("distinct")) for c in df.columns])
    x = wide.select("n", F.explode(rows).alias("x")).select("n", "x.*")
    return x.select("column", "nulls", "distinct", (1 - ratio(F.col("nulls"), F.col("n"))).alias("completeness"), ratio(F.col("distinct"), F.col("n")).alias("uniqueness"))


def iqr_outliers(df: DataFrame, columns: list[str], k: float = 1.5) -> DataFrame:
    """(column, low, high, outliers): values beyond k interquartile ranges (linear quantiles)."""
    out = None
    for c in columns:
        v = F.col(c).cast("double")
        q = F.broadcast(df.agg(F.percentile(v, 0.25).alias("q1"), F.percentile(v, 0.75).alias("q3")).select((F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("low"), (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("high")))
        r = df.select(v.alias("v")).join(q).groupBy("low", "high").agg(F.count_if((F.col("v") < F.col("low")) | (F.col("v") > F.col("high"))).alias("outliers")).select(F.lit(c).alias("column"), "low", "high", "outliers")
        out = r if out is None else out.unionByName(r)
    return out


def duplicates(df: DataFrame) -> DataFrame:
    """(rows, distinct_rows, duplicates)."""
    g = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return g.agg(F.sum("_n").alias("rows"), F.count("*").alias("distinct_rows")).select(F.coalesce("rows", F.lit(0)).alias("rows"), "distinct_rows", (F.coalesce("rows", F.lit(0)) - F.col("distinct_rows")).alias("duplicates"))


def column_kind(df: DataFrame, column: str, sample: int = 1000) -> str:
    """boolean, temporal, numerical, json, categorical or text, from at most ``sample`` values: a report on a sample by definition."""
    t = df.schema[column].dataType
    if not isinstance(t, StringType):
        name = t.simpleString()
        return "boolean" if name == "boolean" else "temporal" if name in ("date", "timestamp", "timestamp_ntz") else "vector" if name.startswith("array") else "numerical"
    c = F.col(column)
    s = df.where(c.isNotNull()).limit(sample).agg(
        F.count("*").alias("n"), F.count_if(F.expr(f"try_parse_json(`{column}`)").isNotNull() & c.rlike(r"^\s*[\[{]")).alias("json"), F.count_if(c.rlike(r"^\d{4}-\d{2}-\d{2}")).alias("date"),
        F.count_if(c.try_cast("double").isNotNull()).alias("num"), F.countDistinct(c).alias("d"), F.avg(F.length(c)).alias("len"),
    ).first()
    n = max(1, s["n"])
    if s["json"] > 0.5 * n:
        return "json"
    if s["date"] > 0.7 * n:
        return "temporal"
    if s["num"] > 0.8 * n:
        return "numerical"
    if s["d"] < 0.1 * n:
        return "categorical"
    return "text" if s["d"] > 0.8 * n or (s["len"] or 0) >= 50 else "categorical"


# cleaning


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def _strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, StringType)]


def fill_missing(df: DataFrame, value=None) -> DataFrame:
    """A constant, else the median of numbers and the mode of strings (ties: the least)."""
    if value is not None:
        return df.fillna(value)
    num, text = _numeric(df), _strings(df)
    stats = F.broadcast(df.agg(*[F.median(c).alias(f"_m_{c}") for c in num], *[F.mode(c, deterministic=True).alias(f"_m_{c}") for c in text]))
    return df.join(stats).select(*[F.coalesce(F.col(c), F.col(f"_m_{c}")).alias(c) if c in num + text else F.col(c) for c in df.columns])


def interpolate(df: DataFrame, column: str, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Linear interpolation by row number within the keys; ends stay null.

    Rows are dealt into ranges of (keys, order), one task each; every range
    takes the rows before it and the known values around it from a table of
    ranges, which has one row for each range and key in it.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    dealt = df.select("*", *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).repartitionByRange(*names, order).withColumn("_b", F.spark_partition_id())
    rows = cut(dealt)  # the ranges are drawn from a sample: not twice
    w = Window.partitionBy("_b", *names).orderBy(order)
    value = F.when(F.col(column).isNotNull(), F.struct("_i", F.col(column).cast("double").alias("v")))
    r = cut(rows.withColumn("_i", F.row_number().over(w).cast("long")).withColumn("_x", value))
    ranges = r.groupBy("_b", *names).agg(F.count("*").alias("_rows"), F.min("_x").alias("_first"), F.max("_x").alias("_last"))
    of = Window.partitionBy(*names).orderBy("_b")
    backward = Window.partitionBy(*names).orderBy(F.desc("_b"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    at = lambda x: F.when(x.isNotNull(), F.struct((x["_i"] + F.col("_o")).alias("_i"), x["v"].alias("v")))
    ranges = ranges.withColumn("_o", F.coalesce(F.sum("_rows").over(before(of)), F.lit(0)))
    ranges = ranges.withColumn("_p0", F.last(at(F.col("_last")), ignorenulls=True).over(before(of))).withColumn("_n0", F.last(at(F.col("_first")), ignorenulls=True).over(before(backward)))
    keyed = ranges.select(F.col("_b").alias("_rb"), *[F.col(n).alias(f"_r{n}") for n in names], "_o", "_p0", "_n0")
    same = F.col("_b") == F.col("_rb")
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"_r{n}"))
    # both ways from the frame's open end: a frame that is open ahead is read anew for each row
    up_to = lambda i: Window.partitionBy("_b", *names).orderBy(i).rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("_pl", F.last("_x", ignorenulls=True).over(up_to("_i"))).withColumn("_nl", F.last("_x", ignorenulls=True).over(up_to(F.desc("_i"))))
    r = r.join(keyed, same).withColumn("_p", F.coalesce(at(F.col("_pl")), "_p0")).withColumn("_n", F.coalesce(at(F.col("_nl")), "_n0"))
    step = F.try_divide(F.col("_n.v") - F.col("_p.v"), F.col("_n._i") - F.col("_p._i"))
    return r.withColumn(column, F.coalesce(F.col(column).cast("double"), F.col("_p.v") + step * (F.col("_i") + F.col("_o") - F.col("_p._i")))).select(*df.columns)


def clean_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.lower(F.trim(F.col(c))).alias(c) if c in _strings(df) else F.col(c) for c in df.columns])


def infer_numbers(df: DataFrame, share: float = 0.9) -> DataFrame:
    """Strings of which more than ``share`` are numbers become doubles."""
    text = _strings(df)
    if not text:
        return df
    s = df.agg(*[ratio(F.count_if(F.col(c).try_cast("double").isNotNull()), F.count(c)).alias(c) for c in text]).first()
    return df.select(*[F.col(c).try_cast("double").alias(c) if c in text and s[c] > share else F.col(c) for c in df.columns])


def parse_dates(df: DataFrame, share: float = 0.8) -> DataFrame:
    text = _strings(df)
    if not text:
        return df
    s = df.agg(*[ratio(F.count_if(F.try_to_timestamp(F.col(c)).isNotNull()), F.count(c)).alias(c) for c in text]).first()
    return df.select(*[F.try_to_timestamp(F.col(c)).alias(c) if c in text and s[c] > share else F.col(c) for c in df.columns])


def clean(df: DataFrame, steps: tuple[str, ...] = ("fill", "distinct", "numbers", "text", "dates")) -> DataFrame:
    chain = {"drop": lambda d: d.dropna(), "fill": fill_missing, "distinct": lambda d: d.distinct(), "numbers": infer_numbers, "text": clean_text, "dates": parse_dates}
    return reduce(lambda d, s: d.transform(chain[s]), steps, df)


def policies(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(policy, violations, share): rows for which each policy's condition does not hold (null counts as not)."""
    wide = df.agg(F.count("*").alias("n"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in conditions.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("policy"), F.col(k).alias("violations")) for k in conditions])
    return wide.select("n", F.explode(rows).alias("x")).select("x.policy", "x.violations", ratio(F.col("x.violations"), F.col("n")).alias("share"))
