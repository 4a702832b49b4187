"""Mixing sources to target weights by capped water-filling.

Every source's target is its weight's share of all words, stopped at
``max_epochs`` times the source's size; what is over is shared again by weight
until no target is above its stop. The fixed point is a water level: with the
sources in ascending order of stop / weight, those below the level are full and
the rest get weight x level. Whole repetitions take every document, and the
fractional rest takes documents in a seeded hash order until the running size
reaches it, so a source misses its target by at most half a document.

Results by case: a null text has size 0; a null source is a source of its own
and sorts last; sources of size 0 have target 0; repeated rows count each; an
empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: float = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source.

    The windows order the sources, of which there is one row each, not the documents.
    """
    ranked = sizes.withColumn("_at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("_w", F.get(cycle, F.col("_at") % len(weights))).withColumn("_cap", F.col("source_size") * float(max_epochs))
    below = Window.orderBy(F.col("_cap") / F.col("_w"), "_at").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(0))
    total, weight = F.sum("source_size").over(whole).cast("double"), F.sum("_w").over(whole)
    level = (total - F.coalesce(F.sum("_cap").over(below), F.lit(0.0))) / (weight - F.coalesce(F.sum("_w").over(below), F.lit(0.0)))
    filled = ranked.withColumn("_full", F.col("_cap") <= F.col("_w") * level).withColumn("_total", total)
    full_cap = F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(whole)
    open_w = F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_w"))).over(whole)
    share = F.col("_w") * (F.col("_total") - full_cap) / F.when(open_w > 0, open_w)
    return filled.select("source", "source_size", F.when(F.col("_full"), F.col("_cap")).otherwise(F.least(share, F.col("_cap"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: float = 3, seed: int = 17, bins: int = 1024, broadcast_sources: int = 10_000, bin_rows: int = 10_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, *keep, size, source_size, target, repeats, taken): how often the mix takes each document.

    A source's documents are ordered by a hash and its leading bits make bins,
    ``bins`` of them or as many more as make them of about ``bin_rows`` rows;
    running sums of the bins tell which are taken whole, and only the one bin that
    a source's target cuts is ordered document by document. So ``keep`` columns
    are not shuffled, but for that bin's, and the number of bins does not change
    the result. The source table is broadcast when it has at most
    ``broadcast_sources`` rows, else joined with skew handling.
    """
    h = F.xxhash64(F.lit(seed), "doc_id")
    sized = docs.select("doc_id", "source", *keep, word_count(F.col("text")).alias("size"))
    bits = min(24, max(bins, docs.count() // bin_rows).bit_length() - 1)
    sized = sized.withColumn("_h", h).withColumn("_bin", F.shiftrightunsigned("_h", 64 - bits))
    binned = cut(sized.groupBy("source", "_bin").agg(F.sum("size").alias("_bin_size")))
    plan = targets(binned.groupBy("source").agg(F.sum("_bin_size").alias("source_size")), weights, max_epochs)
    plan = plan.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = cut(plan.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size")))
    few = plan.count() <= broadcast_sources
    small = F.broadcast if few else (lambda df: df)

    def with_plan(df, table):
        t = table.withColumnRenamed("source", "_source")
        return df.join(small(t), df["source"].eqNullSafe(t["_source"]), "left").drop("_source")

    ends = F.sum("_bin_size").over(Window.partitionBy("source").orderBy("_bin"))
    cut_bin = with_plan(binned.withColumn("_end", ends), plan.select("source", "_rest"))
    cut_bin = cut_bin.where(F.col("_end") > F.col("_rest")).groupBy("source").agg(F.min_by(F.struct("_bin", (F.col("_end") - F.col("_bin_size")).alias("_begin")), "_bin").alias("_cut"))
    plan = cut(plan.join(small(cut_bin.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").select("*", F.col("_cut._bin").alias("_cut_bin"), F.col("_cut._begin").alias("_begin")).drop("_cut"))

    planned = with_plan(sized, plan)
    at_cut = F.coalesce(F.col("_bin") == F.col("_cut_bin"), F.lit(False))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = planned.where(at_cut).withColumn("_extra", (F.col("_begin") + before + F.col("size") / 2 <= F.col("_rest")).cast("long"))
    outer = planned.where(~at_cut).withColumn("_extra", (F.col("_cut_bin").isNull() | (F.col("_bin") < F.col("_cut_bin"))).cast("long"))
    out = inner.unionByName(outer).withColumn("repeats", F.col("_whole") + F.when(F.col("_rest") > 0, F.col("_extra")).otherwise(0))
    return out.select("doc_id", "source", *keep, "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))


def take(mixed: DataFrame) -> DataFrame:
    """The rows of ``mix``, each as often as it is taken."""
    copies = F.sequence(F.lit(1), F.col("repeats").cast("int"))
    return mixed.where("repeats > 0").withColumn("_copy", F.explode(copies)).drop("_copy")
