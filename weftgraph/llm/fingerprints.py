"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph hashes to a wide vector; a document's fingerprint is the sum of its
paragraphs' vectors modulo 2**32 in every lane. Sums do not depend on the order
of paragraphs, and a paragraph is inserted or deleted by adding or subtracting
its vector. The first 8 lanes are a paragraph's SHA-256 and decide equality.
The rest, one lane that counts and 64 lanes that sum the bits of the hashes of
the paragraph's 3-word units (or of the whole, if shorter), are a random
projection, so the lanes of two documents also tell how alike they are:
``1 - |a - b|^2 / (|a|^2 + |b|^2)`` over the signed lanes, at least 0.

Only built-in column functions. Results by case: a null text is the empty text,
which has one empty paragraph; equal fingerprints have likeness 1; repeated
rows are kept each; with one row the next document is the row itself; rows
with a null id come last in descending order; an empty table gives an empty
result; other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import let

EXACT, SIGNED = 8, 64
_TWO_BITS = 0x0000000100000001


def _units(paragraph: Column) -> Column:
    def of(h):
        three = F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))
        return F.when(F.size(h) >= 3, three).otherwise(F.array(F.xxhash64(paragraph)))

    return let(F.transform(F.split(paragraph, " ", -1), lambda w: F.xxhash64(w)), of)


def lanes(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, lanes): array<long> of EXACT + 1 lanes and SIGNED / 2 pairs of lanes, summed over each key's paragraphs.

    Group keys may come from one row only (no two rows of equal keys are told apart).
    """
    paragraphs = texts.select(*keys, F.explode(F.split(F.col(text), "\n", -1)).alias("_p"))
    paragraphs = paragraphs.select(*keys, "_p", F.sha2("_p", 256).alias("_sha"))
    units = paragraphs.select(*keys, "_sha", F.posexplode(_units(F.col("_p"))).alias("_at", "_h"))
    exact = [F.sum(F.when(F.col("_at") == 0, F.conv(F.substring("_sha", 8 * i + 1, 8), 16, 10).cast("long")).otherwise(0)) for i in range(EXACT)]
    bits = [F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(F.lit(_TWO_BITS))) for i in range(SIGNED // 2)]
    sums = units.groupBy(*keys).agg(*[c.alias(f"_s{i}") for i, c in enumerate([*exact, F.count("*"), *bits])])
    n = EXACT + 1 + SIGNED // 2
    return sums.select(*keys, F.array(*[F.col(f"_s{i}") for i in range(n)]).alias("lanes"))


def text_form(sums: Column) -> Column:
    """The fingerprint as hexadecimal digits, 8 for each lane modulo 2**32."""
    head = F.transform(F.slice(sums, 1, EXACT + 1), lambda x: F.lpad(F.hex(F.pmod(x, F.lit(1 << 32))), 8, "0"))
    tail = F.transform(F.slice(sums, EXACT + 2, SIGNED // 2), lambda x: F.lpad(F.hex(x), 16, "0"))
    return F.array_join(F.concat(head, tail), "")


def _signed(sums: Column) -> Column:
    count = F.element_at(sums, EXACT + 1)
    pairs = F.slice(sums, EXACT + 2, SIGNED // 2)
    low = F.transform(pairs, lambda x: (count - 2 * x.bitwiseAND(F.lit(0xFFFFFFFF))).cast("double"))
    return F.concat(low, F.transform(pairs, lambda x: (count - 2 * F.shiftrightunsigned(x, 32)).cast("double")))


def likeness(a: Column, b: Column) -> Column:
    """The likeness, 0 to 1, of two lane arrays."""
    x, y = _signed(a), _signed(b)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, c: acc + c)
    apart = total(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)))
    both = total(F.zip_with(x, y, lambda p, q: p * p + q * q))
    return F.when(a == b, F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - apart / both))


def _at_most(bounds: list[int], value: Column) -> Column:
    """How many of the ascending bounds are at most ``value``, by bisection."""
    if not bounds:
        return F.lit(0)
    array = F.array(*[F.lit(b) for b in bounds]).cast("array<long>")
    zero = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def halve(acc, _):
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        below = (acc["lo"] < acc["hi"]) & (F.get(array, mid) <= value)
        lo, hi = F.when(below, mid + 1).otherwise(acc["lo"]), F.when((acc["lo"] < acc["hi"]) & ~below, mid).otherwise(acc["hi"])
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    steps = F.sequence(F.lit(0), F.lit(len(bounds).bit_length()))
    return F.when(value.isNotNull(), F.aggregate(steps, zero, halve, lambda acc: acc["lo"]))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, bucket, at, next): every document with the text of the next one in descending doc_id.

    Ranges of ids (bounds: at most 10,000 quantiles, on the driver) are sorted
    each on its own; one text is moved once. The first text of each range, at
    most one a range, follows the last of the range above it; it is found by a
    broadcast of the ranges' greatest ids.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = min(10_000, max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = texts.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10_000).alias("b")).first()["b"] or []
    bounds = [int(x) for x in sorted(set(cuts))]
    ranged = texts.withColumn("bucket", F.coalesce(_at_most(bounds, F.col("doc_id")), F.lit(0)))
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    heads = ranged.groupBy("bucket").agg(F.max("doc_id").alias("head"))
    few = heads.withColumnRenamed("bucket", "_b")
    head_rows = ranged.join(F.broadcast(few), (F.col("bucket") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("head")))
    head_texts = head_rows.groupBy("bucket").agg(F.min("text").alias("first_text"))
    down = Window.orderBy("bucket")
    top = F.last("first_text").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = head_texts.select("bucket", F.coalesce(F.lag("first_text").over(down), top).alias("after"))
    inner = ranged.withColumn("at", F.row_number().over(order)).withColumn("next", F.lead("text").over(order))
    return inner.join(after, "bucket").select("doc_id", "text", "bucket", "at", F.coalesce("next", "after").alias("next"))


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and the likeness of neighbours (see the query's contract)."""
    k = F.floor(F.col("n_chars") / 3).cast("int")
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - k), F.substring("next", F.lit(1), k)))
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")), F.struct(F.lit(2).alias("kind"), F.col("next").alias("t")))
    keys = ["bucket", "at", "doc_id", "n_chars", "edited_sha256"]
    three = rows.select(*keys[:-1], F.sha2("edited", 256).alias("edited_sha256"), F.explode(kinds).alias("v")).select(*keys, "v.kind", "v.t")
    made = lanes(three, [*keys, "kind"], "t")
    pick = lambda i: F.max(F.when(F.col("kind") == i, F.col("lanes"))).alias(f"_l{i}")
    wide = made.groupBy(*keys).agg(pick(0), pick(1), pick(2))
    return wide.select(
        "doc_id", "n_chars", "edited_sha256", text_form(F.col("_l0")).alias("fingerprint"), text_form(F.col("_l1")).alias("edited_fingerprint"),
        likeness(F.col("_l0"), F.col("_l1")).alias("near_edited"), likeness(F.col("_l0"), F.col("_l2")).alias("near_next"),
    )
