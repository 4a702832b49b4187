"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written and read again as the next one's ``docs``. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe, jaccard_join, langid, mixing, secrets
from weftgraph.llm.links import IdFilter
from weftgraph.llm.runtime import DOCUMENT_COLUMNS, crc_mod, cut, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, or no letter) go; ``lang`` becomes the identified language."""
    sample = langid.training_sample(docs, crc_mod("doc_id", 3) != 1)
    known = langid.identify(docs.select(*DOCUMENT_COLUMNS, F.col("text").alias("_text")), sample, keep=("_text", "source", "n_chars"))
    kept = known.where(F.col("lang_pred") != langid.UNKNOWN)
    return kept.select("doc_id", F.col("_text").alias("text"), F.col("lang_pred").alias("lang"), "source", "n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join stays: the one with the smallest id, once.

    A document is known by its id and a hash of its text, so rows with one id and unlike texts are
    judged each; rows without an id come last. Documents without words stay. Only texts that a
    bit set of the documents to judge lets through are shuffled.
    """
    keyed = docs.select(*DOCUMENT_COLUMNS, F.xxhash64("doc_id", "text").alias("_row"))
    linked = jaccard_join.components_of(keyed, keep=("_row",)).where("n_shingles > 0")
    linked = cut(linked.select("comp", "_row", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("_at")))
    heads = linked.groupBy("comp").agg(F.min("_at").alias("_at"))
    heads = linked.join(heads, ["comp", "_at"]).groupBy("comp").agg(F.min("_row").alias("_row"))
    rows = linked.groupBy("comp", "_row").agg(F.count("*").alias("n"))
    judged = rows.join(heads.withColumn("stays", F.lit(True)), ["comp", "_row"], "left")
    judged = cut(judged.where("n > 1 OR stays IS NULL").select("_row", F.coalesce("stays", F.lit(False)).alias("stays")))
    marked = IdFilter(judged, "_row", most=26).marked(keyed, "_row")
    doubt = marked.where("maybe").join(judged, "_row", "left")
    once = doubt.where("stays").dropDuplicates(["_row"])
    clear = marked.where("NOT maybe").select(*DOCUMENT_COLUMNS)
    return clear.unionByName(doubt.where("stays IS NULL").select(*DOCUMENT_COLUMNS)).unionByName(once.select(*DOCUMENT_COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret span is replaced by a mark, and ``n_chars`` follows."""
    scanned = secrets.scan(docs, keep=("text", "lang", "source"))
    clean = scanned.withColumn("text", secrets.redact(F.col("text"), F.col("spans")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each as often as the mix takes it."""
    return mixing.take(mixing.mix(docs, keep=("text", "lang", "n_chars"))).select(*DOCUMENT_COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids (little-endian unsigned 32-bit), their number, and a digest of what they decode to."""
    tokens = bpe.encode_decode(docs)
    return tokens.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL has no automata, sketches or merges; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
