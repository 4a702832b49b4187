"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, jaccard_join, knn, langid, mixing, paragraphs, secrets, suffixes, toxicity
from .runtime import crc_mod, table


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["k"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    return spans.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.digest(base), 256).alias("base_sha256"), secrets.digest(F.col("spans")).alias("spans"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.encode_decode(table(spark, sf_dir, "documents"))
    return tokens.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sample = langid.training_sample(docs, crc_mod("doc_id", 3) != 1)
    return langid.identify(docs, sample).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines = paragraphs.dedup(docs).select("doc_id", F.lit("line").alias("kind"), F.col("para").alias("at"), "n_words", "first_doc", "removed")
    inner = paragraphs.passages(docs).select("doc_id", F.lit("passage").alias("kind"), "at", "n_words", "first_doc", "removed")
    return lines.unionByName(inner)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return toxicity.score(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


QUERIES = {
    f.__name__: f
    for f in (
        op1_document_fingerprints, op2_secret_scans, op3_mixing, op4_ngram_jaccard_join, op5_suffix_dedup, op6_bpe,
        op7_language_id, op8_exact_topk, op9_substring_dedup, op10_toxicity,
    )
}
ORACLES: dict[str, str] = {"op8_exact_topk": knn.ORACLE_SQL}
