"""Toxicity by FTRL-proximal logistic regression over hashed word features.

A text's features are its words, their beginnings (inflected and compound words
share them), word pairs and pairs with one word between, hashed to 2**bits
coordinates and present or not. Training follows the
per-coordinate rates and L1 sparsity of follow-the-regularised-leader; only the
few coordinates whose weight is not zero are sent to the workers.

Results by case: a null or empty text scores the bias alone; with no label of
either kind every score is 0.5 or the one class's share; repeated rows score
each; an empty table gives an empty result; other input columns are ignored.
Labels that are null are not used, and a document's labels are its largest.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import claim, small_batches, worker_cache
from .textnp import blocks, distinct, mix64, owners, text_bytes, words

BITS = 20
HEADS = (4, 5, 6, 7)
_APART = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def _features(texts: list[bytes], bits: int):
    """(coordinate, text index) of every word, beginning, pair and skip pair; repeated ones included."""
    hashes, first, begun = words([t.translate(_APART) for t in texts], heads=HEADS)
    of = owners(first)
    found = [(hashes, of), *((h, of[at]) for h, at in begun)]
    for gap in (1, 2):
        if len(hashes) > gap:
            same = of[gap:] == of[:-gap]
            pair = mix64(hashes[:-gap] * np.uint64(0x9E3779B97F4A7C15) + hashes[gap:] + np.uint64(gap))
            found.append((pair[same], of[gap:][same]))
    shift = np.uint64(64 - bits)
    return np.concatenate([h >> shift for h, _ in found]).astype(np.int64), np.concatenate([o for _, o in found])


def ftrl(rows, bits: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, weights, bias) learnt from rows of (distinct coordinates, label), in order."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last one is the bias, without L1
    rows = [(np.append(at, size), y) for at, y in rows]

    def weights(at):
        zi = z[at]
        cost = np.where(at == size, 0.0, l1)
        return np.where(np.abs(zi) <= cost, 0.0, -(zi - np.sign(zi) * cost) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for at, y in rows:
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            ni = n[at]
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] += g - sigma * w
            n[at] = ni + g * g
    every = weights(np.arange(size + 1))
    at = np.flatnonzero(every[:-1])
    return at, every[at], float(every[-1])


def train(docs: DataFrame, labels: DataFrame, usable, sample: int = 12_000, bits: int = BITS, alpha: float = 0.1, beta: float = 1.0, l1: float = 2.0, l2: float = 1.0, epochs: int = 3, seed: int = 9) -> dict:
    """The model from a seeded sample of at most ``sample`` labelled documents.

    Ids and labels of the sample come to the driver and are broadcast; features
    are made where the texts are, and one task learns from them.
    """
    labelled = labels.where(usable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = labelled.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample).collect()
    if not picked:
        return {"bits": bits, "at": [], "w": [], "bias": 0.0}
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"], int(r["toxic"])) for r in picked], "doc_id long, toxic int")
    texts = small_batches(docs).where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def features(batches):
        import pyarrow as pa

        for batch in batches:
            raw = text_bytes(batch.column("text"))
            for a, b in blocks(raw):
                at, of = _features(raw[a:b], bits)
                values, first = distinct(at, of, b - a)
                out = [values[i:j].astype(np.int32).tobytes() for i, j in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("doc_id", "toxic")), pa.array(out, pa.binary())], names=["doc_id", "toxic", "at"])

    def learn(batches):
        import pyarrow as pa

        rows = [(np.frombuffer(x, np.int32), y) for batch in batches for x, y in zip(batch.column("at").to_pylist(), batch.column("toxic").to_pylist(), strict=True)]
        at, w, bias = ftrl(rows, bits, alpha, beta, l1, l2, epochs)
        yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary()), pa.array([bias])], names=["at", "w", "bias"])

    made = texts.mapInArrow(features, "doc_id long, toxic int, at binary")
    one = made.repartition(1).sortWithinPartitions(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "at")
    learnt = one.mapInArrow(learn, "at binary, w binary, bias double").collect()
    if not learnt:  # no labelled document is in the table
        return {"bits": bits, "at": [], "w": [], "bias": 0.0}
    r = learnt[0]
    return {"bits": bits, "at": np.frombuffer(r["at"], np.int64).tolist(), "w": np.frombuffer(r["w"], np.float64).tolist(), "bias": r["bias"]}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score, predicted). A narrow pass over whole texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    at, w, bits = np.array(model["at"], np.int64), np.array(model["w"], np.float64), model["bits"]
    name = hashlib.sha256(at.tobytes() + w.tobytes()).hexdigest()

    def run(batches):
        import pyarrow as pa

        claim("toxicity")
        cache = worker_cache()
        if cache.get("toxicity", (None,))[0] != name:
            dense = np.zeros(1 << bits)
            dense[at] = w
            cache["toxicity"] = (name, dense)
        dense = cache["toxicity"][1]
        for batch in batches:
            raw = text_bytes(batch.column("text"))
            for a, b in blocks(raw):
                found, of = _features(raw[a:b], bits)
                hit = dense[found] != 0
                values, first = distinct(found[hit], of[hit], b - a)
                margin = np.bincount(owners(first), weights=dense[values], minlength=b - a) + model["bias"]
                p = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
