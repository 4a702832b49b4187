"""Learnt pieces: triple embeddings, link scores, missing relations, reduction and classification."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ratio, unit_hash


def _epochs(heads, rels, tails, n, m, dim, epochs, rate, margin, rng, kind):
    e = rng.normal(0, 1 / np.sqrt(dim), (n, dim))
    r = rng.normal(0, 1 / np.sqrt(dim), (m, dim))
    for _ in range(epochs):
        order = rng.permutation(len(heads))
        for i in range(0, len(order), 256):
            b = order[i : i + 256]
            h, p, t = heads[b], rels[b], tails[b]
            corrupt = rng.integers(0, n, len(b))
            side = rng.random(len(b)) < 0.5
            h2, t2 = np.where(side, corrupt, h), np.where(side, t, corrupt)
            if kind == "transe":
                d, d2 = e[h] + r[p] - e[t], e[h2] + r[p] - e[t2]
                bad = ((d * d).sum(1) + margin > (d2 * d2).sum(1))[:, None]
                g, g2 = 2 * d * bad, 2 * d2 * bad
                for at, v in ((h, -g), (t, g), (h2, g2), (t2, -g2)):
                    np.add.at(e, at, rate * v)
                np.add.at(r, p, rate * (g2 - g))
                e /= np.maximum(1, np.linalg.norm(e, axis=1, keepdims=True))
            else:  # distmult
                s, s2 = (e[h] * r[p] * e[t]).sum(1), (e[h2] * r[p] * e[t2]).sum(1)
                g, g2 = (1 / (1 + np.exp(s)))[:, None], (1 / (1 + np.exp(-s2)))[:, None]
                dh, dt, dr = g * r[p] * e[t], g * e[h] * r[p], g * e[h] * e[t]
                nh, nt, nr = g2 * r[p] * e[t2], g2 * e[h2] * r[p], g2 * e[h2] * e[t2]
                for at, v in ((h, dh), (t, dt), (h2, -nh), (t2, -nt)):
                    np.add.at(e, at, rate * v)
                np.add.at(r, p, rate * (dr - nr))
    return e, r


def embed(triples: DataFrame, dim: int = 16, epochs: int = 50, rate: float = 0.05, margin: float = 1.0, seed: int = 1, kind: str = "transe", sample: int = 200_000) -> DataFrame:
    """(kind, id, vector): entity and relation vectors, TransE or DistMult, from at most ``sample`` triples in one task.

    The sample takes the triples of least seeded hash, so reruns agree.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["s", "p", "o"])
        ids = sorted(set(pdf["s"]) | set(pdf["o"]))
        rel = sorted(set(pdf["p"]))
        at, rt = {x: i for i, x in enumerate(ids)}, {x: i for i, x in enumerate(rel)}
        e, r = _epochs(pdf["s"].map(at).to_numpy(), pdf["p"].map(rt).to_numpy(), pdf["o"].map(at).to_numpy(), len(ids), len(rel), dim, epochs, rate, margin, np.random.default_rng(seed), kind)
        return pd.DataFrame({"kind": ["entity"] * len(ids) + ["relation"] * len(rel), "id": ids + rel, "vector": [v.tolist() for v in np.concatenate((e, r))]})

    some = triples.select("s", "p", "o").distinct().orderBy(F.xxhash64(F.lit(seed), "s", "p", "o")).limit(sample)
    return some.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(run, "kind string, id string, vector array<double>")


def score_links(candidates: DataFrame, vectors: DataFrame) -> DataFrame:
    """(s, p, o, score) of candidate triples: minus the TransE distance."""
    e = vectors.where("kind = 'entity'")
    x = candidates.join(e.select(F.col("id").alias("s"), F.col("vector").alias("vs")), "s").join(e.select(F.col("id").alias("o"), F.col("vector").alias("vo")), "o")
    x = x.join(vectors.where("kind = 'relation'").select(F.col("id").alias("p"), F.col("vector").alias("vp")), "p")
    d = F.zip_with(F.zip_with("vs", "vp", lambda a, b: a + b), "vo", lambda a, b: (a - b) * (a - b))
    return x.select("s", "p", "o", (-F.sqrt(F.aggregate(d, F.lit(0.0), lambda acc, v: acc + v))).alias("score"))


def nearest(vectors: DataFrame, query: list[float], k: int = 10, kind: str = "entity") -> DataFrame:
    """(id, score): the k entities nearest by cosine."""
    from ..functions import scalars as S

    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.where(F.col("kind") == kind).select("id", S.cosine(F.col("vector"), q).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def analogy(vectors: DataFrame, a: str, b: str, c: str, k: int = 5) -> DataFrame:
    """(id, score): what is to c as b is to a: nearest to b - a + c, the three left out."""
    rows = {r["id"]: np.array(r["vector"]) for r in vectors.where(F.col("id").isin([a, b, c])).collect()}
    target = rows[b] - rows[a] + rows[c]
    return nearest(vectors.where(~F.col("id").isin([a, b, c])), target.tolist(), k)


def missing_by_statistics(triples: DataFrame, confidence: float = 0.7, support: int = 2) -> DataFrame:
    """(s, p, o, confidence): o for subjects of a type of which most, with relation p, have o; for members that lack p.

    The conditional probability is over the type's members that have p.
    """
    types = triples.where(F.col("p") == "rdf:type").select("s", F.col("o").alias("type"))
    facts = triples.where(F.col("p") != "rdf:type").join(types, "s")
    n = facts.groupBy("type", "p").agg(F.countDistinct("s").alias("n"))
    rule = facts.groupBy("type", "p", "o").agg(F.countDistinct("s").alias("c")).join(n, ["type", "p"]).withColumn("confidence", F.col("c") / F.col("n")).where((F.col("confidence") >= confidence) & (F.col("c") >= support))
    lacks = types.join(rule.select("type", "p").distinct(), "type").join(triples.select("s", "p").distinct(), ["s", "p"], "left_anti")
    return lacks.join(rule, ["type", "p"]).select("s", "p", "o", "confidence")


def co_occurring_objects(triples: DataFrame, p: str, least: int = 2) -> DataFrame:
    """(a, b, subjects): objects of one relation that share subjects; grows with the square of a subject's objects."""
    x = triples.where(F.col("p") == p).select("s", F.col("o").alias("a")).distinct()
    return x.join(x.withColumnRenamed("a", "b"), "s").where("a < b").groupBy("a", "b").agg(F.count("*").alias("subjects")).where(F.col("subjects") >= least)


def reduce_dimensions(points: DataFrame, k: int = 2, id_column: str = "id") -> DataFrame:
    """(id, vector) by principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    df = points.withColumn("f", array_to_vector("vector"))
    return PCA(k=k, inputCol="f", outputCol="g").fit(df).transform(df).select(id_column, vector_to_array("g").alias("vector"))


def classify(points: DataFrame, labels: DataFrame, id_column: str = "id", trees: int = 20, seed: int = 1) -> DataFrame:
    """(id, label): a random forest learnt from the labelled points (id, label string) for all of them."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import IndexToString, StringIndexer
    from pyspark.ml.functions import array_to_vector

    df = points.withColumn("features", array_to_vector("vector"))
    known = df.join(labels, id_column)
    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(known)
    model = RandomForestClassifier(labelCol="y", numTrees=trees, seed=seed).fit(index.transform(known))
    back = IndexToString(inputCol="prediction", outputCol="label", labels=index.labels)
    return back.transform(model.transform(df)).select(id_column, "label")


def cross_layer_similarity(vectors: DataFrame, a: str, b: str, how: str = "mean") -> DataFrame:
    """(similarity): the cosine of two entities in each layer of (entity, layer, vector), combined by mean, max or min."""
    from ..functions import scalars as S

    x = vectors.where(F.col("entity") == a).select("layer", F.col("vector").alias("va"))
    y = vectors.where(F.col("entity") == b).select("layer", F.col("vector").alias("vb"))
    agg = {"mean": F.avg, "max": F.max, "min": F.min}[how]
    return x.join(y, "layer").agg(agg(S.cosine(F.col("va"), F.col("vb"))).alias("similarity"))


def search_terms(terms: DataFrame, text: str, domain: str | None = None, synonyms: bool = True) -> DataFrame:
    """Rows of (term, definition, domain, synonyms array) that hold the text."""
    low = F.lit(text.lower())
    hit = F.contains(F.lower("term"), low) | F.contains(F.lower("definition"), low)
    if synonyms:
        hit = hit | F.exists("synonyms", lambda s: F.contains(F.lower(s), low))
    out = terms.where(hit)
    return out if domain is None else out.where(F.col("domain") == domain)


def relationships(links: DataFrame, entity: str, types: list[str] | None = None, least: float = 0.0, both: bool = True) -> DataFrame:
    """(other, type, strength, direction) of (source, target, type, strength, bidirectional)."""
    out = links.where(F.col("source") == entity).select(F.col("target").alias("other"), "type", "strength", F.lit("out").alias("direction"))
    if both:
        out = out.unionByName(links.where(F.col("target") == entity).select(F.col("source").alias("other"), "type", "strength", F.when(F.col("bidirectional"), "both").otherwise("in").alias("direction")))
    out = out.where(F.col("strength") >= least)
    return out if types is None else out.where(F.col("type").isin(types))


def sample_size(nodes: int, edges: int, incidences: int, purpose: str = "general", most: int | None = None, least: int = 100) -> int:
    """How many nodes to sample: a factor by purpose, less for dense graphs, more for sparse ones, within the bounds."""
    factor = {"clustering": 0.3, "centrality": 0.5, "general": 0.4, "community": 0.6}.get(purpose, 0.4)
    density = incidences / max(1, nodes * edges)
    n = nodes * factor * (0.7 if density > 0.1 else 1.2 if density < 0.01 else 1.0)
    return int(max(min(least, nodes), min(n, most if most is not None else nodes)))


def sampled(inc: DataFrame, algorithm, most_nodes: int = 5000, seed: int = 1) -> DataFrame:
    """``algorithm(incidence)`` on the whole, or on a seeded node sample where there are more nodes."""
    from .basic import subgraph
    from .paths import sample_nodes

    n = inc.select("node_id").distinct().count()
    return algorithm(inc if n <= most_nodes else subgraph(inc, sample_nodes(inc, most_nodes, seed=seed)))


def z_anomalies(values: DataFrame, id_column: str, columns: list[str], share: float = 0.1) -> DataFrame:
    """(id, score): the given share of rows with the largest root mean square z-score."""
    stats = F.broadcast(values.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"_{c}") for c in columns]))
    z = sum(F.pow(ratio(F.col(c) - F.col(f"_{c}.m"), F.col(f"_{c}.s")), 2) for c in columns)
    scored = values.join(stats).select(id_column, F.sqrt(z / len(columns)).alias("score"))
    bound = F.broadcast(scored.agg(F.percentile("score", 1 - share).alias("_b")))
    return scored.join(bound).where("score > _b").drop("_b")


def split(df: DataFrame, share: float, *keys: str, seed: int = 1) -> DataFrame:
    """Adds ``held_out``, the same for the same keys on every run."""
    return df.withColumn("held_out", unit_hash(seed, *[F.col(k) for k in keys]) < share)

