"""Learnt operators on small data."""

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import learning


@pytest.fixture(scope="module")
def facts(spark):
    rows = [(f"p{i}", "lives_in", f"c{i % 3}") for i in range(30)] + [(f"c{i}", "part_of", f"r{i % 2}") for i in range(3)] + [(f"p{i}", "rdf:type", "Person") for i in range(33)]
    rows += [(f"p{i}", "speaks", "x") for i in range(20)]
    return spark.createDataFrame(rows, "s string, p string, o string")


@pytest.mark.parametrize("kind", ["transe", "distmult"])
def test_embeddings(spark, facts, kind):
    v = learning.embed(facts.where("p IN ('lives_in', 'part_of')"), 8, 120, kind=kind).cache()
    assert sorted(map(str, v.collect())) == sorted(map(str, learning.embed(facts.where("p IN ('lives_in', 'part_of')").repartition(3), 8, 120, kind=kind).collect()))
    if kind == "transe":
        right = learning.score_links(facts.where("p = 'lives_in'"), v).agg(F.avg("score")).first()[0]
        wrong = learning.score_links(facts.where("p = 'lives_in'").withColumn("o", F.concat(F.lit("c"), ((F.substring("s", 2, 3).cast("int") + 1) % 3).cast("string"))), v).agg(F.avg("score")).first()[0]
        assert right > wrong
    assert learning.nearest(v, v.first()["vector"], 3).count() == 3
    assert learning.analogy(v, "p0", "c0", "p1", 2).count() == 2


def test_missing_relations(facts):
    out = {(r["s"], r["p"], r["o"]) for r in learning.missing_by_statistics(facts).collect()}
    assert out == {(f"p{i}", "speaks", "x") for i in range(20, 33)}
    assert learning.co_occurring_objects(facts, "lives_in").count() == 0


def test_vectors_and_labels(spark):
    pts = spark.createDataFrame([(i, [float(i % 2) * 5 + i * 0.01, float(i % 2) * 5, 1.0]) for i in range(40)], "id int, vector array<double>")
    low = learning.reduce_dimensions(pts, 1)
    assert len(low.first()["vector"]) == 1
    labels = spark.createDataFrame([(i, "odd" if i % 2 else "even") for i in range(20)], "id int, label string")
    got = {r["id"]: r["label"] for r in learning.classify(pts, labels, trees=5).collect()}
    assert got[39] == "odd" and got[38] == "even"
    layers = spark.createDataFrame([("a", "l", [1.0, 0.0]), ("b", "l", [1.0, 0.0]), ("a", "m", [1.0, 0.0]), ("b", "m", [0.0, 1.0])], "entity string, layer string, vector array<double>")
    assert learning.cross_layer_similarity(layers, "a", "b").first()[0] == pytest.approx(0.5)


def test_terms_links_and_sizes(spark):
    t = spark.createDataFrame([("Revenue", "money in", "fin", ["income"])], "term string, definition string, domain string, synonyms array<string>")
    assert learning.search_terms(t, "INCOME").count() == 1 and learning.search_terms(t, "income", synonyms=False).count() == 0
    l = spark.createDataFrame([("a", "b", "k", 0.9, True), ("c", "a", "k", 0.2, False)], "source string, target string, type string, strength double, bidirectional boolean")
    assert {(r["other"], r["direction"]) for r in learning.relationships(l, "a").collect()} == {("b", "out"), ("c", "in")}
    assert learning.relationships(l, "a", least=0.5).count() == 1
    assert learning.sample_size(1000, 100, 500, "centrality") == 600 and learning.sample_size(50, 10, 100) == 50
    v = spark.createDataFrame([(i, float(i == 7) * 9) for i in range(20)], "id int, x double")
    assert [r["id"] for r in learning.z_anomalies(v, "id", ["x"], 0.05).collect()] == [7]
