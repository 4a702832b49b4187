"""The query compiler, reasoning, resolution, formats, databases and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import scalars as S
from weftgraph.hypergraph import Hypergraph
from weftgraph.plans import knowledge, reasoning, sparql
from weftgraph.sources import databases, formats
from weftgraph.streaming import events

T = "s string, p string, o string"


@pytest.fixture(scope="module")
def people(spark):
    rows = [("alice", "knows", "bob"), ("bob", "knows", "carol"), ("alice", "age", "30"), ("bob", "age", "25"), ("alice", "works_for", "acme"), ("carol", "rdf:type", "Person"), ("alice", "rdf:type", "Person")]
    return spark.createDataFrame(rows, T)


def run(t, text, **k):
    return [tuple(r) for r in sparql.execute(t, text, **k).collect()]


def test_joins_and_modifiers(people):
    assert run(people, "SELECT ?a ?c WHERE { ?a knows ?b . ?b knows ?c }") == [("alice", "carol")]
    assert run(people, "SELECT ?x WHERE { ?x age ?n FILTER(?n > 26) }") == [("alice",)]
    assert run(people, "SELECT ?x WHERE { ?x age ?n } ORDER BY DESC(?n) LIMIT 1 OFFSET 1") == [("bob",)]
    assert sorted(run(people, "SELECT ?x ?w WHERE { ?x age ?n OPTIONAL { ?x works_for ?w } }")) == [("alice", "acme"), ("bob", None)]
    assert run(people, "SELECT DISTINCT ?t WHERE { ?x a ?t }") == [("Person",)]
    assert run(people, "SELECT ?b WHERE { ?a knows ?b }", bindings=None, limit=1) != []
    assert run(people, "SELECT ?a ?b WHERE { ?a knows ?b }", bindings={"a": "bob"}) == [("bob", "carol")]
    assert run(people, "SELECT ?x WHERE { { ?x works_for acme } UNION { ?x age \"25\" } } ORDER BY ?x") == [("alice",), ("bob",)]
    assert run(people, "PREFIX f: <kno> SELECT ?x WHERE { ?x f:ws carol }") == [("bob",)]
    assert run(people, "SELECT ?x WHERE { ?x age ?n FILTER(!BOUND(?zz) && REGEX(?x, '^AL', 'i')) }") == [("alice",)]


def test_parse_errors():
    for bad in ("SELECT ?x { ?x a", "SELECT WHERE { ?x a ?y }", "SELECT ?x", "SELECT ?x WHERE { ?x a ?y } LIMIT many", "SELECT ?x WHERE { ?x ~ ?y }"):
        assert sparql.validate(bad)
    assert sparql.validate("SELECT * WHERE { ?x ?p ?y ; a ?z . }") == []
    with pytest.raises(sparql.SparqlError):
        sparql._value(("call", "NOPE", []), None, False)


def test_rules(spark):
    t = spark.createDataFrame([("a", "anc", "b"), ("b", "anc", "c"), ("c", "anc", "a"), ("anc", "rdf:type", reasoning.TRANSITIVE), ("x", "id", "1"), ("y", "id", "1"), ("id", "rdf:type", reasoning.INVERSE_FUNCTIONAL)], T)
    out = reasoning.infer(t)
    new = {(r["s"], r["p"], r["o"]) for r in out.where("rule IS NOT NULL").collect()}
    assert ("a", "anc", "c") in new and ("a", "anc", "a") in new and ("x", reasoning.SAME, "y") in new
    again = reasoning.infer(out.select("s", "p", "o"))
    assert again.where("rule IS NOT NULL").count() == 0
    assert reasoning.explain(out, "a", "anc", "c").first()["rule"] == "transitivity"
    c = reasoning.closure(spark.createDataFrame([("a", "b"), ("b", "a")], "a string, b string"))
    assert c.count() == 4
    custom = reasoning.infer(t, {"mine": lambda x: x.where("p = 'id'").select(F.col("o").alias("s"), F.lit("of").alias("p"), F.col("s").alias("o"))})
    assert custom.where("rule = 'mine'").count() == 2
    bad = spark.createDataFrame([("i", "rdf:type", "A"), ("i", "rdf:type", "B"), ("A", reasoning.DISJOINT, "B")], T)
    assert reasoning.inconsistencies(bad).first()["kind"] == "disjoint"


def test_scalars(spark):
    df = spark.createDataFrame([("Robert", "Rupert", "night", "nacht", "a b", "b c", "kitten", "sitting")], "a string, b string, c string, d string, e string, f string, g string, h string")
    r = df.select(
        S.soundex_equal(F.col("a"), F.col("b")).alias("sx"), S.bigram_similarity(F.col("c"), F.col("d")).alias("bg"), S.token_jaccard(F.col("e"), F.col("f")).alias("tj"), S.levenshtein_ratio(F.col("g"), F.col("h")).alias("lv"),
        S.round_half_even(F.lit("2.5")).alias("r"), S.absolute(F.lit("x")).alias("abs"), S.expand_uri(F.lit("ex:a"), {"ex": "http://e/"}).alias("u"), S.compress_uri(F.lit("http://e/a"), {"ex": "http://e/"}).alias("cu"),
        S.local_name(F.lit("http://e/x#Name")).alias("ln"), S.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("cos"), S.iri(F.lit("x")).alias("iri"),
    ).first()
    assert r["sx"] and r["bg"] == pytest.approx(1 / 7) and r["tj"] == pytest.approx(1 / 3) and r["lv"] == pytest.approx(1 - 3 / 7)
    assert (r["r"], r["abs"], r["u"], r["cu"], r["ln"], r["iri"]) == (2.0, 0.0, "http://e/a", "ex:a", "Name", "<x>")
    assert r["cos"] == pytest.approx(2**-0.5)


def test_resolution_and_fusion(spark):
    e = "id string, type string, name string, props map<string,string>"
    a = spark.createDataFrame([("1", "p", "Acme Corporation", {"city": "Rome"}), ("2", "p", "Globex", {"city": "Oslo"})], e)
    b = spark.createDataFrame([("9", "p", "ACME Corporation", {"city": "Rome"}), ("8", "p", "Initech", {"city": "Bonn"})], e)
    al = knowledge.align(a, b)
    assert [tuple(r)[:2] for r in al.collect()] == [("1", "9")]
    ta, tb = spark.createDataFrame([("1", "k", "2")], T), spark.createDataFrame([("9", "k", "2"), ("8", "k", "9")], T)
    assert sorted(tuple(r)[:3] for r in knowledge.fuse(ta, tb, al).collect()) == [("1", "k", "2"), ("8", "k", "1")]
    m = knowledge.similar_names(a.unionByName(b), 0.7)
    assert [tuple(r)[:2] for r in m.collect()] == [("1", "9")]
    assert knowledge.cluster_matches(m).count() == 2


def test_keyword_queries(people, spark):
    assert knowledge.parse_keywords("find path from alice to carol") == {"kind": "path_search", "terms": ["alice", "carol"]}
    assert knowledge.parse_keywords("how many relations")["kind"] == "aggregate"
    ents = spark.createDataFrame([("p:alice", "t", "Alice Smith"), ("p:bob", "t", "Bob")], "id string, type string, name string")
    assert knowledge.run_keywords(people, ents, "find Alice").first()["id"] == "p:alice"
    assert knowledge.run_keywords(people, ents, "path from alice to carol").count() >= 1
    assert knowledge.semantic_similarity(people, "alice", "bob").first()[0] >= 0
    assert knowledge.typed_paths(people, spark.createDataFrame([("alice", "carol")], "start string, end string")).first()["types"] == ["knows", "knows"]
    text = spark.createDataFrame([(1, "Alice works for Acme. Write to a@b.org on 2024-01-02.")], "doc_id int, text string")
    assert {r["kind"] for r in knowledge.extract_entities(text).collect()} >= {"email", "date"}
    assert knowledge.extract_triples(text, {"works_for": "works for"}).first()["o"] == "Acme"


def test_formats(spark, tmp_path):
    h = Hypergraph.from_dict(spark, {'E"1': ["A&B", "C"], "E2": ["C"]}, name="g")
    for fmt in ("parquet", "csv", "json", "orc"):
        formats.save(h, str(tmp_path / fmt), fmt)
        back = formats.load(spark, str(tmp_path / fmt), fmt)
        assert back.name == "g" and sorted(map(tuple, back.incidence.select("edge_id", "node_id", "weight").collect())) == sorted(map(tuple, h.incidence.collect()))
    doc = "\n".join(r["value"] for r in formats.graphml_rows(h.incidence).orderBy("part", "value").collect())
    assert sorted(map(tuple, formats.from_graphml(spark, doc).collect())) == sorted(map(tuple, h.incidence.collect()))
    doc = "\n".join(r["value"] for r in formats.gexf_rows(h.incidence).orderBy("part", "value").collect())
    assert formats.from_gexf(spark, doc).count() == 3
    assert formats.gml_rows(h.incidence).count() == 2 + 2 + 2 + 3
    formats.save_collection({"x": h, "y": h}, str(tmp_path / "c"))
    assert formats.load_collection(spark, str(tmp_path / "c"), "x").count() == 3
    formats.rewrite(spark, str(tmp_path / "parquet" / "incidence"), str(tmp_path / "z"), files=1, sort_by=["edge_id"])
    assert formats.file_info(spark, str(tmp_path / "z")).agg(F.sum("rows")).first()[0] == 3
    plan = formats.scan(spark, str(tmp_path / "z"), "parquet", ["node_id"], {"edge_id": ["E2"], "weight": 1.0})._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "EqualTo(edge_id,E2)" in plan.replace("In(edge_id, [E2])", "EqualTo(edge_id,E2)")
    with pytest.raises(ValueError):
        formats.format_of("x.unknown")
    with pytest.raises(FileNotFoundError):
        formats.load(spark, str(tmp_path / "none"))
    assert formats.from_edge_list(formats.edge_list_rows(h.incidence, ";"), ";").count() == 3
    seen = []
    assert formats.run_etl(h.incidence, [lambda d: d.where("node_id = 'C'")], seen.append).count() == 2 and len(seen) == 1


def test_sqlite(spark, tmp_path):
    store = databases.SqliteStore(str(tmp_path / "g.db"))
    h = Hypergraph.from_dict(spark, {"E": ["A", "B"]}, name="g")
    store.save(h)
    store.save(h)
    assert store.list() == ["g"] and store.load(spark, "g").incidence.count() == 2
    assert store.delete("g") and not store.delete("g")
    with pytest.raises(KeyError):
        store.load(spark, "g")


def event(i, kind, edge, nodes, at, weight=None):
    return {"event_id": i, "event_type": kind, "ts": f"2024-01-01T00:00:{at:02d}", "graph_id": "g", "edge_id": edge, "nodes": nodes, "weight": weight, "source": "s"}


def test_stream_of_edge_states(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    parts = [[event("1", "add_edge", "e", ["a", "b"], 1), event("2", "add_edge", "f", ["c"], 2)], [event("3", "modify_edge", "e", ["a"], 5, 2.0), event("4", "remove_edge", "f", [], 6), event("0", "add_edge", "e", ["zz"], 0)]]
    for n, rows in enumerate(parts):
        (src / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
    stream = events.edge_state(events.read_files(spark, str(src), 1))
    got = []
    events.each_batch(stream, lambda b, i: got.extend(b.collect()), str(tmp_path / "ck")).awaitTermination(60)
    last = {r["edge_id"]: r for r in sorted(got, key=lambda r: r["version"])}
    assert last["e"]["nodes"] == ["a"] and last["e"]["weight"] == 2.0 and last["e"]["version"] == 2 and not last["f"]["live"]
    batch = spark.read.schema(events.EVENT).json(str(src))
    view = {(r["edge_id"], r["node_id"]): r["weight"] for r in events.edge_view(batch).collect()}
    assert view == {("e", "a"): 2.0}
    assert events.replay(batch, "g", types=["add_edge"]).count() == 3


def test_stream_windows_dedupe_dead_letters(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "0.json").write_text("\n".join(json.dumps(e) for e in [event("1", "add_edge", "e", ["a"], 1), event("1", "add_edge", "e", ["a"], 2), event("2", "add_edge", "e", ["a"], 3)]))
    s = events.deduplicate(events.read_files(spark, str(src)))
    events.to_table(s, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    raw = spark.createDataFrame([('{"event_id": "1", "ts": "2024-01-01T00:00:01"}',), ("not json",), ('{"event_id": "2"}',)], "value string")
    assert events.parse(raw).first()["event_type"] == "add_edge"
    assert sorted(r["error"] for r in events.dead_letters(raw).collect()) == ["no event_id", "no timestamp"]
    failed = []

    def fail(batch, batch_id):
        raise RuntimeError("no")

    events.each_batch(events.read_files(spark, str(src)), fail, str(tmp_path / "ck2"), lambda b, i, e: failed.append((b.count(), e))).awaitTermination(60)
    assert failed == [(3, "no")]


def test_events_of_snapshots(spark):
    t = spark.createDataFrame([(1, "e", "a", 1.0), (1, "f", "b", 1.0), (2, "e", "a", 1.0), (2, "e", "c", 1.0)], "ts int, edge_id string, node_id string, weight double")
    out = sorted((r["ts"], r["event_type"], r["edge_id"]) for r in events.events_of_snapshots(t).collect())
    assert out == [(1, "add_edge", "e"), (1, "add_edge", "f"), (2, "modify_edge", "e"), (2, "remove_edge", "f")]
    e = spark.createDataFrame([("x", dt.datetime(2024, 1, 1)), ("y", dt.datetime(2024, 1, 9))], "event_id string, ts timestamp")
    assert [r["event_id"] for r in events.retain(e, 3, dt.datetime(2024, 1, 10)).collect()] == ["y"]
