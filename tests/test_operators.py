"""Operators on small hypergraphs with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from weftgraph.hypergraph import Hypergraph
from weftgraph.operators import basic, centrality, communities, geometry, hierarchy, layers, metadata, paths, patterns, quality, setops, temporal, transforms

G1 = {"edge1": ["node1", "node2", "node3"], "edge2": ["node2", "node3", "node4"], "edge3": ["node1", "node4", "node5"], "edge4": ["node3", "node5", "node6"]}
NODES = [f"node{i}" for i in range(1, 7)]


@pytest.fixture(scope="module")
def g1(spark):
    return Hypergraph.from_dict(spark, G1).incidence.cache()


def by_node(df, column="score"):
    rows = {r["node_id"]: r[column] for r in df.collect()}
    return [rows[n] for n in NODES]


def test_degrees(g1):
    assert by_node(basic.node_degrees(g1), "degree") == [2, 2, 3, 2, 2, 1]
    assert by_node(centrality.degree_rows(g1)) == pytest.approx([0.5, 0.5, 0.75, 0.5, 0.5, 0.25])
    assert by_node(centrality.degree(g1)) == pytest.approx([0.4, 0.4, 0.6, 0.4, 0.4, 0.2])
    assert by_node(centrality.s_centrality(g1, 2)) == pytest.approx([0.5, 0.5, 0.75, 0.5, 0.5, 0.25])


def test_pagerank(g1):
    assert by_node(centrality.pagerank(g1)) == pytest.approx([0.178448, 0.138533, 0.221719, 0.178448, 0.181576, 0.101277], abs=1e-5)
    for variant in ("multigraph", "neighbors"):
        assert sum(by_node(centrality.pagerank(g1, variant=variant))) == pytest.approx(1, abs=1e-5)


def test_distance_centralities(g1):
    assert by_node(centrality.closeness(g1)) == pytest.approx([0.833333, 0.714286, 1.0, 0.833333, 0.833333, 0.625], abs=1e-6)
    assert by_node(centrality.harmonic(g1)) == pytest.approx([0.9, 0.8, 1.0, 0.9, 0.9, 0.7])
    assert by_node(centrality.betweenness(g1)) == pytest.approx([0.066667, 0, 0.466667, 0.066667, 0.2, 0], abs=1e-6)


def test_neighbors_and_shape(g1):
    want = {"node1": "2345", "node2": "134", "node3": "12456", "node4": "1235", "node5": "1346", "node6": "35"}
    for n, others in want.items():
        assert sorted(r[0][-1] for r in basic.neighbors(g1, n).collect()) == list(others)
    assert paths.diameter(g1).first()[0] == 2
    assert paths.connected_components(g1).select("component").distinct().count() == 1
    assert transforms.adjacency(g1).count() == 11
    assert [tuple(r)[:2] for r in transforms.adjacency(g1, 2).collect()] == [("node2", "node3")]
    assert transforms.line_graph(g1).count() == 6
    assert [(r["e"], r["f"]) for r in transforms.line_graph(g1, 2).collect()] == [("edge1", "edge2")]


def test_overlap_density_motifs(g1):
    assert sorted(r["jaccard"] for r in patterns.edge_jaccard(g1).collect()) == pytest.approx([0.2] * 5 + [0.5])
    assert patterns.average_edge_overlap(g1).first()[0] == pytest.approx(0.25)
    assert patterns.density(g1).first()[0] == pytest.approx(4 / 57)
    assert sorted(r["edge_id"] for r in transforms.contractible(g1).where("contractible").collect()) == ["edge1", "edge2", "edge3"]
    assert transforms.k_uniform(g1, 2).select("edge_id").distinct().count() == 12
    assert communities.edge_modularity(g1).first()[0] == pytest.approx(1.0)


def test_set_operations(spark, g1):
    other = Hypergraph.from_dict(spark, {"edge1": ["node1", "node9"], "edge9": ["node9", "node6"]}).incidence
    a, b = Hypergraph(g1), Hypergraph(other)
    ids = lambda h: sorted((r["edge_id"], r["node_id"]) for r in h.incidence.collect())
    assert ids(a | b) == ids(b | a)
    assert ids(a & b) == [("edge1", "node1")]
    assert {e for e, _ in ids(a - b)} == {"edge2", "edge3", "edge4"}
    assert setops.intersection(g1, g1, "structure").count() == g1.count()
    assert setops.difference(g1, g1, "structure").count() == 0
    assert ids(a.dual().dual()) == ids(a)
    assert basic.filter_by_degree(g1, 0).count() == g1.count()
    with pytest.raises(ValueError):
        basic.subgraph(g1, spark.createDataFrame([("zz",)], "node_id string"), strict=True)
    with pytest.raises(ValueError):
        Hypergraph.from_dataframe(spark.createDataFrame([(1,)], "invalid int"))
    with pytest.raises(ValueError):
        Hypergraph.from_pairs(spark, [("e", "n")], [1.0, 2.0])


def test_paths(spark, g1):
    e = paths.neighbor_edges(g1)
    assert paths.shortest_path(e, "node1", "node6").first()["path"] == ["node1", "node3", "node6"]
    assert sorted(r["path"][1] for r in paths.all_shortest_paths(e, "node1", "node6").collect()) == ["node3", "node5"]
    assert paths.simple_paths(e, "node2", "node6", 2).count() == 1
    assert paths.reachable(e, "node1", "node6").first()[0] == 1.0
    assert paths.reachable(e, "node1", "zz").first()[0] == 0.0
    assert paths.depth_first(g1, "node1")[:3] == ["node1", "node2", "node3"]
    assert paths.spanning_forest(e.withColumn("cost", F.lit(1.0))).count() == 5
    assert {r["node"]: r["distance"] for r in paths.weighted_distances(paths.inverse_strength_edges(g1), "node1").collect()}["node6"] == pytest.approx(2.0)
    triangles = paths.cycles(e.where("a < b"), 3).count()
    by_hand = sum(1 for a in range(6) for b in range(a) for c in range(b) if all(any({NODES[x], NODES[y]} <= set(m) for m in G1.values()) for x, y in ((a, b), (b, c), (a, c))))
    assert triangles == by_hand


def test_components_and_cores(spark):
    h = Hypergraph.from_dict(spark, {"a": ["1", "2", "3"], "b": ["2", "3"], "c": ["3", "1"], "d": ["8", "9"]}).incidence
    comp = {r["node_id"]: r["component"] for r in paths.connected_components(h).collect()}
    assert comp == {"1": "1", "2": "1", "3": "1", "8": "8", "9": "8"}
    assert {r[0] for r in paths.largest_component(h).select("node_id").distinct().collect()} == {"1", "2", "3"}
    core = {r["node_id"]: r["core"] for r in paths.k_core(h).collect()}
    assert core == {"1": 2, "2": 2, "3": 2, "8": 1, "9": 1}
    assert {r["clique_id"] for r in transforms.clique_graph(h).collect()} == {"1|2|3", "8|9"}
    assert transforms.complement(Hypergraph.from_dict(spark, {"a": ["1", "2"], "b": ["1"]}).incidence).collect()[0]["nodes"] == ["2"]
    assert transforms.homomorphism_possible(h, h)


def test_walks_and_sampling_do_not_depend_on_partitions(spark, g1):
    starts = spark.createDataFrame([("w1", "node1"), ("w2", "node6")], "walk string, node_id string")
    a = sorted(map(tuple, paths.random_walks(g1, starts, 4, 7).collect()))
    b = sorted(map(tuple, paths.random_walks(g1.repartition(5), starts, 4, 7).collect()))
    assert a == b and len(a) == 10
    for how in ("random", "degree", "stratified", "adaptive"):
        assert paths.sample_nodes(g1, 3, how).count() == 3


def test_contagion_and_communities(spark, g1):
    ill = spark.createDataFrame([("node6",)], "node_id string")
    h = {(r["step"], r["state"]): r["nodes"] for r in communities.contagion(g1, ill, 2, tau=1.0, gamma=0.0).collect()}
    assert h == {(0, "I"): 1, (0, "S"): 5, (1, "I"): 3, (1, "S"): 3, (2, "I"): 6}
    c = {(r["step"], r["state"]): r["nodes"] for r in communities.contagion(g1, ill, 1, tau=1.0, gamma=1.0, kind="collective", activation=communities.at_least(0.3)).collect()}
    assert c[(1, "R")] == 1 and c[(1, "I")] == 2
    split = Hypergraph.from_dict(spark, {"a": ["1", "2", "3"], "b": ["1", "2"], "c": ["7", "8", "9"], "d": ["8", "9"]}).incidence
    for labels in (communities.label_propagation(split), communities.greedy_jaccard(split)):
        got = {r["node_id"]: r["community"] for r in labels.collect()}
        assert got["1"] == got["2"] and got["8"] == got["9"] and got["1"] != got["8"]
    pi = {r["node_id"]: r["score"] for r in communities.stationary(communities.transition_matrix(g1)).collect()}
    assert sum(pi.values()) == pytest.approx(1) and pi["node3"] == pytest.approx(3 / 12)
    assert communities.algebraic_connectivity(split) == pytest.approx(0, abs=1e-9)
    assert communities.overlapping(g1, 3, rounds=2).count() > 0


def test_temporal_fixture(spark):
    steps = [{"E1": "AB", "E2": "BC"}, {"E1": "AB", "E2": "BC", "E3": "CDE"}, {"E1": "ABF", "E2": "BC", "E3": "CDE", "E4": "AFG"}, {"E1": "ABF", "E3": "CD", "E4": "AFG", "E5": "GHIJ"}, {"E1": "AB", "E3": "CDEK", "E4": "AF", "E5": "GHIJ", "E6": "KL"}]
    t = spark.createDataFrame([(i, e, n, 1.0) for i, s in enumerate(steps) for e, ns in s.items() for n in ns], "ts int, edge_id string, node_id string, weight double")
    g = [(r["ts"], r["num_nodes"], r["num_edges"]) for r in temporal.growth(t).orderBy("ts").collect()]
    assert g == [(0, 3, 2), (1, 5, 3), (2, 7, 4), (3, 9, 4), (4, 12, 5)]
    p = {r["edge_id"]: (r["appearances"], r["lifespan"]) for r in temporal.persistence(t, "edge_id").collect()}
    assert p["E1"] == (5, 5) and p["E2"] == (3, 3) and p["E6"] == (1, 1)
    j = {(r["i"], r["j"]): r["jaccard"] for r in temporal.snapshot_jaccard(t).collect()}
    assert j[(0, 1)] == pytest.approx(2 / 3) and j[(2, 3)] == pytest.approx(3 / 5)
    assert temporal.stability(t).count() == 3
    view = {r["edge_id"] for r in temporal.view(t, "intersection").collect()}
    assert view == {"E1"}
    d = temporal.delta(t.where("ts = 0"), t.where("ts = 1"))
    assert {(r["op"], r["edge_id"]) for r in d.collect()} == {("add", "E3")}
    assert {r["op"] for r in temporal.invert_delta(d).collect()} == {"remove"}


def test_as_of_join(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 3), ("c", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("b", 4, "z")], "k string, rt int, v string")
    out = {(r["k"], r["t"]): r["v"] for r in temporal.as_of_join(left, right, ("k",), "t", "rt").collect()}
    assert out == {("a", 1): None, ("a", 5): "y", ("b", 3): None, ("c", 9): None}


def test_hierarchy_and_layers(spark):
    tree = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("e", "b")], "child string, parent string")
    assert {(r["entity"], r["ancestor"], r["depth"]) for r in hierarchy.ancestry(tree).collect()} >= {("d", "b", 1), ("d", "a", 2)}
    assert hierarchy.common_ancestor(tree, "d", "e").first()[0] == "b"
    assert {r[0] for r in hierarchy.leaves(tree).collect()} == {"c", "d", "e"}
    cyclic = spark.createDataFrame([("x", "y"), ("y", "x")], "child string, parent string")
    assert hierarchy.ancestry(cyclic).count() == 2
    m = hierarchy.hierarchy_metrics(tree).first()
    assert (m["entities"], m["depth"], m["breadth"]) == (5, 2, 2)
    q = spark.createDataFrame([("e", "l", "up", 3.0), ("e", "l", "down", 1.0)], "entity string, layer string, state string, probability double")
    assert layers.dominant_state(q).first()["state"] == "up"
    assert layers.normalise_states(q).where("state = 'up'").first()["probability"] == pytest.approx(0.75)
    draws = spark.range(4000).selectExpr("cast(id as string) as entity", "'l' as layer").crossJoin(q.select("state", "probability"))
    share = layers.collapse(draws).where("state = 'up'").count() / 4000
    assert abs(share - 0.75) < 0.04
    friends = {"f": {"f1": "AB", "f2": "BC", "f3": "AC"}, "c": {"c1": "AB", "c2": "AD", "c3": "BC"}, "m": {"m1": "AB", "m2": "CD"}}
    inc = spark.createDataFrame([(e, n, 1.0, m) for m, es in friends.items() for e, ns in es.items() for n in ns], "edge_id string, node_id string, weight double, modality string")
    assert {r["node_id"]: r["modalities"] for r in layers.modal_bridges(inc).collect()} == {"A": 3, "B": 3, "C": 3, "D": 2}
    assert layers.implicit_links(inc, "f", "c").count() > 0


def test_quality_and_metadata(spark):
    df = spark.createDataFrame([(1, "a", 10.0), (2, "b", None), (2, None, 30.0), (4, "b", 1000.0)], "id int, s string, v double")
    out = {r["rule"]: (round(r["score"], 4), r["status"]) for r in quality.evaluate(df, [quality.Rule("u", "unique", "id"), quality.Rule("n", "not_null", "s", threshold=0.9), quality.Rule("r", "range", "v", (0, 100), 0.5), quality.Rule("c", "custom", "v", lambda c: c > 5, 0.7)]).collect()}
    assert out == {"u": (0.75, "fail"), "n": (0.75, "warn"), "r": (0.5, "pass"), "c": (0.75, "pass")}
    filled = quality.fill_missing(df).collect()
    assert filled[1]["v"] == 30.0 and filled[2]["s"] == "b"
    assert quality.duplicates(df.unionByName(df)).first()["duplicates"] == 4
    assert quality.clean(df).count() == 3  # two rows are equal once filled
    assert quality.column_kind(spark.createDataFrame([(f"2024-01-0{i}",) for i in range(1, 9)], "d string"), "d") == "temporal"
    store = spark.createDataFrame([("e1", "t", '{"k": 1, "name": "x"}', 1, 1, 1)], "entity_id string, entity_type string, metadata string, created_at int, updated_at int, version int")
    new = spark.createDataFrame([("e1", "t", '{"k": 2}', 5), ("e2", "t", '{"k": 2, "name": "Xy"}', 6)], "entity_id string, entity_type string, metadata string, updated_at int")
    up = metadata.upsert(store, new)
    assert {r["entity_id"]: (r["created_at"], r["version"]) for r in up.collect()} == {"e1": (1, 2), "e2": (6, 1)}
    assert metadata.query(up, {"k": 2}).count() == 2 and metadata.query(up, {"name": {"contains": "X"}}).count() == 1
    assert metadata.search_content(up, "xy").count() == 1


def test_geometry(spark):
    df = spark.createDataFrame([(i, float(i % 7), float((i * i) % 11)) for i in range(60)] + [(99, 60.0, 1.0)], "id int, x double, y double")
    assert [r["id"] for r in geometry.property_outliers(df, "id", ["x", "y"]).collect()] == [99]
    s = spark.createDataFrame([("a", i, float(i % 4 == 0)) for i in range(40)], "k string, i int, value double")
    assert geometry.cycles_by_spectrum(s, "k", confidence=0.3).count() == 1


def test_empty_tables(spark):
    e = Hypergraph.from_dict(spark, {}).incidence
    for f in (basic.node_degrees, basic.edge_sizes, basic.statistics, transforms.dual, transforms.line_graph, transforms.adjacency, patterns.node_features, patterns.edge_features, patterns.motifs, centrality.importance, paths.connected_components, centrality.closeness, patterns.average_edge_overlap):
        assert f(e).count() <= 1
    assert setops.union(e, e).count() == 0


def test_similarity_needs_no_order(g1):
    assert patterns.node_similarity(g1).count() == 11
    assert patterns.weighted_clustering(g1).count() == 6
    assert communities.consensus(communities.label_propagation(g1).withColumn("run", F.lit(1))).count() == 6


def test_interpolate_in_ranges(spark):
    """As by hand, with keys and without, over several ranges; no frame is open ahead, which is read anew for each row."""
    import random

    from weftgraph.operators import quality

    rng = random.Random(3)
    data = [(i, i % 3 if i % 7 else None, rng.random() * 9 if rng.random() < 0.3 else None) for i in range(-5, 400)] + [(None, 1, 4.0)]
    df = spark.createDataFrame(data, "t long, k long, v double").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for keys in ((), ("k",)):
        groups = {}
        for t, k, v in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0)):
            groups.setdefault(k if keys else 0, []).append((t, k, v))
        want = []
        for rows in groups.values():
            known = [(i, r[2]) for i, r in enumerate(rows) if r[2] is not None]
            for i, (t, k, v) in enumerate(rows):
                p, n = [x for x in known if x[0] <= i][-1:], [x for x in known if x[0] >= i][:1]
                want.append((t, k, v if v is not None else round(p[0][1] + (n[0][1] - p[0][1]) / (n[0][0] - p[0][0]) * (i - p[0][0]), 9) if p and n else None))
        out = quality.interpolate(df, "v", "t", keys)
        got = [(r["t"], r["k"], r["v"]) for r in out.collect()]
        close = lambda rows: sorted(((t, k, None if v is None else round(v, 6)) for t, k, v in rows), key=repr)
        assert close(got) == close(want) and out.columns == df.columns
        assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_parquet_stream_of_many_files(spark, tmp_path):
    """All rows come in a bounded number of triggers, and in some files each where the files are few."""
    from weftgraph.sources import formats
    from weftgraph.streaming import events

    spark.range(40).repartition(40).write.parquet(f"{tmp_path}/in")
    files = len(list((tmp_path / "in").glob("*.parquet")))
    for most, each in ((5, -(-files // 5)), (64, 2)):
        query = events.to_table(formats.stream_parquet(spark, f"{tmp_path}/in", 2, most), f"{tmp_path}/out{most}", f"{tmp_path}/marks{most}")
        query.awaitTermination()
        assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out{most}").collect()) == list(range(40))
        assert len(list((tmp_path / f"marks{most}" / "commits").glob("[0-9]*"))) == -(-files // each)


def test_edge_jaccard_least(spark):
    """As by hand, on edges of every size around the bounds, repeated rows, null ids, ids as numbers and as strings."""
    import random

    rng = random.Random(5)
    members = {e: set(rng.sample(range(40), rng.choice([1, 1, 2, 2, 3, 4, 5, 6, 9, 14]))) for e in range(90)}
    members |= {100 + e: set(range(e, e + 20)) ^ {rng.randrange(40)} for e in range(8)}
    members |= {200 + e: set(members[e]) for e in range(0, 90, 7)}
    data = [(e, n) for e, m in members.items() for n in m for _ in range(1 + (e + n) % 3 // 2)] + [(e, None) for e in range(3)] + [(None, 1), (None, 2)]
    pairs = {}
    for e, f in ((e, f) for e in members for f in members if str(e) < str(f) and members[e] & members[f]):
        shared = len(members[e] & members[f])
        pairs[str(e), str(f)] = (shared, shared / (len(members[e] | members[f]) + (e < 3) + (f < 3)))
    bounds = ((0.3, 32), (0.3, 7), (0.3, 1), (0.75, 4), (1 / 3, 32), (0.05, 5), (1.0, 32))
    for kind, cases in (("long", bounds), ("string", bounds[:1])):
        df = spark.createDataFrame(data, "edge_id long, node_id long").select(F.col("edge_id").cast(kind), F.col("node_id").cast(kind))
        for least, most in cases:
            got = {(r["e"], r["f"]): (r["shared"], r["jaccard"]) for r in patterns.edge_jaccard(df, least, most).collect()}
            assert got == {k: v for k, v in pairs.items() if v[1] >= least}, (kind, least, most)


def test_edge_jaccard_least_makes_few_rows(spark):
    """Edges that share one node and cannot reach the threshold by it are not listed in pairs: joins make no more rows than are wanted."""
    rows = [(f"e{i}", n) for i in range(300) for n in ("hub", *(f"n{i}_{j}" for j in range(3)))] + [("twin", n) for n in ("hub", "n7_0", "n7_1", "n7_2")]
    inc = spark.createDataFrame(rows, "edge_id string, node_id string").withColumn("weight", F.lit(1.0))

    def made(plan):
        children = plan.children()
        below = sum(made(children.apply(i)) for i in range(children.size()))
        return below + (plan.metrics().apply("numOutputRows").value() if "Join" in plan.nodeName() and plan.metrics().contains("numOutputRows") else 0)

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = patterns.edge_jaccard(inc, 0.3)
        assert [tuple(r) for r in out.collect()] == [("e7", "twin", 4, 1.0)]
        assert made(out._jdf.queryExecution().executedPlan()) <= 6
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_edge_similarity_with_nulls(spark, tmp_path):
    """As the query's SQL gives it: a null part counts to its order's size, and orders do not meet by it."""
    import duckdb

    from weftgraph import catalog

    data = [(o, p, 1.0, 1) for o in range(12) for p in (o % 4, 4 + o % 3, 9)] + [(o, None, 1.0, 2) for o in (0, 0, 4, 5)] + [(None, 1, 1.0, 1)]
    spark.createDataFrame(data, "l_orderkey long, l_partkey long, l_quantity double, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    queries, sql = catalog.collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    for t in ("supplier", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = con.sql(f"SELECT e, f, shared, jaccard FROM ({sql['edge_similarity_jaccard']})").fetchall()
    got = [(r["e"], r["f"], r["shared"], r["jaccard"]) for r in queries["edge_similarity_jaccard"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and any(r[3] == 0.4 for r in want)
