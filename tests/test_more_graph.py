"""Operators that SQL does not give, against plain versions."""

import random
from collections import deque

import pytest

from weftgraph.hypergraph import Hypergraph
from weftgraph.operators import centrality, communities, geometry


def graph(spark, seed=3, nodes=14, edges=16):
    rng = random.Random(seed)
    members = {f"e{i}": sorted({f"n{rng.randrange(nodes):02d}" for _ in range(rng.randint(2, 4))}) for i in range(edges)}
    return Hypergraph.from_dict(spark, members).incidence, members


def neighbours(members):
    near = {}
    for m in members.values():
        for a in m:
            near.setdefault(a, set()).update(b for b in m if b != a)
    return near


def test_load_centrality(spark):
    inc, members = graph(spark)
    near = neighbours(members)
    score = dict.fromkeys(near, 0.0)
    for target in near:
        depth, queue, order = {target: 0}, deque([target]), []
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    queue.append(w)
        load = {v: 1.0 for v in order}
        for v in reversed(order[1:]):
            nearer = [w for w in near[v] if depth[w] == depth[v] - 1]
            for w in nearer:
                load[w] += load[v] / len(nearer)
        for v in order[1:]:
            score[v] += load[v] - 1
    got = {r["node_id"]: r["score"] for r in centrality.load(inc, normalized=False).collect()}
    assert got == pytest.approx(score)


def clusters_by_hand(members, k, linkage):
    near = {}
    for e, m in members.items():
        for n in m:
            near.setdefault(n, set()).add(e)
    groups = [[n] for n in sorted(near)]
    apart = lambda a, b: 1 - len(near[a] & near[b]) / len(near[a] | near[b])
    how = {"single": min, "complete": max, "average": lambda x: sum(x) / len(x)}[linkage]
    while len(groups) > k:
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))), key=lambda p: (round(how([apart(a, b) for a in groups[p[0]] for b in groups[p[1]]]), 9), p))
        groups[i] = sorted(groups[i] + groups.pop(j))
    return {n: min(g) for g in groups for n in g}


@pytest.mark.parametrize("linkage", ["single", "complete", "average"])
def test_agglomerative(spark, linkage):
    inc, members = graph(spark, 5)
    got = {r["node_id"]: r["community"] for r in communities.agglomerative(inc, 4, linkage).collect()}
    want = clusters_by_hand(members, 4, linkage)
    assert len(set(got.values())) == 4 and sorted(got) == sorted(want)
    if linkage != "average":  # sums in another order may break near ties otherwise
        assert got == want


def test_agglomerative_ward_and_bounds(spark):
    inc, _ = graph(spark)
    assert len({r["community"] for r in communities.agglomerative(inc, 3, "ward").collect()}) == 3
    with pytest.raises(ValueError):
        communities.agglomerative(inc, 3, most_nodes=2)


def test_adaptive_method(spark):
    inc, _ = graph(spark)
    assert communities.adaptive_method(inc) == "agglomerative"
    assert {r["method"] for r in communities.adaptive_communities(inc, 3).collect()} == {"agglomerative"}


def test_curvature_of_a_square(spark):
    at = spark.createDataFrame([("c", [0.0, 0.0]), ("e", [1.0, 0.0]), ("n", [0.0, 1.0]), ("s", [0.0, -1.0]), ("w", [-1.0, 0.0])], "id string, vector array<double>")
    e = spark.createDataFrame([("c", x) for x in "ensw"], "a string, b string")
    got = {r["id"]: r["curvature"] for r in geometry.node_curvature(at, e).collect()}
    # neighbours in id order e, n, s, w: angles of 90, 180, 90 and 180 degrees
    import math

    assert got["c"] == pytest.approx((2 * math.pi - 3 * math.pi) / 4, abs=1e-4) and got["e"] == 0.0
