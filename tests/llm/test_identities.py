"""Identities, filters and duplicate rows: what hashes must not confuse, and learning against a plain version."""

import math
import random
import time

import corpus_pipeline
import numpy as np
import pytest
from weftgraph.llm import jaccard_join, links, secrets, suffixes, textnp, toxicity

SCHEMA = "doc_id long, text string"


def thue_morse(n, a, b):
    s = a
    while len(s) < n:
        s += s.translate(str.maketrans(a + b, b + a))
    return s


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_of_equal_structure_are_not_linked(spark, n):
    """A Thue-Morse word and its complement have equal polynomial hashes modulo 2**64 for any odd base."""
    a, b = thue_morse(n, "a", "b"), thue_morse(n, "b", "a")
    hashes, _ = textnp.words([a.encode(), b.encode()])
    assert hashes[0] != hashes[1]
    df = spark.createDataFrame([(1, a), (2, b), (3, a)], SCHEMA)
    assert sorted(map(tuple, jaccard_join.join(df).collect())) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]
    kept = {r["doc_id"]: r["n_removed"] for r in suffixes.dedup(spark.createDataFrame([(1, a + "x" * 40), (2, b + "y" * 40)], SCHEMA)).collect()}
    whole = {a[i : i + 100] for i in range(n - 99)}
    assert (kept[2] > 0) == any(b[i : i + 100] in whole | {b[j : j + 100] for j in range(i)} for i in range(n - 99))


def test_runs_of_words_of_equal_structure():
    pattern = thue_morse(4096, "a", "b")
    h, _ = textnp.words([" ".join(pattern).encode(), " ".join(pattern.translate(str.maketrans("ab", "ba"))).encode()])
    runs = textnp.runs_hash(h, np.array([0, 4096]), 5)
    assert runs[0] != runs[1]


def test_classes_that_share_half_an_identity(spark):
    """Two identities with one first half come apart by a turn of the second half."""
    rows = spark.createDataFrame([(1, 7, 100), (2, 7, 200), (3, 8, 100), (4, 7, 100)], "doc_id long, c1 long, c2 long")
    out, turn = links.exact_nodes(rows)
    assert turn > 0
    nodes = {r["doc_id"]: r["cls"] for r in out.collect()}
    assert nodes[1] == nodes[4] and len(set(nodes.values())) == 3
    a, b = np.array([7, 7, 8, 7]), np.array([100, 200, 100, 100])
    assert textnp.node_of(a, b, turn).tolist() == [nodes[i] for i in (1, 2, 3, 4)]


def test_join_with_clashing_first_halves(spark, monkeypatch):
    """The join is right when first halves of unlike documents clash."""
    from test_corpus_operators import jaccard_by_hand

    import weftgraph.llm.jaccard_join as j

    plain = textnp.set_ids
    monkeypatch.setattr(j, "set_ids", lambda values, first: (lambda a, b: (a & np.int64(3), b))(*plain(values, first)))
    rng = random.Random(5)
    data = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 9)))) for i in range(60)]
    df = spark.createDataFrame(data, SCHEMA)
    assert sorted(map(tuple, j.join(df).collect()), key=repr) == jaccard_by_hand(data)


@pytest.mark.parametrize("few", [0, 1000])
def test_id_filter(spark, few):
    ids = spark.range(0, 3000, 7).withColumnRenamed("id", "k")
    df = spark.range(0, 3000).selectExpr("id AS doc", "cast(id AS string) AS text")
    passed = {r["text"] for r in links.IdFilter(ids, "k").passing(df, "doc", ("text",), few).collect()}
    assert {str(i) for i in range(0, 3000, 7)} <= passed and len(passed) < 1200


def test_grouping_by_ends_and_by_sort(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(300), rng.randrange(10**6)) for _ in range(900)] + [(5, i) for i in range(400)]
    df = spark.createDataFrame(rows, "sig long, cls long").repartition(5)
    lists = df.selectExpr("cls", "array(sig) AS keys").unionByName(df.selectExpr("cls", "cast(array() AS array<bigint>) AS keys"))
    want = {}
    for s, c in rows:
        want.setdefault(s, set()).add(c)
    want = sorted((s, min(v), c) for s, v in want.items() if len(v) > 1 for c in v)
    assert sorted(set(map(tuple, links.grouped_by_ends(lists).collect()))) == want
    for size in (3, 50, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
        got = links.grouped(df.selectExpr("sig * 128 + cls % 5 AS sig", "cls")).collect()
        hubs = {}
        for r in got:
            hubs.setdefault(r["sig"], set()).add(r["hub"])
        assert {(r["sig"], r["cls"]) for r in got} == {(s, c) for s, _, c in want}
        assert all(len(v) == 1 for v in hubs.values()) and {(s, h) for s, v in hubs.items() for h in v} <= {(s, c) for s, _, c in want}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_links_with_hubs_that_are_not_the_nearest(spark):
    """A class links with each hub it meets: with one beside its nearest, and with one where the nearest fails the exact test."""
    sets = {
        1: range(100), 2: range(101), 3: [*range(100), *range(200, 210)],  # 1 links with both
        11: range(1000, 1100), 12: [*range(1000, 1085), *range(1300, 1315)], 13: range(1000, 1110),  # 11 links with 13 only
    }
    groups = spark.createDataFrame([(s, h, c) for s, (h, c) in enumerate([(2, 1), (3, 1), (12, 11), (13, 11)]) for c in (h, c)], "sig long, hub long, cls long")
    values = {c: np.array(list(v), np.uint64) for c, v in sets.items()}
    rows = lambda payload: spark.createDataFrame([(c, bytearray(payload(c, v))) for c, v in values.items()], "cls long, payload binary")
    # a sketch is a lower bound: 12's collides with that of 11, so 12 looks nearest
    sketch = lambda c, v: links.bit_sketch(values[11] if c == 12 else v, 9)
    labels = links.resolve(groups, lambda nodes: rows(sketch), lambda nodes: rows(lambda c, v: v.tobytes()).join(nodes, "cls", "left_semi"), jaccard_join.exact_test, 7)
    found = {}
    for r in labels.collect():
        found.setdefault(r["comp"], set()).add(r["node"])
    assert sorted(map(sorted, found.values())) == [[1, 2, 3], [11, 13]]


@pytest.mark.parametrize("options", [{}, {"most_open": 0}, {"block": 4, "largest": 4}])
def test_links_of_groups_by_brute_force(spark, monkeypatch, options):
    """Components are those of all links inside groups, whether a component is compared at once, again, or in several blocks; whole ones only once."""
    rng = random.Random(11)
    plain, turns = links.satellite_pairs, []
    monkeypatch.setattr(links, "satellite_pairs", lambda *a: turns.append(a[4]) or plain(*a, **options))
    base = [rng.sample(range(10**6), 60) for _ in range(3)]
    values = {c: np.unique(np.array([rng.randrange(10**6) if rng.random() < 0.13 else x for x in base[c % 3]], np.uint64)) for c in range(60)}
    groups = [(s, m[0], c) for s in range(12) for m in [rng.sample(range(60), 14)] for c in m]
    df = spark.createDataFrame(groups, "sig long, hub long, cls long")
    rows = lambda f: spark.createDataFrame([(c, bytearray(f(v))) for c, v in values.items()], "cls long, payload binary")
    labels = links.resolve(df, lambda nodes: rows(lambda v: links.bit_sketch(v, 7)), lambda nodes: rows(lambda v: v.tobytes()).join(nodes, "cls", "left_semi"), jaccard_join.exact_test, 7)
    found = {}
    for r in labels.collect():
        found.setdefault(r["comp"], set()).add(r["node"])
    root = list(range(60))
    top = lambda c: c if root[c] == c else top(root[c])
    for s, _, a in groups:
        for z, _, b in groups:
            if s == z and a < b and jaccard_join.exact_test([values[a].tobytes()], [values[b].tobytes()])[0]:
                root[max(top(a), top(b))] = min(top(a), top(b))
    want = {}
    for c in range(60):
        want.setdefault(top(c), set()).add(c)
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
    assert turns == ([True, False] if options else [True])


def test_near_duplicate_stage_with_repeated_ids(spark):
    """Rows with one id and unlike texts are two documents; of equal ones the first stays, once."""
    one, two = "a b c d e f g h i j", "q r s t u v w x y z"
    data = [(1, one, "en", "s", 19), (1, two, "en", "s", 19), (1, one, "de", "s", 19), (2, two, "en", "s", 19), (None, one, "en", "s", 19), (None, "only here it is", "en", "s", 15), (3, "", "en", "s", 0), (3, "", "en", "s", 0)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()), key=repr)
    assert kept == sorted([(1, one), (1, two), (None, "only here it is"), (3, ""), (3, "")], key=repr)


def test_many_secrets_in_one_text(spark):
    """The time for one text grows about as its matches do."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(20))
    took = {}
    for n in (1000, 8000):
        text = " ".join(word() for _ in range(n))
        df = spark.createDataFrame([(1, text)], SCHEMA)
        start = time.time()
        spans = secrets.scan(df, keep=("text",))
        row = spans.selectExpr("size(spans) AS n", "spans[0].s AS s", "element_at(spans, -1).e AS e").first()
        took[n] = time.time() - start
        assert (row["n"], row["s"], row["e"]) == (n, 0, 21 * n - 1)
        cleaned = spans.select(secrets.redact(spans["text"], spans["spans"]).alias("t")).first()["t"]
        assert cleaned == " ".join(["[SECRET]"] * n)
    assert took[8000] < 30 * max(took[1000], 0.2)


def test_ftrl_by_plain_dictionaries():
    """Weights and scores of the learner are those of the textbook update, one coordinate at a time."""
    rng = random.Random(9)
    rows = [(sorted({rng.randrange(64) for _ in range(rng.randint(0, 12))}), rng.randrange(2)) for _ in range(150)]
    alpha, beta, l1, l2 = 0.1, 1.0, 0.3, 1.0
    z, n = {}, {}

    def weight(i):
        cost = 0.0 if i == "bias" else l1
        x = z.get(i, 0.0)
        return 0.0 if abs(x) <= cost else -(x - math.copysign(cost, x)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(2):
        for at, y in rows:
            every = [*at, "bias"]
            w = {i: weight(i) for i in every}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in every:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    want = {i: weight(i) for i in range(64) if weight(i)}
    at, w, bias = toxicity.ftrl([(np.array(a, np.int64), y) for a, y in rows], 6, alpha, beta, l1, l2, 2)
    assert dict(zip(at.tolist(), w.tolist(), strict=True)) == pytest.approx(want) and bias == pytest.approx(weight("bias"))
