"""Fingerprints, byte dedup, top-k, paragraph dedup and toxicity against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from test_corpus_operators import AWKWARD, DATA, SCHEMA, rows
from weftgraph.llm import fingerprints, knn, paragraphs, queries, suffixes, toxicity


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, 1, "x") for r in AWKWARD], SCHEMA + ", bucket int, cls string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# fingerprints


def edited_by_hand(data):
    data = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    for i, (d, t) in enumerate(data):
        after = data[(i + 1) % len(data)][1]
        k = len(t) // 3
        yield d, t, t[: len(t) - k] + after[:k], after


@pytest.mark.parametrize("which", ["docs", "awkward"])
def test_fingerprints(which, request):
    df = request.getfixturevalue(which)
    want = list(edited_by_hand([(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]))
    out = fingerprints.compare(df).collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((repr(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in out) == sorted((repr(d), len(t), digest(e)) for d, t, e, _ in want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    of = {}
    for d, t, e, n in want:
        of[(repr(d), digest(e))] = (t, e, n)
    by_text = {}
    for r in out:
        t, e, n = of[(repr(r["doc_id"]), r["edited_sha256"])]
        by_text.setdefault(t, set()).add(r["fingerprint"])
        by_text.setdefault(e, set()).add(r["edited_fingerprint"])
        if t == n:
            assert r["near_next"] == 1
    assert all(len(v) == 1 for v in by_text.values())
    assert len({min(v) for v in by_text.values()}) == len({tuple(sorted(t.split("\n"))) for t in by_text})


def test_fingerprint_lanes_by_hand(spark):
    """The exact lanes are the sums of the paragraphs' SHA-256; order does not matter; sums are homomorphic."""
    texts = [(1, "a b c d\nx\n"), (2, "x\n\na b c d"), (3, "a b c d"), (4, "x\n")]
    df = spark.createDataFrame(texts, "id long, t string")
    got = {r["id"]: list(r["lanes"]) for r in fingerprints.lanes(df, ["id"], "t").collect()}
    for i, t in texts:
        sums = [0] * 8
        for p in t.split("\n"):
            h = hashlib.sha256(p.encode()).hexdigest()
            sums = [s + int(h[8 * j : 8 * j + 8], 16) for j, s in enumerate(sums)]
        assert got[i][:8] == sums
    assert got[1] == got[2] == [a + b for a, b in zip(got[3], got[4], strict=True)]


def test_likeness_follows_the_overlap(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    rowset = []
    for i in range(40):
        share = i / 40
        other = base[: int(600 * share)] + [f"v{rng.randrange(10**6)}" for _ in range(600 - int(600 * share))]
        rowset.append((i, " ".join(base), " ".join(other), share))
    df = spark.createDataFrame(rowset, "id long, a string, b string, share double")
    a = fingerprints.lanes(df, ["id"], "a").withColumnRenamed("lanes", "la")
    b = fingerprints.lanes(df, ["id"], "b").withColumnRenamed("lanes", "lb")
    out = {r["id"]: r["l"] for r in a.join(b, "id").select("id", fingerprints.likeness(a["la"], b["lb"]).alias("l")).collect()}
    assert sum(abs(out[i] - share) for i, *_, share in rowset) / 40 < 0.15


def test_fingerprints_empty(empty):
    assert fingerprints.compare(empty).count() == 0


# byte dedup


def dedup_by_hand(data, length):
    seen, gone = {}, {}
    places = sorted(((d is not None, d or 0), i, t) for i, (d, t) in enumerate(data))
    for d, _, t in places:
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            seen[w] = min(seen.get(w, (d, s)), (d, s))
    out = []
    for d, i, t in places:
        cover = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] < (d, s):
                cover[s : s + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, cover, strict=True) if not g)
        runs = sum(1 for j, g in enumerate(cover) if g and (j == 0 or not cover[j - 1]))
        out.append((data[i][0], len(t), sum(cover), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_byte_dedup_tables(docs):
    data = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    want = dedup_by_hand(data, 100)
    assert any(w[2] for w in want)
    assert rows(suffixes.dedup(docs)) == want


def test_byte_dedup_awkward(awkward, empty):
    data = [(r[0], (r[1] or "").encode()) for r in AWKWARD]
    assert rows(suffixes.dedup(awkward)) == dedup_by_hand(data, 100)
    assert suffixes.dedup(empty).count() == 0


@pytest.mark.parametrize("length", [17, 40, 100])
def test_byte_dedup_random(spark, length):
    rng = random.Random(length)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(length // 2, 3 * length))) for _ in range(12)]
    data = []
    for i in range(60):
        t = "".join(rng.choice([rng.choice(passages), "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 30)))]) for _ in range(rng.randint(0, 6)))
        if rng.random() < 0.2:
            t += "ab" * rng.randint(0, 150)
        data.append((i // 2 * 2 if i % 9 == 0 else i, t))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert rows(suffixes.dedup(df, length)) == dedup_by_hand([(d, t.encode()) for d, t in data], length)


def test_byte_dedup_of_texts_in_pieces(spark):
    """A text that repeats itself across pieces, and once over their border, and one that repeats another's later piece."""
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, other = noise(130), noise(120)
    data = [(1, noise(300) + passage + noise(2000) + passage + noise(900)), (2, noise(940) + other + noise(1800) + other), (3, noise(2500) + passage), (4, noise(5000))]
    want = dedup_by_hand([(d, t.encode()) for d, t in data], 100)
    assert [w[2] > 0 for w in want] == [True, True, True, False]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(suffixes.dedup(df, piece=1000)) == rows(suffixes.dedup(df)) == want
    alone = data[:1]
    want = dedup_by_hand([(d, t.encode()) for d, t in alone], 100)
    assert rows(suffixes.dedup(spark.createDataFrame(alone, "doc_id long, text string"), piece=1000)) == want


# exact top-k


def top_by_hand(data, k=5, every=50):
    from math import floor, isfinite

    vectors = [(i, [floor(256 * x) for x in v]) for i, v in data if v is not None and all(x is not None and isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in vectors if i % every == 0}.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in vectors if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = top_by_hand([(r["vec_id"], r["embedding"]) for r in df.collect()])
    assert sorted(map(tuple, knn.top_k(df).collect())) == want
    assert sorted(map(tuple, knn.top_k(df, cell_rows=20, block=16).collect())) == want


def test_top_k_awkward(spark):
    rng = random.Random(4)
    data = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)]) for i in range(160)]
    data += [(200, None), (250, [1.0, None, 2.0]), (300, [float("nan"), 0.0, 1.0]), (350, [float("inf"), 0.0, 1.0]), (400, [1.0, 2.0]), (401, [2.0, 1.0]), (450, []), (151, data[151][1]), (151, data[151][1])]
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in data], "vec_id long, embedding array<float>, cell int, v string")
    want = top_by_hand(data)
    assert sorted(map(tuple, knn.top_k(df, cell_rows=10, block=8).collect())) == want
    assert sorted(map(tuple, knn.top_k(df, every=1, k=3).where("query_id != 151").collect())) == [w for w in top_by_hand(data, 3, 1) if w[0] != 151]
    assert knn.top_k(df.where("vec_id < 0")).count() == 0


def test_top_k_of_large_components(spark):
    """Components of any finite size take part, and products are exact beyond 2**53."""
    rng = random.Random(6)
    big = lambda: [rng.choice([0.5, -1.0, 5000.0, 1e6, -1e6, 123456.789]) for _ in range(3)]
    data = [(0, [1.0, 0.0, 0.0]), (1, [5000.0, 0.0, 0.0]), (2, [0.5, 0.0, 0.0])] + [(i, big()) for i in range(3, 220)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    want = top_by_hand(data)
    assert max(abs(w[3]) for w in want) > 1 << 53
    assert sorted(map(tuple, knn.top_k(df).collect())) == want
    assert sorted(map(tuple, knn.top_k(df, cell_rows=10, block=16).collect())) == want
    huge = spark.createDataFrame([(50, [1e300, 1.0]), (1, [1e300, 1.0]), (2, [-1e300, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in knn.top_k(huge).orderBy("rank").collect()] == [(1, 2**63 - 1), (3, 2**63 - 1), (2, -(2**63))]


# paragraph dedup


def paragraphs_by_hand(data, min_words=16):
    items = []
    for d, t in data:
        for j, line in enumerate((t or "").split("\n")):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
            w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", w) if x]
            if len(w) >= min_words:
                items.append((d, j, {tuple(w[i : i + 5]) for i in range(len(w) - 4)}))
    parent = list(range(len(items)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    index = {}
    for i, (*_, s) in enumerate(items):
        for g in s:
            index.setdefault(g, []).append(i)
    for i, (*_, s) in enumerate(items):
        for o, c in Counter(j for g in s for j in index[g] if j < i).items():
            if 4 * c >= 3 * (len(s) + len(items[o][2]) - c):
                parent[max(root(i), root(o))] = min(root(i), root(o))
    groups = {}
    for i, (d, j, _) in enumerate(items):
        groups.setdefault(root(i), []).append((d, j))
    return {(d, j): min(g) for g in groups.values() if len(g) > 1 for d, j in g}


def test_paragraph_dedup(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = paragraphs_by_hand([(r["doc_id"], r["text"]) for r in df.collect()])
    out = paragraphs.dedup(df).collect()
    got = {(r["doc_id"], r["para"]): (r["first_doc"], r["first_para"]) for r in out}
    assert all(r["removed"] == ((r["doc_id"], r["para"]) != (r["first_doc"], r["first_para"])) for r in out)
    missed = [k for k in want if k not in got]
    assert not [k for k in got if k not in want] and len(missed) <= 0.002 * len(want)
    assert sum(got.get(k) != v for k, v in want.items()) <= 0.005 * len(want)


def test_paragraph_dedup_awkward(awkward, empty):
    out = paragraphs.dedup(awkward).collect()
    assert all(r["cluster_size"] >= 2 for r in out)
    assert paragraphs.dedup(empty).count() == 0
    bands, r = paragraphs.tune()
    assert 1 - (1 - 0.75**r) ** bands >= 0.9995 > 1 - (1 - 0.75**r) ** (bands - 1)


def test_passages_inside_lines(spark, awkward, empty):
    """Passages of over 50 words inside different lines are found, and nothing else is."""
    rng = random.Random(8)
    word = lambda: f"{rng.choice('bcdfgh')}{rng.randrange(10**5)}"
    shared = [" ".join(word() for _ in range(rng.randint(52, 70))) for _ in range(40)]
    data, planted = [], {}
    for i in range(400):
        w = [word() for _ in range(rng.randint(5, 200))]
        if rng.random() < 0.4:
            k = rng.randrange(40)
            w.insert(rng.randrange(len(w) + 1), shared[k])
            planted.setdefault(k, []).append(i)
        data.append((i, " ".join(w)))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    out = paragraphs.passages(df).collect()
    want = {i for docs in planted.values() if len(docs) > 1 for i in docs}
    got = {r["doc_id"] for r in out}
    assert got == want
    for r in out:
        text = data[r["doc_id"]][1].split()
        run = " ".join(text[r["at"] : r["at"] + r["n_words"]])
        assert run in data[r["first_doc"]][1] and r["removed"] == (r["doc_id"] != r["first_doc"])
    assert sorted(map(tuple, out)) == sorted(map(tuple, paragraphs.passages(df.repartition(1)).collect()))


def test_passages_hold_every_shared_window(spark, awkward, empty):
    """Every 50-word window that two documents of the table hold lies in documents that are found; one-word texts and ids that repeat too."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    more = [(10**6, "la " * 300), (10**6 + 1, "x la " + "la " * 200), (10**6 + 2, "do re " * 90), (10**6 + 3, "re do " * 60)]
    rng = random.Random(3)
    w = [f"q{rng.randrange(10**6)}" for _ in range(200)]
    more += [(10**6 + 4, " ".join(w[:120])), (10**6 + 5, " ".join(w[:60])), (10**6 + 5, " ".join(w[120:] + w[60:115])), (None, " ".join(w[125:190]))]
    df = df.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    holders = {}
    texts = {(r["doc_id"], r["text"]) for r in df.collect() if r["text"]}
    for key in texts:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in key[1])
        words = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", words) if x]
        for i in range(len(words) - 49):
            holders.setdefault(hash(tuple(words[i : i + 50])), set()).add(key)
    want = {k[0] for who in holders.values() if len(who) > 1 for k in who}
    out = paragraphs.passages(df).collect()
    assert want <= {r["doc_id"] for r in out} and min(r["n_words"] for r in out) >= 28
    spans = [(0, 60, 10**6 + 4), (0, 80, None), (80, 135, 10**6 + 4)]  # each is found but for 22 words at either end
    found = [(r["at"], r["at"] + r["n_words"], r["first_doc"]) for r in out if r["doc_id"] == 10**6 + 5]
    assert len(found) == 3
    for s, e, first in found:
        assert any(a <= s <= a + 22 and z - 22 <= e <= z and first in (o, 10**6 + 5) for a, z, o in spans)
    assert paragraphs.passages(empty).count() == 0
    assert {r["doc_id"] for r in paragraphs.passages(awkward).collect()} <= {r[0] for r in AWKWARD}


# toxicity


def test_toxicity_held_out(spark):
    data = "/root/testdata/sf0.1"
    out = {r["doc_id"]: r for r in queries.op10_toxicity(spark, data).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for d, r in out.items())
    held = [(out[r["doc_id"]]["score"], r["toxic"]) for r in spark.read.parquet(f"{data}/labels.parquet").collect() if out[r["doc_id"]]["held_out"]]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc > 0.95
    assert sum((s >= 0.5) == bool(y) for s, y in held) > 0.95 * len(held)


def test_toxicity_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(13, 1, None), (15, 1, 1), (16, 1, 0), (16, 1, 0), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(awkward, labels, labels["doc_id"] != 14)
    out = toxicity.score(awkward, model).collect()
    assert len(out) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in out)
    nothing = toxicity.train(empty, labels.where("false"), labels["doc_id"] > 0)
    assert toxicity.score(empty, nothing).count() == 0
    assert {r["score"] for r in toxicity.score(awkward, nothing).collect()} == {0.5}
    assert toxicity.train(empty, labels, labels["doc_id"] > 0)["at"] == []


def test_ftrl_separates():
    import numpy as np

    rng = random.Random(6)
    data = [(np.array(sorted({rng.randrange(10, 200) for _ in range(15)} | ({1} if y else set()))), y) for y in (rng.random() < 0.3 for _ in range(600))]
    at, w, _ = toxicity.ftrl(data, 8, 0.1, 1.0, 1.0, 1.0, 3)
    assert at[np.argmax(w)] == 1 and len(at) < 200
