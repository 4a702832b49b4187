"""Pattern, path, similarity, ontology and resolution queries on a knowledge graph.

Tables: triples (s, p, o); entities (id, type, name, props map<string,string>).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import paths
from ..session import cut, ratio
from .reasoning import SUBCLASS, TYPE, closure


def triples_of(inc: DataFrame, edge_type: str = "edge_type", pos: str = "pos") -> DataFrame:
    """(s, p, o, edge_id): subject and object by the position of a node in its edge."""
    s = inc.where(F.col(pos) == 0).select("edge_id", F.col("node_id").alias("s"), F.col(edge_type).alias("p"))
    return s.join(inc.where(F.col(pos) == 1).select("edge_id", F.col("node_id").alias("o")), "edge_id").select("s", "p", "o", "edge_id")


def edges_of(triples: DataFrame, relations: list[str] | None = None, directed: bool = False) -> DataFrame:
    t = triples if relations is None else triples.where(F.col("p").isin(relations))
    e = t.select(F.col("s").alias("a"), F.col("o").alias("b"))
    return e.distinct() if directed else paths.both_directions(e)


def neighborhood(triples: DataFrame, entity: str, hops: int = 1, relations: list[str] | None = None) -> DataFrame:
    """(node, depth) within ``hops``, in both directions."""
    start = triples.sparkSession.createDataFrame([(entity,)], "source string")
    return paths.bfs(edges_of(triples, relations), start, hops).select("node", "depth")


def subgraph(triples: DataFrame, centers: list[str], depth: int = 2, most_nodes: int | None = None, relations: list[str] | None = None) -> DataFrame:
    """Triples between the nodes within ``depth`` of the centres; at most ``most_nodes`` nodes, nearest first, then by id."""
    start = triples.sparkSession.createDataFrame([(c,) for c in centers], "source string")
    near = paths.bfs(edges_of(triples, relations), start, depth).groupBy("node").agg(F.min("depth").alias("depth"))
    if most_nodes is not None:
        near = near.orderBy("depth", "node").limit(most_nodes)
    near = cut(near.select("node"))
    t = triples if relations is None else triples.where(F.col("p").isin(relations))
    return t.join(near.withColumnRenamed("node", "s"), "s", "left_semi").join(near.withColumnRenamed("node", "o"), "o", "left_semi").select("s", "p", "o")


def path_query(triples: DataFrame, start: str, end: str, most_hops: int = 3, relations: list[str] | None = None) -> DataFrame:
    return paths.simple_paths(edges_of(triples, relations), start, end, most_hops)


def typed_paths(triples: DataFrame, pairs: DataFrame, most_hops: int = 3) -> DataFrame:
    """(types, n): how often each sequence of relations joins the pairs (start, end)."""
    state = pairs.select("start", "end", F.col("start").alias("at"), F.array("start").alias("path"), F.array().cast("array<string>").alias("types"))
    found = None
    for _ in range(most_hops):
        state = state.join(triples.select(F.col("s").alias("at"), "p", "o"), "at").where(~F.array_contains("path", F.col("o")))
        state = state.select("start", "end", F.col("o").alias("at"), F.array_append("path", F.col("o")).alias("path"), F.array_append("types", F.col("p")).alias("types"))
        hits = state.where("at = end").select("types")
        found = hits if found is None else found.unionByName(hits)
        state = state.where("at != end")
    return found.groupBy("types").agg(F.count("*").alias("n"))


def pattern_match(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None, limit: int | None = None) -> DataFrame:
    out = triples
    for c, v in (("s", s), ("p", p), ("o", o)):
        if v is not None:
            out = out.where(F.col(c) == v)
    return out if limit is None else out.orderBy("s", "p", "o").limit(limit)


def relation_statistics(triples: DataFrame) -> DataFrame:
    """(p, triples, subjects, objects)."""
    return triples.groupBy("p").agg(F.count("*").alias("triples"), F.countDistinct("s").alias("subjects"), F.countDistinct("o").alias("objects"))


def schema_patterns(triples: DataFrame, support: float = 0.0) -> DataFrame:
    """(source_type, p, target_type, n, confidence): frequencies of typed relations; the share among the source type's relations."""
    types = triples.where(F.col("p") == TYPE).select(F.col("s").alias("id"), F.col("o").alias("type"))
    t = triples.where(F.col("p") != TYPE)
    x = t.join(types.select(F.col("id").alias("s"), F.col("type").alias("source_type")), "s").join(types.select(F.col("id").alias("o"), F.col("type").alias("target_type")), "o")
    g = x.groupBy("source_type", "p", "target_type").agg(F.count("*").alias("n"))
    g = g.withColumn("confidence", F.col("n") / F.sum("n").over(Window.partitionBy("source_type")))
    return g.where(F.col("n") / F.sum("n").over(Window.partitionBy()) >= support) if support else g


def ontology(triples: DataFrame) -> DataFrame:
    """(class, instances, properties): how many members a class has, and how many relations they use."""
    types = triples.where(F.col("p") == TYPE).select("s", F.col("o").alias("class"))
    n = types.groupBy("class").agg(F.countDistinct("s").alias("instances"))
    used = types.join(triples.where(F.col("p") != TYPE), "s").groupBy("class").agg(F.countDistinct("p").alias("properties"))
    return n.join(used, "class", "left").fillna(0, ["properties"])


def class_depths(triples: DataFrame) -> DataFrame:
    """(class, ancestors, descendants, root, leaf) over subclass chains."""
    sub = triples.where(F.col("p") == SUBCLASS).select(F.col("s").alias("a"), F.col("o").alias("b"))
    c = closure(sub)
    up = c.groupBy(F.col("a").alias("class")).agg(F.countDistinct("b").alias("ancestors"))
    down = c.groupBy(F.col("b").alias("class")).agg(F.countDistinct("a").alias("descendants"))
    out = up.join(down, "class", "full").fillna(0)
    return out.withColumns({"root": F.col("ancestors") == 0, "leaf": F.col("descendants") == 0})


def missing_properties(triples: DataFrame, required: DataFrame) -> DataFrame:
    """(s, class, p): members of a class that lack a relation that ``required`` (class, p) asks for."""
    types = triples.where(F.col("p") == TYPE).select("s", F.col("o").alias("class"))
    return types.join(required, "class").join(triples.select("s", "p").distinct(), ["s", "p"], "left_anti").select("s", "class", "p")


def semantic_similarity(triples: DataFrame, a: str, b: str) -> DataFrame:
    """(similarity): the mean of the shared share of (relation, object) facts and the Jaccard of the neighbours."""
    def sets(x, what):
        rows = triples.where(F.col("s") == x) if what == "facts" else paths.both_directions(triples.select(F.col("s").alias("a"), F.col("o").alias("b"))).where(F.col("a") == x)
        return rows.agg(F.collect_set(F.concat_ws("\t", "p", "o") if what == "facts" else F.col("b")).alias(what + ("1" if x == a else "2")))

    one = sets(a, "facts").join(sets(b, "facts")).join(sets(a, "near")).join(sets(b, "near"))
    return one.select((0.5 * S.set_jaccard(F.col("facts1"), F.col("facts2")) + 0.5 * S.set_jaccard(F.col("near1"), F.col("near2"))).alias("similarity"))


# search


def search(entities: DataFrame, query: str, limit: int | None = None, types: list[str] | None = None) -> DataFrame:
    """(id, name, score): 1.0 exact, 0.8 substring, 0.6 any word, and 0.4 more if the id's local name holds it; over 0, best first."""
    q = query.lower()
    name = F.lower("name")
    words = [w for w in q.split() if w]
    some = F.lit(False)
    for w in words:
        some = some | F.contains(name, F.lit(w))
    score = F.when(name == q, 1.0).when(F.contains(name, F.lit(q)), 0.8).when(some, 0.6).otherwise(0.0)
    score = score + F.when(F.contains(F.lower(S.local_name(F.col("id"))), F.lit(q)), 0.4).otherwise(0.0)
    out = (entities if types is None else entities.where(F.col("type").isin(types))).select("id", "name", score.alias("score")).where("score > 0")
    return out if limit is None else out.orderBy(F.desc("score"), "id").limit(limit)


def vector_search(vectors: DataFrame, query: list[float], k: int = 10, metric: str = "cosine", least: float | None = None, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, score): the k best by cosine, dot, euclidean 1/(1+d) or binary Jaccard; ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.col(column).cast("array<double>")
    score = {"cosine": S.cosine, "dot": S.dot, "euclidean": S.euclidean_similarity, "jaccard": S.binary_jaccard}[metric](v, q)
    out = vectors.select(id_column, score.alias("score"))
    if least is not None:
        out = out.where(F.col("score") >= least)
    return out.orderBy(F.desc("score"), id_column).limit(k)


def batch_vector_search(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", most_queries: int = 10_000) -> DataFrame:
    """(query_id, id, score, rank) for queries (query_id, q array<double>): every query against every vector, at most ``most_queries`` of them broadcast."""
    if queries.limit(most_queries + 1).count() > most_queries:
        raise ValueError(f"more than {most_queries} queries in one batch")
    score = {"cosine": S.cosine, "dot": S.dot, "euclidean": S.euclidean_similarity}[metric]
    x = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")).join(F.broadcast(queries), F.col("id") != F.col("query_id"))
    scored = x.select("query_id", "id", score(F.col("v"), F.col("q")).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# resolution and fusion


def similar_names(entities: DataFrame, threshold: float = 0.7, measure: str = "bigram", most_block: int = 1000) -> DataFrame:
    """(a, b, similarity) of entities of one type whose names are alike, found through shared bigrams or words.

    A pair at a Jaccard of t shares a feature among its rarest: each name is listed under its
    rarest ``ceil((1-t)*n)+1`` features only, so common features make no pairs.
    """
    feature = S.bigrams if measure == "bigram" else S.tokens
    rows = entities.select("id", "type", "name", feature(F.col("name")).alias("f")).where(F.size("f") > 0)
    items = rows.select("id", "type", F.size("f").alias("n"), F.explode("f").alias("x"))
    freq = items.groupBy("type", "x").agg(F.count("*").alias("df"))
    rank = Window.partitionBy("id").orderBy("df", "x")
    prefix = items.join(freq, ["type", "x"]).withColumn("r", F.row_number().over(rank)).where(F.col("r") <= F.floor((1 - threshold) * F.col("n")) + 1)
    p, q = prefix.select("type", "x", F.col("id").alias("a"), F.col("n").alias("na")), prefix.select("type", "x", F.col("id").alias("b"), F.col("n").alias("nb"))
    cand = p.join(q, ["type", "x"]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb"))).select("a", "b").distinct()
    both = cand.join(rows.select(F.col("id").alias("a"), F.col("f").alias("fa")), "a").join(rows.select(F.col("id").alias("b"), F.col("f").alias("fb")), "b")
    return both.select("a", "b", S.set_jaccard(F.col("fa"), F.col("fb")).alias("similarity")).where(F.col("similarity") >= threshold)


def cluster_matches(matches: DataFrame, least: int = 2) -> DataFrame:
    """(id, cluster, size): components of the matches (a, b)."""
    inc = matches.select(F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string")).alias("edge_id"), F.explode(F.array(F.col("a").cast("string"), F.col("b").cast("string"))).alias("node_id"))
    c = paths.connected_components(inc)
    return c.select(F.col("node_id").alias("id"), F.col("component").alias("cluster"), F.count("*").over(Window.partitionBy("component")).alias("size")).where(F.col("size") >= least)


def align(a: DataFrame, b: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, confidence): the best partner of each entity of a in b: 0.4 name + 0.6 property similarity, one to one by confidence."""
    both = a.select(F.concat(F.lit("a:"), "id").alias("id"), F.lit("").alias("type"), "name").unionByName(b.select(F.concat(F.lit("b:"), "id").alias("id"), F.lit("").alias("type"), "name"))
    names = similar_names(both, 0.7).where(F.col("a").startswith("a:") & F.col("b").startswith("b:"))
    x = names.select(F.substring("a", 3, 1 << 20).alias("a"), F.substring("b", 3, 1 << 20).alias("b"), "similarity")
    x = x.join(a.select(F.col("id").alias("a"), F.col("props").alias("pa")), "a").join(b.select(F.col("id").alias("b"), F.col("props").alias("pb")), "b")
    c = x.select("a", "b", (0.4 * F.col("similarity") + 0.6 * S.map_similarity(F.col("pa"), F.col("pb"))).alias("confidence")).where(F.col("confidence") >= threshold)
    ra = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("confidence"), "b"))
    rb = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("confidence"), "a"))
    return c.withColumn("ra", ra).withColumn("rb", rb).where("ra = 1 AND rb = 1").select("a", "b", "confidence")


def fuse(a: DataFrame, b: DataFrame, alignment: DataFrame, strategy: str = "unified") -> DataFrame:
    """(s, p, o, graph): ``unified`` renames b's aligned entities to a's and drops repeats; ``layered`` keeps both apart by graph."""
    if strategy == "layered":
        return a.select("s", "p", "o", F.lit("a").alias("graph")).unionByName(b.select("s", "p", "o", F.lit("b").alias("graph")))
    to = alignment.select(F.col("b").alias("id"), F.col("a").alias("to"))
    y = b.join(to.withColumnRenamed("id", "s"), "s", "left").select(F.coalesce("to", "s").alias("s"), "p", "o")
    y = y.join(to.withColumnRenamed("id", "o"), "o", "left").select("s", "p", F.coalesce("to", "o").alias("o"))
    both = a.select("s", "p", "o", F.lit("a").alias("graph")).unionByName(y.select("s", "p", "o", F.lit("b").alias("graph")))
    return both.groupBy("s", "p", "o").agg(F.min("graph").alias("graph"))


def federated_union(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources' rows by name with ``_source``; of equal rows the first source's stays."""
    out = None
    for order, (name, df) in enumerate(sources.items()):
        keyed = df.withColumn("_key", F.md5(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])))).withColumn("_source", F.lit(name)).withColumn("_order", F.lit(order))
        out = keyed if out is None else out.unionByName(keyed, allowMissingColumns=True)
    w = Window.partitionBy("_key").orderBy("_order")
    return out.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_key", "_order")


def to_triples(inc: DataFrame, reify: bool = False) -> DataFrame:
    """A hypergraph as triples: node pairs of each edge, or each edge as an entity with its members."""
    from ..operators.basic import co_nodes

    if reify:
        return inc.select(F.col("edge_id").alias("s"), F.lit("has_member").alias("p"), F.col("node_id").alias("o")).distinct()
    return co_nodes(inc).select(F.col("a").alias("s"), F.lit("co_occurs").alias("p"), F.col("b").alias("o")).distinct()


# text


def extract_concepts(texts: DataFrame, least: int = 2) -> DataFrame:
    """(term, frequency, documents) of words of four letters or more."""
    w = texts.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{4,}"), F.lit(0))).alias("term"))
    return w.groupBy("term").agg(F.count("*").alias("frequency"), F.countDistinct("doc_id").alias("documents")).where(F.col("frequency") >= least)


PATTERNS = {"email": r"[\w.+-]+@[\w-]+\.[\w.]+", "url": r"https?://[^\s\"'<>]+", "date": r"\d{4}-\d{2}-\d{2}", "number": r"\b\d+(?:\.\d+)?\b", "name": r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b"}


def extract_entities(texts: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(doc_id, kind, value) by regular expressions."""
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0)).alias("v")) for k in (kinds or PATTERNS)])
    x = texts.select("doc_id", F.explode(found).alias("x"))
    return x.select("doc_id", "x.kind", F.explode("x.v").alias("value"))


def extract_triples(texts: DataFrame, relations: dict[str, str]) -> DataFrame:
    """(doc_id, s, p, o) for each relation's phrase between two capitalised names."""
    out = None
    for p, phrase in relations.items():
        pattern = rf"([A-Z]\w+(?: [A-Z]\w+)*) {re.escape(phrase)} ([A-Z]\w+(?: [A-Z]\w+)*)"
        s, o = F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), F.regexp_extract_all("text", F.lit(pattern), F.lit(2))
        rows = texts.select("doc_id", F.explode(F.arrays_zip(s.alias("s"), o.alias("o"))).alias("x")).select("doc_id", "x.s", F.lit(p).alias("p"), "x.o")
        out = rows if out is None else out.unionByName(rows)
    return out


# keyword queries


def parse_keywords(text: str) -> dict:
    """{kind: node_search | path_search | pattern_match | aggregate, terms} of a free query."""
    low = text.lower()
    terms = re.findall(r'"([^"]+)"|\b([A-Z][\w:]*)', text)
    names = [a or b for a, b in terms]
    m = re.search(r"(?:path|connect\w*|route)\b.*?\bfrom\s+(\S+)\s+to\s+(\S+)", low)
    if m:
        i = low.index(m[1], m.start(1))
        j = low.index(m[2], m.start(2))
        return {"kind": "path_search", "terms": [text[i : i + len(m[1])], text[j : j + len(m[2])]]}
    if re.search(r"\b(count|how many|average|sum|total|aggregate)\b", low):
        return {"kind": "aggregate", "terms": names}
    if re.search(r"\b(pattern|match|where)\b", low):
        return {"kind": "pattern_match", "terms": names}
    return {"kind": "node_search", "terms": names or [w for w in re.sub(r"\b(find|search|show|get|list|all|the|nodes?|entit\w+)\b", "", low).split()]}


def run_keywords(triples: DataFrame, entities: DataFrame, text: str, limit: int = 100) -> DataFrame:
    q = parse_keywords(text)
    if q["kind"] == "path_search":
        return path_query(triples, *q["terms"][:2])
    if q["kind"] == "aggregate":
        return relation_statistics(triples)
    if q["kind"] == "pattern_match":
        t = triples
        for term in q["terms"]:
            t = t.where((F.col("s") == term) | (F.col("p") == term) | (F.col("o") == term))
        return t.limit(limit)
    return search(entities, " ".join(q["terms"]), limit)


def influence(triples: DataFrame, seeds: DataFrame, decay: float = 0.5, steps: int = 3) -> DataFrame:
    """(node, activation): seeds (node, activation) spread along relations both ways, times ``decay`` a step, divided over the neighbours."""
    e = edges_of(triples)
    e = cut(e.join(e.groupBy("a").agg(F.count("*").alias("d")), "a"))
    total = frontier = seeds.select("node", "activation")
    for _ in range(steps):
        frontier = cut(frontier.join(e, frontier["node"] == e["a"]).groupBy(F.col("b").alias("node")).agg((decay * F.sum(ratio(F.col("activation"), F.col("d")))).alias("activation")))
        total = total.unionByName(frontier)
    return total.groupBy("node").agg(F.sum("activation").alias("activation"))


def build_indexes(triples: DataFrame) -> DataFrame:
    """(kind, key, entity): entities by type, by relation and by object, one table to partition by kind and look keys up in."""
    types = triples.where(F.col("p") == TYPE).select(F.lit("type").alias("kind"), F.col("o").alias("key"), F.col("s").alias("entity"))
    facts = triples.where(F.col("p") != TYPE)
    cells = F.array(F.struct(F.lit("property").alias("kind"), F.col("p").alias("key")), F.struct(F.lit("object").alias("kind"), F.col("o").alias("key")))
    return types.unionByName(facts.select(F.explode(cells).alias("x"), F.col("s").alias("entity")).select("x.kind", "x.key", "entity")).distinct()
