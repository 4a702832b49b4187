"""Rules over triples (s, p, o), applied to a fixpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

TYPE, SUBCLASS, SUBPROPERTY, DOMAIN, RANGE, INVERSE, SAME = "rdf:type", "rdfs:subClassOf", "rdfs:subPropertyOf", "rdfs:domain", "rdfs:range", "owl:inverseOf", "owl:sameAs"
TRANSITIVE, SYMMETRIC, FUNCTIONAL, INVERSE_FUNCTIONAL, DISJOINT = "owl:TransitiveProperty", "owl:SymmetricProperty", "owl:FunctionalProperty", "owl:InverseFunctionalProperty", "owl:disjointWith"


def _of_kind(t: DataFrame, kind: str) -> DataFrame:
    return t.where((F.col("p") == TYPE) & (F.col("o") == kind)).select(F.col("s").alias("p")).distinct()


def transitivity(t: DataFrame) -> DataFrame:
    x = t.join(_of_kind(t, TRANSITIVE), "p", "left_semi")
    y = x.select("p", F.col("s").alias("o"), F.col("o").alias("o2"))
    return x.select("s", "p", "o").join(y, ["p", "o"]).select("s", "p", F.col("o2").alias("o"))


def symmetry(t: DataFrame) -> DataFrame:
    return t.join(_of_kind(t, SYMMETRIC), "p", "left_semi").select(F.col("o").alias("s"), "p", F.col("s").alias("o"))


def inverse(t: DataFrame) -> DataFrame:
    pairs = t.where(F.col("p") == INVERSE).select(F.col("s").alias("p1"), F.col("o").alias("p2"))
    pairs = pairs.unionByName(pairs.select(F.col("p2").alias("p1"), F.col("p1").alias("p2"))).distinct()
    return t.join(pairs, t["p"] == pairs["p1"]).select(F.col("o").alias("s"), F.col("p2").alias("p"), F.col("s").alias("o"))


def subclass(t: DataFrame) -> DataFrame:
    """Types pass up, and subclass chains close."""
    sub = t.where(F.col("p") == SUBCLASS).select(F.col("s").alias("c"), F.col("o").alias("super"))
    chained = t.where(F.col("p").isin(TYPE, SUBCLASS))
    return chained.join(sub, chained["o"] == sub["c"]).select("s", "p", F.col("super").alias("o"))


def subproperty(t: DataFrame) -> DataFrame:
    sub = t.where(F.col("p") == SUBPROPERTY).select(F.col("s").alias("q"), F.col("o").alias("super"))
    lifted = t.join(sub, t["p"] == sub["q"]).select("s", F.col("super").alias("p"), "o")
    chain = t.where(F.col("p") == SUBPROPERTY).join(sub, F.col("o") == F.col("q")).select("s", "p", F.col("super").alias("o"))
    return lifted.unionByName(chain)


def domain_range(t: DataFrame) -> DataFrame:
    dom = t.where(F.col("p") == DOMAIN).select(F.col("s").alias("q"), F.col("o").alias("c"))
    ran = t.where(F.col("p") == RANGE).select(F.col("s").alias("q"), F.col("o").alias("c"))
    d = t.join(dom, t["p"] == dom["q"]).select("s", F.lit(TYPE).alias("p"), F.col("c").alias("o"))
    r = t.join(ran, t["p"] == ran["q"]).select(F.col("o").alias("s"), F.lit(TYPE).alias("p"), F.col("c").alias("o"))
    return d.unionByName(r)


def _same(t: DataFrame, kind: str, key: str, value: str) -> DataFrame:
    """Values of one key are the same: each with the least of its group, so a group of n makes n - 1 rows."""
    x = t.join(_of_kind(t, kind), "p", "left_semi").select("p", F.col(key).alias("k"), F.col(value).alias("v")).distinct()
    least = x.groupBy("p", "k").agg(F.min("v").alias("m"))
    return x.join(least, ["p", "k"]).where("v != m").select(F.col("m").alias("s"), F.lit(SAME).alias("p"), F.col("v").alias("o"))


def functional(t: DataFrame) -> DataFrame:
    return _same(t, FUNCTIONAL, "s", "o")


def inverse_functional(t: DataFrame) -> DataFrame:
    return _same(t, INVERSE_FUNCTIONAL, "o", "s")


RULES = {
    "transitivity": transitivity, "symmetry": symmetry, "inverse": inverse, "subclass": subclass, "subproperty": subproperty,
    "domain_range": domain_range, "functional": functional, "inverse_functional": inverse_functional,
}


def infer(triples: DataFrame, rules: dict | None = None, most_rounds: int = 10) -> DataFrame:
    """(s, p, o, rule): the given triples (rule null) and those that the rules add, to a fixpoint or ``most_rounds``.

    A rule is a function from triples to triples; custom ones need no more.
    """
    rules = RULES if rules is None else rules
    known = cut(triples.select("s", "p", "o").distinct().withColumn("rule", F.lit(None).cast("string")))
    for _ in range(most_rounds):
        t = known.select("s", "p", "o")
        new = None
        for name, rule in rules.items():
            r = rule(t).select("s", "p", "o").withColumn("rule", F.lit(name))
            new = r if new is None else new.unionByName(r)
        fresh = cut(new.groupBy("s", "p", "o").agg(F.min("rule").alias("rule")).join(t, ["s", "p", "o"], "left_anti"))
        if fresh.isEmpty():
            break
        known = cut(known.unionByName(fresh))
    return known


def explain(inferred: DataFrame, s: str, p: str, o: str) -> DataFrame:
    return inferred.where((F.col("s") == s) & (F.col("p") == p) & (F.col("o") == o)).select("rule")


def closure(pairs: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(a, b): the transitive closure of (a, b), semi-naive: only new pairs are extended; safe on cycles."""
    base = cut(pairs.select("a", "b").distinct())
    known, new = base, base
    for _ in range(most_rounds):
        step = new.join(base.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")).distinct()
        new = cut(step.join(known, ["a", "b"], "left_anti"))
        if new.isEmpty():
            return known
        known = cut(known.unionByName(new))
    raise RuntimeError("closure did not settle")


def property_closure(triples: DataFrame, p: str) -> DataFrame:
    return closure(triples.where(F.col("p") == p).select(F.col("s").alias("a"), F.col("o").alias("b"))).select(F.col("a").alias("s"), F.lit(p).alias("p"), F.col("b").alias("o"))


def inconsistencies(t: DataFrame) -> DataFrame:
    """(kind, s, detail): members of disjoint classes, and subjects with two values of a functional property."""
    types = t.where(F.col("p") == TYPE).select("s", F.col("o").alias("c"))
    dis = t.where(F.col("p") == DISJOINT).select(F.col("s").alias("c1"), F.col("o").alias("c2"))
    x = types.join(dis, types["c"] == dis["c1"]).select("s", "c1", "c2")
    both = x.join(types.withColumnRenamed("c", "c2"), ["s", "c2"]).select(F.lit("disjoint").alias("kind"), "s", F.concat_ws(" ", F.least("c1", "c2"), F.greatest("c1", "c2")).alias("detail")).distinct()
    fun = t.join(_of_kind(t, FUNCTIONAL), "p", "left_semi").groupBy("s", "p").agg(F.countDistinct("o").alias("n")).where("n > 1")
    return both.unionByName(fun.select(F.lit("functional").alias("kind"), "s", F.col("p").alias("detail")))
