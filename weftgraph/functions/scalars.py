"""Scalar functions of the query language and string similarities, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD_STRING = "http://www.w3.org/2001/XMLSchema#string"


def _number(x: Column) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def bound(x: Column) -> Column:
    return x.isNotNull()


def to_str(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def lang(x: Column) -> Column:
    return F.lit("")


def datatype(x: Column) -> Column:
    return F.lit(XSD_STRING)


def iri(x: Column) -> Column:
    return F.concat(F.lit("<"), x, F.lit(">"))


def bnode() -> Column:
    return F.concat(F.lit("_:bn"), F.substring(F.expr("uuid()"), 1, 8))


def rand() -> Column:
    return F.rand()


def absolute(x: Column) -> Column:
    return F.abs(_number(x))


def ceil(x: Column) -> Column:
    return F.ceil(_number(x))


def floor(x: Column) -> Column:
    return F.floor(_number(x))


def round_half_even(x: Column) -> Column:
    return F.bround(_number(x), 0)


def strlen(x: Column) -> Column:
    return F.char_length(to_str(x))


def ucase(x: Column) -> Column:
    return F.upper(to_str(x))


def lcase(x: Column) -> Column:
    return F.lower(to_str(x))


def contains(x: Column, y: Column, ignore_case: bool = False) -> Column:
    return F.contains(F.lower(x), F.lower(y)) if ignore_case else F.contains(x, y)


def strstarts(x: Column, y: Column, ignore_case: bool = False) -> Column:
    return F.startswith(F.lower(x), F.lower(y)) if ignore_case else F.startswith(x, y)


def strends(x: Column, y: Column, ignore_case: bool = False) -> Column:
    return F.endswith(F.lower(x), F.lower(y)) if ignore_case else F.endswith(x, y)


def regex(x: Column, pattern: str, flags: str = "") -> Column:
    """False for a pattern that is none, as for one that does not match."""
    import re

    try:
        re.compile(pattern)
    except re.error:
        return F.lit(False)
    return x.rlike(("(?i)" if "i" in flags else "") + pattern)


# string similarity


def bigrams(x: Column) -> Column:
    """The distinct lower-case character pairs of a string."""
    s = F.lower(x)
    pairs = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2)))
    return F.array_distinct(F.when(F.length(s) >= 2, pairs).otherwise(F.array().cast("array<string>")))


def tokens(x: Column) -> Column:
    """The distinct lower-case words of a string."""
    return F.array_distinct(F.filter(F.split(F.lower(x), r"\s+"), lambda t: t != ""))


def set_jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b| of two arrays; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def bigram_similarity(a: Column, b: Column) -> Column:
    return F.when(F.lower(a) == F.lower(b), 1.0).otherwise(set_jaccard(bigrams(a), bigrams(b)))


def token_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(tokens(a), tokens(b))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty strings."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(F.lower(a), F.lower(b)) / longer)


def soundex_equal(a: Column, b: Column) -> Column:
    return F.soundex(a) == F.soundex(b)


def map_similarity(a: Column, b: Column) -> Column:
    """Mean over shared keys: equal values 1, else the bigram Jaccard; 0 without shared keys."""
    keys = F.array_intersect(F.map_keys(a), F.map_keys(b))
    score = F.aggregate(keys, F.lit(0.0), lambda acc, k: acc + F.coalesce(bigram_similarity(F.try_element_at(a, k), F.try_element_at(b, k)), F.lit(0.0)))
    return F.when(F.size(keys) > 0, score / F.size(keys)).otherwise(0.0)


# vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda acc, v: acc + v))


def euclidean_similarity(a: Column, b: Column) -> Column:
    return 1 / (1 + euclidean(a, b))


def binary_jaccard(a: Column, b: Column, above: float = 0.5) -> Column:
    """Jaccard of the positions whose components are over ``above``."""
    on = F.zip_with(a, b, lambda x, y: F.struct((x > above).alias("x"), (y > above).alias("y")))
    both = F.size(F.filter(on, lambda v: v["x"] & v["y"]))
    either = F.size(F.filter(on, lambda v: v["x"] | v["y"]))
    return F.coalesce(F.try_divide(both, either), F.lit(0.0))


# names


def expand_uri(x: Column, prefixes: dict[str, str]) -> Column:
    """prefix:name to the full form; other strings stay."""
    out = x
    for p, uri in prefixes.items():
        out = F.when(x.startswith(f"{p}:"), F.concat(F.lit(uri), F.substring(x, F.lit(len(p) + 2), F.length(x)))).otherwise(out)
    return out


def compress_uri(x: Column, prefixes: dict[str, str]) -> Column:
    """A full form to prefix:name by the longest matching prefix; other strings stay."""
    out = x
    for p, uri in sorted(prefixes.items(), key=lambda kv: len(kv[1])):
        out = F.when(x.startswith(uri), F.concat(F.lit(f"{p}:"), F.substring(x, F.lit(len(uri) + 1), F.length(x)))).otherwise(out)
    return out


def local_name(x: Column) -> Column:
    """What follows the last of '#', '/' and ':'."""
    return F.regexp_extract(x, r"([^#/:]*)$", 1)


def type_of(x: Column) -> Column:
    """What stands before the last of '#', '/', ':' and '_' followed by an identifier, by its local part."""
    return F.lower(F.regexp_extract(x, r"([A-Za-z]+)[#/:_][^#/:_]*$", 1))
