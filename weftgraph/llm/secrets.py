"""Secret scans: patterns, and sliding-window entropy over candidate strings.

Only built-in column functions. A candidate is a run of base-64 or URL-safe
characters with a letter and a digit. A window of ``window`` characters slides
over it; the counts of its characters are kept incrementally (one goes up, one
goes down), and so is the sum of c*log2(c) that gives the Shannon entropy. Each
character class has its own threshold. Windows over it make one span, from the
first such window's start to the last one's end, unless the candidate matches
the allow-list or the span overlaps a pattern's span.

Results by case: null and empty text have no spans; repeated rows are scanned
each; an empty table gives an empty result; other input columns are ignored.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import let

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of fewer characters fails anyway, and matches of these two cannot hide others: they end where their run ends.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}"
#: Character classes with their entropy thresholds, narrowest first.
CLASSES = ((r"^[0-9a-fA-F]+$", 3.0), (r"^[a-z0-9]+$|^[A-Z0-9]+$", 3.6), (r"^", 3.75))
_PART = r"(?:(?:[A-Z]?[a-z]{1,16}|[A-Z]{1,16})[0-9]{0,4}|[0-9]{1,4})"
#: Identifiers and placeholders that are no secrets. Each describes a whole candidate, so that nothing hides behind a part of one.
ALLOW = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    rf"^(?=.*(?i:example|placeholder|changeme|dummy|redacted))[/+=_-]*{_PART}(?:[/+=_-]+{_PART})*[/+=_-]*$",
    r"(?i)^(?:abcdefghij(?:klmnop(?:qrstuvwxyz)?)?|0123456789(?:abcdef)?|[/+=_-])+$",
    r"^(?:(.)\1{7,})+$",
    rf"^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(?:[T_-]?[0-9]{{2}}-?[0-9]{{2}}(?:-?[0-9]{{2}})?Z?)?(?:[/_-]+{_PART})*[/_-]?$",
    rf"^/?(?:[a-z]{{1,16}}[/_-]){{2,}}{_PART}(?:[/_-]+{_PART})*[/_-]?$",
)
_SLOT0, _SLOTS = 42, 80  # '+' is 43 and 'z' is 122


_CHUNK = 128


def _running(values: Column, zero: int, merge) -> Column:
    """The running ``merge`` of an array of integers.

    An array grows by copying, so this runs over chunks and their totals: n**2 / 16,000 copies and not n**2 / 2.
    """
    parts = F.transform(F.sequence(F.lit(0), F.shiftright(F.greatest(F.size(values) - 1, F.lit(0)), 7)), lambda i: F.slice(values, i * _CHUNK + 1, F.lit(_CHUNK)))
    none = F.array().cast("array<int>")

    def walk(items, start, by, inclusive):
        def step(acc, x):
            now = merge(acc["p"], by(x))
            return F.struct(now.alias("p"), F.concat(acc["out"], F.array(now if inclusive else acc["p"])).alias("out"))

        return F.aggregate(items, F.struct(start.alias("p"), none.alias("out")), step, lambda acc: acc["out"])

    total = lambda chunk: F.aggregate(chunk, F.lit(zero), lambda acc, x: merge(acc, x))
    return let(parts, lambda c: F.flatten(F.zip_with(c, walk(c, F.lit(zero), total, False), lambda chunk, start: walk(chunk, start, lambda x: x, True))))


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<s,e,w>>: code-point spans of the pattern's matches, and the matches."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    none = F.array().cast("array<struct<s:int,e:int,w:string>>")

    def spans(found):
        ends = _running(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, w: g + F.length(w)), 0, lambda p, x: p + x)
        return F.zip_with(ends, found, lambda e, w: F.struct((e - F.length(w)).alias("s"), e.alias("e"), w.alias("w")))

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)).otherwise(none)


def _count_below(sorted_values: Column, value: Column) -> Column:
    """How many of an ascending array's integers are below ``value``, by bisection."""
    zero = F.struct(F.lit(0).alias("lo"), F.size(sorted_values).alias("hi"))

    def halve(acc, _):
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        up = (acc["lo"] < acc["hi"]) & (F.get(sorted_values, mid) < value)
        return F.struct(F.when(up, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when((acc["lo"] < acc["hi"]) & ~up, mid).otherwise(acc["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(sorted_values) + 2)).cast("int")), zero, halve, lambda acc: acc["lo"])


def _window(word: Column, window: int) -> Column:
    """struct<first,last>: where the windows over the threshold begin and end in a candidate; first is -1 if none."""
    slots = F.transform(F.split(word, ""), lambda c: F.ascii(c) - _SLOT0)
    return let(slots, lambda x: _windows(word, x, window))


def _windows(word: Column, slots: Column, window: int) -> Column:
    xlog = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    threshold = F.when(word.rlike(CLASSES[0][0]), CLASSES[0][1]).when(word.rlike(CLASSES[1][0]), CLASSES[1][1]).otherwise(CLASSES[2][1])
    most = (F.lit(math.log2(window)) - threshold) * window
    zero = F.struct(F.array_repeat(F.lit(0), _SLOTS).alias("n"), F.lit(0.0).alias("x"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def bump(n, x, at, by):
        old = F.element_at(n, at)
        n2 = F.concat(F.slice(n, F.lit(1), at - 1), F.array(old + by), F.slice(n, at + 1, F.lit(_SLOTS)))
        return n2, x - F.element_at(xlog, old + 1) + F.element_at(xlog, old + 1 + by)

    def enter(acc, i):
        n, x = bump(acc["n"], acc["x"], F.get(slots, i - 1), 1)
        return F.struct(n.alias("n"), x.alias("x"), acc["first"].alias("first"), acc["last"].alias("last"))

    def leave(acc, i):
        n, x = bump(acc["n"], acc["x"], F.get(slots, i - 1 - window), -1)
        return F.struct(n.alias("n"), x.alias("x"), acc["first"].alias("first"), acc["last"].alias("last"))

    def judge(acc, i):
        over = (i >= window) & (acc["x"] <= most)
        return F.struct(
            acc["n"].alias("n"), acc["x"].alias("x"),
            F.when(over & (acc["first"] < 0), i - window).otherwise(acc["first"]).alias("first"),
            F.when(over, i).otherwise(acc["last"]).alias("last"),
        )

    # each index stands three times in the walk: a character enters, one leaves, the window is judged
    walk = F.flatten(F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.array(F.struct(i.alias("i"), F.lit(0).alias("k")), F.struct(i.alias("i"), F.lit(1).alias("k")), F.struct(i.alias("i"), F.lit(2).alias("k")))))
    step = lambda acc, w: F.when(w["k"] == 0, enter(acc, w["i"])).when((w["k"] == 1) & (w["i"] > window), leave(acc, w["i"])).when(w["k"] == 2, judge(acc, w["i"])).otherwise(acc)
    return F.aggregate(walk, zero, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def scan(docs: DataFrame, window: int = 20, allow: tuple[str, ...] = ALLOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, spans): array<struct<s,k,e>> per document, sorted; k is the index in KINDS.

    One narrow pass without a shuffle or Python on the executors.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", *keep, text.alias("_text"))
    t = F.col("_text")
    group2 = F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2))
    assign = F.filter(F.zip_with(_matches(t, ASSIGN), group2, lambda x, g: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.length(g).alias("n"))), lambda x: x["n"] >= 12)
    df = df.withColumn("_assign", F.when(t.rlike(ASSIGN), assign).otherwise(F.array().cast("array<struct<s:int,e:int,n:int>>")))
    df = df.withColumn("_access", _matches(t, ACCESS)).withColumn("_hex", _matches(t, HEX)).withColumn("_cand", _matches(t, CANDIDATE))
    kind = lambda name, k: F.transform(F.col(name), lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))
    df = df.withColumn("_base", F.array_sort(F.concat(kind("_assign", 0), kind("_access", 1), kind("_hex", 2))))

    def plausible(c):
        ok = c["w"].rlike("[0-9]") & c["w"].rlike("[A-Za-z]")
        for pattern in allow:
            ok = ok & ~c["w"].rlike(pattern)
        return ok

    scanned = F.transform(F.filter("_cand", plausible), lambda c: F.struct(c["s"].alias("s"), _window(c["w"], window).alias("r")))
    found = F.transform(F.filter(scanned, lambda x: x["r"]["first"] >= 0), lambda x: F.struct((x["s"] + x["r"]["first"]).alias("s"), F.lit(3).alias("k"), (x["s"] + x["r"]["last"]).alias("e")))
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    df = df.withColumn("_found", F.when(F.size("_cand") > 0, found).otherwise(none))

    def fresh(starts):
        # of the base spans that begin before a span ends, the one that reaches farthest must end before it begins
        reach = _running(F.transform("_base", lambda b: b["e"]), 0, lambda p, x: F.greatest(p, x))
        return let(reach, lambda ends: F.filter("_found", lambda x: F.coalesce(F.get(ends, _count_below(starts, x["e"]) - 1), F.lit(0)) <= x["s"]))

    both = F.array_sort(F.concat("_base", let(F.transform("_base", lambda b: b["s"]), fresh)))
    spans = F.when((F.size("_found") == 0) | (F.size("_base") == 0), F.concat("_base", "_found")).otherwise(both)
    return df.withColumn("spans", spans).select("doc_id", *keep, "spans")


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]", group: int = 256) -> Column:
    """The text with every span, overlapping ones as one, replaced by ``mark``.

    A place in a string is found from its beginning, so the text is first cut
    into parts of ``group`` spans and these into the pieces that stay.
    """

    def cut(reach):
        n = F.size(spans)
        heads = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(spans, i)["s"] >= F.get(reach, i - 1)))
        return let(heads, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 1), lambda j: F.struct(F.get(spans, F.get(h, j))["s"].alias("s"), F.get(reach, F.coalesce(F.get(h, j + 1), n) - 1).alias("e"))))

    def kept(merged):
        n = F.size(merged)

        def part(i):
            own = F.slice(merged, i * group + 1, F.lit(group))
            begin = F.when(i == 0, F.lit(0)).otherwise(F.get(merged, i * group - 1)["e"])
            end = F.coalesce(F.get(merged, (i + 1) * group - 1)["s"], F.length(text))
            last = F.when((i + 1) * group >= n, F.length(text)).otherwise(end)
            return F.struct(begin.alias("begin"), F.substring(text, begin + 1, last - begin).alias("t"), own.alias("own"), ((i + 1) * group >= n).alias("last"))

        def pieces(x):
            n_own = F.size(x["own"])
            count = F.when(x["last"], n_own + 1).otherwise(n_own)
            at = lambda j: F.when(j == 0, x["begin"]).otherwise(F.get(x["own"], j - 1)["e"])
            to = lambda j: F.coalesce(F.get(x["own"], j)["s"] - at(j), F.length(x["t"]))
            return F.transform(F.sequence(F.lit(0), count - 1), lambda j: F.substring(x["t"], at(j) - x["begin"] + 1, to(j)))

        parts = F.transform(F.sequence(F.lit(0), F.shiftright(n - 1, group.bit_length() - 1)), part)
        return F.flatten(F.transform(parts, pieces))

    reach = _running(F.transform(spans, lambda x: x["e"]), 0, lambda p, x: F.greatest(p, x))
    pieces = let(reach, lambda r: let(cut(r), kept))
    return F.when(F.size(spans) > 0, F.array_join(pieces, mark)).otherwise(text)
