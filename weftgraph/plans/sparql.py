"""A SPARQL subset compiled to DataFrame plans over a triples table (s, p, o).

SELECT [DISTINCT] vars|* WHERE { triples, FILTER, OPTIONAL { }, { } UNION { } }
ORDER BY [ASC|DESC](?v) ... LIMIT n OFFSET n, with PREFIX. Groups nest.
Basic patterns are natural joins, OPTIONAL left joins, UNION unions by name;
OFFSET comes before LIMIT. Catalyst orders and places the joins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

_TOKEN = re.compile(
    r"""\s*(?:\#[^\n]*\n\s*)*(
      <[^<>\s]*> | "(?:[^"\\]|\\.)*" | '(?:[^'\\]|\\.)*' | \?[A-Za-z_]\w* | \$[A-Za-z_]\w*
    | -?\d+(?:\.\d+)? | \|\| | && | != | <= | >= | [{}().;,=<>!*/+-] | [A-Za-z_][\w-]*:[\w./-]* | :[\w./-]+ | [A-Za-z_][\w-]*
    )""",
    re.X,
)


class SparqlError(ValueError):
    """A query that the parser does not accept."""


@dataclass
class Group:
    triples: list[tuple[str, str, str]] = field(default_factory=list)
    filters: list = field(default_factory=list)
    optionals: list[Group] = field(default_factory=list)
    unions: list[list[Group]] = field(default_factory=list)


@dataclass
class Query:
    variables: list[str]
    distinct: bool
    where: Group
    order: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SparqlError(f"unexpected text at {text[at : at + 20]!r}")
            self.tokens.append(m[1])
            at = m.end()
        self.i = 0
        self.prefixes: dict[str, str] = {}

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.i + ahead] if self.i + ahead < len(self.tokens) else ""

    def word(self) -> str:
        return self.peek().upper()

    def take(self, expected: str | None = None) -> str:
        t = self.peek()
        if not t or (expected is not None and t.upper() != expected):
            raise SparqlError(f"expected {expected or 'more'}, found {t or 'the end'}")
        self.i += 1
        return t

    def term(self) -> str:
        t = self.take()
        if t[0] in "?$":
            return "?" + t[1:]
        if t[0] == "<":
            return t[1:-1]
        if t[0] in "\"'":
            return re.sub(r"\\(.)", r"\1", t[1:-1])
        if t == "a":
            return "rdf:type"
        if t in "{}().;,=<>!*/+-" or t in ("||", "&&", "!=", "<=", ">="):
            raise SparqlError(f"unexpected {t}")
        prefix, colon, name = t.partition(":")
        return self.prefixes[prefix] + name if colon and prefix in self.prefixes else t

    def parse(self) -> Query:
        while self.word() == "PREFIX":
            self.take()
            name = self.take().rstrip(":")
            self.prefixes[name] = self.take()[1:-1]
        self.take("SELECT")
        distinct = self.word() == "DISTINCT"
        if distinct:
            self.take()
        variables = []
        while self.peek()[:1] in ("?", "$") or self.peek() == "*":
            variables.append("?" + self.take().lstrip("?$") if self.peek() != "*" else self.take())
        if not variables:
            raise SparqlError("SELECT names no variable")
        if self.word() == "WHERE":
            self.take()
        if self.peek() != "{":
            raise SparqlError("WHERE is missing")
        q = Query([] if "*" in variables else [v[1:] for v in variables], distinct, self.group())
        while self.peek():
            w = self.take().upper()
            if w == "ORDER":
                self.take("BY")
                while self.word() in ("ASC", "DESC") or self.peek()[:1] in ("?", "$"):
                    ascending = True
                    if self.word() in ("ASC", "DESC"):
                        ascending = self.take().upper() == "ASC"
                        self.take("(")
                        q.order.append((self.take()[1:], ascending))
                        self.take(")")
                    else:
                        q.order.append((self.take()[1:], True))
            elif w in ("LIMIT", "OFFSET"):
                n = self.take()
                if not n.isdigit():
                    raise SparqlError(f"{w} needs a number")
                if w == "LIMIT":
                    q.limit = int(n)
                else:
                    q.offset = int(n)
            else:
                raise SparqlError(f"unexpected {w}")
        return q

    def group(self) -> Group:
        g = Group()
        self.take("{")
        while self.peek() != "}":
            w = self.word()
            if w == "FILTER":
                self.take()
                g.filters.append(self.expression() if self.peek() == "(" else self.primary())
            elif w == "OPTIONAL":
                self.take()
                g.optionals.append(self.group())
            elif self.peek() == "{":
                arms = [self.group()]
                while self.word() == "UNION":
                    self.take()
                    arms.append(self.group())
                g.unions.append(arms)
            elif self.peek() == ".":
                self.take()
            elif not self.peek():
                raise SparqlError("a group is not closed")
            else:
                self.triple_block(g)
        self.take("}")
        return g

    def triple_block(self, g: Group) -> None:
        s = self.term()
        while True:
            p = self.term()
            while True:
                g.triples.append((s, p, self.term()))
                if self.peek() != ",":
                    break
                self.take()
            if self.peek() != ";":
                break
            self.take()
            if self.peek() in (".", "}"):
                break

    # filters: nested tuples (operator, operands)

    def expression(self):
        left = self.conjunction()
        while self.peek() == "||":
            self.take()
            left = ("||", left, self.conjunction())
        return left

    def conjunction(self):
        left = self.comparison()
        while self.peek() == "&&":
            self.take()
            left = ("&&", left, self.comparison())
        return left

    def comparison(self):
        left = self.primary()
        if self.peek() in ("=", "!=", "<", ">", "<=", ">="):
            op = self.take()
            return (op, left, self.primary())
        return left

    def primary(self):
        if self.peek() == "!":
            self.take()
            return ("!", self.primary())
        if self.peek() == "(":
            self.take()
            e = self.expression()
            self.take(")")
            return e
        if self.peek(1) == "(" and self.peek()[0].isalpha():
            name, args = self.take().upper(), []
            self.take("(")
            while self.peek() != ")":
                args.append(self.expression())
                if self.peek() == ",":
                    self.take()
            self.take(")")
            return ("call", name, args)
        raw = self.peek()
        if re.fullmatch(r"-?\d+(\.\d+)?", raw):
            self.take()
            return ("number", float(raw))
        t = self.term()
        return ("var", t[1:]) if t.startswith("?") else ("text", t)


def parse(text: str) -> Query:
    """The query's syntax tree; ``SparqlError`` if it is none."""
    return _Parser(text).parse()


def validate(text: str) -> list[str]:
    """The parser's complaints; empty if there are none."""
    try:
        parse(text)
    except SparqlError as e:
        return [str(e)]
    return []


_COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}


def _is_number(e) -> bool:
    return e[0] == "number" or (e[0] == "call" and e[1] in ("ABS", "CEIL", "FLOOR", "ROUND", "STRLEN", "RAND"))


def _value(e, df: DataFrame, ignore_case: bool) -> Column:
    kind = e[0]
    if kind == "number":
        return F.lit(e[1])
    if kind == "text":
        return F.lit(e[1])
    if kind == "var":
        return F.col(e[1]) if e[1] in df.columns else F.lit(None).cast("string")
    if kind in ("&&", "||"):
        a, b = _value(e[1], df, ignore_case), _value(e[2], df, ignore_case)
        return a & b if kind == "&&" else a | b
    if kind == "!":
        return ~_value(e[1], df, ignore_case)
    if kind in _COMPARE:
        a, b = _value(e[1], df, ignore_case), _value(e[2], df, ignore_case)
        if _is_number(e[1]) or _is_number(e[2]):
            a, b = a.try_cast("double"), b.try_cast("double")
        return _COMPARE[kind](a, b)
    name, args = e[1], e[2]
    v = [_value(x, df, ignore_case) for x in args]
    one = {
        "BOUND": S.bound, "STR": S.to_str, "LANG": S.lang, "DATATYPE": S.datatype, "IRI": S.iri, "URI": S.iri, "ABS": S.absolute, "CEIL": S.ceil,
        "FLOOR": S.floor, "ROUND": S.round_half_even, "STRLEN": S.strlen, "UCASE": S.ucase, "LCASE": S.lcase,
    }
    two = {"CONTAINS": S.contains, "STRSTARTS": S.strstarts, "STRENDS": S.strends}
    if name in one and len(v) == 1:
        return one[name](v[0])
    if name in two and len(v) == 2:
        return two[name](v[0], v[1], ignore_case)
    if name == "REGEX" and len(args) in (2, 3) and args[1][0] == "text":
        return S.regex(v[0], args[1][1], args[2][1] if len(args) == 3 else "")
    if name == "RAND":
        return S.rand()
    if name == "BNODE":
        return S.bnode()
    raise SparqlError(f"unknown function {name}/{len(args)}")


def match(triples: DataFrame, pattern: tuple[str, str, str]) -> DataFrame:
    """One triple pattern: constants filter, variables become columns, a repeated variable must agree."""
    df, names = triples, {}
    for column, term in zip(("s", "p", "o"), pattern, strict=True):
        if not term.startswith("?"):
            df = df.where(F.col(column) == term)
        elif term[1:] in names:
            df = df.where(F.col(column) == F.col(names[term[1:]]))
        else:
            names[term[1:]] = column
    return df.select(*[F.col(c).alias(v) for v, c in names.items()])


#: Patterns without a common variable multiply; one side may have so many solutions.
MOST_PRODUCT_ROWS = 10_000


def _join(a: DataFrame | None, b: DataFrame, how: str = "inner") -> DataFrame:
    """Solutions that agree on the common variables. Without any, all pairs, if one side has few (it is broadcast)."""
    if a is None:
        return b
    shared = [c for c in b.columns if c in a.columns]
    if not shared:
        few = lambda df: df.limit(MOST_PRODUCT_ROWS + 1).count() <= MOST_PRODUCT_ROWS
        if few(b):
            return a.join(F.broadcast(b), F.lit(True), how)
        if how == "inner" and few(a):
            return b.join(F.broadcast(a), F.lit(True)).select(*a.columns, *b.columns)
        raise SparqlError(f"patterns without a common variable, of over {MOST_PRODUCT_ROWS} solutions each")
    return a.join(b, shared, how)


def solve(group: Group, triples: DataFrame, ignore_case: bool = False) -> DataFrame:
    """The solutions of a group as columns."""
    out = None
    for pattern in group.triples:
        out = _join(out, match(triples, pattern))
    for arms in group.unions:
        both = None
        for arm in arms:
            s = solve(arm, triples, ignore_case)
            both = s if both is None else both.unionByName(s, allowMissingColumns=True)
        out = _join(out, both)
    for g in group.optionals:
        if out is None:
            raise SparqlError("OPTIONAL has nothing to extend")
        out = _join(out, solve(g, triples, ignore_case), "left")
    if out is None:
        raise SparqlError("a group has no pattern")
    for f in group.filters:
        out = out.where(_value(f, out, ignore_case))
    return out


def execute(triples: DataFrame, text: str, bindings: dict[str, str] | None = None, limit: int | None = None, ignore_case: bool = False) -> DataFrame:
    """Run a query over (s, p, o). ``bindings`` fix variables beforehand."""
    q = parse(text)
    df = solve(q.where, triples, ignore_case)
    for v, x in (bindings or {}).items():
        df = df.where(F.col(v) == x)
    names = q.variables or sorted(df.columns)
    if q.order:
        df = df.select("*", *[F.lit(None).cast("string").alias(v) for v in names if v not in df.columns])
        if q.distinct:
            df = df.select(*dict.fromkeys([*names, *(v for v, _ in q.order)])).distinct()
        df = df.orderBy(*[F.col(v).asc_nulls_first() if up else F.col(v).desc_nulls_last() for v, up in q.order])
        df = df.select(*names)
    else:
        df = df.select(*[F.col(v) if v in df.columns else F.lit(None).cast("string").alias(v) for v in names])
        if q.distinct:
            df = df.distinct()
    if q.offset:
        df = df.offset(q.offset)
    least = min(x for x in (q.limit, limit, 1 << 31) if x is not None)
    return df.limit(least) if least < 1 << 31 else df
