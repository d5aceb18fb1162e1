"""Query text -> syntax tree: a tokenizer and a recursive-descent parser for the Cypher dialect.

Expressions are ``Expr`` nodes with a kind and named fields; a query is a list of clauses. Nothing here knows
tables or Spark.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any


class QueryError(ValueError):
    """The text is not a valid query, or names something that does not exist."""


_TOKENS = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)
    |(?P<number>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\d+)
    |(?P<string>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*")
    |(?P<quoted>`[^`]+`)
    |(?P<param>\$\w+)
    |(?P<name>[^\W\d]\w*)
    |(?P<op><=|>=|<>|!=|<<|>>|\|\||->|<-|:=|=~|\.\.|[-+*/%^=<>()\[\]{},.:;|&~?!])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "0": "\0"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "name" else ""


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKENS.match(text, at)
        if not m:
            raise QueryError(f"unexpected character {text[at]!r} at {at}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m.group(), at))
        at = m.end()
    out.append(Token("end", "", at))
    return out


@dataclass(frozen=True)
class Expr:
    kind: str
    f: dict[str, Any] = field(default_factory=dict)

    def __getattr__(self, name: str) -> Any:
        try:
            return self.f[name]
        except KeyError:
            raise AttributeError(name) from None


def E(kind: str, **f: Any) -> Expr:  # noqa: N802
    return Expr(kind, f)


@dataclass
class NodePattern:
    var: str | None
    labels: list[str]
    props: list[tuple[str, Expr]]


@dataclass
class RelPattern:
    var: str | None
    types: list[str]
    props: list[tuple[str, Expr]]
    direction: str  # out, in, both
    hops: tuple[int, int | None] | None = None
    per_hop: tuple[str, str, Expr] | None = None  # rel variable, node variable, predicate


@dataclass
class PathPattern:
    var: str | None
    parts: list  # node, rel, node, ...


@dataclass
class Projection:
    items: list[tuple[Expr, str]]
    distinct: bool = False
    star: bool = False
    order: list[tuple[Expr, bool]] = field(default_factory=list)
    skip: Expr | None = None
    limit: Expr | None = None
    where: Expr | None = None


@dataclass
class Clause:
    kind: str
    f: dict[str, Any]

    def __getattr__(self, name: str) -> Any:
        try:
            return self.__dict__["f"][name]
        except KeyError:
            raise AttributeError(name) from None


@dataclass
class Query:
    """Single queries, joined by UNION (all: which of the joints keep duplicates)."""

    singles: list[list[Clause]]
    alls: list[bool]
    mode: str | None = None  # EXPLAIN or PROFILE


_COMPARE = {"=", "<>", "!=", "<", "<=", ">", ">="}
_STOP = {"RETURN", "WITH", "MATCH", "OPTIONAL", "WHERE", "UNWIND", "UNION", "ORDER", "SKIP", "LIMIT", "CREATE", "MERGE", "SET", "DELETE", "DETACH", "CALL", "ON", "YIELD", "AS", "AND", "OR", "XOR", "THEN", "ELSE", "END", "WHEN", "IN", "ASC", "DESC", "ASCENDING", "DESCENDING", "LOAD", "COPY", "BETWEEN", "STARTS", "ENDS", "CONTAINS", "IS", "FROM"}


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.i = text, tokenize(text), 0
        self.bar_ends = False  # within [x IN l | e] a bar is no operator

    # -- tokens
    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def peek(self, n: int = 1) -> Token:
        return self.tokens[min(self.i + n, len(self.tokens) - 1)]

    def word(self, *words: str) -> bool:
        """Take these keywords, if they come next."""
        if all(self.peek(n).upper == w for n, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def op(self, text: str) -> bool:
        if self.now.kind == "op" and self.now.text == text:
            self.i += 1
            return True
        return False

    def is_op(self, text: str, n: int = 0) -> bool:
        t = self.peek(n)
        return t.kind == "op" and t.text == text

    def need(self, text: str) -> None:
        if not (self.op(text) or (text.isalpha() and self.word(text))):
            raise QueryError(f"expected {text} at {self.now.at}, found {self.now.text or 'the end'!r}")

    def name(self) -> str:
        t = self.now
        if t.kind == "quoted":
            self.i += 1
            return t.text[1:-1]
        if t.kind != "name":
            raise QueryError(f"expected a name at {t.at}, found {t.text or 'the end'!r}")
        self.i += 1
        return t.text

    def string(self) -> str:
        if self.now.kind != "string":
            raise QueryError(f"expected a text at {self.now.at}")
        raw = self.now.text
        self.i += 1
        body = raw[1:-1].replace("''", "'") if raw[0] == "'" else raw[1:-1]
        return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), body, flags=re.S)

    # -- queries
    def query(self) -> Query:
        mode = next((m for m in ("EXPLAIN", "PROFILE") if self.word(m)), None)
        out = self.union()
        out.mode = mode
        self.op(";")
        if self.now.kind != "end":
            raise QueryError(f"unexpected {self.now.text!r} at {self.now.at}")
        return out

    def union(self) -> Query:
        singles, alls = [self.single()], []
        while self.word("UNION"):
            alls.append(self.word("ALL"))
            singles.append(self.single())
        return Query(singles, alls)

    def single(self) -> list[Clause]:
        out: list[Clause] = []
        while True:
            if self.word("OPTIONAL", "MATCH"):
                out.append(self.match(True))
            elif self.word("MATCH"):
                out.append(self.match(False))
            elif self.word("UNWIND"):
                e = self.expression()
                self.need("AS")
                out.append(Clause("unwind", {"expr": e, "var": self.name()}))
            elif self.word("WITH"):
                out.append(Clause("with", {"projection": self.projection(True)}))
            elif self.word("RETURN"):
                out.append(Clause("return", {"projection": self.projection(False)}))
            elif self.word("CALL"):
                out.append(self.call())
            elif self.word("LOAD"):
                out.append(self.load())
            elif self.word("CREATE"):
                out.append(Clause("create", {"patterns": self.patterns()}))
            elif self.word("MERGE"):
                out.append(self.merge())
            elif self.word("SET"):
                out.append(Clause("set", {"items": self.assignments()}))
            elif self.now.upper in ("DELETE", "DETACH"):
                detach = self.word("DETACH")
                self.need("DELETE")
                out.append(Clause("delete", {"vars": self.listed(self.name), "detach": detach}))
            else:
                if not out:
                    raise QueryError(f"expected a clause at {self.now.at}, found {self.now.text or 'the end'!r}")
                return out

    def listed(self, item) -> list:
        out = [item()]
        while self.op(","):
            out.append(item())
        return out

    def match(self, optional: bool) -> Clause:
        patterns = self.patterns()
        return Clause("match", {"patterns": patterns, "optional": optional, "where": self.expression() if self.word("WHERE") else None})

    def merge(self) -> Clause:
        pattern, created, matched = self.path(), [], []
        while self.word("ON"):
            to = created if self.word("CREATE") else matched
            if to is matched:
                self.need("MATCH")
            self.need("SET")
            to += self.assignments()
        return Clause("merge", {"pattern": pattern, "on_create": created, "on_match": matched})

    def assignments(self) -> list[tuple[str, str, Expr]]:
        def one() -> tuple[str, str, Expr]:
            """(variable, property, value), or (variable, '=' or '+=', bag of properties)."""
            var = self.name()
            if self.op("."):
                prop = self.name()
                self.need("=")
                return var, prop, self.expression()
            how = "+=" if self.op("+=") or self.op("+") else "="
            if how == "=" or self.is_op("="):
                self.need("=")
            return var, how, self.expression()

        return self.listed(one)

    def call(self) -> Clause:
        if self.op("{"):
            imports = []
            if self.word("WITH"):
                imports = self.listed(self.name)
            body = self.union()
            self.need("}")
            return Clause("subquery", {"query": body, "imports": imports})
        name = self.name()
        if self.op("="):
            return Clause("option", {"name": name, "value": self.expression()})
        self.need("(")
        args = [] if self.is_op(")") else self.listed(self.expression)
        self.need(")")
        where, yields = self.expression() if self.word("WHERE") else None, []
        if self.word("YIELD"):
            yields = self.listed(lambda: (self.name(), self.name() if self.word("AS") else None))
            where = self.expression() if self.word("WHERE") else where
        return Clause("call", {"name": name, "args": args, "yields": yields, "where": where})

    def load(self) -> Clause:
        headers = None
        if self.word("WITH", "HEADERS"):
            self.need("(")
            headers = self.listed(lambda: (self.name(), self.type_name()))
            self.need(")")
        self.need("FROM")
        path = self.string()
        return Clause("load", {"path": path, "headers": headers, "where": self.expression() if self.word("WHERE") else None})

    def type_name(self) -> str:
        out = self.name()
        if self.op("("):
            depth, out = 1, out + "("
            while depth:
                depth += self.is_op("(") - self.is_op(")")
                out += self.now.text + (" " if self.now.kind == "name" else "")
                self.i += 1
        while self.op("["):
            out += "[" + (self.now.text if self.now.kind == "number" else "") + "]"
            self.i += self.now.kind == "number"
            self.need("]")
        return out

    def projection(self, may_filter: bool) -> Projection:
        p = Projection([], distinct=self.word("DISTINCT"))
        if self.op("*"):
            p.star = True
        if not p.star or self.op(","):
            p.items = self.listed(self.item)
        if self.word("ORDER", "BY"):
            p.order = self.listed(lambda: (self.expression(), self.ascending()))
        if self.word("SKIP"):
            p.skip = self.expression()
        if self.word("LIMIT"):
            p.limit = self.expression()
        if may_filter and self.word("WHERE"):
            p.where = self.expression()
        return p

    def item(self) -> tuple[Expr, str]:
        at = self.now.at
        e = self.expression()
        if self.word("AS"):
            return e, self.name()
        return e, self.text[at : self.tokens[self.i - 1].at + len(self.tokens[self.i - 1].text)]

    # -- patterns
    def patterns(self) -> list[PathPattern]:
        return self.listed(self.path)

    def path(self) -> PathPattern:
        var = None
        if self.now.kind in ("name", "quoted") and self.is_op("=", 1):
            var = self.name()
            self.need("=")
        parts: list = [self.node()]
        while self.is_op("-") or self.is_op("<-") or self.is_op("->"):
            parts.append(self.rel())
            parts.append(self.node())
        return PathPattern(var, parts)

    def node(self) -> NodePattern:
        self.need("(")
        var = self.name() if self.now.kind in ("name", "quoted") else None
        labels = self.labels()
        props = self.properties() if self.is_op("{") else []
        self.need(")")
        return NodePattern(var, labels, props)

    def labels(self) -> list[str]:
        if not self.op(":"):
            return []
        out = [self.name()]
        while self.op("|") or self.op(":"):
            self.op(":")
            out.append(self.name())
        return out

    def properties(self) -> list[tuple[str, Expr]]:
        self.need("{")
        out = []
        while not self.op("}"):
            key = self.name()
            self.need(":")
            out.append((key, self.expression()))
            self.op(",")
        return out

    def rel(self) -> RelPattern:
        left = self.op("<-")
        if not left:
            self.need("-")
        r = RelPattern(None, [], [], "both")
        if self.op("["):
            r.var = self.name() if self.now.kind in ("name", "quoted") else None
            r.types = self.labels()
            if self.op("*"):
                lo = hi = None
                if self.now.kind == "number":
                    lo = hi = int(self.now.text)
                    self.i += 1
                if self.op(".."):
                    hi = None
                    if self.now.kind == "number":
                        hi = int(self.now.text)
                        self.i += 1
                r.hops = (1 if lo is None else lo, hi)
                if self.op("("):
                    rv = self.name()
                    self.need(",")
                    nv = self.name()
                    self.need("|")
                    self.need("WHERE")
                    r.per_hop = (rv, nv, self.expression())
                    self.need(")")
            if self.is_op("{"):
                r.props = self.properties()
            self.need("]")
        right = self.op("->")
        if not right:
            self.need("-")
            right = self.op(">")
        r.direction = "both" if left == right else "in" if left else "out"
        return r

    # -- expressions, loosest first
    def expression(self) -> Expr:
        e = self.xor()
        while self.word("OR"):
            e = E("or", a=e, b=self.xor())
        return e

    def xor(self) -> Expr:
        e = self.conjunction()
        while self.word("XOR"):
            e = E("xor", a=e, b=self.conjunction())
        return e

    def conjunction(self) -> Expr:
        e = self.negation()
        while self.word("AND"):
            e = E("and", a=e, b=self.negation())
        return e

    def negation(self) -> Expr:
        return E("not", a=self.negation()) if self.word("NOT") else self.comparison()

    def comparison(self) -> Expr:
        e = self.bits()
        if self.now.kind == "op" and self.now.text in _COMPARE:
            op = self.now.text
            self.i += 1
            return E("compare", op="<>" if op == "!=" else op, a=e, b=self.bits())
        return e

    def bits(self) -> Expr:
        e = self.sum()
        while self.now.kind == "op" and self.now.text in ("|", "&", "<<", ">>") and not (self.bar_ends and self.now.text == "|"):
            op = self.now.text
            self.i += 1
            e = E("call", name=op, args=[e, self.sum()], distinct=False)
        return e

    def sum(self) -> Expr:
        e = self.product()
        while self.now.kind == "op" and self.now.text in ("+", "-", "||"):
            op = self.now.text
            self.i += 1
            e = E("call", name=op, args=[e, self.product()], distinct=False)
        return e

    def product(self) -> Expr:
        e = self.power()
        while self.now.kind == "op" and self.now.text in ("*", "/", "%"):
            op = self.now.text
            self.i += 1
            e = E("call", name=op, args=[e, self.power()], distinct=False)
        return e

    def power(self) -> Expr:
        e = self.unary()
        while self.op("^"):
            e = E("call", name="^", args=[e, self.unary()], distinct=False)
        return e

    def unary(self) -> Expr:
        if self.op("-"):
            e = self.unary()
            return E("lit", value=-e.value) if e.kind == "lit" and isinstance(e.value, (int, float)) else E("call", name="negate", args=[e], distinct=False)
        if self.op("~"):
            return E("call", name="~", args=[self.unary()], distinct=False)
        self.op("+")
        return self.predicate()

    def predicate(self) -> Expr:
        e = self.postfix()
        while True:
            if self.word("IS", "NOT", "NULL"):
                e = E("null", a=e, negated=True)
            elif self.word("IS", "NULL"):
                e = E("null", a=e, negated=False)
            elif self.word("IN"):
                e = E("call", name="list_contains", args=[self.postfix(), e], distinct=False)
            elif self.word("STARTS", "WITH"):
                e = E("call", name="starts_with", args=[e, self.sum()], distinct=False)
            elif self.word("ENDS", "WITH"):
                e = E("call", name="ends_with", args=[e, self.sum()], distinct=False)
            elif self.word("CONTAINS"):
                e = E("call", name="contains", args=[e, self.sum()], distinct=False)
            else:
                return e

    def postfix(self) -> Expr:
        e = self.atom()
        while True:
            if self.is_op(".") and self.peek().kind in ("name", "quoted"):
                self.i += 1
                e = E("prop", of=e, name=self.name())
            elif self.is_op(".") and self.is_op("*", 1):
                self.i += 2
                e = E("all_props", of=e)
            elif self.op("["):
                if self.op(".."):
                    e = E("slice", of=e, start=None, stop=self.expression())
                else:
                    start = self.expression()
                    if self.op(".."):
                        e = E("slice", of=e, start=start, stop=None if self.is_op("]") else self.expression())
                    else:
                        e = E("index", of=e, at=start)
                self.need("]")
            else:
                return e

    def atom(self) -> Expr:
        t = self.now
        if t.kind == "number":
            self.i += 1
            return E("lit", value=float(t.text) if re.search(r"[.eE]", t.text) else int(t.text))
        if t.kind == "string":
            return E("lit", value=self.string())
        if t.kind == "param":
            self.i += 1
            return E("param", name=t.text[1:])
        if self.op("["):
            return self.list_literal()
        if self.is_op("{"):
            return E("struct", items=self.properties())
        if self.is_op("("):
            if (e := self.pattern_predicate()) is not None:
                return e
            self.need("(")
            e = self.expression()
            self.need(")")
            return e
        if t.kind not in ("name", "quoted"):
            raise QueryError(f"expected an expression at {t.at}, found {t.text or 'the end'!r}")
        for word, value in (("TRUE", True), ("FALSE", False), ("NULL", None)):
            if t.upper == word and not self.is_op("(", 1):
                self.i += 1
                return E("lit", value=value)
        if t.upper == "CASE":
            return self.case()
        if t.upper in ("EXISTS", "COUNT") and self.is_op("{", 1):
            self.i += 2
            self.word("MATCH")
            patterns = self.patterns()
            where = self.expression() if self.word("WHERE") else None
            self.need("}")
            return E("exists" if t.upper == "EXISTS" else "count_of", patterns=patterns, where=where)
        if t.upper in ("ALL", "ANY", "NONE", "SINGLE") and self.is_op("(", 1) and self.peek(3).upper == "IN":
            self.i += 2
            var = self.name()
            self.need("IN")
            items = self.expression()
            self.need("WHERE")
            test = self.expression()
            self.need(")")
            return E("quantifier", which=t.upper, var=var, items=items, test=test)
        if t.upper == "CAST" and self.is_op("(", 1):
            self.i += 2
            e = self.expression()
            if self.word("AS"):
                to = self.type_name()
            else:
                self.need(",")
                to = self.string()
            self.need(")")
            return E("cast", a=e, to=to)
        if self.is_op("(", 1):
            return self.function()
        return E("var", name=self.name())

    def pattern_predicate(self) -> Expr | None:
        """A path with at least one relationship where an expression could stand."""
        start = self.i
        try:
            p = self.path()
        except QueryError:
            p = None
        if p is None or len(p.parts) < 3:
            self.i = start
            return None
        return E("exists", patterns=[p], where=None)

    def list_literal(self) -> Expr:
        if self.now.kind in ("name", "quoted") and self.peek().upper == "IN":
            var, outer, self.bar_ends = self.name(), self.bar_ends, True
            self.need("IN")
            items = self.expression()
            test = self.expression() if self.word("WHERE") else None
            to = self.expression() if self.op("|") else None
            self.need("]")
            self.bar_ends = outer
            return E("comprehension", var=var, items=items, test=test, to=to)
        items = [] if self.is_op("]") else self.listed(self.expression)
        self.need("]")
        return E("list", items=items)

    def case(self) -> Expr:
        self.need("CASE")
        base = None if self.now.upper == "WHEN" else self.expression()
        whens = []
        while self.word("WHEN"):
            test = self.expression()
            self.need("THEN")
            whens.append((test, self.expression()))
        other = self.expression() if self.word("ELSE") else None
        self.need("END")
        return E("case", base=base, whens=whens, other=other)

    def argument(self) -> Expr:
        """An argument, or a lambda ``x -> e`` or ``(a, x) -> e``."""
        if self.now.kind == "name" and self.is_op("->", 1):
            var = self.name()
            self.need("->")
            return E("lambda", vars=[var], body=self.expression())
        if self.is_op("(") and self.peek().kind == "name" and self.is_op(",", 2) and self.is_op(")", 4) and self.is_op("->", 5):
            self.i += 1
            a = self.name()
            self.need(",")
            b = self.name()
            self.i += 2
            return E("lambda", vars=[a, b], body=self.expression())
        return self.expression()

    def function(self) -> Expr:
        name = self.name()
        self.need("(")
        distinct, args = self.word("DISTINCT"), []
        if self.op("*"):
            args = [E("star")]
        elif not self.is_op(")"):
            args = self.listed(self.argument)
        self.need(")")
        e = E("call", name=name.lower(), args=args, distinct=distinct)
        if self.now.upper == "OVER" and self.is_op("(", 1):
            self.i += 2
            by, order, frame = [], [], None
            if self.word("PARTITION", "BY"):
                by = self.listed(self.expression)
            if self.word("ORDER", "BY"):
                order = self.listed(lambda: (self.expression(), self.ascending()))
            for unit in ("ROWS", "RANGE", "GROUPS"):
                if self.word(unit):
                    if self.word("BETWEEN"):
                        lo = self.bound()
                        self.need("AND")
                        frame = (unit, lo, self.bound())
                    else:
                        frame = (unit, self.bound(), 0)
            self.need(")")
            e = E("over", call=e, by=by, order=order, frame=frame)
        return e

    def ascending(self) -> bool:
        if self.word("DESC") or self.word("DESCENDING"):
            return False
        _ = self.word("ASC") or self.word("ASCENDING")
        return True

    def bound(self) -> int | None:
        """Rows from the current one; None is unbounded (its side is clear from its place)."""
        if self.word("UNBOUNDED"):
            _ = self.word("PRECEDING") or self.word("FOLLOWING")
            return None
        if self.word("CURRENT", "ROW"):
            return 0
        n = int(self.now.text)
        self.i += 1
        if self.word("PRECEDING"):
            return -n
        self.need("FOLLOWING")
        return n


def parse(text: str) -> Query:
    return Parser(text).query()


def parse_expression(text: str) -> Expr:
    p = Parser(text)
    e = p.expression()
    if p.now.kind != "end":
        raise QueryError(f"unexpected {p.now.text!r} at {p.now.at}")
    return e


def walk(x: Any):
    """Every Expr, pattern and clause below x, x included."""
    if isinstance(x, (list, tuple)):
        for y in x:
            yield from walk(y)
    elif isinstance(x, (Expr, Clause)):
        yield x
        yield from walk(list(x.f.values()))
    elif isinstance(x, (Projection, NodePattern, RelPattern, PathPattern, Query)):
        yield x
        yield from walk(list(vars(x).values()))
