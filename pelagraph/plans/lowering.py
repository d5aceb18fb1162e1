"""Syntax tree -> DataFrame.

A query part is one DataFrame. A node variable ``a`` is the columns ``a___id`` (its key) and ``a__<property>``, a
relationship the columns ``r___src``, ``r___dst``, ``r___type`` and its properties, a path one struct, any other
variable one column. Columns stay flat, so Catalyst prunes them and pushes predicates into the scans.

An endpoint's table is joined only if the query uses one of its properties, or its label says more than the
relationship does. A pattern starts at a bound variable if it has one. Matching is homomorphic: nodes and
relationships may repeat, except that a variable-length path visits no node twice.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelagraph import semantics
from pelagraph.catalog import NODE, RelPair
from pelagraph.functions import SCALARS, Context
from pelagraph.functions.casts import cast, spark_type
from pelagraph.operators import updates
from pelagraph.plans.parser import Clause, E, Expr, NodePattern, PathPattern, Projection, Query, QueryError, RelPattern
from pelagraph.storage import cut

#: Variables of a lambda: the column, and a null of its type, by which the types of expressions on it are found.
Local = dict[str, tuple[Column, Column]] | None
#: Hops after which an unbounded variable-length pattern that still grows is an error.
MAX_HOPS = 30
_ID_ONLY = {"count", "id", "label", "labels", "offset", "tableid"}
AGGREGATES = {"count", "count_star", "sum", "avg", "min", "max", "collect", "count_if"}


@dataclass(frozen=True)
class Bound:
    """What a variable stands for. name: its column, or the beginning of its columns."""

    kind: str  # node, rel, path, value
    name: str
    labels: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()  # properties that are there
    ident: bool = False  # a relationship with its row id

    def col(self, part: str) -> Column:
        return F.col(f"`{self.name}__{part}`")

    def all_columns(self) -> list[str]:
        if self.kind == "node":
            return [f"{self.name}___id", *([f"{self.name}___label"] if len(self.labels) != 1 else []), *(f"{self.name}__{p}" for p in self.columns)]
        if self.kind == "rel":
            return [f"{self.name}__{p}" for p in ("_src", "_dst", "_type", *(["_rid"] if self.ident else []), *self.columns)]
        return [self.name]


@dataclass
class State:
    df: DataFrame
    scope: dict[str, Bound] = field(default_factory=dict)
    empty: bool = True  # one row, nothing bound yet
    carry: tuple[str, ...] = ()  # columns of a surrounding query that every projection keeps


def split_and(e: Expr | None) -> list[Expr]:
    if e is None:
        return []
    return split_and(e.a) + split_and(e.b) if e.kind == "and" else [e]


def children(e: Any):
    if isinstance(e, Expr):
        yield from children(list(e.f.values()))
    elif isinstance(e, (list, tuple)):
        for x in e:
            if isinstance(x, Expr):
                yield x
            else:
                yield from children(x)


def has_aggregate(e: Expr) -> bool:
    if e.kind == "call" and e.name in AGGREGATES:
        return True
    if e.kind == "over":
        return any(has_aggregate(x) for x in [*e.call.args, *e.by, *(o for o, _ in e.order)])
    return e.kind not in ("exists", "count_of") and any(map(has_aggregate, children(e)))


def rewrite(e: Any, f) -> Any:
    """f(expr) gives a replacement or None; applied from the top."""
    if isinstance(e, Expr):
        out = f(e)
        return out if out is not None else Expr(e.kind, {k: rewrite(v, f) for k, v in e.f.items()})
    if isinstance(e, list):
        return [rewrite(x, f) for x in e]
    if isinstance(e, tuple):
        return tuple(rewrite(x, f) for x in e)
    return e


def uses(x: Any, out: dict[str, set[str]] | None = None) -> dict[str, set[str]]:
    """Variable -> properties that the tree reads of it; '*' for all."""
    out = {} if out is None else out
    if isinstance(x, Expr):
        if x.kind in ("prop", "all_props") and x.of.kind == "var":
            out.setdefault(x.of.name, set()).add(x.name if x.kind == "prop" else "*")
        elif x.kind == "call" and x.name in _ID_ONLY and len(x.args) == 1 and x.args[0].kind == "var":
            out.setdefault(x.args[0].name, set())
        elif x.kind == "var":
            out.setdefault(x.name, set()).add("*")
        else:
            uses(list(x.f.values()), out)
    elif isinstance(x, Clause):
        uses(list(x.f.values()), out)
    elif isinstance(x, Projection):
        if x.star:
            out.setdefault("*", set()).add("*")
        uses([x.items, x.order, x.where, x.skip, x.limit], out)
    elif isinstance(x, (NodePattern, RelPattern)):
        uses(list(vars(x).values()), out)
    elif isinstance(x, PathPattern):
        uses(x.parts, out)
    elif isinstance(x, Query):
        uses(x.singles, out)
    elif isinstance(x, (list, tuple)):
        for y in x:
            uses(y, out)
    return out


def changed(clauses: list[Clause]) -> set[str]:
    """The variables that SET or DELETE names, and those that WITH has renamed to them."""
    out: set[str] = set()
    for c in reversed(clauses):
        if c.kind == "delete":
            out |= set(c.vars)
        elif c.kind in ("set", "merge"):
            out |= {v for v, _, _ in (c.items if c.kind == "set" else [*c.on_create, *c.on_match])}
        elif c.kind == "with":
            out |= {e.name for e, n in c.projection.items if e.kind == "var" and n in out}
    return out


class Lowering:
    def __init__(self, session: Any, parameters: dict[str, Any] | None = None):
        self.session, self.catalog, self.parameters = session, session.catalog, parameters or {}
        self.fresh = count()
        self.identified: set[str] = set()

    # ------------------------------------------------------------ queries
    def query(self, q: Query, start: State | None = None) -> DataFrame:
        frames = [self.single(s, start) for s in q.singles]
        out = frames[0]
        for other, keep_all in zip(frames[1:], q.alls, strict=True):
            if len(other.columns) != len(out.columns):
                raise QueryError("the sides of UNION have different numbers of columns")
            out = out.union(other)
            if not keep_all:
                out = out.distinct()
        return out

    def single(self, clauses: list[Clause], start: State | None = None) -> DataFrame:
        self.needed = uses(clauses)
        self.identified = changed(clauses)
        state = start or State(self.session.spark.range(1).select())
        for i, c in enumerate(clauses):
            if c.kind == "return" and i + 1 != len(clauses):
                raise QueryError("RETURN has to be the last clause")
            state = getattr(self, f"on_{c.kind}")(state, c)
        return state.df

    def on_match(self, s: State, c: Clause) -> State:
        if c.optional:
            return self.optional(s, c)
        for p in c.patterns:
            s = self.path(s, p)
        return self.where(s, c.where)

    def on_unwind(self, s: State, c: Clause) -> State:
        df, e = self.prepare(s, c.expr)
        s = State(df, s.scope, s.empty, s.carry)
        x = self.value(s, e)
        t = df.select(x.alias("x")).schema[0].dataType
        if not isinstance(t, T.ArrayType):
            x = F.when(x.isNotNull(), F.array(x))
        return self.bind(State(df.withColumn(c.var, F.explode(x)), s.scope, False, s.carry), c.var)

    def bind(self, s: State, name: str) -> State:
        return State(s.df, {**s.scope, name: Bound("value", name)}, False, s.carry)

    def on_with(self, s: State, c: Clause) -> State:
        out = self.project(s, c.projection, final=False)
        return self.where(out, c.projection.where)

    def on_return(self, s: State, c: Clause) -> State:
        return self.project(s, c.projection, final=True)

    def on_subquery(self, s: State, c: Clause) -> State:
        inner = Lowering(self.session, self.parameters)
        inner.fresh = self.fresh
        if not c.imports:
            got = inner.query(c.query)
            df = got if s.empty else s.df.crossJoin(got)
            scope = {**s.scope, **{n: Bound("value", n) for n in got.columns}}
            return State(df, scope, False, s.carry)
        bound = {v: s.scope[v] for v in c.imports}
        keys = [x for b in bound.values() for x in b.all_columns()]
        seed = s.df.select(*(f"`{k}`" for k in keys)).distinct()
        got = inner.query(c.query, State(seed, bound, False, tuple(keys)))
        new = [x for x in got.columns if x not in keys]
        whole = all(has_aggregate(e) for single in c.query.singles for e, _ in single[-1].projection.items)
        renamed = got.select(*(F.col(f"`{k}`").alias(f"_k_{k}") for k in keys), *(F.col(f"`{n}`") for n in new))
        on = reduce(lambda a, b: a & b, (F.col(f"`{k}`").eqNullSafe(F.col(f"`_k_{k}`")) for k in keys))
        df = s.df.join(renamed, on, "left" if whole else "inner").drop(*(f"_k_{k}" for k in keys))
        if whole:  # an aggregate over no row
            for e, n in c.query.singles[0][-1].projection.items:
                if e.kind == "call" and e.name in ("count", "count_star", "count_if"):
                    df = df.withColumn(n, F.coalesce(F.col(f"`{n}`"), F.lit(0).cast("long")))
        return State(df, {**s.scope, **{n: Bound("value", n) for n in new}}, False, s.carry)

    def on_call(self, s: State, c: Clause) -> State:
        args = [self.constant(a) for a in c.args]
        return self.rows(s, self.session.call_table_function(c.name, args), c.yields, c.where)

    def on_load(self, s: State, c: Clause) -> State:
        return self.rows(s, self.session.load(c.path, c.headers), [], c.where)

    def rows(self, s: State, got: DataFrame, yields: list, where: Expr | None) -> State:
        if yields:
            got = got.select(*(F.col(f"`{n}`").alias(a or n) for n, a in yields))
        df = got if s.empty else s.df.crossJoin(got)
        return self.where(State(df, {**s.scope, **{n: Bound("value", n) for n in got.columns}}, False, s.carry), where)

    def on_create(self, s: State, c: Clause) -> State:
        return updates.create(self, s, c)

    def on_merge(self, s: State, c: Clause) -> State:
        return updates.merge(self, s, c)

    def on_set(self, s: State, c: Clause) -> State:
        return updates.set_properties(self, s, c)

    def on_delete(self, s: State, c: Clause) -> State:
        return updates.delete(self, s, c)

    # ------------------------------------------------------------ patterns
    def wants(self, var: str | None, table: list[str], more: list[str] = ()) -> list[str]:
        """The properties to carry for a variable."""
        found = self.needed.get(var, set()) if var else set()
        if "*" in found or (var and "*" in self.needed.get("*", ())):
            return table
        return [p for p in table if p in found or p in more]

    def scan(self, var: str, name: str, labels: list[str], props: list[tuple[str, Expr]], s: State) -> tuple[DataFrame, Bound]:
        labels = labels or sorted(self.catalog.nodes)
        tables = [self.catalog.node(x) for x in labels]
        every = list(dict.fromkeys(p for t in tables for p in t.properties))
        asked = {p for p in self.needed.get(var, ())} - {"*"} | {k for k, _ in props}
        if unknown := asked - set(every):
            raise QueryError(f"{'|'.join(labels)} has no property {sorted(unknown)[0]}")
        props_wanted = self.wants(var, every)
        frames = []
        for t in tables:
            df = t.df
            for k, e in props:
                df = df.where(semantics.compare("=", F.col(f"`{k}`"), F.lit(self.constant(e)), True, False) if k in t.properties else F.lit(False))
            cols = [F.col(f"`{t.key}`").alias(f"{name}___id")]
            if len(labels) > 1:
                cols = [F.col(f"`{t.key}`").cast("string").alias(f"{name}___id"), F.lit(t.label).alias(f"{name}___label")] if self.mixed(labels) else [*cols, F.lit(t.label).alias(f"{name}___label")]
            frames.append(df.select(*cols, *(F.col(f"`{p}`").alias(f"{name}__{p}") for p in props_wanted if p in t.properties)))
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        return df, Bound("node", name, tuple(labels), tuple(props_wanted))

    def mixed(self, labels: list[str]) -> bool:
        return len({str(self.catalog.node(x).df.schema[self.catalog.node(x).key].dataType) for x in labels}) > 1

    def name_for(self, var: str | None) -> str:
        return var if var else f"_v{next(self.fresh)}"

    def path(self, s: State, p: PathPattern) -> State:
        parts = list(p.parts)
        for x in parts[::2]:
            x.var = x.var or f"_v{next(self.fresh)}"
        backward = parts[0].var not in s.scope and parts[-1].var in s.scope
        if backward:
            parts = parts[::-1]
            parts = [RelPattern(x.var, x.types, x.props, {"out": "in", "in": "out"}.get(x.direction, "both"), x.hops, x.per_hop) if isinstance(x, RelPattern) else x for x in parts]
        first = parts[0]
        shared = any(x.var in s.scope for x in parts[::2])
        if first.var in s.scope:
            s = self.check_node(s, first)
        elif shared:  # bound in the middle: join the whole path by its variables
            fresh = self.path(State(self.session.spark.range(1).select()), PathPattern(p.var, p.parts))
            return self.join_states(s, fresh, "inner")
        else:
            first_rel = parts[1] if len(parts) > 1 else None
            if first_rel is not None and first_rel.hops is None and not first.props and self.implied(first, first_rel, parts[2]) and (self.key_only(first, first_rel, parts[2]) or self.in_rel(first, first_rel, first.labels, parts[2].labels, False)):
                s = self.from_rel(s, first, first_rel, parts[2])
            else:
                df, bound = self.scan(first.var, first.var, first.labels, first.props, s)
                s = State(df if s.empty else s.df.crossJoin(df), {**s.scope, first.var: bound}, False, s.carry)
        made: list[tuple[str, Any]] = [("node", first.var)]
        for i in range(1, len(parts), 2):
            r, b = parts[i], parts[i + 1]
            r.var = r.var or f"_r{next(self.fresh)}"
            if not (i == 1 and f"{r.var}" in s.scope and s.scope[r.var].kind == "rel" and getattr(self, "_started", None) is r):
                s = self.recursive(s, parts[i - 1], r, b) if r.hops else self.expand(s, parts[i - 1], r, b)
            else:
                s = self.arrive(s, r, b, self._far)
                self._started = None
            made += [("rel", r.var), ("node", b.var)]
        if p.var:
            s = self.path_value(s, p.var, made[::-1] if backward else made)
        return s

    def properties_of(self, labels: list[str]) -> list[str]:
        return list(dict.fromkeys(p for x in (labels or self.catalog.nodes) for p in self.catalog.node(x).properties))

    def pairs(self, r: RelPattern, sources: list[str], targets: list[str]) -> list[tuple[str, RelPair, bool]]:
        """(type, pair, reversed) that the pattern can follow from a node of sources to one of targets."""
        out = []
        for t in r.types or sorted(self.catalog.rels):
            if r.var in self.identified:
                self.catalog.identify(t)
            for pair in self.catalog.rel(t).pairs:
                for back in {"out": (False,), "in": (True,), "both": (False, True)}[r.direction]:
                    a, b = (pair.target, pair.source) if back else (pair.source, pair.target)
                    if (not sources or a in sources) and (not targets or b in targets):
                        out.append((t, pair, back))
        return out

    def implied(self, n: NodePattern, r: RelPattern, b: NodePattern) -> bool:
        ends = {(p.target if back else p.source) for _, p, back in self.pairs(r, n.labels, b.labels)}
        return len(ends) == 1

    def key_only(self, n: NodePattern, r: RelPattern, b: NodePattern) -> bool:
        _, p, back = self.pairs(r, n.labels, b.labels)[0]
        table = self.catalog.node(p.target if back else p.source)
        return set(self.wants(n.var, table.properties)) | (self.needed.get(n.var, set()) - {"*"}) <= {table.key}

    def in_rel(self, n: NodePattern, r: RelPattern, sources: list[str], targets: list[str], far: bool) -> Bound | None:
        """What n stands for, if the relationship's rows hold its properties; far: n is where the step arrives."""
        found = self.pairs(r, sources, targets)
        if len(found) != 1 or n.props or r.var in self.identified:
            return None
        _, pair, back = found[0]
        if pair.end != ("_dst" if far != back else "_src"):
            return None
        label = pair.target if pair.end == "_dst" else pair.source
        if n.labels and n.labels != [label]:
            return None
        table = self.catalog.node(label)
        if unknown := self.needed.get(n.var, set()) - {"*"} - set(table.properties):
            raise QueryError(f"{label} has no property {sorted(unknown)[0]}")
        return Bound("node", n.var, (label,), tuple(self.wants(n.var, table.properties)))

    def edges(self, name: str, r: RelPattern, found: list[tuple[str, RelPair, bool]], ends: bool, node: Bound | None = None) -> tuple[DataFrame, Bound]:
        """Relationship rows with from and to as the pattern walks them; ends: with their labels; node: an end that they hold (in_rel)."""
        every = list(dict.fromkeys(p for _, pair, _ in found for p in pair.properties))
        if unknown := (self.needed.get(r.var, set()) - {"*"} | {k for k, _ in r.props}) - set(every):
            if found:
                raise QueryError(f"{'|'.join(r.types) or 'relationship'} has no property {sorted(unknown)[0]}")
        wanted = self.wants(r.var, every)
        frames = []
        for t, pair, back in found:
            df = pair.df if node is None else pair.wide.where(F.col(pair.end).isNotNull())
            for k, e in r.props:
                df = df.where(semantics.compare("=", F.col(f"`{k}`"), F.lit(self.constant(e)), True, False) if k in pair.properties else F.lit(False))
            a, b = ("_dst", "_src") if back else ("_src", "_dst")
            cols = [F.col(a).alias(f"{name}___from"), F.col(b).alias(f"{name}___to"), F.col("_src").alias(f"{name}___src"), F.col("_dst").alias(f"{name}___dst"), F.lit(t).alias(f"{name}___type")]
            if r.var in self.identified:
                cols.append(F.col("_rid").alias(f"{name}___rid"))
            if node is not None:
                cols += [F.col(f"`{NODE}{p}`").alias(f"{node.name}__{p}") for p in node.columns]
            if ends:
                cols += [F.lit(pair.target if back else pair.source).alias(f"{name}___fl"), F.lit(pair.source if back else pair.target).alias(f"{name}___tl")]
            frames.append(df.select(*cols, *(F.col(f"`{p}`").alias(f"{name}__{p}") for p in wanted if p in pair.properties)))
        if not frames:
            raise QueryError(f"no relationship table fits {'|'.join(r.types) or 'the pattern'}")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames), Bound("rel", name, tuple(dict.fromkeys(t for t, _, _ in found)), tuple(wanted), r.var in self.identified)

    def check_node(self, s: State, n: NodePattern) -> State:
        b = s.scope[n.var]
        if b.kind != "node":
            raise QueryError(f"{n.var} is no node")
        if n.labels and not set(b.labels) <= set(n.labels):
            s = State(s.df.where(b.col("_label").isin(n.labels) if len(b.labels) != 1 else F.lit(False)), s.scope, s.empty, s.carry)
        for k, e in n.props:
            s = self.where(s, E("compare", op="=", a=E("prop", of=E("var", name=n.var), name=k), b=e))
        return s

    def from_rel(self, s: State, a: NodePattern, r: RelPattern, b: NodePattern) -> State:
        """Start at the relationship's rows: the first node needs no more than its key."""
        r.var = r.var or f"_r{next(self.fresh)}"
        found = self.pairs(r, a.labels, b.labels)
        label = found[0][1].target if found[0][2] else found[0][1].source
        here = self.in_rel(a, r, a.labels, b.labels, False)
        self._far = self.in_rel(b, r, a.labels, b.labels, True) if b.var != a.var and b.var not in s.scope else None
        e, bound = self.edges(r.var, r, found, True, here or self._far)
        e = e.withColumn(f"{a.var}___id", F.col(f"{r.var}___from")).drop(f"{r.var}___from", f"{r.var}___fl")
        self._started = r
        return State(e if s.empty else s.df.crossJoin(e), {**s.scope, a.var: here or Bound("node", a.var, (label,), ()), r.var: bound}, False, s.carry)

    def expand(self, s: State, a: NodePattern, r: RelPattern, b: NodePattern) -> State:
        start = s.scope[a.var]
        known = list(s.scope[b.var].labels) if b.var in s.scope else b.labels
        found = self.pairs(r, list(start.labels), known)
        if r.var in s.scope and s.scope[r.var].kind == "rel":
            raise QueryError(f"relationship {r.var} is bound twice")
        far = self.in_rel(b, r, list(start.labels), known, True) if b.var not in s.scope else None
        e, bound = self.edges(r.var, r, found, True, far)
        on = start.col("_id") == F.col(f"{r.var}___from")
        if len(start.labels) != 1:
            on = (start.col("_id").cast("string") == F.col(f"{r.var}___from").cast("string")) & (start.col("_label") == F.col(f"{r.var}___fl"))
        if b.var in s.scope:  # both ends in one join condition
            end = s.scope[b.var]
            on = on & (end.col("_id").cast("string") == F.col(f"{r.var}___to").cast("string") if len(end.labels) != 1 else end.col("_id") == F.col(f"{r.var}___to"))
        df = s.df.join(e, on).drop(f"{r.var}___from", f"{r.var}___fl")
        return self.arrive(State(df, {**s.scope, r.var: bound}, False, s.carry), r, b, far)

    def arrive(self, s: State, r: RelPattern, b: NodePattern, node: Bound | None) -> State:
        """Bind the end of a step, which the columns __to and __tl of the relationship name; node: it is in the relationship's rows."""
        to, label = f"{r.var}___to", f"{r.var}___tl"
        if node is not None:
            return State(s.df.withColumnRenamed(to, f"{b.var}___id").drop(label), {**s.scope, b.var: node}, False, s.carry)
        if b.var in s.scope:
            end = s.scope[b.var]
            same = end.col("_id") == F.col(to) if len(end.labels) == 1 else (end.col("_id").cast("string") == F.col(to).cast("string")) & (end.col("_label") == F.col(label))
            s = State(s.df.where(same).drop(to, label), s.scope, False, s.carry)
            return self.check_node(s, b)
        ends = self.end_labels(r, b)
        props = self.properties_of(ends)
        wanted = self.wants(b.var, props)
        keys = {self.catalog.node(x).key for x in ends}
        if len(ends) == 1 and not b.props and set(wanted) <= keys and not (self.needed.get(b.var, set()) - {"*"} - set(props)):
            df = s.df.withColumnRenamed(to, f"{b.var}___id").drop(label)
            bound = Bound("node", b.var, tuple(ends), tuple(wanted))
            for w in wanted:
                df = df.withColumn(f"{b.var}__{w}", F.col(f"{b.var}___id"))
            return State(df, {**s.scope, b.var: bound}, False, s.carry)
        df, bound = self.scan(b.var, b.var, ends, b.props, s)
        on = F.col(to) == F.col(f"{b.var}___id")
        if len(ends) > 1:
            on = (F.col(to).cast("string") == F.col(f"{b.var}___id").cast("string")) & (F.col(label) == F.col(f"{b.var}___label"))
        return State(s.df.join(df, on).drop(to, label), {**s.scope, b.var: bound}, False, s.carry)

    def end_labels(self, r: RelPattern, b: NodePattern) -> list[str]:
        ends = sorted({(p.source if back else p.target) for _, p, back in self.pairs(r, [], b.labels)})
        return [x for x in ends if not b.labels or x in b.labels]

    def recursive(self, s: State, a: NodePattern, r: RelPattern, b: NodePattern) -> State:
        """All paths of lo to hi hops on which no node repeats. Ids only; the end's properties are joined last."""
        lo, hi = r.hops
        start = s.scope[a.var]
        found = self.pairs(r, [], [])
        labels = sorted({x for _, p, _ in found for x in (p.source, p.target)})
        one = len(labels) == 1
        if r.per_hop:
            rv, nv, test = r.per_hop
            mine = Lowering(self.session, self.parameters)
            mine.needed = uses(test)
            e, rel = mine.edges("_hop", RelPattern(rv, r.types, r.props, r.direction), found, True)
            nodes, node = mine.scan(nv, "_hopnode", labels, [], s)
            at_node = F.col("_hop___to") == F.col("_hopnode___id") if one else (F.col("_hop___to").cast("string") == F.col("_hopnode___id").cast("string")) & (F.col("_hop___tl") == F.col("_hopnode___label"))
            e = e.join(nodes, at_node)
            e = mine.where(State(e, {rv: rel, nv: node}, False), test).df
        else:
            e, _ = self.edges("_hop", RelPattern(None, r.types, r.props, r.direction), found, True)
        #: Over several node tables a node is named label:key.
        named = lambda label, key: key if one else F.concat(label, F.lit(":"), key.cast("string"))
        here = named(F.lit(start.labels[0]) if len(start.labels) == 1 else start.col("_label"), start.col("_id"))
        e = e.select(named(F.col("_hop___fl"), F.col("_hop___from")).alias("_f"), named(F.col("_hop___tl"), F.col("_hop___to")).alias("_t"), F.concat_ws("|", "_hop___type", F.col("_hop___src").cast("string"), F.col("_hop___dst").cast("string")).alias("_e"))
        vis, rels, end = f"{r.var}___nodes", f"{r.var}___rels", f"{r.var}___to"
        at = s.df.withColumn(vis, F.array(here)).withColumn(rels, F.array().cast("array<string>")).withColumn(end, here)
        levels = [at] if lo == 0 else []
        depth = 0
        while hi is None or depth < hi:
            step = at.join(e, F.col(end) == F.col("_f")).where(~F.array_contains(vis, F.col("_t")))
            step = step.withColumn(vis, F.array_append(vis, F.col("_t"))).withColumn(rels, F.array_append(rels, F.col("_e"))).withColumn(end, F.col("_t")).drop("_f", "_t", "_e")
            depth += 1
            if hi is None or depth >= 3:  # each further level would repeat the joins below it
                step = cut(step, "paths")
                if step.isEmpty():
                    break
            if hi is None and depth > MAX_HOPS:
                raise QueryError(f"an unbounded pattern still grows after {MAX_HOPS} hops; give it a bound")
            if depth >= lo:
                levels.append(step)
            at = step
        df = reduce(lambda x, y: x.unionByName(y), levels) if levels else at.limit(0)
        if one:
            df = df.withColumn(f"{r.var}___tl", F.lit(labels[0]))
        else:
            df = df.withColumn(f"{r.var}___tl", F.substring_index(end, ":", 1)).withColumn(end, F.regexp_replace(end, "^[^:]*:", ""))
            wanted = list(s.scope[b.var].labels) if b.var in s.scope else self.end_labels(RelPattern(r.var, r.types, r.props, r.direction), b)
            df = df.where(F.col(f"{r.var}___tl").isin(wanted))
            if len(wanted) == 1:  # the key has its own type again
                t = self.catalog.node(wanted[0])
                df = df.withColumn(end, F.col(end).try_cast(t.df.schema[t.key].dataType))
        scope = {**s.scope, r.var: Bound("hops", r.var)}
        return self.arrive(State(df, scope, False, s.carry), RelPattern(r.var, r.types, r.props, r.direction), b, None)

    def path_value(self, s: State, name: str, made: list[tuple[str, str]]) -> State:
        """struct(nodes: ids, rels: texts type|src|dst)."""
        nodes, rels = [], []
        for i, (kind, var) in enumerate(made):
            b = s.scope[var]
            if kind == "node":
                if i and s.scope[made[i - 1][1]].kind == "hops":
                    continue  # the hops hold their end
                nodes.append(F.array(b.col("_id").cast("string")))
            elif b.kind == "hops":
                nodes.append(F.transform(F.slice(F.col(f"{var}___nodes"), F.lit(2), F.size(f"{var}___nodes")), lambda x: x.cast("string")))
                rels.append(F.col(f"{var}___rels"))
            else:
                rels.append(F.array(F.concat_ws("|", b.col("_type"), b.col("_src").cast("string"), b.col("_dst").cast("string"))))
        value = F.struct(F.concat(*nodes).alias("nodes"), (F.concat(*rels) if rels else F.array().cast("array<string>")).alias("rels"))
        return State(s.df.withColumn(name, value), {**s.scope, name: Bound("path", name)}, False, s.carry)

    def join_states(self, left: State, right: State, how: str, on_more: Column | None = None) -> State:
        shared = [v for v in right.scope if v in left.scope]
        df, on = right.df, on_more
        for v in shared:
            a, b = left.scope[v], right.scope[v]
            df = df.withColumnRenamed(f"{b.name}___id", f"_j_{v}")
            df = df.drop(*(x for x in b.all_columns() if x in left.df.columns))
            same = a.col("_id") == F.col(f"_j_{v}")
            on = same if on is None else on & same
        df = df.drop(*(x for x in df.columns if x in left.df.columns))
        out = left.df.join(df, on, how).drop(*(f"_j_{v}" for v in shared))
        return State(out, {**{v: b for v, b in right.scope.items() if v not in left.scope}, **left.scope}, False, left.carry)

    def optional(self, s: State, c: Clause) -> State:
        """The pattern and its WHERE are one side of a left outer join on the shared variables."""
        fresh = State(self.session.spark.range(1).select())
        for p in c.patterns:
            for n in p.parts[::2]:
                if n.var in s.scope and not n.labels:
                    n.labels = list(s.scope[n.var].labels)
            fresh = self.path(fresh, p)
        fresh = self.where(fresh, c.where)
        if s.empty:
            one = self.session.spark.range(1).select(F.lit(1).alias("_one"))
            return State(one.join(fresh.df, F.lit(True), "left").drop("_one"), fresh.scope, False, s.carry)
        if any(v in s.scope for v in fresh.scope):
            return self.join_states(s, fresh, "left")
        new = [x for x in fresh.df.columns if x not in s.df.columns]
        empty = {f.name: f.dataType for f in fresh.df.schema}
        df = s.df.select("*", *(F.lit(None).cast(empty[x]).alias(x) for x in new))
        return State(df, {**fresh.scope, **s.scope}, False, s.carry)

    # ------------------------------------------------------------ filters and subqueries
    def where(self, s: State, e: Expr | None) -> State:
        for part in split_and(e):
            negated, inner = (True, part.a) if part.kind == "not" else (False, part)
            if inner.kind == "exists":
                s = self.semi(s, inner, negated)
                continue
            df, part = self.prepare(s, part)
            s = State(df, s.scope, s.empty, s.carry)
            s = State(df.where(self.value(s, part, filtering=True)), s.scope, s.empty, s.carry)
        return s

    def inner_match(self, s: State, e: Expr) -> tuple[DataFrame, Column, list[str], list[str] | None]:
        """(rows of the subquery's pattern, condition joining them to s, the outer columns it reads, and, if the
        condition only equates these with inner columns, the inner columns)."""
        mine = Lowering(self.session, self.parameters)
        mine.fresh = self.fresh
        tag = f"_i{next(self.fresh)}_"
        rename = lambda v: tag + v if v else None
        patterns, inner_vars = [], set()
        for p in e.patterns:
            parts = []
            for x in p.parts:
                if x.var:
                    inner_vars.add(x.var)
                if isinstance(x, NodePattern):
                    labels = x.labels or (list(s.scope[x.var].labels) if x.var in s.scope else [])
                    parts.append(NodePattern(rename(x.var), labels, x.props))
                else:
                    parts.append(RelPattern(rename(x.var), x.types, x.props, x.direction, x.hops, x.per_hop))
            patterns.append(PathPattern(rename(p.var), parts))
        swap = lambda x: E("var", name=tag + x.name) if x.kind == "var" and x.name in inner_vars and x.name not in s.scope else None
        test = rewrite(e.where, swap) if e.where is not None else None
        mine.needed = uses([patterns, test])
        got = State(self.session.spark.range(1).select())
        for p in patterns:
            got = mine.path(got, p)
        inside, outside = [], []
        for part in split_and(test):
            (outside if any(v in s.scope for v in uses(part)) else inside).append(part)
        for part in inside:
            got = mine.where(got, part)
        shared = [v for v in inner_vars if v in s.scope]
        if not shared and not outside:
            raise QueryError("a subquery without a shared variable is not supported in this place")
        on, outer = F.lit(True), []
        for v in shared:
            on = on & (s.scope[v].col("_id") == got.scope[tag + v].col("_id"))
            outer.append(f"{s.scope[v].name}___id")
        equal = [f"{tag}{v}___id" for v in shared] if not outside else None
        both = State(s.df.limit(0).crossJoin(got.df.limit(0)), {**s.scope, **got.scope}, False)
        for part in outside:
            on = on & self.value(both, part, filtering=True)
            for v, props in uses(part).items():
                if v in s.scope:
                    outer += s.scope[v].all_columns() if "*" in props else [f"{s.scope[v].name}__{'_id' if self.is_key(s.scope[v], p) else p}" for p in props]
        return got.df, on, list(dict.fromkeys(outer)), equal

    def is_key(self, b: Bound, prop: str) -> bool:
        return b.kind == "node" and len(b.labels) == 1 and self.catalog.node(b.labels[0]).key == prop and prop not in b.columns

    def semi(self, s: State, e: Expr, negated: bool) -> State:
        inner, on, _, _ = self.inner_match(s, e)
        return State(s.df.join(inner, on, "left_anti" if negated else "left_semi"), s.scope, s.empty, s.carry)

    def prepare(self, s: State, e: Expr) -> tuple[DataFrame, Expr]:
        """Give s a column for each subquery within e, and name it in e's place."""
        df = s.df

        def replace(x: Expr) -> Expr | None:
            nonlocal df
            if x.kind not in ("exists", "count_of"):
                return None
            inner, on, outer, equal = self.inner_match(State(df, s.scope, s.empty), x)
            name = f"_sub{next(self.fresh)}"
            if equal:  # one aggregation of the pattern's rows by their own ends
                n = inner.groupBy(*(F.col(f"`{i}`").alias(f"_k_{o}") for o, i in zip(outer, equal, strict=True))).agg(F.count(F.lit(1)).alias(name))
                match = reduce(lambda a, b: a & b, (F.col(f"`{o}`") == F.col(f"`_k_{o}`") for o in outer))
            else:
                keys = df.select(*(f"`{o}`" for o in outer)).distinct()
                n = keys.join(inner, on).groupBy(*(F.col(f"`{o}`").alias(f"_k_{o}") for o in outer)).agg(F.count(F.lit(1)).alias(name))
                match = reduce(lambda a, b: a & b, (F.col(f"`{o}`").eqNullSafe(F.col(f"`_k_{o}`")) for o in outer))
            df = df.join(n, match, "left").drop(*(f"_k_{o}" for o in outer))
            got = F.coalesce(F.col(name), F.lit(0).cast("long"))
            df = df.withColumn(name, got > 0 if x.kind == "exists" else got)
            return E("col", name=name)

        new = rewrite(e, replace) if any(self._subqueries(e)) else e
        return df, new

    def _subqueries(self, e: Any):
        if isinstance(e, Expr):
            if e.kind in ("exists", "count_of"):
                yield e
            else:
                for x in children(e):
                    yield from self._subqueries(x)

    # ------------------------------------------------------------ projection
    def project(self, s: State, p: Projection, final: bool) -> State:
        items = list(p.items)
        if p.star:
            own = [(E("var", name=v), v) for v, b in s.scope.items() if not v.startswith("_") and b.kind != "hops"]
            items = own + items
        expanded = []
        for e, n in items:
            if e.kind == "all_props":
                b = s.scope[e.of.name]
                expanded += [(E("prop", of=e.of, name=c), c) for c in b.columns]
            else:
                expanded.append((e, n))
        items = [(self.macros(e), n) for e, n in expanded]
        order = [(self.macros(e), up) for e, up in p.order]
        if len({n for _, n in items}) < len(items):
            raise QueryError("two result columns have the same name")
        df = s.df
        for i, (e, n) in enumerate(items):
            df, e = self.prepare(State(df, s.scope, s.empty), e)
            items[i] = (e, n)
        s = State(df, s.scope, s.empty, s.carry)
        if any(has_aggregate(e) for e, _ in items):
            out = self.aggregate(s, items, order, final)
        else:
            out = self.plain_items(s, items, order, final, p.distinct)
        df, scope, hidden = out
        if p.distinct:
            df = df.distinct()
        if order:
            df = df.orderBy(*(semantics.ordering(F.col(f"`{c}`"), up) for c, (_, up) in zip(hidden, order, strict=True)))
        if p.skip is not None:
            df = df.offset(max(0, int(self.constant(p.skip))))
        if p.limit is not None:
            df = df.limit(max(0, int(self.constant(p.limit))))
        keep = [*s.carry, *(c for v in scope.values() for c in (v.all_columns()))]
        return State(df.select(*(F.col(f"`{c}`") for c in dict.fromkeys(keep))), scope, False, s.carry)

    def carried(self, s: State, e: Expr, name: str, final: bool) -> tuple[list[Column], Bound]:
        """The columns of an item, and what its name stands for afterwards."""
        if e.kind == "var" and e.name in s.scope and s.scope[e.name].kind in ("node", "rel") and not final:
            b = s.scope[e.name]
            moved = Bound(b.kind, name, b.labels, b.columns, b.ident)
            return [F.col(f"`{x}`").alias(y) for x, y in zip(b.all_columns(), moved.all_columns(), strict=True)], moved
        if e.kind == "var" and e.name in s.scope and s.scope[e.name].kind == "path" and not final:
            return [F.col(f"`{e.name}`").alias(name)], Bound("path", name)
        return [self.value(s, e).alias(name)], Bound("value", name)

    def sort_columns(self, s: State, items: list, order: list, scope: dict[str, Bound]) -> tuple[list[str], list[tuple[str, Expr]]]:
        """For each order key the column that holds it; the keys that still have to be computed."""
        names, extra = [], []
        for i, (e, _) in enumerate(order):
            hit = next((n for x, n in items if x == e or e == E("var", name=n)), None)
            if hit is not None and scope[hit].kind in ("node", "rel"):
                hit = f"{scope[hit].name}__{'_id' if scope[hit].kind == 'node' else '_src'}"
            if hit is None:
                hit = f"_o{i}"
                extra.append((hit, e))
            names.append(hit)
        return names, extra

    def plain_items(self, s: State, items: list, order: list, final: bool, distinct: bool):
        cols, scope = [F.col(f"`{x}`") for x in s.carry], {}
        for e, n in items:
            made, scope[n] = self.carried(s, e, n, final)
            cols += made
        names, extra = self.sort_columns(s, items, order, scope)
        if extra and distinct:
            raise QueryError("after DISTINCT, ORDER BY can only use result columns")
        late = []
        for name, e in extra:
            if all(v in s.scope for v in uses(e)):
                cols.append(self.value(s, e).alias(name))
            else:
                late.append((name, e))
        df = s.df.select(*cols)
        for name, e in late:  # uses result columns
            df = df.withColumn(name, self.value(State(df, {**s.scope, **scope}, False), e))
        return df, scope, names

    def aggregate(self, s: State, items: list, order: list, final: bool):
        keys = [(e, n) for e, n in items if not has_aggregate(e)]
        group, scope = [F.col(f"`{x}`") for x in s.carry], {}
        for e, n in keys:
            made, scope[n] = self.carried(s, e, n, final)
            group += made
        calls: list[tuple[Expr, str]] = []

        def take(x: Expr) -> Expr | None:
            for e, n in keys:
                if x == e:
                    return E("col", name=n) if scope[n].kind == "value" else E("var", name=n)
            if x.kind == "call" and x.name in AGGREGATES:
                for e, n in calls:
                    if e == x:
                        return E("col", name=n)
                calls.append((x, f"_a{len(calls)}"))
                return E("col", name=calls[-1][1])
            return None

        rest = [(rewrite(e, take), n) for e, n in items if has_aggregate(e)]
        names, extra = self.sort_columns(s, items, order, {**scope, **{n: Bound("value", n) for _, n in rest}})
        extra = [(n, rewrite(rewrite(e, lambda x: next((i for i, m in items if x == E("var", name=m) and has_aggregate(i)), None)), take)) for n, e in extra]
        df = s.df
        for i, (e, n) in enumerate(calls):
            df, e = self.prepare(State(df, s.scope, s.empty), e)
            calls[i] = (e, n)
        s = State(df, s.scope, s.empty, s.carry)
        made = [self.aggregate_call(s, e).alias(n) for e, n in calls]
        df = s.df.groupBy(*group).agg(*made) if group else s.df.agg(*made)
        after = State(df, dict(scope), False)
        cols = [F.col(f"`{c}`") for c in df.columns if not c.startswith("_a") or c in s.carry]
        cols += [self.value(after, e).alias(n) for e, n in [*rest, *extra]]
        scope = {n: scope.get(n, Bound("value", n)) for _, n in items}
        return df.select(*cols), scope, names

    def aggregate_call(self, s: State, e: Expr) -> Column:
        if e.name == "count_star" or e.args and e.args[0].kind == "star":
            return F.count(F.lit(1))
        arg = e.args[0]
        if e.name == "count" and arg.kind == "var" and arg.name in s.scope and s.scope[arg.name].kind in ("node", "rel"):
            b = s.scope[arg.name]
            x = b.col("_id") if b.kind == "node" else F.struct(b.col("_type"), b.col("_src"), b.col("_dst"))
            if b.kind == "rel":
                x = F.when(b.col("_src").isNotNull(), x)
        else:
            x = self.value(s, arg)
        if e.name == "count_if":
            t = s.df.select(x.alias("x")).schema[0].dataType
            return F.count_if(semantics.truth(x if isinstance(t, T.BooleanType) else x != 0))
        if e.name in ("sum", "avg"):
            x = x.cast("double")
        if e.name == "collect":
            return F.collect_set(x) if e.distinct else F.collect_list(x)
        if e.name == "count":
            return F.count_distinct(x) if e.distinct else F.count(x)
        return {"sum": F.sum_distinct if e.distinct else F.sum, "avg": (lambda y: F.sum_distinct(y) / F.count_distinct(y)) if e.distinct else F.avg, "min": F.min, "max": F.max}[e.name](x)

    # ------------------------------------------------------------ expressions
    def macros(self, e: Expr) -> Expr:
        def expand(x: Expr) -> Expr | None:
            if x.kind != "call" or x.name not in self.catalog.macros:
                return None
            m = self.catalog.macros[x.name]
            given = dict(zip((n for n, _ in m.parameters), x.args, strict=False))
            for n, default in m.parameters:
                if n not in given:
                    if default is None:
                        raise QueryError(f"macro {m.name} needs {n}")
                    given[n] = default
            return self.macros(rewrite(m.body, lambda y: given.get(y.name) if y.kind == "var" else None))

        return rewrite(e, expand)

    def constant(self, e: Expr) -> Any:
        if e.kind == "lit":
            return e.value
        if e.kind == "param":
            if e.name not in self.parameters:
                raise QueryError(f"parameter {e.name} is missing")
            return self.parameters[e.name]
        if e.kind == "list":
            return [self.constant(x) for x in e.items]
        if e.kind == "struct":
            return {k: self.constant(x) for k, x in e.items}
        if e.kind in ("call", "cast"):
            return self.session.spark.range(1).select(self.value(State(self.session.spark.range(1).select()), e).alias("x")).first()[0]
        if e.kind == "var":
            return e.name
        raise QueryError("a constant is needed here")

    def maybe_constant(self, e: Expr) -> Any:
        return self.constant(e) if e.kind in ("lit", "param") else Context.NONE

    def value(self, s: State, e: Expr, local: Local = None, filtering: bool = False) -> Column:
        v = lambda x, loc=local: self.value(s, x, loc)
        k = e.kind
        if k == "lit":
            return F.lit(e.value)
        if k == "param":
            x = self.constant(e)
            return F.lit(x) if not isinstance(x, dict) else F.struct(*(F.lit(y).alias(n) for n, y in x.items()))
        if k == "col":
            return F.col(f"`{e.name}`")
        if k == "var":
            return self.variable(s, e.name, local)
        if k == "prop":
            return self.property(s, e, local)
        if k == "compare":
            known = lambda x: x.kind in ("lit", "param") and self.constant(x) is not None
            return semantics.compare(e.op, v(e.a), v(e.b), not known(e.a), not known(e.b), filtering)
        if k in ("and", "or", "xor"):
            if filtering and k != "xor":
                a, b = (self.value(s, x, local, True) for x in (e.a, e.b))
                return a & b if k == "and" else a | b
            a, b = semantics.truth(v(e.a)), semantics.truth(v(e.b))
            return a & b if k == "and" else a | b if k == "or" else a != b
        if k == "not":
            return ~semantics.truth(v(e.a))
        if k == "null":
            x = v(e.a) if not (e.a.kind == "var" and e.a.name in s.scope and s.scope[e.a.name].kind in ("node", "rel")) else s.scope[e.a.name].col("_id" if s.scope[e.a.name].kind == "node" else "_src")
            return x.isNotNull() if e.negated else x.isNull()
        if k == "list":
            return F.array(*map(v, e.items)) if e.items else F.array().cast("array<string>")
        if k == "struct":
            return F.struct(*(v(x).alias(n) for n, x in e.items))
        if k == "case":
            return self.case(e, v)
        if k == "cast":
            x = v(e.a)
            return F.lit(None).cast(spark_type(e.to)) if e.a.kind == "lit" and e.a.value is None else cast(self.context(s, [e.a], local, [x]), x, e.to)
        if k == "index":
            base = v(e.of)
            t = self.context(s, [e.of], local, [base]).type(base)
            at = self.maybe_constant(e.at)
            if isinstance(t, T.StructType) and isinstance(at, str):
                return base.getField(at)
            return SCALARS["list_element"](None, base, v(e.at))
        if k == "slice":
            base = v(e.of)
            return SCALARS["list_slice"](None, base, v(e.start) if e.start is not None else F.lit(1), v(e.stop) if e.stop is not None else F.size(base))
        if k == "quantifier":
            items = v(e.items)
            one = self.element(s, e.items, local)
            test = lambda x: semantics.truth(self.value(s, e.test, {**(local or {}), e.var: (x, one)}))
            hits = F.size(F.filter(items, test))
            out = {"ALL": F.forall(items, test), "ANY": F.exists(items, test), "NONE": ~F.exists(items, test), "SINGLE": hits == 1}[e.which]
            return F.coalesce(out, F.lit(e.which in ("ALL", "NONE"))) if e.which != "SINGLE" else semantics.truth(out)
        if k == "comprehension":
            x, one = v(e.items), self.element(s, e.items, local)
            inside = lambda body: lambda y: self.value(s, body, {**(local or {}), e.var: (y, one)})
            if e.test is not None:
                x = F.filter(x, lambda y: semantics.truth(inside(e.test)(y)))
            return F.transform(x, inside(e.to)) if e.to is not None else x
        if k == "over":
            return self.window(s, e, v)
        if k == "call":
            return self.call(s, e, local)
        raise QueryError(f"{k} cannot stand here")

    def context(self, s: State, exprs: list[Expr], local: Local, args: list[Column] = ()) -> Context:
        literals = [self.maybe_constant(a) for a in exprs]
        if not local:
            return Context(s.df, literals, self.session)
        return _LocalContext(s.df, literals, self.session, [(a, self.value(s, x, self.typed(local))) for a, x in zip(args, exprs, strict=True)])

    def typed(self, local: Local) -> Local:
        return {k: (null, null) for k, (_, null) in (local or {}).items()}

    def element(self, s: State, items: Expr, local: Local) -> Column:
        """A null of the list's element type."""
        t = s.df.select(self.value(s, items, self.typed(local)).alias("x")).schema[0].dataType
        return F.lit(None).cast(t.elementType if isinstance(t, T.ArrayType) else t)

    def case(self, e: Expr, v) -> Column:
        out = None
        for test, then in e.whens:
            hit = v(e.base).eqNullSafe(v(test)) if e.base is not None else semantics.truth(v(test))
            out = F.when(hit, v(then)) if out is None else out.when(hit, v(then))
        return out.otherwise(v(e.other)) if e.other is not None else out

    def variable(self, s: State, name: str, local: Local) -> Column:
        if local and name in local:
            return local[name][0]
        if name not in s.scope:
            raise QueryError(f"unknown variable {name}")
        b = s.scope[name]
        if b.kind == "node":
            label = F.lit(b.labels[0]) if len(b.labels) == 1 else b.col("_label")
            parts = [F.concat(label, F.lit(":"), b.col("_id").cast("string")).alias("_id"), label.alias("_label"), *(b.col(p).alias(p) for p in b.columns)]
            return F.when(b.col("_id").isNotNull(), F.struct(*parts))
        if b.kind == "rel":
            return F.when(b.col("_src").isNotNull(), F.struct(b.col("_type").alias("_type"), b.col("_src").cast("string").alias("_src"), b.col("_dst").cast("string").alias("_dst"), *(b.col(p).alias(p) for p in b.columns)))
        if b.kind == "hops":
            return F.col(f"`{name}___rels`")
        return F.col(f"`{name}`")

    def property(self, s: State, e: Expr, local: Local) -> Column:
        if e.of.kind == "var" and not (local and e.of.name in local) and e.of.name in s.scope:
            b = s.scope[e.of.name]
            if b.kind in ("node", "rel"):
                if e.name in b.columns:
                    return b.col(e.name)
                if self.is_key(b, e.name):
                    return b.col("_id")
                raise QueryError(f"{e.of.name} has no property {e.name}")
        return self.value(s, e.of, local).getField(e.name)

    def call(self, s: State, e: Expr, local: Local) -> Column:
        name = e.name
        if name in self.catalog.macros:
            return self.value(s, self.macros(e), local)
        if name in AGGREGATES:
            raise QueryError(f"{name} cannot stand here")
        if any(a.kind == "lambda" for a in e.args):
            return self.with_lambda(s, e, local)
        if e.args and e.args[0].kind == "var" and e.args[0].name in s.scope and not (local and e.args[0].name in local):
            b = s.scope[e.args[0].name]
            if b.kind == "node" and name in ("label", "labels"):
                return F.lit(b.labels[0]) if len(b.labels) == 1 else b.col("_label")
            if b.kind == "node" and name == "id":
                return F.concat(F.lit(b.labels[0]) if len(b.labels) == 1 else b.col("_label"), F.lit(":"), b.col("_id").cast("string"))
            if b.kind == "rel" and name in ("type", "relationship_type", "label"):
                return b.col("_type")
            if b.kind == "hops" and name in ("length", "size", "len"):
                return F.size(F.col(f"`{b.name}___rels`")).cast("long")
        if name in self.session.scalar_functions:
            return self.session.scalar_functions[name](*(self.value(s, a, local) for a in e.args))
        if name not in SCALARS:
            raise QueryError(f"unknown function {name}")
        args = [self.value(s, a, local) for a in e.args]
        return SCALARS[name](self.context(s, e.args, local, args), *args)

    def with_lambda(self, s: State, e: Expr, local: Local) -> Column:
        items, f = self.value(s, e.args[0], local), e.args[1]
        one = self.element(s, e.args[0], local)
        inside = lambda *xs: self.value(s, f.body, {**(local or {}), **{n: (x, one) for n, x in zip(f.vars, xs, strict=True)}})
        if e.name == "list_filter":
            return F.filter(items, lambda x: semantics.truth(inside(x)))
        if e.name in ("list_transform", "list_apply", "array_apply"):
            return F.transform(items, lambda x: inside(x))
        if e.name == "list_reduce":
            return F.when(F.size(items) > 0, F.aggregate(F.slice(items, F.lit(2), F.size(items)), F.try_element_at(items, F.lit(1)), lambda a, x: inside(a, x)))
        raise QueryError(f"{e.name} takes no lambda")

    # ------------------------------------------------------------ windows
    def window(self, s: State, e: Expr, v) -> Column:
        by, order = [v(x) for x in e.by], [semantics.ordering(v(x), up) for x, up in e.order]
        w = W.partitionBy(*by).orderBy(*order) if order else W.partitionBy(*by)
        name, args = e.call.name, e.call.args
        whole = W.partitionBy(*by)
        if name == "ntile":  # floor(i * n / total) + 1
            i, n = F.row_number().over(w) - 1, int(self.constant(args[0]))
            return F.floor(i * n / F.count(F.lit(1)).over(whole)).cast("long") + 1
        plain = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank, "cume_dist": F.cume_dist}
        if name in plain:
            out = plain[name]().over(w)
            return out if name in ("percent_rank", "cume_dist") else out.cast("long")
        if name in ("lag", "lead"):
            off = int(self.constant(args[1])) if len(args) > 1 else 1
            default = self.constant(args[2]) if len(args) > 2 else None
            return (F.lag if name == "lag" else F.lead)(v(args[0]), off, default).over(w)
        if e.frame:
            unit, lo, hi = e.frame
            low = W.unboundedPreceding if lo is None else lo
            high = W.unboundedFollowing if hi is None else hi
            framed = w.rangeBetween(low, high) if unit == "RANGE" and low in (W.unboundedPreceding, 0) and high in (W.unboundedFollowing, 0) else w.rowsBetween(low, high)
        else:
            framed = w
        if name in ("count", "count_star"):
            return F.count(F.lit(1)).over(framed)
        x = v(args[0])
        if name == "nth_value":
            return F.nth_value(x, int(self.constant(args[1]))).over(framed)
        functions = {"sum": lambda: F.sum(x.cast("double")), "avg": lambda: F.avg(x.cast("double")), "min": lambda: F.min(x), "max": lambda: F.max(x), "first_value": lambda: F.first_value(x), "last_value": lambda: F.last_value(x)}
        if name not in functions:
            raise QueryError(f"{name} is no window function")
        return functions[name]().over(framed)


class _LocalContext(Context):
    """typed: for each argument a stand-in without the lambda's variables."""

    def __init__(self, df: DataFrame, literals: list[Any], session: Any, typed: list[tuple[Column, Column]]):
        super().__init__(df, literals, session)
        self.typed = typed

    def type(self, c: Column) -> T.DataType:
        return super().type(next((t for a, t in self.typed if a is c), c))
