"""CREATE, MERGE, SET and DELETE as new versions of the catalog's tables.

An update clause first writes the rows it has matched, so that all it does follows from the same rows. Each table
that it changes becomes one new written table; nothing is changed in place, and a statement that fails leaves the
catalog as it was (the session restores it). Relationships have no key: where one is to be changed or deleted, its
table gets a row id (``_rid``) before the pattern is matched.

Decided here: missing properties are null. Keys are unique and not null; what breaks that raises. If several rows
give one property of one node or relationship different values, the greatest stays. A changed key moves the
node's relationships along; a deleted node takes its relationships with it, detached or not. MERGE merges node by
node, then relationship by relationship: each is matched on all its given properties (null equals null), or
created once for all rows that give the same values; ON CREATE is for rows for which anything was created, ON MATCH
for the others.
"""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelagraph.catalog import NodeTable
from pelagraph.plans.parser import Clause, E, Expr, NodePattern, QueryError, RelPattern
from pelagraph.storage import cut

if TYPE_CHECKING:
    from pelagraph.plans.lowering import Lowering, State


# ---------------------------------------------------------------- pieces
def _with(s: State, df: DataFrame, scope: dict | None = None) -> State:
    from pelagraph.plans.lowering import State

    return State(df, {**s.scope, **(scope or {})}, False, s.carry)


def _fixed(s: State) -> State:
    """The state's rows, written."""
    return _with(s, cut(s.df, "rows")) if s.df.columns else s


def _typed(lo: Lowering, s: State, props: list[tuple[str, Expr]], like: DataFrame) -> dict[str, Column]:
    types = {f.name: f.dataType for f in like.schema}
    if unknown := [k for k, _ in props if k not in types or k in ("_src", "_dst", "_rid")]:
        raise QueryError(f"no property {unknown[0]}")
    return {k: lo.value(s, e).cast(types[k]) for k, e in props}


def _append(table: DataFrame, rows: DataFrame) -> DataFrame:
    return cut(table.unionByName(rows, allowMissingColumns=True).select(*table.columns), "table")


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _check_keys(t: NodeTable, new: DataFrame) -> None:
    """new: rows to be added; keys that are null, repeated or there already raise."""
    key = F.col(f"`{t.key}`")
    if new.where(key.isNull()).limit(1).count():
        raise QueryError(f"a node of {t.label} needs its key {t.key}")
    again = new.groupBy(key.alias("k")).count().where("count > 1").select("k")
    there = new.select(key.alias("k")).join(t.df.select(key.alias("k")), "k", "left_semi")
    if (twice := again.unionByName(there).first()) is not None:
        raise QueryError(f"{t.label} would have the key {twice[0]} twice")


def _add_nodes(lo: Lowering, label: str, new: DataFrame) -> None:
    new = cut(new, "new")
    t = lo.catalog.node(label)
    _check_keys(t, new)
    lo.catalog.replace_node(label, _append(t.df, new))


def _one_label(n: NodePattern) -> str:
    if len(n.labels) != 1:
        raise QueryError("a node to be created needs one label")
    return n.labels[0]


def _pair(lo: Lowering, s: State, r: RelPattern, a: NodePattern, b: NodePattern) -> int:
    if len(r.types) != 1 or r.hops:
        raise QueryError("a relationship to be created needs one type")
    ends = s.scope[a.var].labels, s.scope[b.var].labels
    for i, pair in enumerate(lo.catalog.rel(r.types[0]).pairs):
        if ((pair.source,), (pair.target,)) == ends:
            return i
    raise QueryError(f"{r.types[0]} does not go from {ends[0]} to {ends[1]}")


def _ends(parts: list, i: int) -> tuple[NodePattern, RelPattern, NodePattern]:
    a, r, b = parts[i - 1 : i + 2]
    return (b, r, a) if r.direction == "in" else (a, r, b)


# ---------------------------------------------------------------- CREATE
def create(lo: Lowering, s: State, c: Clause) -> State:
    s = _fixed(s)
    for p in c.patterns:
        for n in p.parts[::2]:
            n.var = n.var or f"_v{next(lo.fresh)}"
            if n.var not in s.scope:
                s = _create_node(lo, s, n)
        for i in range(1, len(p.parts), 2):
            s = _create_rel(lo, s, *_ends(p.parts, i))
        if p.var:
            s = lo.path_value(s, p.var, [("rel" if i % 2 else "node", x.var) for i, x in enumerate(p.parts)])
    return s


def _create_node(lo: Lowering, s: State, n: NodePattern) -> State:
    from pelagraph.plans.lowering import Bound

    t = lo.catalog.node(_one_label(n))
    values = _typed(lo, s, n.props, t.df)
    if t.key not in values:
        raise QueryError(f"a created {t.label} needs its key {t.key}")
    _add_nodes(lo, t.label, s.df.select(*(v.alias(k) for k, v in values.items())))
    columns = [p for p in t.properties if p in values or p in lo.wants(n.var, t.properties)]
    none = {f.name: F.lit(None).cast(f.dataType) for f in t.df.schema}
    df = s.df.select("*", values[t.key].alias(f"{n.var}___id"), *(values.get(p, none[p]).alias(f"{n.var}__{p}") for p in columns))
    return _with(s, df, {n.var: Bound("node", n.var, (t.label,), tuple(columns))})


def _create_rel(lo: Lowering, s: State, a: NodePattern, r: RelPattern, b: NodePattern) -> State:
    name, i = r.types[0] if r.types else "", _pair(lo, s, r, a, b)
    r.var = r.var or f"_r{next(lo.fresh)}"
    if r.var in lo.identified:
        lo.catalog.identify(name)
    pair = lo.catalog.rel(name).pairs[i]
    values = _typed(lo, s, r.props, pair.df)
    s = _bind_rel(s, r.var, name, pair.df, values, s.scope[a.var].col("_id"), s.scope[b.var].col("_id"), F.expr("uuid()"))
    if s.scope[r.var].ident:
        s = _fixed(s)
    bound = s.scope[r.var]
    new = s.df.select(*(bound.col(x).alias(x) for x in ("_src", "_dst", *(["_rid"] if bound.ident else []), *bound.columns)))
    lo.catalog.replace_pair(name, i, _append(pair.df, new))
    return s


def _bind_rel(s: State, var: str, name: str, like: DataFrame, values: dict[str, Column], src: Column, dst: Column, rid: Column) -> State:
    from pelagraph.plans.lowering import Bound

    bound = Bound("rel", var, (name,), tuple(f.name for f in like.schema if f.name not in ("_src", "_dst", "_rid")), "_rid" in like.columns)
    none = {f.name: F.lit(None).cast(f.dataType) for f in like.schema}
    cols = [src.alias(f"{var}___src"), dst.alias(f"{var}___dst"), F.lit(name).alias(f"{var}___type")]
    cols += [rid.alias(f"{var}___rid")] if bound.ident else []
    return _with(s, s.df.select("*", *cols, *(values.get(p, none[p]).alias(f"{var}__{p}") for p in bound.columns)), {var: bound})


# ---------------------------------------------------------------- MERGE
def merge(lo: Lowering, s: State, c: Clause) -> State:
    parts = c.pattern.parts
    made = f"_made{next(lo.fresh)}"
    s = _with(s, s.df.withColumn(made, F.lit(False)))
    s = _fixed(s)
    for n in parts[::2]:
        n.var = n.var or f"_v{next(lo.fresh)}"
        if n.var not in s.scope:
            s = _merge_node(lo, s, n, made)
    for i in range(1, len(parts), 2):
        s = _merge_rel(lo, s, *_ends(parts, i), made)
    if c.on_create:
        s = _assign(lo, s, c.on_create, F.col(made))
    if c.on_match:
        s = _assign(lo, s, c.on_match, ~F.col(made))
    s = _with(s, s.df.drop(made))
    return lo.path_value(s, c.pattern.var, [("rel" if i % 2 else "node", x.var) for i, x in enumerate(parts)]) if c.pattern.var else s


def _merge_node(lo: Lowering, s: State, n: NodePattern, made: str) -> State:
    from pelagraph.plans.lowering import Bound

    t = lo.catalog.node(_one_label(n))
    values = _typed(lo, s, n.props, t.df)
    if not values:
        raise QueryError("MERGE of a node needs a property")
    df = s.df.select("*", *(v.alias(f"_w_{k}") for k, v in values.items()))
    if t.key in values and df.where(F.col(f"_w_{t.key}").isNull()).limit(1).count():
        raise QueryError("MERGE with a null key")
    columns = [p for p in t.properties if p in values or p in lo.wants(n.var, t.properties)]
    there = t.df.select(F.col(f"`{t.key}`").alias(f"{n.var}___id"), *(F.col(f"`{p}`").alias(f"{n.var}__{p}") for p in columns))
    same = _all([F.col(f"_w_{k}").eqNullSafe(F.col(f"`{n.var}__{k}`")) for k in values])
    df = df.join(there, same, "left")
    lost = F.col(f"`{n.var}___id`").isNull()
    new = cut(df.where(lost).select(*(F.col(f"_w_{k}").alias(k) for k in values)).distinct(), "new")
    if not new.isEmpty():
        if t.key not in values:
            raise QueryError(f"MERGE creates a {t.label}, which needs its key {t.key}")
        _add_nodes(lo, t.label, new)
        key = F.col(f"_w_{t.key}")
        given = [F.when(lost, F.col(f"_w_{p}")).otherwise(F.col(f"`{n.var}__{p}`")).alias(f"{n.var}__{p}") for p in columns if p in values]
        others = [F.col(f"`{n.var}__{p}`") for p in columns if p not in values]
        rest = [F.col(f"`{x}`") for x in s.df.columns if x != made]
        df = df.select(*rest, (F.col(made) | lost).alias(made), F.coalesce(F.col(f"`{n.var}___id`"), key).alias(f"{n.var}___id"), *given, *others)
    else:
        df = df.drop(*(f"_w_{k}" for k in values))
    return _fixed(_with(s, df, {n.var: Bound("node", n.var, (t.label,), tuple(columns))}))


def _merge_rel(lo: Lowering, s: State, a: NodePattern, r: RelPattern, b: NodePattern, made: str) -> State:
    name, i = r.types[0] if r.types else "", _pair(lo, s, r, a, b)
    r.var = r.var or f"_r{next(lo.fresh)}"
    if r.var in s.scope:
        raise QueryError(f"relationship {r.var} is bound already")
    lo.catalog.identify(name)
    pair = lo.catalog.rel(name).pairs[i]
    values = _typed(lo, s, r.props, pair.df)
    src, dst = s.scope[a.var].col("_id"), s.scope[b.var].col("_id")
    df = s.df.select("*", src.alias("_ws"), dst.alias("_wd"), *(v.alias(f"_w_{k}") for k, v in values.items()))
    asked = ["_ws", "_wd", *(f"_w_{k}" for k in values)]
    there = pair.df.select(*(F.col(f"`{x}`").alias(f"_e_{x}") for x in pair.df.columns))
    same = _all([F.col("_ws") == F.col("_e__src"), F.col("_wd") == F.col("_e__dst"), *(F.col(f"_w_{k}").eqNullSafe(F.col(f"_e_{k}")) for k in values)])
    df = cut(df.join(there, same, "left"), "rows")
    new = df.where("_e__rid is null and _ws is not null and _wd is not null").select(*asked).distinct()
    new = cut(new.withColumn("_n_rid", F.expr("uuid()")), "new")
    if not new.isEmpty():
        rows = new.select(F.col("_ws").alias("_src"), F.col("_wd").alias("_dst"), F.col("_n_rid").alias("_rid"), *(F.col(f"_w_{k}").alias(k) for k in values))
        lo.catalog.replace_pair(name, i, _append(pair.df, rows))
    new = new.select(*(F.col(x).alias(f"_k{x}") for x in asked), "_n_rid")
    df = df.join(new, _all([F.col("_e__rid").isNull(), *(F.col(x).eqNullSafe(F.col(f"_k{x}")) for x in asked)]), "left")
    lost = F.col("_n_rid").isNotNull()
    now = {p: F.when(lost, F.col(f"_w_{p}")).otherwise(F.col(f"_e_{p}")) if p in values else F.col(f"_e_{p}") for p in pair.properties}
    out = _bind_rel(_with(s, df), r.var, name, pair.df, now, F.col("_ws"), F.col("_wd"), F.coalesce("_e__rid", "_n_rid"))
    bound = out.scope[r.var]
    rest = [F.col(f"`{x}`") for x in s.df.columns if x != made]
    df = out.df.select(*rest, (F.col(made) | lost).alias(made), *(F.col(f"`{x}`") for x in bound.all_columns()))
    return _fixed(_with(s, df, {r.var: bound}))


# ---------------------------------------------------------------- SET
def set_properties(lo: Lowering, s: State, c: Clause) -> State:
    return _assign(lo, _fixed(s), c.items, F.lit(True))


def _tables(lo: Lowering, s: State, var: str) -> list[DataFrame]:
    b = s.scope.get(var)
    if b is None or b.kind not in ("node", "rel"):
        raise QueryError(f"SET and DELETE need a matched node or relationship, not {var}")
    return [lo.catalog.node(x).df for x in b.labels] if b.kind == "node" else [p.df for x in b.labels for p in lo.catalog.rel(x).pairs]


def _bag(lo: Lowering, s: State, var: str, mode: str, e: Expr) -> list[tuple[str, Expr | None]]:
    """SET v = {...} gives every other property null, but the key; SET v += {...} leaves them."""
    b = s.scope[var]
    keys = {lo.catalog.node(x).key for x in b.labels} if b.kind == "node" else {"_src", "_dst", "_rid"}
    if e.kind == "struct":
        given = dict(e.items)
    elif e.kind == "param" and isinstance(lo.constant(e), dict):
        given = {k: E("lit", value=v) for k, v in lo.constant(e).items()}
    else:
        t = s.df.select(lo.value(s, e).alias("x")).schema[0].dataType
        if not isinstance(t, T.StructType):
            raise QueryError(f"SET {var} needs a struct")
        given = {f.name: E("prop", of=e, name=f.name) for f in t if not f.name.startswith("_")}
    names = list(dict.fromkeys(f.name for df in _tables(lo, s, var) for f in df.schema if f.name not in keys))
    if unknown := [k for k in given if k not in names and k not in keys]:
        raise QueryError(f"no property {unknown[0]}")
    given = {k: x for k, x in given.items() if k not in keys}
    return list(given.items()) if mode == "+=" else [(k, given.get(k)) for k in names]


def _assign(lo: Lowering, s: State, items: list[tuple[str, str, Expr]], flag: Column) -> State:
    """items, in order: (variable, property, value) or (variable, '=' or '+=', bag), for the rows where flag holds."""
    changed: dict[str, dict[str, str]] = {}
    df = s.df
    for var, prop, e in items:
        tables = _tables(lo, s, var)
        b = s.scope[var]
        for name, x in _bag(lo, s, var, prop, e) if prop in ("=", "+=") else [(prop, e)]:
            kind = next((t.schema[name].dataType for t in tables if name in t.columns and name not in ("_src", "_dst", "_rid")), None)
            if kind is None:
                raise QueryError(f"{var} has no property {name}")
            now = _with(s, df)
            value = lo.value(now, x).cast(kind) if x is not None else F.lit(None).cast(kind)
            to = changed.setdefault(var, {}).setdefault(name, f"_new{next(lo.fresh)}")
            key = b.kind == "node" and any(lo.catalog.node(y).key == name for y in b.labels)
            if key and f"_old_{var}" not in df.columns:
                df = df.withColumn(f"_old_{var}", b.col("_id"))
            df = df.withColumn(to, F.when(flag, value))
            seen = [f"{b.name}__{name}"] * (name in b.columns) + [f"{b.name}___id"] * key
            for y in seen:
                df = df.withColumn(y, F.when(flag, F.col(to)).otherwise(F.col(f"`{y}`")))
    df = cut(df, "rows")
    for var, props in changed.items():
        b = s.scope[var]
        if b.kind == "node":
            _change_nodes(lo, df.where(flag), b, f"_old_{var}" if f"_old_{var}" in df.columns else f"{b.name}___id", props)
        else:
            _change_rels(lo, df.where(flag), b, props)
    return _with(s, df.drop(*(x for props in changed.values() for x in props.values()), *(f"_old_{v}" for v in changed)))


def _replaced(table: DataFrame, by: str, rows: DataFrame, props: dict[str, str]) -> DataFrame:
    """table with the props of rows (_sid and new values), found by its column by."""
    props = {p: n for p, n in props.items() if p in table.columns}
    new = rows.where("_sid is not null").groupBy("_sid").agg(*(F.max(n).alias(n) for n in props.values()))
    df = table.join(new, F.col(f"`{by}`").cast(new.schema["_sid"].dataType) == F.col("_sid"), "left")
    hit = F.col("_sid").isNotNull()
    return cut(df.select(*(F.when(hit, F.col(props[x])).otherwise(F.col(f"`{x}`")).alias(x) if x in props else F.col(f"`{x}`") for x in table.columns)), "table")


def _change_nodes(lo: Lowering, rows: DataFrame, b, old: str, props: dict[str, str]) -> None:
    for label in b.labels:
        t = lo.catalog.node(label)
        if not set(props) & set(t.properties):
            continue
        mine = rows.where(b.col("_label") == label) if len(b.labels) != 1 else rows
        mine = mine.select(F.col(f"`{old}`").alias("_sid"), *props.values())
        df = _replaced(t.df, t.key, mine, props)
        if t.key in props:
            again = df.groupBy(F.col(f"`{t.key}`").alias("k")).count().where("count > 1 or k is null").first()
            if again is not None:
                raise QueryError(f"{label} would have the key {again[0]} twice" if again[0] is not None else f"{label} needs its key")
            moved = mine.groupBy(F.col("_sid").alias("_from")).agg(F.max(props[t.key]).alias("_to"))
            _move_ends(lo, label, moved.where("_from is not null"))
        lo.catalog.replace_node(label, df)


def _move_ends(lo: Lowering, label: str, moved: DataFrame) -> None:
    for name, rel in list(lo.catalog.rels.items()):
        for i, pair in enumerate(rel.pairs):
            df = pair.df
            for end, at in ((pair.source, "_src"), (pair.target, "_dst")):
                if end == label:
                    df = df.join(moved, F.col(at) == F.col("_from"), "left").withColumn(at, F.coalesce("_to", at)).select(*pair.df.columns)
            if df is not pair.df:
                lo.catalog.replace_pair(name, i, cut(df, "table"))


def _change_rels(lo: Lowering, rows: DataFrame, b, props: dict[str, str]) -> None:
    mine = rows.select(b.col("_rid").alias("_sid"), *props.values())
    for name in b.labels:
        for i, pair in enumerate(lo.catalog.rel(name).pairs):
            if set(props) & set(pair.properties):
                lo.catalog.replace_pair(name, i, _replaced(pair.df, "_rid", mine, props))


# ---------------------------------------------------------------- DELETE
def delete(lo: Lowering, s: State, c: Clause) -> State:
    s = _fixed(s)
    for var in c.vars:
        _tables(lo, s, var)
        b = s.scope[var]
        if b.kind == "rel":
            gone = s.df.select(b.col("_rid").alias("_gone")).distinct()
            for name in b.labels:
                for i, pair in enumerate(lo.catalog.rel(name).pairs):
                    lo.catalog.replace_pair(name, i, cut(pair.df.join(gone, F.col("_rid") == F.col("_gone"), "left_anti"), "table"))
            continue
        for label in b.labels:
            t = lo.catalog.node(label)
            mine = s.df.where(b.col("_label") == label) if len(b.labels) != 1 else s.df
            gone = cut(mine.select(b.col("_id").cast(t.df.schema[t.key].dataType).alias("_gone")).where("_gone is not null").distinct(), "gone")
            lo.catalog.replace_node(label, cut(t.df.join(gone, F.col(f"`{t.key}`") == F.col("_gone"), "left_anti"), "table"))
            for name, rel in list(lo.catalog.rels.items()):
                for i, pair in enumerate(rel.pairs):
                    df = pair.df
                    for end, at in ((pair.source, "_src"), (pair.target, "_dst")):
                        if end == label:
                            df = df.join(gone, F.col(at) == F.col("_gone"), "left_anti")
                    if df is not pair.df:
                        lo.catalog.replace_pair(name, i, cut(df, "table"))
    return s
