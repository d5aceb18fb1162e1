"""The session: a catalog of tables and the ways to query it.

``cypher(text, parameters)`` takes one statement and returns a DataFrame. Besides queries and updates:
CREATE/DROP/ALTER of node and relationship tables, COPY FROM and TO, LOAD FROM, CREATE MACRO, ATTACH/DETACH,
BEGIN/COMMIT/ROLLBACK (catalog snapshots), INSTALL/LOAD EXTENSION (modules are always there) and
``CALL option = value``.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelagraph.catalog import Catalog, Macro, RelTable
from pelagraph.functions import SCALARS
from pelagraph.functions.casts import cast as cast_to
from pelagraph.functions.casts import spark_type
from pelagraph.functions.registry import Context
from pelagraph.plans.lowering import Lowering
from pelagraph.plans.parser import Parser, QueryError, parse
from pelagraph.sources import readers, sinks
from pelagraph.storage import importable


class GraphSession:
    def __init__(self, spark: SparkSession):
        self.spark, self.catalog = spark, Catalog()
        importable(spark)
        self.settings: dict[str, Any] = {}
        self.sequences: dict[str, int] = {}
        self.attached: dict[str, tuple[str, str]] = {}
        self.scalar_functions: dict[str, Callable[..., Column]] = {}
        self.table_functions: dict[str, Callable[..., DataFrame]] = {}
        self.indexes: dict[str, Any] = {}
        self.extensions: set[str] = set()
        self.warnings: list[str] = []
        self.provider: Any = None
        self._saved: Catalog | None = None
        self._pool: ThreadPoolExecutor | None = None

    # ------------------------------------------------------------ tables
    def node_table(self, label: str, df: DataFrame, key: str) -> GraphSession:
        self.catalog.add_node(label, df, key)
        return self

    def rel_table(self, name: str, source: str, target: str, df: DataFrame, src: str, dst: str, properties: list[str] | None = None) -> GraphSession:
        self.catalog.add_rel(name, source, target, df, src, dst, properties)
        return self

    # ------------------------------------------------------------ statements
    def cypher(self, text: str, parameters: dict[str, Any] | None = None) -> DataFrame:
        """The statement's result. Updates happen now, the reading of results later; a statement that fails changes nothing."""
        handler, m = self._statement(text.strip().rstrip(";").strip())
        before = self.catalog.snapshot()
        try:
            if handler is not None:
                return handler(self, m) if m is not None else handler(self)
            q = parse(text)
            df = Lowering(self, parameters).query(q)
            if not q.mode:
                return df
            out = self._profiled(df) if q.mode == "PROFILE" else self._explained(df)
        except BaseException:
            self.catalog = before
            raise
        if q.mode != "PROFILE":
            self.catalog = before
        return out

    query = cypher

    def prepare(self, text: str) -> Callable[..., DataFrame]:
        """The parsed statement as a function of its parameters."""
        parse(text)
        return lambda **parameters: self.cypher(text, parameters)

    def script(self, text: str) -> list[DataFrame]:
        """Statements separated by semicolons outside quotes."""
        parts = re.findall(r"(?:'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[^;])+", text)
        return [self.cypher(p) for p in parts if p.strip()]

    def submit(self, text: str, parameters: dict[str, Any] | None = None) -> Future:
        """Runs the statement and collects its rows in a thread of its own."""
        if self._pool is None:
            self._pool = ThreadPoolExecutor(4)
        return self._pool.submit(lambda: self.cypher(text, parameters).collect())

    @contextmanager
    def interruptible(self, tag: str) -> Iterator[None]:
        """Jobs started within can be stopped by interrupt(tag)."""
        self.spark.addTag(tag)
        try:
            yield
        finally:
            self.spark.removeTag(tag)

    def interrupt(self, tag: str) -> None:
        self.spark.interruptTag(tag)

    def _profiled(self, df: DataFrame) -> DataFrame:
        """Runs the query; its plan follows the number of rows and the seconds they took."""
        start = time.perf_counter()
        rows = df.count() if df.columns else 0
        head = [f"rows: {rows}", f"seconds: {time.perf_counter() - start:.3f}"]
        return self.spark.createDataFrame([(x,) for x in [*head, *(r[0] for r in self._explained(df).collect())]], "plan string")

    def _explained(self, df: DataFrame) -> DataFrame:
        text = self.spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        return self.spark.createDataFrame([(x,) for x in text.splitlines()], "plan string")

    def done(self, message: str) -> DataFrame:
        return self.spark.createDataFrame([(message,)], "result string")

    def _statement(self, text: str):
        for pattern, handler in _STATEMENTS:
            if m := pattern.match(text):
                return handler, m
        return None, None

    # ------------------------------------------------------------ table functions and files
    def call_table_function(self, name: str, args: list[Any]) -> DataFrame:
        from pelagraph.operators import calls

        f = self.table_functions.get(name.lower()) or calls.TABLE_FUNCTIONS.get(name.lower())
        if f is None:
            raise QueryError(f"unknown table function {name}")
        return f(self, *args)

    def load(self, path: str, headers: list[tuple[str, str]] | None = None) -> DataFrame:
        if path.startswith("attached:"):
            alias, table = path[len("attached:") :].split("|", 1)
            return self.attached_table(alias, table)
        return readers.read(self.spark, path, headers)

    def attached_table(self, alias: str, table: str) -> DataFrame:
        if alias not in self.attached:
            raise QueryError(f"nothing is attached as {alias}")
        path, kind = self.attached[alias]
        if kind == "postgres":
            return readers.scan_postgres(self.spark, path, table)
        if kind in ("sqlite", "duckdb"):
            return readers.read_jdbc(self.spark, f"jdbc:{kind}:{path}", table)
        return readers.read(self.spark, f"{path.rstrip('/')}/{table}.{kind}")

    # ------------------------------------------------------------ extensions of the language
    def register_scalar(self, name: str, f: Callable[..., Column]) -> None:
        """f builds a Column from Columns (a UDF is one such function)."""
        self.scalar_functions[name.lower()] = f

    def register_table(self, name: str, f: Callable[..., DataFrame]) -> None:
        """f(session, *arguments) -> DataFrame."""
        self.table_functions[name.lower()] = f

    # ------------------------------------------------------------ method chaining
    def mutate(self) -> Mutation:
        return Mutation(self)

    def match(self, pattern: str) -> Fluent:
        return Fluent(self, [f"MATCH {pattern}"])


class Fluent:
    """A query, clause by clause; nothing runs before ``frame``."""

    def __init__(self, session: GraphSession, parts: list[str], parameters: dict[str, Any] | None = None):
        self.session, self.parts, self.parameters = session, parts, parameters or {}

    def _with(self, part: str) -> Fluent:
        return Fluent(self.session, [*self.parts, part], self.parameters)

    def match(self, pattern: str) -> Fluent:
        return self._with(f"MATCH {pattern}")

    def optional(self, pattern: str) -> Fluent:
        return self._with(f"OPTIONAL MATCH {pattern}")

    def where(self, condition: str) -> Fluent:
        return self._with(f"WHERE {condition}")

    def with_(self, *items: str) -> Fluent:
        return self._with("WITH " + ", ".join(items))

    def returns(self, *items: str) -> Fluent:
        return self._with("RETURN " + ", ".join(items))

    def order_by(self, *keys: str) -> Fluent:
        return self._with("ORDER BY " + ", ".join(keys))

    def skip(self, n: int) -> Fluent:
        return self._with(f"SKIP {n}")

    def limit(self, n: int) -> Fluent:
        return self._with(f"LIMIT {n}")

    def parameter(self, name: str, value: Any) -> Fluent:
        return Fluent(self.session, self.parts, {**self.parameters, name: value})

    @property
    def text(self) -> str:
        return " ".join(self.parts)

    def frame(self) -> DataFrame:
        return self.session.cypher(self.text, self.parameters)


class Mutation:
    """Nodes and relationships collected row by row, then written to the catalog in one step each table.

    upsert_node replaces a node of the same key; upsert_rel adds a relationship unless its ends have one.
    """

    def __init__(self, session: GraphSession):
        self.session = session
        self.nodes: dict[str, dict[Any, dict[str, Any]]] = {}
        self.rels: dict[tuple[str, str, str], dict[tuple[Any, Any], dict[str, Any]]] = {}

    def upsert_node(self, label: str, **properties: Any) -> Mutation:
        t = self.session.catalog.node(label)
        if properties.get(t.key) is None:
            raise QueryError(f"{label} needs its key {t.key}")
        self.nodes.setdefault(label, {})[properties[t.key]] = properties
        return self

    def upsert_rel(self, name: str, source: tuple[str, Any], target: tuple[str, Any], **properties: Any) -> Mutation:
        self.rels.setdefault((name, source[0], target[0]), {})[(source[1], target[1])] = properties
        return self

    def apply(self) -> None:
        s = self.session
        for label, rows in self.nodes.items():
            t = s.catalog.node(label)
            new = s.spark.createDataFrame([tuple(r.get(c) for c in t.df.columns) for r in rows.values()], t.df.schema)
            s.catalog.replace_node(label, t.df.join(new.select(t.key), t.key, "left_anti").select(*t.df.columns).unionByName(new))
        for (name, a, b), rows in self.rels.items():
            i = next((i for i, p in enumerate(s.catalog.rel(name).pairs) if (p.source, p.target) == (a, b)), None)
            if i is None:
                raise QueryError(f"{name} does not go from {a} to {b}")
            old = s.catalog.rel(name).pairs[i].df
            new = s.spark.createDataFrame([tuple({"_src": k[0], "_dst": k[1], **r}.get(c) for c in old.columns) for k, r in rows.items()], old.schema)
            s.catalog.replace_pair(name, i, old.unionByName(new.join(old, ["_src", "_dst"], "left_anti").select(*old.columns)))


# ---------------------------------------------------------------- statements outside the query grammar
def _split(text: str) -> list[str]:
    """At commas outside brackets."""
    out, depth, at = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch in "([") - (ch in ")]")
        if ch == "," and depth == 0:
            out.append(text[at:i])
            at = i + 1
    return [x.strip() for x in [*out, text[at:]] if x.strip()]


def _columns(parts: list[str]) -> list[T.StructField]:
    out = []
    for p in parts:
        name, kind = p.split(None, 1)
        kind = re.sub(r"(?i)\s+(primary\s+key|default\s+.*|not\s+null)\s*", "", kind)
        out.append(T.StructField(name.strip("`"), T._parse_datatype_string(spark_type(kind))))
    return out


def _create_node(s: GraphSession, m: re.Match) -> DataFrame:
    if m["maybe"] and m["name"] in s.catalog.nodes:
        return s.done(f"table {m['name']} exists")
    parts = _split(m["body"])
    key = next((k[1].strip(" `") for p in parts if (k := re.match(r"(?i)primary\s+key\s*\(([^)]*)\)", p))), None)
    cols = [p for p in parts if not re.match(r"(?i)primary\s+key\s*\(", p)]
    key = key or next((p.split()[0].strip("`") for p in cols if re.search(r"(?i)primary\s+key", p)), None)
    if key is None:
        raise QueryError("a node table needs a primary key")
    s.catalog.add_node(m["name"], s.spark.createDataFrame([], T.StructType(_columns(cols))), key)
    return s.done(f"created node table {m['name']}")


def _create_rel(s: GraphSession, m: re.Match) -> DataFrame:
    if m["maybe"] and m["name"] in s.catalog.rels:
        return s.done(f"table {m['name']} exists")
    if m["name"] in s.catalog.rels:
        raise QueryError(f"table {m['name']} exists already")
    parts = _split(m["body"])
    ends = [x for p in parts if (x := re.match(r"(?i)from\s+(\w+)\s+to\s+(\w+)", p))]
    fields = _columns([p for p in parts if not re.match(r"(?i)from\s", p) and not re.fullmatch(r"(?i)(many|one)_(many|one)", p)])
    if not ends:
        raise QueryError("a relationship table needs FROM and TO")
    for x in ends:
        a, b = s.catalog.node(x[1]), s.catalog.node(x[2])
        schema = T.StructType([T.StructField("_src", a.df.schema[a.key].dataType), T.StructField("_dst", b.df.schema[b.key].dataType), *fields])
        s.catalog.add_rel(m["name"], x[1], x[2], s.spark.createDataFrame([], schema), "_src", "_dst")
    return s.done(f"created relationship table {m['name']}")


def _drop(s: GraphSession, m: re.Match) -> DataFrame:
    name = m["name"]
    used = [r.name for r in s.catalog.rels.values() for p in r.pairs if name in (p.source, p.target)]
    if name in s.catalog.nodes:
        if used:
            raise QueryError(f"{name} is used by {used[0]}")
        del s.catalog.nodes[name]
    elif name in s.catalog.rels:
        del s.catalog.rels[name]
    elif not m["maybe"]:
        raise QueryError(f"no table {name}")
    return s.done(f"dropped {name}")


def _alter(s: GraphSession, m: re.Match) -> DataFrame:
    name, rest = m["name"], m["rest"]

    def change(f: Callable[[DataFrame], DataFrame]) -> None:
        if name in s.catalog.nodes:
            s.catalog.replace_node(name, f(s.catalog.node(name).df))
        else:
            for i, p in enumerate(s.catalog.rel(name).pairs):
                s.catalog.replace_pair(name, i, f(p.df))

    if x := re.fullmatch(r"(?i)add\s+from\s+(\w+)\s+to\s+(\w+)", rest):
        old = s.catalog.rel(name).pairs[0]
        s.catalog.add_rel(name, x[1], x[2], old.df.limit(0), "_src", "_dst")
    elif x := re.fullmatch(r"(?i)drop\s+from\s+(\w+)\s+to\s+(\w+)", rest):
        t = s.catalog.rel(name)
        s.catalog.rels[name] = RelTable(name, tuple(p for p in t.pairs if (p.source, p.target) != (x[1], x[2])))
    elif x := re.fullmatch(r"(?i)add\s+(?:if\s+not\s+exists\s+)?(\w+)\s+(\S+)(?:\s+default\s+(.+))?", rest):
        value = Lowering(s).constant(Parser(x[3]).expression()) if x[3] else None
        change(lambda df: df.withColumn(x[1], F.lit(value).cast(spark_type(x[2]))))
    elif x := re.fullmatch(r"(?i)drop\s+(?:if\s+exists\s+)?(\w+)", rest):
        if name in s.catalog.nodes and s.catalog.node(name).key == x[1]:
            raise QueryError("the primary key cannot be dropped")
        change(lambda df: df.drop(x[1]))
    elif x := re.fullmatch(r"(?i)rename\s+to\s+(\w+)", rest):
        if name in s.catalog.nodes:
            s.catalog.nodes[x[1]] = replace(s.catalog.nodes.pop(name), label=x[1])
            for r in list(s.catalog.rels.values()):
                s.catalog.rels[r.name] = RelTable(r.name, tuple(replace(p, source=x[1] if p.source == name else p.source, target=x[1] if p.target == name else p.target) for p in r.pairs))
        else:
            s.catalog.rels[x[1]] = replace(s.catalog.rels.pop(name), name=x[1])
    elif x := re.fullmatch(r"(?i)rename\s+(\w+)\s+to\s+(\w+)", rest):
        change(lambda df: df.withColumnRenamed(x[1], x[2]))
        if name in s.catalog.nodes and s.catalog.node(name).key == x[1]:
            s.catalog.nodes[name] = replace(s.catalog.node(name), key=x[2])
    else:
        raise QueryError(f"cannot alter: {rest}")
    return s.done(f"altered {name}")


def _fit(s: GraphSession, got: DataFrame, like: DataFrame, names: list[str]) -> DataFrame:
    """got's columns cast to the types of like; what fails is null."""
    ctx = Context(got)
    cols = []
    for n in names:
        t = like.schema[n].dataType
        c = F.col(f"`{n}`")
        cols.append((c if got.schema[n].dataType == t else F.from_json(c, t) if isinstance(t, (T.ArrayType, T.StructType, T.MapType)) else cast_to(ctx, c, "timestamp") if isinstance(t, T.TimestampType) else c.try_cast(t)).alias(n))
    return got.select(*cols)


def _copy_from(s: GraphSession, m: re.Match) -> DataFrame:
    """Into a node table: its columns by name; keys that are null, repeated or there already raise. Into a relationship table: the first two columns are the ends' keys, and have to exist."""
    name, got = m["name"], s.load(m["path"])
    if name in s.catalog.nodes:
        t = s.catalog.node(name)
        if missing := [x for x in t.df.columns if x not in got.columns]:
            raise QueryError(f"{m['path']} lacks the column {missing[0]}")
        new = _fit(s, got, t.df, t.df.columns)
        both = t.df.unionByName(new)
        if new.where(F.col(t.key).isNull()).limit(1).count() or both.groupBy(t.key).count().where("count > 1").limit(1).count():
            raise QueryError(f"null or repeated keys in {m['path']}")
        s.catalog.replace_node(name, both)
        return s.done(f"copied {new.count()} rows")
    t = s.catalog.rel(name)
    if len(t.pairs) != 1:
        raise QueryError(f"{name} has several pairs of tables")
    pair = t.pairs[0]
    got = got.withColumnRenamed(got.columns[0], "_src").withColumnRenamed(got.columns[1], "_dst")
    new = _fit(s, got, pair.df, pair.df.columns)
    for end, col in ((pair.source, "_src"), (pair.target, "_dst")):
        n = s.catalog.node(end)
        if new.join(n.df, new[col] == n.df[n.key], "left_anti").limit(1).count():
            raise QueryError(f"{m['path']} names nodes that {end} does not have")
    s.catalog.replace_pair(name, 0, pair.df.unionByName(new))
    return s.done(f"copied {new.count()} rows")


def _copy_to(s: GraphSession, m: re.Match) -> DataFrame:
    sinks.write(s.cypher(m["query"]), m["path"])
    return s.done(f"written to {m['path']}")


def _macro(s: GraphSession, m: re.Match) -> DataFrame:
    params = []
    for p in _split(m["params"]):
        n, _, default = p.partition(":=")
        params.append((n.strip(), Parser(default).expression() if default.strip() else None))
    s.catalog.macros[m["name"].lower()] = Macro(m["name"], params, Parser(m["body"]).expression())
    return s.done(f"created macro {m['name']}")


def _attach(s: GraphSession, m: re.Match) -> DataFrame:
    s.attached[m["alias"]] = (m["path"], m["kind"].lower())
    return s.done(f"attached {m['alias']}")


def _detach(s: GraphSession, m: re.Match) -> DataFrame:
    if s.attached.pop(m["alias"], None) is None:
        raise QueryError(f"nothing is attached as {m['alias']}")
    return s.done(f"detached {m['alias']}")


def _transaction(s: GraphSession, m: re.Match) -> DataFrame:
    word = m["word"].upper()
    if word == "BEGIN":
        if s._saved is not None:
            raise QueryError("a transaction is open already")
        s._saved = s.catalog.snapshot()
    elif s._saved is None:
        raise QueryError("no transaction is open")
    else:
        if word == "ROLLBACK":
            s.catalog = s._saved
        s._saved = None
    return s.done(word.lower())


def _extension(s: GraphSession, m: re.Match) -> DataFrame:
    (s.extensions.discard if m["word"].upper() == "UNINSTALL" else s.extensions.add)(m["name"].lower())
    return s.done(f"{m['word'].lower()} {m['name']}")


def _option(s: GraphSession, m: re.Match) -> DataFrame:
    s.settings[m["name"]] = Lowering(s).constant(Parser(m["value"]).expression())
    return s.done(f"{m['name']} set")


def _use(s: GraphSession, m: re.Match) -> DataFrame:
    if m["alias"] not in s.attached:
        raise QueryError(f"nothing is attached as {m['alias']}")
    s.settings["database"] = m["alias"]
    return s.done(f"using {m['alias']}")


def _rx(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace(" ", r"\s+") + r"\Z", re.I | re.S)


_STATEMENTS = [
    (_rx(r"create node table (?P<maybe>if not exists )?(?P<name>\w+)\s*\((?P<body>.*)\)"), _create_node),
    (_rx(r"create rel table (?:group )?(?P<maybe>if not exists )?(?P<name>\w+)\s*\((?P<body>.*)\)"), _create_rel),
    (_rx(r"drop table (?P<maybe>if exists )?(?P<name>\w+)"), _drop),
    (_rx(r"alter table (?P<name>\w+) (?P<rest>.*)"), _alter),
    (_rx(r"copy (?P<name>\w+) from (?P<q>['\"])(?P<path>.*)(?P=q)(?:\s*\(.*\))?"), _copy_from),
    (_rx(r"copy\s*\((?P<query>.*)\)\s*to (?P<q>['\"])(?P<path>[^'\"]*)(?P=q)(?:\s*\(.*\))?"), _copy_to),
    (_rx(r"create macro (?P<name>\w+)\s*\((?P<params>.*?)\) as (?P<body>.*)"), _macro),
    (_rx(r"attach (?P<q>['\"])(?P<path>.*)(?P=q) as (?P<alias>\w+)\s*\(\s*dbtype (?P<kind>\w+).*\)"), _attach),
    (_rx(r"detach (?!delete )(?P<alias>\w+)"), _detach),
    (_rx(r"use (?P<alias>\w+)"), _use),
    (_rx(r"(?P<word>begin|commit|rollback)(?: transaction)?(?: read only)?"), _transaction),
    (_rx(r"(?P<word>install|uninstall|update|load)(?: extension)? (?!from |with )(?P<name>\w+)"), _extension),
    (_rx(r"call (?P<name>\w+)\s*=\s*(?P<value>.*)"), _option),
]

__all__ = ["SCALARS", "Fluent", "GraphSession"]
