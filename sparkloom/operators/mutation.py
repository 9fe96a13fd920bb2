"""Updates: each clause takes a graph and a binding table and gives a new graph. Old versions stay as they are.

The binding table of an updating clause is written once, with a number for each row: rows then act in that order, and identifiers
that are made up do not change when a part of the work is done again. Rows keep the bindings they came with.
"""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DataError, GqlSyntaxError, InvalidParameter
from ..functions.values import Value
from ..gql.tree import Change, Element, Expr, Leaf, Op
from ..plans.expressions import Expressions, identity
from ..plans.matching import Matcher
from ..plans.scope import Binding, Scope
from ..sources.graph import EdgeTable, NodeTable, PropertyGraph, common_type
from ..sources.tables import materialise

EDGE_KEY = ("$src", "$dst", "$rank")
MAX_DOCUMENT = 16 << 20
#: Levels of lists and records within a property.
MAX_DEPTH = 128


def depth(kind: T.DataType) -> int:
    if isinstance(kind, T.ArrayType):
        return 1 + depth(kind.elementType)
    return 1 + max((depth(f.dataType) for f in kind.fields), default=0) if isinstance(kind, T.StructType) else 0


def shallow(value: Value) -> Value:
    if depth(value.type) > MAX_DEPTH:
        raise DataError(f"a property has at most {MAX_DEPTH} levels")
    return value


def numbered(df: DataFrame) -> DataFrame:
    return materialise(df.withColumn("$row", F.monotonically_increasing_id()), "rows")


def some(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


class Mutator:
    def __init__(self, matcher: Matcher, max_document: int = MAX_DOCUMENT):
        self.matcher, self.graph, self.params = matcher, matcher.graph, matcher.params
        self.max_document = max_document
        self.count = 0

    def _done(self, df: DataFrame, graph: PropertyGraph) -> PropertyGraph:
        self.graph = self.matcher.graph = graph
        return graph

    # --- INSERT
    def insert(self, df: DataFrame | None, scope: Scope, clause: Change) -> tuple[DataFrame, Scope]:
        df = self.graph.spark.range(1).select() if df is None else df
        df = numbered(df)
        scope = dict(scope)
        salt = uuid.uuid4().int & 0x7FFFFFFF
        for path in clause.targets:
            df, ids = self._insert_nodes(df, scope, path, salt)
            df = self._insert_edges(df, scope, path, ids)
        return df.drop("$row"), scope

    def _props(self, scope: Scope, props) -> list[tuple[str, Value]]:
        e = Expressions(scope, self.params)
        return [(k, v) for k, v in ((k, shallow(e.value(x))) for k, x in props) if v.kind != "null"]

    def _insert_nodes(self, df, scope: Scope, path: tuple[Element, ...], salt: int):
        ids: list[Column] = []
        for k, pat in enumerate(path[::2]):
            if pat.var in scope:
                if scope[pat.var].kind != "node":
                    raise GqlSyntaxError(f"{pat.var} is no node")
                ids.append(scope[pat.var].column("$id"))
                continue
            labels = insert_labels(pat.labels)
            props = self._props(scope, pat.given)
            var = pat.var or f"$i{uuid.uuid4().hex[:12]}"
            given = dict(props).get("id")
            if given is not None and given.kind != "int":
                raise DataError("the id of a node is an integer and not negative")
            made = F.xxhash64(F.col("$row"), F.lit(salt), F.lit(k), F.lit(var)).bitwiseAND(F.lit((1 << 63) - 1).cast("long"))
            columns = {f"{var}$id": made if given is None else given.col, f"{var}$labels": F.array(*map(F.lit, labels)).cast("array<string>")}
            columns |= {f"{var}$p${key}": v.col for key, v in props}
            df = materialise(df.withColumns(columns), "inserted")
            b = scope[var] = Binding("node", var, tuple((key, v.type) for key, v in props))
            ids.append(b.column("$id"))
            table = df.select(b.column("$id").alias("$id"), *[b.prop(key).alias(key) for key, _ in b.props])
            self._guard(table, [key for key, _ in b.props])
            if some(table.where("`$id` is null or `$id` < 0")):
                raise DataError("the id of a node is an integer and not negative")
            if some(table.groupBy("$id").count().where("count > 1")) or some(table.join(self.graph.scan_nodes(None, []).select("$id"), "$id", "left_semi")):
                raise DataError("a node with this id exists")
            self.count += table.count()
            self._done(df, self.graph.replaced(nodes=(*self.graph.nodes, NodeTable(table, labels))))
        return df, ids

    def _guard(self, table: DataFrame, props: list[str]) -> None:
        """A node's or edge's properties have a bounded size when written out."""
        if props and some(table.where(F.octet_length(F.to_json(F.struct(*[F.col(f"`{p}`") for p in props]))) > self.max_document)):
            raise DataError(f"properties of over {self.max_document} bytes")

    def _insert_edges(self, df, scope: Scope, path: tuple[Element, ...], ids: list[Column]):
        for k, pat in enumerate(path[1::2]):
            if not isinstance(pat.labels, Leaf):
                raise GqlSyntaxError("an inserted edge has one type")
            if pat.hops is not None or pat.way == "any":
                raise GqlSyntaxError("an inserted edge has a direction and no quantifier")
            src, dst = (ids[k], ids[k + 1]) if pat.way == "out" else (ids[k + 1], ids[k])
            props = self._props(scope, pat.given)
            var = pat.var or f"$i{uuid.uuid4().hex[:12]}"
            made = df.withColumns({f"{var}$src": src, f"{var}$dst": dst, f"{var}$type": F.lit(pat.labels.value), **{f"{var}$p${key}": v.col for key, v in props}})
            there = self.graph.scan_edges(pat.labels, []).groupBy("$src", "$dst").agg(F.max("$rank").alias("$top"))
            on = (F.col(f"`{var}$src`") == F.col("`$src`")) & (F.col(f"`{var}$dst`") == F.col("`$dst`"))
            before = F.row_number().over(Window.partitionBy(f"{var}$src", f"{var}$dst").orderBy("$row"))
            made = made.join(there, on, "left").withColumn(f"{var}$rank", (F.coalesce("$top", F.lit(-1)) + before).cast("long")).drop("$src", "$dst", "$top")
            df = materialise(made, "inserted")
            b = Binding("edge", var, tuple((key, v.type) for key, v in props))
            if pat.var:
                scope[var] = b
            table = df.select(b.column("$src").alias("$src"), b.column("$dst").alias("$dst"), b.column("$rank").alias("$rank"), *[b.prop(key).alias(key) for key, _ in b.props])
            self._guard(table, [key for key, _ in b.props])
            self._ends(table)
            self.count += table.count()
            self._done(df, self._with_edges(table, pat.labels.value))
        return df

    def _with_edges(self, table: DataFrame, type: str) -> PropertyGraph:
        # that a node has one edge of this type at most was told of the edges so far
        told = tuple(replace(t, src_single=False, dst_single=False) if t.type == type else t for t in self.graph.edges)
        return self.graph.replaced(edges=(*told, EdgeTable(table, type)))

    def _ends(self, table: DataFrame) -> None:
        nodes = self.graph.scan_nodes(None, []).select("$id")
        ends = table.select(F.explode(F.array("$src", "$dst")).alias("$id"))
        if some(ends.where("`$id` is null")) or some(ends.join(nodes, "$id", "left_anti")):
            raise DataError("an end of the edge does not exist")

    def bulk_edges(self, edges: DataFrame, type: str) -> PropertyGraph:
        """Edges $src, $dst, $rank and properties at once: ends are checked once, and none may exist already."""
        self._ends(edges)
        if some(edges.groupBy(*EDGE_KEY).count().where("count > 1")) or some(edges.join(self.graph.scan_edges(Leaf("label", type), []).select(*EDGE_KEY), list(EDGE_KEY), "left_semi")):
            raise DataError("an edge of this type, ends and rank exists")
        table = materialise(edges, "bulk")
        self.count += table.count()
        return self._done(table, self._with_edges(table, type))

    # --- SET and REMOVE
    def set(self, df: DataFrame, scope: Scope, targets, labels=None, remove: bool = False) -> None:
        """Values are those before the clause. The writes of a clause to one variable's properties are one table of updates, joined to
        the tables that can hold its elements: labels are those that the variable was matched with."""
        df = numbered(df)
        for name in dict.fromkeys(t[0] for t in targets):
            if name not in scope:
                raise GqlSyntaxError(f"unbound variable {name}")
            b = scope[name]
            if b.kind not in ("node", "edge"):
                raise DataError(f"{name} is no node or edge")
            own = [t for t in targets if t[0] == name]
            here = (labels or {}).get(name)
            fields = [t for t in own if t[1] != "label"]
            if fields:
                self._values(df, scope, b, fields, remove, here)
            for _, _, label, _ in (t for t in own if t[1] == "label"):
                if b.kind == "edge":
                    raise DataError("an edge has one type for good")
                self._labels(df.where(b.column("$id").isNotNull()), b, label, remove, here)

    def _tables(self, b: Binding, labels: Expr | None):
        """The tables in which the elements of a variable can stand, by their place."""
        tables = self.graph.nodes if b.kind == "node" else self.graph.edges
        able = [id(t) for t in (self.graph.node_tables(labels) if b.kind == "node" else self.graph.edge_tables(labels))]
        return tables, [id(t) in able for t in tables]

    def _written(self, scope: Scope, b: Binding, part: str, key, expr, remove: bool):
        """What one item writes: {property: value}, and whether all others go."""
        nothing = Value(F.lit(None).cast("string"), T.NullType())
        if part == "field":
            return {key: nothing if remove else shallow(Expressions(scope, self.params).value(expr))}, False
        value = shallow(Expressions(scope, self.params).value(expr))
        if value.kind != "record":
            raise DataError("all properties are set from a record")
        return {f.name: Value(value.col.getField(f.name), f.dataType) for f in value.type.fields if f.name != "$"}, True

    def _values(self, df, scope: Scope, b: Binding, items, remove: bool, labels) -> None:
        fields: dict[str, Value] = {}
        whole = False
        for _, part, key, expr in items:
            more, all_go = self._written(scope, b, part, key, expr, remove)
            fields, whole = ({} if all_go else fields) | more, whole or all_go
        # where rows write one property of an element several times the last row's value stays
        parts = identity(b)
        named = {k: f"$new{i}" for i, k in enumerate(fields)}
        rows = df.where(b.column(parts[0]).isNotNull())
        new = F.struct(F.lit(True).alias("$hit"), *[v.col.alias(named[k]) for k, v in fields.items()])
        rows = rows.select(*[b.column(p).alias(p) for p in parts], "$row", new.alias("$new"))
        last = materialise(rows.groupBy(*parts).agg(F.max_by("$new", "$row").alias("$new"), F.count(F.lit(1)).alias("$n")).select(*parts, "$new.*", "$n"), "updates")
        self.count += (last.agg(F.sum("$n").alias("n")).first().n or 0) * len(items)
        tables, able = self._tables(b, labels)
        fresh = tuple(self._updated(t, last.drop("$n"), b, fields, named, whole) if there else t for t, there in zip(tables, able, strict=True))
        self._done(df, self.graph.replaced(**{"nodes" if b.kind == "node" else "edges": fresh}))

    def _updated(self, table, updates: DataFrame, b: Binding, fields: dict[str, Value], named: dict[str, str], whole: bool):
        own = table.props
        if b.kind == "edge":
            updates = updates.where(F.col("$type") == table.type).drop("$type")
        keys = list(EDGE_KEY) if b.kind == "edge" else ["$id"]
        if not whole and all(isinstance(v.type, T.NullType) and k not in own for k, v in fields.items()):
            return table
        hit = F.col("$hit").isNotNull()
        columns = [F.col(f"`{c}`") for c in table.df.columns if c.startswith("$")]
        changed = []
        for k in [*own, *[k for k in fields if k not in own]]:
            if k in fields:
                kind = common_type([own.get(k, T.NullType()), fields[k].type])
                if isinstance(kind, T.NullType):
                    continue
                old = F.col(f"`{k}`").cast(kind) if k in own else F.lit(None).cast(kind)
                fresh = F.lit(None).cast(kind) if isinstance(fields[k].type, T.NullType) else F.col(f"`{named[k]}`").cast(kind)
                columns.append(F.when(hit, fresh).otherwise(old).alias(k))
                changed.append(k)
            else:
                columns.append(F.when(~hit, F.col(f"`{k}`")).alias(k) if whole else F.col(f"`{k}`"))
        # written, so that later statements read a table and not a chain of joins
        out = materialise(table.df.join(updates, keys, "left").select(*columns, hit.alias("$changed")), "updated")
        self._guard(out.where("`$changed`"), changed)
        return replace(table, df=out.drop("$changed"), **({"route": None} if b.kind == "node" and table.route and table.route.column in fields else {}))

    def _labels(self, df, b: Binding, label: str, remove: bool, labels) -> None:
        targets = materialise(df.groupBy(b.column("$id").alias("$id")).agg(F.count(F.lit(1)).alias("$n")).withColumn("$hit", F.lit(True)), "updates")
        self.count += targets.agg(F.sum("$n").alias("n")).first().n or 0
        targets, fresh = targets.drop("$n"), []
        for t, there in zip(*self._tables(b, labels), strict=True):
            if not there or (t.labels is not None and (label in t.labels) != remove):
                fresh.append(t)
                continue
            now = t.labels_column()
            changed = F.array_remove(now, label) if remove else F.array_sort(F.array_union(now, F.array(F.lit(label))))
            joined = t.df.withColumn("$labels", now).join(targets, "$id", "left")
            made = joined.withColumn("$labels", F.when(F.col("$hit"), changed if t.labels is None else _relabel(t.labels, label, remove)).otherwise(F.col("$labels"))).drop("$hit")
            fresh.append(NodeTable(materialise(made, "relabelled"), None, t.route))
        # what was told of the labels at the ends of edges may no longer hold
        edges = tuple(replace(t, src_labels=None, dst_labels=None) for t in self.graph.edges)
        self._done(df, self.graph.replaced(nodes=tuple(fresh), edges=edges))

    # --- DELETE
    def delete(self, df: DataFrame, scope: Scope, clause: Change) -> None:
        for var in clause.targets:
            if var not in scope:
                raise GqlSyntaxError(f"unbound variable {var}")
        # edges go before nodes, so that DELETE e, n can take both
        chosen = [scope[v] for v in clause.targets]
        for b in (b for b in chosen if b.kind == "edge"):
            self._delete_edges(df, b)
        nodes = [df.select(b.column("$id").alias("$id")).where("`$id` is not null") for b in chosen if b.kind == "node"]
        if nodes:
            self._delete_nodes(materialise(reduce(DataFrame.unionByName, nodes).distinct(), "deleted"), clause.action == "detach")

    def _delete_edges(self, df, b: Binding) -> None:
        targets = materialise(df.select(*[b.column(p).alias(p) for p in identity(b)]).where("`$src` is not null").distinct(), "deleted")
        fresh = []
        for t in self.graph.edges:
            own = targets.where(F.col("$type") == t.type).drop("$type")
            self.count += t.df.join(own, list(EDGE_KEY), "left_semi").count()
            fresh.append(replace(t, df=t.df.join(own, list(EDGE_KEY), "left_anti")))
        self._done(df, self.graph.replaced(edges=tuple(fresh)))

    def incident(self, ids: DataFrame) -> DataFrame:
        """Edges with an end in ids ($id); a loop stands once."""
        edges = self.graph.scan_edges(None, [])
        at = lambda end: edges.join(ids.withColumnRenamed("$id", end), end, "left_semi").select(*edges.columns)
        return at("$src").unionByName(at("$dst")).distinct()

    def _delete_nodes(self, ids: DataFrame, detach: bool) -> int:
        touched = self.incident(ids)
        removed = 0
        if detach:
            removed = touched.count()
            off = lambda df, end: df.join(ids.withColumnRenamed("$id", end), end, "left_anti")
            edges = tuple(replace(t, df=off(off(t.df, "$src"), "$dst")) for t in self.graph.edges)
            self._done(ids, self.graph.replaced(edges=edges))
        elif some(touched):
            raise DataError("the node has edges; DETACH DELETE takes them along")
        self.count += self.graph.scan_nodes(None, []).join(ids, "$id", "left_semi").count()
        self._done(ids, self.graph.replaced(nodes=tuple(replace(t, df=t.df.join(ids, "$id", "left_anti")) for t in self.graph.nodes)))
        return removed


def _relabel(labels, label: str, remove: bool) -> Column:
    now = sorted(set(labels) - {label} if remove else {*labels, label})
    return F.array(*map(F.lit, now)).cast("array<string>")


def insert_labels(expr: Expr | None) -> tuple[str, ...]:
    if expr is None:
        return ()
    if isinstance(expr, Leaf):
        return (expr.value,)
    if expr.name == "&":
        return tuple(sorted({x for a in expr.args for x in insert_labels(a)}))
    raise GqlSyntaxError("an inserted node has labels joined by &")


def document_limit(size: int) -> int:
    """A limit for properties that was asked for, if it is allowed."""
    if not 0 < size <= 256 << 20:
        raise InvalidParameter("the limit is from 1 byte to 256 MiB")
    return size
