"""The property graph: typed node and edge tables with a catalog.

A node table has $id, properties under their own names and either one set of labels for all its rows or a column $labels; an
edge table has $src, $dst, $rank and properties, and one type. Integers are 64 bits wide and floats double. A property whose
type differs between the tables of a scan is a VARIANT there.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DataError
from ..gql.tree import Expr, Leaf

NODE_FIELDS = ("$id", "$labels")
EDGE_FIELDS = ("$src", "$dst", "$rank")


def wide(df: DataFrame) -> DataFrame:
    """Integers as bigint, floats as double, local timestamps as instants."""
    cast = {T.ByteType: "long", T.ShortType: "long", T.IntegerType: "long", T.FloatType: "double", T.TimestampNTZType: "timestamp", T.DateType: "timestamp"}
    return df.select([F.col(f"`{f.name}`").cast(cast[type(f.dataType)]).alias(f.name) if type(f.dataType) in cast else F.col(f"`{f.name}`") for f in df.schema.fields])


@dataclass(frozen=True)
class Route:
    """Identifiers of a table: first + a column of it, less than first + span. A lookup by identifier then becomes one by the column,
    which reaches the file scan, and tables in whose range it does not lie are not read."""

    column: str
    first: int
    span: int

    def select(self, df: DataFrame, id: int) -> DataFrame | None:
        return df.where(F.col(f"`{self.column}`") == id - self.first) if self.first <= id < self.first + self.span else None


def _routed(df: DataFrame, route: Route | None, own: str, id: int) -> DataFrame | None:
    """The rows of one identifier; none if the table can't have it."""
    if route is not None and route.column in df.columns:
        return route.select(df, id)
    return df.where(F.col(own) == id)


@dataclass(frozen=True)
class NodeTable:
    df: DataFrame
    labels: tuple[str, ...] | None = None  # None: by row, in $labels
    route: Route | None = None

    @property
    def props(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema.fields if f.name not in NODE_FIELDS}

    def labels_column(self) -> Column:
        return F.col("$labels") if self.labels is None else F.array(*[F.lit(x) for x in sorted(set(self.labels))]).cast("array<string>")

    def at(self, id: int) -> "NodeTable | None":
        found = _routed(self.df, self.route, "$id", id)
        return None if found is None else replace(self, df=found)


@dataclass(frozen=True)
class EdgeTable:
    """What may be told of all edges of a table: src_labels and dst_labels, just these labels have the nodes at their ends; src_single
    and dst_single, a node is the source (destination) of one at most; routes of their ends, by columns named $.."""

    df: DataFrame
    type: str
    src_labels: tuple[str, ...] | None = None
    dst_labels: tuple[str, ...] | None = None
    src_single: bool = False
    dst_single: bool = False
    src_route: Route | None = None
    dst_route: Route | None = None

    def ends(self, forward: bool) -> tuple[tuple[str, ...] | None, tuple[str, ...] | None]:
        return (self.src_labels, self.dst_labels) if forward else (self.dst_labels, self.src_labels)

    @property
    def props(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema.fields if not f.name.startswith("$")}

    def at(self, end: str, id: int) -> "EdgeTable | None":
        found = _routed(self.df, self.src_route if end == "$src" else self.dst_route, end, id)
        return None if found is None else replace(self, df=found)


def label_value(expr: Expr, one, some):
    """A label expression's value by what one(label) and some (any label) are, of truth values or columns."""
    if isinstance(expr, Leaf):
        return one(expr.value)
    if expr.name == "%":
        return some
    parts = [label_value(a, one, some) for a in expr.args]
    if expr.name == "!":
        return not parts[0] if isinstance(parts[0], bool) else ~parts[0]
    return parts[0] & parts[1] if expr.name == "&" else parts[0] | parts[1]


def label_test(expr: Expr | None, labels: set[str]) -> bool:
    return True if expr is None else label_value(expr, lambda x: x in labels, bool(labels))


def label_column(expr: Expr, labels: Column) -> Column:
    return label_value(expr, lambda x: F.array_contains(labels, x), F.size(labels) > 0)


def common_type(types: list[T.DataType]) -> T.DataType:
    kinds = {t.simpleString(): t for t in types if not isinstance(t, T.NullType)}
    if not kinds:
        return T.NullType()
    if len(kinds) == 1:
        return next(iter(kinds.values()))
    if all(isinstance(t, T.DecimalType) for t in kinds.values()):
        scale = max(t.scale for t in kinds.values())
        return T.DecimalType(min(38, max(t.precision - t.scale for t in kinds.values()) + scale), scale)
    return T.VariantType()


def _key(c: Column | Route) -> Column:
    return F.lit(c.first).cast("long") + F.col(c.column).cast("long") if isinstance(c, Route) else c


@dataclass(frozen=True)
class PropertyGraph:
    """complete: no edge has an end that is not a node, so a node of which nothing but its id is asked needs no scan."""

    spark: SparkSession
    nodes: tuple[NodeTable, ...] = ()
    edges: tuple[EdgeTable, ...] = ()
    name: str = "default"
    number: int = 1
    complete: bool = field(default=False)

    def with_nodes(self, df: DataFrame, *labels: str, id: str | Column | Route = "id") -> "PropertyGraph":
        """The graph with a table of nodes; id: the column, expression or route of their identifiers."""
        key = F.col(id) if isinstance(id, str) else _key(id)
        made = wide(df.withColumn("$id", key.cast("long")))
        if isinstance(id, str):
            made = made.drop(id)
        return replace(self, nodes=(*self.nodes, NodeTable(made, tuple(sorted(set(labels))) if "$labels" not in df.columns else None, id if isinstance(id, Route) else None)))

    def with_edges(self, df: DataFrame, type: str, src: str | Column | Route = "src", dst: str | Column | Route = "dst", rank: str | Column | None = None, between: tuple[str, str] | None = None, single: str = "") -> "PropertyGraph":
        """The graph with a table of edges; between: the one label that all their sources have, and that of their destinations; single:
        src, dst or both by a space, if a node is that end of one edge at most."""
        if not type:
            raise DataError("a type has a name")
        of = lambda c: F.col(c) if isinstance(c, str) else _key(c)
        keys = {f"${end}$key": (F.col(r.column), r) for end, r in (("src", src), ("dst", dst)) if isinstance(r, Route)}
        made = df.withColumns({"$src": of(src).cast("long"), "$dst": of(dst).cast("long"), "$rank": (F.lit(0) if rank is None else of(rank)).cast("long"), **{k: c for k, (c, _) in keys.items()}})
        used = [c for c in (src, dst, rank) if isinstance(c, str)] + [r.column for _, r in keys.values()]
        src_route, dst_route = (replace(keys[k][1], column=k) if k in keys else None for k in ("$src$key", "$dst$key"))
        told = [(between[0],), (between[1],)] if between else [None, None]
        return replace(self, edges=(*self.edges, EdgeTable(wide(made.drop(*used)), type, *told, "src" in single.split(), "dst" in single.split(), src_route, dst_route)))

    def replaced(self, nodes=None, edges=None) -> "PropertyGraph":
        return replace(self, nodes=self.nodes if nodes is None else tuple(nodes), edges=self.edges if edges is None else tuple(edges))

    # --- catalog
    def node_tables(self, labels: Expr | None = None) -> list[NodeTable]:
        """Tables that can hold a node of these labels: the others are not read."""
        return [t for t in self.nodes if t.labels is None or label_test(labels, set(t.labels))]

    def edge_tables(self, labels: Expr | None = None) -> list[EdgeTable]:
        return [t for t in self.edges if label_test(labels, {t.type})]

    def node_props(self, labels: Expr | None = None) -> dict[str, T.DataType]:
        return self._props(self.node_tables(labels))

    def edge_props(self, labels: Expr | None = None) -> dict[str, T.DataType]:
        return self._props(self.edge_tables(labels))

    @staticmethod
    def _props(tables) -> dict[str, T.DataType]:
        found: dict[str, list[T.DataType]] = {}
        for t in tables:
            for k, kind in t.props.items():
                found.setdefault(k, []).append(kind)
        return {k: common_type(v) for k, v in sorted(found.items())}

    # --- scans
    def scan_nodes(self, labels: Expr | None = None, props: list[str] | None = None, among: set[tuple[str, ...]] | None = None, id: int | None = None) -> DataFrame:
        """$id, $labels and the properties (None: all) of the nodes of these labels; among: those label sets suffice; id: that node only."""
        kinds = self.node_props(labels)
        wanted = sorted(kinds) if props is None else sorted(set(props) & set(kinds))
        parts = []
        for t in self.node_tables(labels):
            if among is not None and t.labels is not None and t.labels not in among:
                continue
            t = t if id is None else t.at(id)
            if t is None:
                continue
            df = t.df if t.labels is not None or labels is None else t.df.where(label_column(labels, F.col("$labels")))
            parts.append(df.select("$id", t.labels_column().alias("$labels"), *self._columns(t, wanted, kinds)))
        if not parts:
            return self.spark.createDataFrame([], T.StructType([T.StructField("$id", T.LongType()), T.StructField("$labels", T.ArrayType(T.StringType())), *[T.StructField(k, kinds[k]) for k in wanted]]))
        return reduce(DataFrame.unionByName, parts)

    def scan_edges(self, labels: Expr | None = None, props: list[str] | None = None, tables: list[EdgeTable] | None = None) -> DataFrame:
        """$src, $type, $dst, $rank and the properties (None: all) of the edges of these types; tables: of these only."""
        kinds = self.edge_props(labels)
        wanted = sorted(kinds) if props is None else sorted(set(props) & set(kinds))
        parts = [t.df.select("$src", F.lit(t.type).alias("$type"), "$dst", "$rank", *self._columns(t, wanted, kinds)) for t in (self.edge_tables(labels) if tables is None else tables)]
        if not parts:
            fields = [("$src", T.LongType()), ("$type", T.StringType()), ("$dst", T.LongType()), ("$rank", T.LongType())]
            return self.spark.createDataFrame([], T.StructType([T.StructField(k, v) for k, v in [*fields, *[(k, kinds[k]) for k in wanted]]]))
        return reduce(DataFrame.unionByName, parts)

    @staticmethod
    def edges_at(tables: list[EdgeTable], end: str, id: int) -> list[EdgeTable]:
        """Those of the tables that can have edges of a node, cut down to these."""
        return [t for t in (x.at(end, id) for x in tables) if t is not None]

    @staticmethod
    def _columns(table, wanted, kinds):
        own = table.props
        for k in wanted:
            if k not in own:
                yield F.lit(None).cast(kinds[k]).alias(k)
            elif own[k] != kinds[k]:
                yield F.col(f"`{k}`").cast(kinds[k]).alias(k)
            else:
                yield F.col(f"`{k}`").alias(k)

    def get_node(self, id: int) -> DataFrame:
        return self.scan_nodes(id=id)

    def adjacent(self, id: int, direction: str = "out", type: str | None = None, limit: int | None = None) -> DataFrame:
        """A node's edges; limit: the first by (type, other end, rank)."""
        near, far = ("$src", "$dst") if direction == "out" else ("$dst", "$src")
        labels = Leaf("label", type) if type else None
        out = self.scan_edges(labels, None, self.edges_at(self.edge_tables(labels), near, id))
        return out if limit is None else out.orderBy("$type", far, "$rank").limit(limit)

    def bounded_adjacency(self, limit: int, direction: str = "out", type: str | None = None) -> DataFrame:
        """The first edges of every node, by (type, other end, rank)."""
        from pyspark.sql import Window

        near, far = ("$src", "$dst") if direction == "out" else ("$dst", "$src")
        place = F.row_number().over(Window.partitionBy(near).orderBy("$type", far, "$rank"))
        return self.scan_edges(Leaf("label", type) if type else None).withColumn("$place", place).where(F.col("$place") <= limit).drop("$place")
