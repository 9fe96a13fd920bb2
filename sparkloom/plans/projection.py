"""RETURN: items, DISTINCT, aggregates, ORDER BY, OFFSET and LIMIT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DataError, GqlSyntaxError, UnsupportedFeature
from ..functions import values as V
from ..functions.values import Value
from ..gql.parser import AGGREGATES
from ..gql.tree import Expr, Give, Leaf, Op, is_op, is_var, nodes_of, var
from .expressions import Expressions, identity
from .matching import Matcher
from .scope import Binding, Scope


def item_name(expr: Expr) -> str:
    if is_var(expr):
        return expr.value
    if is_op(expr, "field"):
        return f"{item_name(expr.args[0])}.{expr.tag}"
    if is_op(expr, "call"):
        return expr.tag[0].lower()
    return "trim" if is_op(expr, "trim") else "expr"


def is_aggregate(expr: Expr) -> bool:
    return is_op(expr, "call") and expr.tag[0] in AGGREGATES


def project(matcher: Matcher, df: DataFrame, scope: Scope, clause: Give) -> DataFrame:
    items = clause.items
    if items is None:
        items = tuple((var(v), None) for v in sorted(v for v in scope if not v.startswith("$")))
    names = [alias or item_name(e) for e, alias in items]
    if any(is_aggregate(e) for e, _ in items):
        if not all(is_aggregate(e) for e, _ in items):
            raise UnsupportedFeature("GQ15", 0)
        # one row: an order of it is no order
        out = aggregate(matcher, df, scope, [e for e, _ in items])
        return page(matcher, out, clause).toDF(*names)
    inner = dict(scope)
    outputs, aliases = [], {}
    for k, (expr, alias) in enumerate(items):
        df, inner, expr = matcher.marked(df, inner, expr)
        v = Expressions(inner, matcher.params).value(expr)
        outputs.append((f"$out{k}", v))
        if alias:
            aliases.setdefault(alias, Binding("value", f"$out{k}", type=v.type))
    df = df.withColumns({c: v.col for c, v in outputs}) if outputs else df
    keys: list[tuple[Column, bool, bool | None]] = []
    if clause.order:
        # a variable of the rows wins over an alias of the same name
        seen = {**aliases, **inner}
        ordered = {}
        for k, (of, falling, first) in enumerate(clause.order):
            df, seen, of = matcher.marked(df, seen, of)
            ordered[f"$key{k}"] = Expressions(seen, matcher.params).value(of).col
            keys.append((F.col(f"$key{k}"), falling, first))
        df = df.withColumns(ordered)
    outs = [c for c, _ in outputs]
    df = df.select(*[F.col(c) for c in outs], *[c for c, _, _ in keys])
    if clause.distinct:
        df = df.dropDuplicates(outs) if outs else df.limit(1)
    if keys:
        df = df.orderBy(*[direction(*k) for k in keys])
    return page(matcher, df, clause).select(*[F.col(c) for c in outs]).toDF(*names)


def direction(c: Column, falling: bool, first: bool | None) -> Column:
    """Nulls stand last when ascending and first when descending, unless told otherwise."""
    first = falling if first is None else first
    if falling:
        return c.desc_nulls_first() if first else c.desc_nulls_last()
    return c.asc_nulls_first() if first else c.asc_nulls_last()


def page(matcher: Matcher, df: DataFrame, clause: Give) -> DataFrame:
    offset, limit = (None if e is None else count(matcher, e) for e in (clause.skip, clause.take))
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(min(limit, (1 << 31) - 1))


def count(matcher: Matcher, expr: Expr) -> int:
    """A constant number of rows."""
    if isinstance(expr, Leaf) and expr.kind == "param":
        if expr.value not in matcher.params:
            raise GqlSyntaxError(f"missing parameter ${expr.value}")
        n = matcher.params[expr.value]
    elif isinstance(expr, Leaf) and expr.kind != "var":
        n = expr.value
    else:
        v = Expressions({}, matcher.params).value(expr)
        n = matcher.graph.spark.range(1).select(v.col.alias("n")).first().n
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise DataError("a number of rows is an integer and not negative")
    return n


def aggregate(matcher: Matcher, df: DataFrame, scope: Scope, calls: list[Op]) -> DataFrame:
    columns = []
    for k, call in enumerate(calls):
        name, how = call.tag
        if any(is_aggregate(x) for a in call.args for x in nodes_of(a)):
            raise GqlSyntaxError("aggregates don't nest")
        if how != "*" and not call.args:
            raise GqlSyntaxError(f"{name} needs an argument")
        if how == "*":
            columns.append(F.count(F.lit(1)).alias(f"$out{k}"))
            continue
        df, scope, arg = matcher.marked(df, scope, call.args[0])
        columns.append(_aggregate(name, how == "distinct", Expressions(scope, matcher.params), arg).alias(f"$out{k}"))
    return df.agg(*columns)


def _aggregate(name: str, distinct: bool, e: Expressions, arg: Expr) -> Column:
    b = e._element(arg, "node", "edge")
    if name == "COUNT":
        if b is not None:
            parts = [b.column(p) for p in identity(b)]
            return F.count_distinct(*parts) if distinct else F.count(parts[0])
        v = e.value(arg)
        return F.count_distinct(v.col) if distinct else F.count(v.col)
    v = e.value(arg)
    if name in ("MIN", "MAX"):
        if v.kind in ("record", "variant"):
            raise DataError(f"{name} can't order {v.kind}s")
        return F.min(v.col) if name == "MIN" else F.max(v.col)
    if v.kind == "variant":
        v = V.cast(v, "float")
    if v.kind not in (*V.NUMBERS, "null"):
        raise DataError(f"{name} needs numbers, not {v.kind}")
    if v.kind == "null":
        return F.max(v.col.cast("double"))
    if name == "AVG":
        total = v.col.cast("double")
        return F.sum_distinct(total) / F.count_distinct(total) if distinct else F.avg(total)
    if v.kind == "decimal":
        v = Value(v.col.cast(T.DecimalType(38, v.type.scale)), v.type)
    return F.sum_distinct(v.col) if distinct else F.sum(v.col)
