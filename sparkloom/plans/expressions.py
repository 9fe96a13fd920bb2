"""Expressions to typed columns, within a scope."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DataError, GqlSyntaxError
from ..functions import scalar
from ..functions import values as V
from ..functions.values import Value
from ..gql.parser import AGGREGATES
from ..gql.tree import Expr, Leaf, Op, is_op, is_var
from ..sources.graph import label_column, label_value
from .scope import Binding, Scope, property_name


class Expressions:
    def __init__(self, scope: Scope, params: dict | None = None):
        self.scope, self.params = scope, params or {}

    def value(self, node: Expr) -> Value:
        if isinstance(node, Leaf):
            return self._leaf(node)
        if len(node.args) == 1 and node.name in ("+", "-"):
            return self._sign(node)
        return getattr(self, METHODS.get(node.name, "_arithmetic"))(node)

    def condition(self, node: Expr) -> Column:
        """True where the expression is true; anything else is not."""
        v = self.value(node)
        return v.col if v.kind == "bool" else F.lit(False)

    def binding(self, node: Expr) -> Binding | None:
        if not is_var(node):
            return None
        if node.value not in self.scope:
            raise GqlSyntaxError(f"unbound variable {node.value}", node.at)
        return self.scope[node.value]

    def _element(self, node: Expr, *kinds: str) -> Binding | None:
        b = self.binding(node)
        return b if b is not None and b.kind in kinds else None

    # --- leaves
    def _leaf(self, node: Leaf):
        if node.kind == "var":
            b = self.binding(node)
            return Value(b.column(""), b.type) if b.kind in ("value", "edges") else element_record(b)
        if node.kind == "param":
            if node.value not in self.params:
                raise GqlSyntaxError(f"missing parameter ${node.value}")
            return V.literal(self.params[node.value])
        return V.literal(node.value)

    def _field(self, node: Op):
        of, key = node.args[0], node.tag
        b = self._element(of, "node", "edge")
        if b is not None:
            stored = b.prop(key)
            kind = dict(b.props).get(key)
            if b.kind == "node" and key == "id":
                if stored is None:
                    return Value(b.column("$id"), T.LongType())
                return Value(F.coalesce(stored, b.column("$id")), kind) if isinstance(kind, T.LongType) else Value(stored, kind)
            return V.null() if stored is None else Value(stored, kind)
        base = self.value(of)
        if base.kind == "null":
            return base
        if base.kind == "variant":
            quoted = key.replace("'", "\\'")
            return Value(F.try_variant_get(base.col, f"$['{quoted}']", "variant"), T.VariantType())
        if base.kind != "record":
            raise DataError(f"{base.kind} has no properties")
        found = [f for f in base.type.fields if f.name == key]
        return Value(base.col.getField(key), found[0].dataType) if found else V.null()

    def _list(self, node):
        return V.list_of([self.value(i) for i in node.args])

    def _record(self, node):
        return V.record_of([(k, self.value(v)) for k, v in zip(node.tag, node.args, strict=True)])

    # --- operators
    def _not(self, node):
        v = self.value(node.args[0])
        if v.kind not in ("bool", "null"):
            raise DataError(f"NOT needs a truth value, not {v.kind}")
        return V.boolean(~v.col.cast("boolean"))

    def _sign(self, node):
        v = self.value(node.args[0])
        if v.kind == "variant":
            v = V.cast(v, "float")
        if v.kind not in (*V.NUMBERS, "null"):
            raise DataError(f"{node.name} needs a number, not {v.kind}")
        return v if node.name == "+" else Value(-v.col if v.kind != "null" else v.col, v.type)

    def _logic(self, node):
        a, b = (v.col if v.kind == "bool" else F.lit(None).cast("boolean") for v in map(self.value, node.args))
        return V.boolean({"AND": lambda: a & b, "OR": lambda: a | b, "XOR": lambda: a != b}[node.name]())

    def _comparison(self, node):
        if node.name in ("=", "<>"):
            # elements of one kind are equal by their identity; their records need not be built
            a, b = (self._element(x, "node", "edge") for x in node.args)
            if a is not None and b is not None and a.kind == b.kind:
                same = reduce(lambda x, y: x & y, [a.column(p) == b.column(p) for p in identity(a)])
                return V.boolean(same if node.name == "=" else ~same)
        return V.compare(node.name, *map(self.value, node.args))

    def _concat(self, node):
        return V.concat(*map(self.value, node.args))

    def _arithmetic(self, node):
        return V.arithmetic(node.name, *map(self.value, node.args))

    def _is_null(self, node):
        b = self._element(node.args[0], "node", "edge")
        return V.boolean((self.value(node.args[0]).col if b is None else b.column(identity(b)[0])).isNull())

    def _in(self, node):
        of, among = node.args
        needle = self.value(of)
        if is_op(among, "list") and among.args and all(isinstance(i, Leaf) and i.kind != "var" for i in among.args):
            items = [self.value(i) for i in among.args if i.kind != "null"]
            if items and all(type(i.type) is type(needle.type) for i in items) and needle.kind in ("int", "string", "bool"):
                return V.boolean(needle.col.isin(*[i.col for i in items]))
        return V.boolean(V.contains(needle, self.value(among)).col)

    def _is_labeled(self, node):
        of, labels = node.args
        b = self._element(of, "node", "edge")
        if b is None:
            if self.value(of).kind == "null" or is_var(of):
                return V.boolean(F.lit(None).cast("boolean"))
            raise DataError("only nodes and edges have labels")
        return V.boolean(label_column(labels, b.column("$labels")) if b.kind == "node" else edge_label_column(labels, b.column("$type")))

    def _is_directed(self, node):
        b = self._element(node.args[0], "edge")
        if b is None:
            raise DataError("IS DIRECTED needs an edge")
        return V.boolean(F.when(b.column("$src").isNotNull(), F.lit(True)))

    def _is_end(self, node):
        n, e = self._element(node.args[0], "node"), self._element(node.args[1], "edge")
        if n is None or e is None:
            return V.boolean(F.lit(None).cast("boolean"))
        return V.boolean(n.column("$id") == e.column("$src" if node.name == "is source" else "$dst"))

    def _is_typed(self, node):
        v, kind = self.value(node.args[0]), node.tag
        if v.kind == "variant":
            spark = {"int": "BIGINT", "float": "DOUBLE", "string": "STRING", "bool": "BOOLEAN", "bytes": "BINARY", "datetime": "TIMESTAMP"}
            told = F.schema_of_variant(v.col)
            return V.boolean(F.coalesce(told == spark[kind] if kind in spark else told.startswith({"list": "ARRAY", "record": "OBJECT", "decimal": "DECIMAL"}[kind]), F.lit(False)))
        return V.boolean(v.col.isNotNull() if v.kind == kind else F.lit(False))

    def _cast(self, node):
        return V.cast(self.value(node.args[0]), node.tag)

    def _case(self, node):
        args = list(node.args)
        operand = self.value(args.pop(0)) if node.name == "case" else None
        default, arms = args.pop(), []
        for when, then in zip(args[::2], args[1::2], strict=True):
            test = self.condition(when) if operand is None else F.coalesce(V.equal(operand, self.value(when)), F.lit(False))
            arms.append((test, self.value(then)))
        results = V.promote([*[v for _, v in arms], self.value(default)])
        kind = V.common_type([r.type for r in results])
        out = F
        for (test, _), r in zip(arms, results, strict=False):
            out = out.when(test, r.col.cast(kind))
        return Value(out.otherwise(results[-1].col.cast(kind)), kind)

    def _trim(self, node):
        of, *letters = map(self.value, node.args)
        return scalar.trim(node.tag, of, letters[0] if letters else None)

    def _exists(self, node):
        raise GqlSyntaxError("EXISTS can't stand here")

    def _call(self, node):
        name = node.tag[0]
        if name in AGGREGATES:
            raise GqlSyntaxError(f"{name} stands only for a whole item of RETURN")
        if name == "ELEMENT_ID":
            return self._element_id(node)
        if name == "PROPERTY_EXISTS":
            if len(node.args) != 2:
                raise GqlSyntaxError("PROPERTY_EXISTS takes 2 arguments")
            b = self.scope.get(node.args[0].value) if is_var(node.args[0]) else None
            stored = b.prop(property_name(node.args[1])) if b is not None and b.kind in ("node", "edge") else None
            return V.boolean(F.lit(False) if stored is None else stored.isNotNull())
        if name in ("SAME", "ALL_DIFFERENT"):
            return self._sameness(node)
        return scalar.call(name, [self.value(a) for a in node.args])

    def _element_id(self, node):
        if len(node.args) != 1:
            raise GqlSyntaxError("ELEMENT_ID takes 1 argument")
        b = self.scope.get(node.args[0].value) if is_var(node.args[0]) else None
        if b is not None and b.kind == "node":
            return Value(b.column("$id"), T.LongType())
        if b is not None and b.kind == "edge":
            parts = [b.column(p).cast("string") for p in ("$src", "$type", "$dst", "$rank")]
            return V.text(F.when(b.column("$src").isNotNull(), F.concat_ws("-", *parts)))
        return V.null(T.LongType())

    def _sameness(self, node):
        name = node.tag[0]
        if len(node.args) < 2:
            raise GqlSyntaxError(f"{name} takes 2 arguments or more")
        pairs = list(zip(node.args, node.args[1:], strict=False)) if name == "SAME" else [(a, b) for k, a in enumerate(node.args) for b in node.args[:k]]
        tests = []
        for x, y in pairs:
            a, b = self._element(x, "node", "edge"), self._element(y, "node", "edge")
            if a is not None and b is not None and a.kind == b.kind:
                test = reduce(lambda p, q: p & q, [a.column(p).eqNullSafe(b.column(p)) for p in identity(a)])
            elif (a is None) != (b is None) or (a is not None and a.kind != b.kind):
                test = F.lit(False)
            else:
                test = V.same(self.value(x), self.value(y))
            tests.append(test if name == "SAME" else ~test)
        return V.boolean(reduce(lambda p, q: p & q, tests))


#: Operators by what compiles them; the others are arithmetic.
METHODS = {
    "field": "_field", "list": "_list", "record": "_record", "NOT": "_not", "AND": "_logic", "OR": "_logic", "XOR": "_logic", **dict.fromkeys(("=", "<>", "<", "<=", ">", ">="), "_comparison"),
    "||": "_concat", "is null": "_is_null", "in": "_in", "is labeled": "_is_labeled", "is directed": "_is_directed", "is source": "_is_end", "is destination": "_is_end", "is typed": "_is_typed",
    "cast": "_cast", "case": "_case", "when": "_case", "trim": "_trim", "exists": "_exists", "call": "_call",
}


def identity(b: Binding) -> tuple[str, ...]:
    return ("$id",) if b.kind == "node" else ("$src", "$type", "$dst", "$rank")


def edge_label_column(expr: Expr, kind: Column) -> Column:
    return label_value(expr, lambda x: kind == x, kind.isNotNull())


def element_record(b: Binding) -> Value:
    """A node as {id, labels, properties}, an edge as {source, target, type, rank, properties}; null if it is not bound."""
    props = F.struct(*[b.prop(k).alias(k) for k, _ in b.props]) if b.props else F.struct(F.lit(None).alias("$"))
    kind = T.StructType([T.StructField(k, t) for k, t in b.props] or [T.StructField("$", T.NullType())])
    if b.kind == "node":
        fields = [("id", "$id", T.LongType()), ("labels", "$labels", T.ArrayType(T.StringType()))]
    else:
        fields = [("source", "$src", T.LongType()), ("target", "$dst", T.LongType()), ("type", "$type", T.StringType()), ("rank", "$rank", T.LongType())]
    made = F.struct(*[b.column(c).alias(n) for n, c, _ in fields], props.alias("properties"))
    whole = T.StructType([*[T.StructField(n, t) for n, _, t in fields], T.StructField("properties", kind)])
    return Value(F.when(b.column(identity(b)[0]).isNotNull(), made), whole)

