"""What the variables of a query are bound to, and which of their properties it asks for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import GqlSyntaxError
from ..gql.tree import Bind, Change, Element, Expr, Find, Give, Keep, Leaf, Op, Query, is_op, is_var

ALL = object()


@dataclass(frozen=True)
class Binding:
    """kind: node, edge, edges (a list, of a quantified edge) or value. Columns carry the variable's name and a suffix."""

    kind: str
    name: str
    props: tuple[tuple[str, T.DataType], ...] = ()
    type: T.DataType | None = None

    def column(self, part: str) -> Column:
        return F.col(f"`{self.name}{part}`")

    def prop(self, key: str) -> Column | None:
        return self.column(f"$p${key}") if key in dict(self.props) else None

    @property
    def columns(self) -> list[str]:
        if self.kind == "node":
            parts = ["$id", "$labels"]
        elif self.kind == "edge":
            parts = ["$src", "$type", "$dst", "$rank"]
        else:
            return [self.name]
        return [self.name + p for p in parts] + [f"{self.name}$p${k}" for k, _ in self.props]


Scope = dict[str, Binding]


def variables(node: Expr | None) -> set[str]:
    """Free variables of an expression."""
    if isinstance(node, Leaf):
        return {node.value} if node.kind == "var" else set()
    if node is None:
        return set()
    if node.name == "exists":
        elements = [e for path in node.tag for e in path]
        return {e.var for e in elements if e.var} | set().union(*[variables(x) for e in elements for x in e.expressions()])
    args = node.args[:1] if is_op(node, "call") and node.tag[0] == "PROPERTY_EXISTS" else node.args
    return set().union(*map(variables, args))


class _Needs:
    def __init__(self):
        self.out: dict[str, object] = {}
        self.stands: list[tuple[str, bool]] = []

    def add(self, of: str, key: str) -> None:
        if self.out.get(of) is not ALL:
            self.out.setdefault(of, set()).add(key)

    def expr(self, node: Expr | None) -> None:
        if is_var(node):
            self.out[node.value] = ALL
        if not isinstance(node, Op):
            return
        args = node.args
        if node.name == "exists":
            for path in node.tag:
                self.path(path)
        elif node.name == "field" and is_var(args[0]):
            self.add(args[0].value, node.tag)
            args = ()
        elif node.name == "call":
            name, how = node.tag
            if name == "PROPERTY_EXISTS" and len(args) == 2 and is_var(args[0]):
                self.add(args[0].value, property_name(args[1]))
                args = ()
            elif name in ("ELEMENT_ID", "SAME", "ALL_DIFFERENT") or (name == "COUNT" and how != "distinct"):
                args = tuple(a for a in args if not is_var(a))
        elif node.name in ("is labeled", "is directed", "is source", "is destination", "is null"):
            # what an element is, not what it has
            if node.name == "is labeled":
                if is_var(args[0]):
                    self.add("$labels", args[0].value)
                args = args[:1]
            args = tuple(a for a in args if not is_var(a))
        for a in args:
            self.expr(a)

    def path(self, path: tuple[Element, ...]) -> None:
        for e in path:
            if e.var:
                self.stands.append((e.var, e.labels is not None))
                for k, _ in e.given:
                    self.add(e.var, k)
            for x in e.expressions():
                self.expr(x)

    def clause(self, c) -> None:
        if isinstance(c, Find) or (isinstance(c, Change) and c.action == "insert"):
            for path in c.paths if isinstance(c, Find) else c.targets:
                self.path(path)
        if isinstance(c, (Find, Keep)):
            for t in c.tests:
                self.expr(t)
        if isinstance(c, Bind):
            self.expr(c.value)
        if isinstance(c, Change) and c.action in ("set", "remove"):
            for _, _, _, value in c.targets:
                self.expr(value)
        if isinstance(c, Give):
            if c.items is None:
                self.out["*"] = ALL
            for x in [*[e for e, _ in c.items or ()], *[e for e, _, _ in c.order], c.skip, c.take]:
                self.expr(x)


def needs(query: Query) -> dict[str, object]:
    """Properties that the query asks of each variable; ALL where it takes the whole element."""
    found = _Needs()
    for c in query.clauses:
        found.clause(c)
    # labels of a variable that stands in several patterns are tested on what binds it
    for var, labelled in found.stands:
        if labelled and sum(v == var for v, _ in found.stands) > 1:
            found.add("$labels", var)
    return found.out


def property_name(node: Expr) -> str:
    if isinstance(node, Leaf) and node.kind in ("var", "string"):
        return node.value
    raise GqlSyntaxError("PROPERTY_EXISTS names a property")
