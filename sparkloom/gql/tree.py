"""What the parser makes of a text, cut for the planner.

Expressions, label expressions included, have two shapes: a Leaf has a kind and a value, an Op a name, its arguments and what else
belongs to the name. A negated predicate is the Op NOT of the plain one. Patterns carry their conditions as conjuncts.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Leaf:
    """kind: null, bool, int, float, decimal, string, bytes, datetime, or of a name: var, param, label."""

    kind: str
    value: Any = None
    at: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Op:
    """Operators under their own signs; and: field (tag: the key), list, record (tag: the keys), call (tag: the function), COUNT(*) as
    call without arguments and a star, cast and is typed (tag: the type), is null, is labeled, is directed, is source, is
    destination, in, case and when (arguments: [operand,] condition, result, ..., default), trim (tag: the side; arguments: text,
    letters), exists (tag: the paths). Labels: !, &, |, and % for any."""

    name: str
    args: tuple = ()
    tag: Any = None


Expr = Leaf | Op


def var(name: str, at: int = 0) -> Leaf:
    return Leaf("var", name, at)


def is_var(node) -> bool:
    return isinstance(node, Leaf) and node.kind == "var"


def is_op(node, *names: str) -> bool:
    return isinstance(node, Op) and node.name in names


def no(node: Expr) -> Op:
    return Op("NOT", (node,))


def conjuncts(node: Expr | None) -> tuple[Expr, ...]:
    if node is None:
        return ()
    return tuple(x for a in node.args for x in conjuncts(a)) if is_op(node, "AND") else (node,)


def nodes_of(node):
    """The expression and all within it, those of EXISTS included."""
    yield node
    if isinstance(node, Op):
        inner = [x for path in node.tag for e in path for x in e.expressions()] if node.name == "exists" else []
        for x in (*node.args, *inner):
            yield from nodes_of(x)


def rewritten(node, change):
    """The expression with change(part) in place of each part for which that is not None."""
    other = change(node)
    if other is not None:
        return other
    if isinstance(node, Op):
        tag = tuple(tuple(e.rewritten(change) for e in path) for path in node.tag) if node.name == "exists" else node.tag
        return Op(node.name, tuple(rewritten(a, change) for a in node.args), tag)
    return node


@dataclass(frozen=True)
class Element:
    """A node, or an edge with the ways it may be gone: out, in or any. given: properties by key; tests: conjuncts of its WHERE; hops:
    the least and the most edges of a quantified one."""

    kind: str
    var: str | None = None
    labels: Expr | None = None
    given: tuple = ()
    tests: tuple = ()
    way: str = ""
    hops: tuple[int, int] | None = None

    def expressions(self) -> list[Expr]:
        return [*[v for _, v in self.given], *self.tests]

    def rewritten(self, change) -> "Element":
        given = tuple((k, rewritten(v, change)) for k, v in self.given)
        return Element(self.kind, self.var, self.labels, given, tuple(rewritten(t, change) for t in self.tests), self.way, self.hops)


@dataclass(frozen=True)
class Find:
    """MATCH: paths are tuples of elements, nodes and edges in turn."""

    paths: tuple
    tests: tuple = ()
    optional: bool = False


@dataclass(frozen=True)
class Keep:
    tests: tuple


@dataclass(frozen=True)
class Bind:
    """LET, a variable at a time; each: FOR, a row for each member of a list."""

    var: str
    value: Expr
    each: bool = False


@dataclass(frozen=True)
class Change:
    """An update. action insert has paths as targets, set and remove (variable, part, name, value) with part field, all or label, delete
    and detach variables."""

    action: str
    targets: tuple


@dataclass(frozen=True)
class Give:
    """RETURN: items (expression, alias), None for all; order (expression, falling, nulls first or None)."""

    items: tuple | None
    distinct: bool = False
    order: tuple = ()
    skip: Expr | None = None
    take: Expr | None = None


@dataclass(frozen=True)
class Query:
    graph: str | None
    clauses: tuple


@dataclass(frozen=True)
class Control:
    """A transaction's start, commit or rollback."""

    action: str
    read_only: bool = False
