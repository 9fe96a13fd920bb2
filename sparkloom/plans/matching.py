"""Patterns to joins.

A path is compiled from scans by itself. Elements that are already bound elsewhere stand in it by their identity only: the path
is then joined to what binds them on these identities, with whatever else refers to both sides in the join's condition. MATCH
joins inner, OPTIONAL MATCH left outer, EXISTS semi or anti. No row numbers are needed, and no product where an identity is shared.

Several paths of single edges, or a path that meets what is bound, are taken edge by edge in an order of their own: first edges
that close a cycle, then those that lead to one node at most, then the others. Quantified edges go out from the nodes that the
rows so far have. A node that is given by its id is looked up by that, and so are the edges at it.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import GqlSyntaxError
from ..gql.tree import Element, Expr, Find, Leaf, Op, is_op, is_var, nodes_of, rewritten, var
from ..sources.graph import EdgeTable, PropertyGraph, label_test
from ..sources.tables import materialise
from .expressions import Expressions, element_record, identity
from .scope import ALL, Binding, Scope, variables

_fresh = itertools.count()
#: Walks up to this length are one plan; longer ones are written a step at a time, until no walk goes on.
PLAN_HOPS = 4
TURNED = {"out": "in", "in": "out", "any": "any"}


@dataclass
class Pattern:
    """df is None for a path of one bound node: it has tests only."""

    df: DataFrame | None = None
    scope: Scope = field(default_factory=dict)
    #: (variable, parts of its identity, columns here) of elements bound elsewhere
    keys: list[tuple[str, tuple[str, ...], tuple[str, ...]]] = field(default_factory=list)
    #: conditions that refer to variables bound elsewhere
    tests: list[Expr] = field(default_factory=list)
    #: labels that a variable's nodes were scanned for
    labels: dict[str, Expr | None] = field(default_factory=dict)


class Matcher:
    def __init__(self, graph: PropertyGraph, needs: dict[str, object], params: dict):
        self.graph, self.needs, self.params = graph, needs, params
        self.given: tuple[Expr, ...] = ()
        #: labels that variables were matched with
        self.labels: dict[str, Expr | None] = {}

    # --- joins
    def match(self, df: DataFrame | None, scope: Scope, clause: Find) -> tuple[DataFrame, Scope]:
        if clause.optional:
            return self._optional(df, scope, clause)
        # the clause's tests tell identifiers as an element's own do
        self.given = clause.tests
        for path in self._in_order(clause.paths, scope):
            df, scope = self._join(df, scope, self.path(path, scope, df), "inner")
        self.given = ()
        return self.filter(df, scope, clause.tests), scope

    def _in_order(self, paths, scope: Scope) -> list[tuple[Element, ...]]:
        """The paths, or their edges in an order that keeps the rows few."""
        edges = [e for p in paths for e in p[1::2]]
        met = any(e.var in scope for p in paths for e in p)
        apart = all(variables(x) <= {e.var} for p in paths for e in p for x in e.expressions())
        if not edges or not apart or any(e.hops for e in edges) or not (len(paths) > 1 or (met and len(edges) > 1)):
            return list(paths)
        out, steps = [], []
        for p in paths:
            named = [e if e.kind == "edge" or e.var else replace(e, var=f"$m{next(_fresh)}") for e in p]
            if len(named) == 1:
                out.append(tuple(named))
            steps += [tuple(named[k : k + 3]) for k in range(0, len(named) - 2, 2)]
        start = {v for v in scope} | {p[0].var for p in out}
        plans = [self._greedy(steps, start, None)] if any({a.var, b.var} & start for a, _, b in steps) else [self._greedy(steps, start, k) for k in range(len(steps))]
        told: set[int] = set()
        for a, edge, b in min(plans, key=lambda plan: plan[0])[1]:
            # an element that two edges share brings its labels and tests along once
            plain = [Element("node", var=n.var) if id(n) in told else n for n in (a, b)]
            told |= {id(a), id(b)}
            fresh = out[-1][-1].var if out and len(out[-1]) == 3 else None
            if fresh in (a.var, b.var) and fresh not in start and self._closes((a, edge, b), fresh, start):
                # the way to a new node and on to one that is bound is a path of its own, joined by both its ends
                if a.var != fresh:
                    edge, plain = replace(edge, way=TURNED[edge.way]), plain[::-1]
                out[-1] = (*out[-1], edge, plain[1])
            else:
                start |= {x.var for x in out[-1][::2]} if out else set()
                out.append((plain[0], edge, plain[1]))
        return out

    def _greedy(self, steps, bound: set[str], first: int | None) -> tuple[int, list]:
        """(cost, edges in order), from the edge first or from what is bound."""
        left, bound, cost, out = list(steps), set(bound), 0, []
        while left:
            def price(step):
                a, edge, b = step
                if a.var in bound and b.var in bound:
                    return 0
                chosen = any(n.given for n in (a, b))
                if a.var in bound or b.var in bound:
                    if self._leads_to_one(edge, a.var in bound):
                        return 2 - chosen
                    fresh = b.var if a.var in bound else a.var
                    return (3 if any(self._closes(other, fresh, bound) for other in left if other is not step) else 4) - chosen
                return 10 - 4 * chosen

            step = steps[first] if first is not None and not out else min(left, key=price)
            cost += price(step)
            left.remove(step)
            a, edge, b = step
            if b.var in bound and a.var not in bound:
                step = (b, replace(edge, way=TURNED[edge.way]), a)
            bound |= {a.var, b.var}
            out.append(step)
        return cost, out

    def _closes(self, step, fresh: str, bound: set[str]) -> bool:
        """Whether an edge leads from a new node to one that is bound, and to one at most."""
        a, edge, b = step
        return (a.var == fresh and b.var in bound and self._leads_to_one(edge, True)) or (b.var == fresh and a.var in bound and self._leads_to_one(edge, False))

    def _leads_to_one(self, edge: Element, forward: bool) -> bool:
        """Whether a node has one such edge at most, from the edge's first node or to it."""
        out = {"out": forward, "in": not forward, "any": None}[edge.way]
        tables = self.graph.edge_tables(edge.labels)
        return out is not None and len({t.type for t in tables}) == 1 and all(t.src_single if out else t.dst_single for t in tables)

    def _join(self, df, scope: Scope, p: Pattern, how: str) -> tuple[DataFrame, Scope]:
        both = {**scope, **p.scope}
        if p.df is None:
            return self._tested(df, both, p.tests), both
        if df is None and not p.keys:
            return self._tested(p.df, both, p.tests), both
        df = self.graph.spark.range(1).select() if df is None else df
        on = self._on(scope, p, both)
        joined = df.crossJoin(p.df) if on is None else df.join(p.df, on, how)
        hidden = [c for _, _, columns in p.keys for c in columns]
        return joined.drop(*hidden), both

    def _on(self, scope: Scope, p: Pattern, both: Scope) -> Column | None:
        parts = [scope[v].column(part) == F.col(f"`{c}`") for v, names, columns in p.keys for part, c in zip(names, columns, strict=True)]
        parts += [Expressions(both, self.params).condition(t) for t in p.tests]
        return reduce(lambda a, b: a & b, parts) if parts else None

    def _tested(self, df, scope, tests):
        e = Expressions(scope, self.params)
        return reduce(lambda d, t: d.where(e.condition(t)), tests, df)

    def together(self, paths, tests, outer: Scope) -> Pattern:
        """Several paths and conditions as one pattern, against variables of outer."""
        out = Pattern()
        for path in paths:
            p = self.path(path, {**outer, **out.scope})
            inner = [k for k in p.keys if k[0] in out.scope]
            rest = [k for k in p.keys if k[0] not in out.scope]
            both = {**out.scope, **p.scope}
            local = [t for t in p.tests if variables(t) <= set(both)]
            out.tests += [t for t in p.tests if t not in local]
            if p.df is not None and out.df is not None:
                step = Pattern(p.df, p.scope, inner, local)
                on = self._on(out.scope, step, both)
                joined = out.df.crossJoin(p.df) if on is None else out.df.join(p.df, on, "inner")
                out.df = joined.drop(*[c for _, _, cs in inner for c in cs])
            elif p.df is not None:
                out.df = self._tested(p.df, both, local)
            elif out.df is not None and local:
                out.df = self._tested(out.df, both, local)
            else:
                out.tests += local
            out.scope = both
            out.keys += rest
        if tests and out.df is not None and all(variables(t) <= set(out.scope) and not has_exists(t) for t in tests):
            out.df = self._tested(out.df, out.scope, tests)
        else:
            out.tests += tests
        return out

    def _optional(self, df, scope, clause):
        if df is None:
            df = self.graph.spark.range(1).select()
        p = self.together(clause.paths, clause.tests, scope)
        both = {**scope, **p.scope}
        if p.df is None:
            return df, both
        on = self._on(scope, p, both)
        joined = df.join(p.df, F.lit(True) if on is None else on, "left")
        return joined.drop(*[c for _, _, columns in p.keys for c in columns]), both

    # --- EXISTS
    def filter(self, df: DataFrame, scope: Scope, tests) -> DataFrame:
        """Rows of which all tests are true. EXISTS is a semi join, NOT EXISTS an anti join."""
        for part in tests:
            negated = is_op(part, "NOT") and is_op(part.args[0], "exists")
            if negated or is_op(part, "exists"):
                df = self._semi(df, scope, part.args[0] if negated else part, "left_anti" if negated else "left_semi")
            else:
                marked, own, part = self.marked(df, scope, part)
                df = marked.where(Expressions(own, self.params).condition(part)).select(*df.columns) if marked is not df else df.where(Expressions(scope, self.params).condition(part))
        return df

    def _semi(self, df, scope, exists: Op, how: str) -> DataFrame:
        p = self.together(exists.tag, (), scope)
        if p.df is None:
            test = reduce(lambda a, b: a & b, [Expressions(scope, self.params).condition(t) for t in p.tests], F.lit(True))
            return df.where(test if how == "left_semi" else ~F.coalesce(test, F.lit(False)))
        on = self._on(scope, p, {**scope, **p.scope})
        return df.join(p.df, F.lit(True) if on is None else on, how)

    def marked(self, df: DataFrame, scope: Scope, node: Expr) -> tuple[DataFrame, Scope, Expr]:
        """EXISTS within an expression becomes a Boolean variable: a join with the distinct values that satisfy it."""
        found: dict[Op, str] = {}

        def change(x):
            return var(found.setdefault(x, f"$exists{next(_fresh)}")) if is_op(x, "exists") else None

        node = rewritten(node, change)
        for exists, name in found.items():
            used = [c for v in sorted(variables(exists)) if v in scope for c in scope[v].columns]
            keys = [c for c in used if c in df.columns]
            if not keys:
                there = self._semi(self.graph.spark.range(1).select(), {}, exists, "left_semi").limit(1).agg((F.count(F.lit(1)) > 0).alias(name))
                df = df.crossJoin(there)
            else:
                quoted = [F.col(f"`{c}`") for c in keys]
                yes = self._semi(df.select(*quoted).distinct(), scope, exists, "left_semi").select(*[q.alias(f"{name}{k}") for k, q in enumerate(quoted)], F.lit(True).alias(name + "yes"))
                on = reduce(lambda a, b: a & b, [q.eqNullSafe(F.col(f"`{name}{k}`")) for k, q in enumerate(quoted)])
                df = df.join(yes, on, "left").withColumn(name, F.coalesce(F.col(f"`{name}yes`"), F.lit(False))).drop(name + "yes", *[f"{name}{k}" for k in range(len(keys))])
            scope = {**scope, name: Binding("value", name, type=T.BooleanType())}
        return df, scope, node

    # --- one path
    def path(self, path: tuple[Element, ...], known: Scope, rows: DataFrame | None = None) -> Pattern:
        """rows: what binds the variables known, if the path is to be joined to it."""
        out = Pattern()
        nodes, edges = path[::2], path[1::2]
        here = self._start(out, nodes[0], known, (edges[0], nodes[1]) if edges else None)
        near = nodes[0]
        for edge, node in zip(edges, nodes[1:], strict=True):
            here = self._step(out, here, edge, node, known, near, rows)
            near = node
        return out

    def _wanted(self, var: str | None, kinds: dict[str, T.DataType], extra: set[str]) -> list[str]:
        asked = self.needs.get(var, set()) if var else set()
        if asked is ALL or "*" in self.needs and var:
            return sorted(kinds)
        return sorted((set(asked) | extra) & set(kinds))

    def _test(self, out: Pattern, known: Scope, test: Expr, hidden: str | None = None) -> None:
        """Tests of the path's own variables are filters; those of others wait for the join."""
        free = variables(test)
        if hidden in free or not free <= set(out.scope) | set(known):
            missing = next(iter(({hidden} & free) or (free - set(out.scope) - set(known))))
            raise GqlSyntaxError(f"unbound variable {missing}")
        if free <= set(out.scope) and not has_exists(test):
            out.df = out.df.where(Expressions(out.scope, self.params).condition(test))
        else:
            out.tests.append(test)

    def _pattern_tests(self, out: Pattern, known: Scope, name: str, pat, labels: bool, hidden: str | None = None) -> None:
        if labels and pat.labels is not None:
            self._test(out, known, Op("is labeled", (var(name), pat.labels)))
        for test in element_tests(pat, name):
            self._test(out, known, test, hidden)

    # --- what is known of the ends of edges
    def _tables(self, edge: Element, near: Expr | None, far: Expr | None, forward: bool) -> list[EdgeTable]:
        """Edge tables that can join nodes of these labels, in one direction."""
        fits = lambda labels, expr: labels is None or label_test(expr, set(labels))
        return [t for t in self.graph.edge_tables(edge.labels) if all(fits(x, y) for x, y in zip(t.ends(forward), (near, far), strict=True))]

    def _ways(self, edge: Element) -> tuple[bool, ...]:
        return {"out": (True,), "in": (False,), "any": (True, False)}[edge.way]

    def _end_labels(self, edge: Element, near: Expr | None, far: Expr | None, at_far: bool) -> set[tuple[str, ...]] | None:
        """The label sets of the nodes at one end of the edges that can match; None: any."""
        if edge.hops is not None:
            return None
        out = set()
        for forward in self._ways(edge):
            for t in self._tables(edge, near, far, forward):
                labels = t.ends(forward)[1 if at_far else 0]
                if labels is None:
                    return None
                out.add(labels)
        return out

    def _told(self, pat: Element, ends: set[tuple[str, ...]] | None) -> bool:
        """Whether nodes need no scan: nothing but their id is asked, and the edges tell that they exist with their labels."""
        plain = self.graph.complete and not pat.given and not pat.tests and not self._shown(pat.var)
        if not plain or self._wanted(pat.var, self.graph.node_props(pat.labels), set()):
            return False
        return pat.labels is None or (ends is not None and all(label_test(pat.labels, set(x)) for x in ends))

    def _id(self, pat: Element) -> int | None:
        """The identifier that the pattern asks for, if it is told by a whole number and no node has a property of that name."""
        if any("id" in t.props for t in self.graph.nodes):
            return None
        asked = [v for k, v in pat.given if k == "id"]
        for t in (*pat.tests, *self.given):
            if is_op(t, "=") and pat.var:
                own = Op("field", (var(pat.var),), "id")
                asked += [b for a, b in (t.args, t.args[::-1]) if a == own]
        for v in asked:
            value = self.params.get(v.value) if isinstance(v, Leaf) and v.kind == "param" else v.value if isinstance(v, Leaf) and v.kind == "int" else None
            if isinstance(value, int) and not isinstance(value, bool):
                return value
        return None

    def _asked(self, pat: Element, kinds) -> list[str]:
        return self._wanted(pat.var, kinds, {k for k, _ in pat.given} | {x.tag for t in pat.tests for x in nodes_of(t) if is_op(x, "field")})

    def _nodes(self, name: str, pat: Element, among=None) -> tuple[DataFrame, Binding]:
        kinds = self.graph.node_props(pat.labels)
        props = self._asked(pat, kinds)
        b = Binding("node", name, tuple((k, kinds[k]) for k in props))
        scan = self.graph.scan_nodes(pat.labels, props, among, self._id(pat))
        return scan.select(F.col("$id").alias(f"{name}$id"), F.col("$labels").alias(f"{name}$labels"), *[F.col(f"`{k}`").alias(f"{name}$p${k}") for k in props]), b

    def _start(self, out: Pattern, pat: Element, known: Scope, more) -> str | None:
        if pat.var in known:
            self._kind(known[pat.var], "node")
            self._pattern_tests(out, known, pat.var, pat, True)
            return None
        name = pat.var or f"$n{next(_fresh)}"
        out.labels[name] = self.labels[name] = pat.labels
        ends = None
        if more:
            edge, other = more
            ends = self._end_labels(edge, pat.labels, None if other.var in known else other.labels, False)
            if (edge.hops is None or pat.labels is None and edge.hops[0] > 0) and self._told(pat, ends):
                out.scope[name] = Binding("node", name)
                return f"?{name}"
        out.df, out.scope[name] = self._nodes(name, pat, ends)
        self._pattern_tests(out, known, name, pat, False)
        return f"{name}$id"

    def _shown(self, name: str | None) -> bool:
        """Whether a query can see more of a node than its id."""
        if name is None or name.startswith("$"):
            return False
        return self.needs.get(name) is ALL or "*" in self.needs or name in self.needs.get("$labels", ())

    @staticmethod
    def _kind(b: Binding, kind: str) -> None:
        if b.kind != kind:
            raise GqlSyntaxError(f"{b.name} is no {kind}")

    def _step(self, out: Pattern, here: str | None, edge: Element, node: Element, known: Scope, before: Element, rows: DataFrame | None) -> str:
        k = next(_fresh)
        start, end = f"$from{k}", f"$to{k}"
        quantified = edge.hops is not None
        repeated = edge.var is not None and (edge.var in known or edge.var in out.scope)
        if repeated and quantified:
            raise GqlSyntaxError(f"{edge.var} is bound already")
        name = edge.var if edge.var and not repeated else f"$e{k}"
        near = self.labels.get(before.var) if here is None else out.labels.get(here.lstrip("?").removesuffix("$id"))
        far = None if node.var in known or node.var in out.scope else node.labels
        if quantified:
            hops, binding = self._walks(edge, name, start, end, self._starts(out, here, known, before, rows))
        else:
            ids = (self._id(before), None if node.var in known or node.var in out.scope else self._id(node))
            hops, binding = self._edges(edge, name, start, end, near, far, ids)
        if here is None:
            # the path starts at a node that is bound elsewhere
            first = f"$key{k}"
            hops = hops.withColumnRenamed(start, first)
            out.df = hops
            out.keys.append((before.var, ("$id",), (first,)))
        elif here.startswith("?"):
            out.df = hops.withColumnRenamed(start, f"{here[1:]}$id").withColumn(f"{here[1:]}$labels", F.lit(None).cast("array<string>"))
        else:
            out.df = out.df.join(hops, F.col(f"`{here}`") == F.col(f"`{start}`"), "inner").drop(start)
        out.scope[name] = binding
        if not quantified:
            own = edge if edge.var in (None, name) else replace(edge, tests=tuple(renamed(t, edge.var, name) for t in edge.tests))
            self._pattern_tests(out, known, name, own, False)
        if repeated:
            own = [F.col(f"`{name}{p}`") for p in identity(binding)]
            if edge.var in out.scope:
                out.df = out.df.where(reduce(lambda a, b: a & b, [c == out.scope[edge.var].column(p) for c, p in zip(own, identity(binding), strict=True)]))
                out.df = out.df.drop(*binding.columns)
            else:
                self._kind(known[edge.var], "edge")
                out.keys.append((edge.var, identity(binding), tuple(f"{name}{p}" for p in identity(binding))))
                out.df = out.df.drop(*[c for c in binding.columns if "$p$" in c])
            del out.scope[name]
        return self._arrive(out, end, node, known, edge.var if not repeated else None, self._end_labels(edge, near, far, True))

    @staticmethod
    def _starts(out: Pattern, here: str | None, known: Scope, before: Element, rows: DataFrame | None) -> DataFrame | None:
        """The nodes from which walks go out ($a), if they are known; none: all."""
        if here is None:
            return None if rows is None else rows.select(known[before.var].column("$id").alias("$a")).where("`$a` is not null").distinct()
        return None if here.startswith("?") else out.df.select(F.col(f"`{here}`").alias("$a")).distinct()

    def _arrive(self, out: Pattern, end: str, pat: Element, known: Scope, hidden: str | None, ends) -> str:
        if pat.var is not None and pat.var in out.scope:
            self._kind(out.scope[pat.var], "node")
            out.df = out.df.where(F.col(f"`{end}`") == out.scope[pat.var].column("$id")).drop(end)
            self._pattern_tests(out, known, pat.var, pat, True, hidden)
            return f"{pat.var}$id"
        if pat.var in known:
            self._kind(known[pat.var], "node")
            out.keys.append((pat.var, ("$id",), (end,)))
            self._pattern_tests(out, known, pat.var, pat, True, hidden)
            return end
        name = pat.var or f"$n{next(_fresh)}"
        out.labels[name] = self.labels[name] = pat.labels
        if self._told(pat, ends):
            out.df = out.df.withColumnRenamed(end, f"{name}$id").withColumn(f"{name}$labels", F.lit(None).cast("array<string>"))
            out.scope[name] = Binding("node", name)
            return f"{name}$id"
        nodes, binding = self._nodes(name, pat, ends)
        out.df = out.df.join(nodes, F.col(f"`{end}`") == F.col(f"`{name}$id`"), "inner").drop(end)
        out.scope[name] = binding
        self._pattern_tests(out, known, name, pat, False, hidden)
        return f"{name}$id"

    # --- edges
    def _both_ways(self, pat: Element, props: list[str], start: str, end: str, near, far, ids=(None, None)) -> DataFrame:
        """Edges by the end where one comes from and the end where one gets to; a loop has one way only. ids: of either end."""
        parts = []
        for forward in self._ways(pat):
            tables = self._tables(pat, near, far, forward)
            for id, at in zip(ids, ("$src", "$dst") if forward else ("$dst", "$src"), strict=True):
                tables = tables if id is None else self.graph.edges_at(tables, at, id)
            scan = self.graph.scan_edges(pat.labels, props, tables)
            if not forward and pat.way == "any":
                scan = scan.where("`$src` <> `$dst`")
            parts.append(scan.withColumns({start: F.col("$src" if forward else "$dst"), end: F.col("$dst" if forward else "$src")}))
        return reduce(DataFrame.unionByName, parts)

    def _edges(self, pat: Element, name: str, start: str, end: str, near=None, far=None, ids=(None, None)) -> tuple[DataFrame, Binding]:
        kinds = self.graph.edge_props(pat.labels)
        props = self._asked(pat, kinds)
        scan = self._both_ways(pat, props, start, end, near, far, ids)
        columns = [F.col(c).alias(f"{name}{c}") for c in ("$src", "$type", "$dst", "$rank")] + [F.col(f"`{k}`").alias(f"{name}$p${k}") for k in props]
        return scan.select(start, end, *columns), Binding("edge", name, tuple((k, kinds[k]) for k in props))

    def _walks(self, pat: Element, name: str, start: str, end: str, starts: DataFrame | None) -> tuple[DataFrame, Binding]:
        """Walks of so many edges, one row each, from the nodes starts ($a) where these are known. Without a use of the edge
        variable no list is carried along. Short walks are one plan; of longer ones each length is a written table that the next
        one reads, and the walks end where none goes on, whatever the bound."""
        low, high = pat.hops
        local = f"$w{next(_fresh)}"
        hop, binding = self._edges(replace(pat, hops=None), local, "$a", "$b")
        own = {local: binding}
        for test in element_tests(pat, local):
            if not variables(test) <= set(own):
                raise GqlSyntaxError(f"unbound variable {next(iter(variables(test) - set(own)))}")
            hop = hop.where(Expressions(own, self.params).condition(test))
        listed = pat.var is not None and (pat.var in self.needs or "*" in self.needs)
        record = element_record(binding)
        hop = hop.select("$a", "$b", *([record.col.alias("$edge")] if listed else []))
        kind = T.ArrayType(record.type)
        if not self.graph.complete:
            # a walk passes only through nodes that exist
            there = self.graph.scan_nodes(None, []).select(F.col("$id").alias("$b"))
            hop = hop.join(there, "$b", "left_semi").select(*hop.columns)
        parts, walks = [], None
        if low == 0:
            stay = self.graph.scan_nodes(None, []).select(F.col("$id").alias("$a")) if starts is None else starts
            parts.append(stay.select(F.col("$a").alias(start), F.col("$a").alias(end), *([F.array().cast(kind).alias(name)] if listed else [])))
        for depth in range(1, high + 1):
            if walks is None:
                first = hop if starts is None else hop.join(starts, "$a", "left_semi")
                walks = first.select(F.col("$a").alias(start), F.col("$b").alias(end), *([F.array("$edge").alias(name)] if listed else []))
            else:
                longer = walks.join(hop, F.col(end) == F.col("$a"), "inner")
                walks = longer.select(start, F.col("$b").alias(end), *([F.concat(F.col(f"`{name}`"), F.array("$edge")).alias(name)] if listed else []))
            if high > PLAN_HOPS:
                walks = materialise(walks, "walks")
                if not walks.limit(1).count():
                    break
            if depth >= low:
                parts.append(walks)
        df = reduce(DataFrame.unionByName, parts or [walks.limit(0)])
        if not listed:
            df = df.withColumn(name, F.lit(None).cast(kind))
        return df, Binding("edges", name, type=kind)


def element_tests(pat: Element, name: str) -> list[Expr]:
    """The conditions of an element, of its variable under another name."""
    given = [Op("=", (Op("field", (var(name),), key), value)) for key, value in pat.given]
    return given + [renamed(t, pat.var, name) for t in pat.tests]


def has_exists(node: Expr) -> bool:
    return any(is_op(x, "exists") for x in nodes_of(node))


def renamed(node: Expr, old: str | None, new: str) -> Expr:
    """The expression with another name for a variable."""
    if old is None or old == new:
        return node
    return rewritten(node, lambda x: var(new, x.at) if is_var(x) and x.value == old else None)
