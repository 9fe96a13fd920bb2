"""Statements against versions of a graph: snapshots, transactions and attempts."""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import DataError, GqlSyntaxError, GraphError, InvalidParameter, SerializationConflict, translate
from .functions import values as V
from .gql.parser import parse
from .gql.tree import Bind, Change, Control, Find, Give, Keep, Query
from .operators.mutation import MAX_DOCUMENT, Mutator, document_limit
from .plans.expressions import Expressions
from .plans.matching import Matcher
from .plans.projection import project
from .plans.scope import Binding, needs
from .sources.graph import PropertyGraph

ATTEMPTS, BACKOFF = 5, 0.002


@dataclass
class Result:
    """rows is None for a statement without RETURN."""

    rows: DataFrame | None = None
    mutations: int = 0

    @property
    def columns(self) -> list[str]:
        return self.rows.columns if self.rows is not None else []

    def collect(self) -> list[tuple]:
        try:
            return [tuple(r) for r in self.rows.collect()] if self.rows is not None else []
        except Exception as e:
            raise translate(e) from e


def run(graph: PropertyGraph, query: Query, params: dict | None = None, max_document: int = MAX_DOCUMENT) -> tuple[Result, PropertyGraph]:
    """A query on one version; the version after it."""
    if query.graph not in (None, "default", graph.name, str(graph.number)):
        raise GqlSyntaxError(f"no graph {query.graph}")
    state = _Run(graph, query, params, max_document)
    for clause in query.clauses:
        getattr(state, type(clause).__name__.lower())(clause)
    return Result(state.out, state.mutator.count), state.mutator.graph


class _Run:
    """A query's binding table and scope from clause to clause."""

    def __init__(self, graph, query, params, max_document):
        self.matcher = Matcher(graph, needs(query), params or {})
        self.mutator = Mutator(self.matcher, max_document)
        self.df, self.scope, self.out = None, {}, None
        #: labels that variables were matched with, while these hold
        self.labels: dict = {}

    def rows(self) -> DataFrame:
        return self.matcher.graph.spark.range(1).select() if self.df is None else self.df

    def find(self, c: Find) -> None:
        fresh = {e.var: e.labels for p in c.paths for e in p if e.var and e.labels is not None and e.var not in self.scope}
        self.df, self.scope = self.matcher.match(self.df, self.scope, c)
        self.labels |= fresh

    def keep(self, c: Keep) -> None:
        self.df = self.matcher.filter(self.rows(), self.scope, c.tests)

    def bind(self, c: Bind) -> None:
        if c.each:
            v = Expressions(self.scope, self.matcher.params).value(c.value)
            if v.kind not in ("list", "null"):
                raise DataError(f"FOR needs a list, not {v.kind}")
            kind = v.type.elementType if v.kind == "list" else V.null().type
            items = v.col if v.kind == "list" else F.array().cast("array<void>")
            self.df = self.rows().select("*", F.explode(items).alias(c.var))
        else:
            df, marked, expr = self.matcher.marked(self.rows(), self.scope, c.value)
            v = Expressions(marked, self.matcher.params).value(expr)
            self.df, kind = df.withColumn(c.var, v.col), v.type
        self.scope = {**self.scope, c.var: Binding("value", c.var, type=kind)}

    def change(self, c: Change) -> None:
        if c.action == "insert":
            self.df, self.scope = self.mutator.insert(self.df, self.scope, c)
        elif c.action in ("set", "remove"):
            self.mutator.set(self.rows(), self.scope, c.targets, self.labels, c.action == "remove")
            if any(part == "label" for _, part, _, _ in c.targets):
                self.labels = {}
        else:
            self.mutator.delete(self.rows(), self.scope, c)

    def give(self, c: Give) -> None:
        self.out = project(self.matcher, self.rows(), self.scope, c)


def query(graph: PropertyGraph, text: str, params: dict | None = None) -> DataFrame:
    """The rows of a query that only reads."""
    statement = parse(text)
    if not isinstance(statement, Query):
        raise InvalidParameter("not a query")
    result, after = run(graph, statement, params)
    if result.mutations or after is not graph:
        raise InvalidParameter("the query changes the graph; use a session")
    if result.rows is None:
        raise GqlSyntaxError("the query returns nothing")
    return result.rows


class GraphStore:
    """The versions of a graph. A version is put in place only if the one it was made from is still the last."""

    def __init__(self, graph: PropertyGraph):
        self.version, self.graph = 0, graph
        self._lock = threading.Lock()

    def snapshot(self) -> tuple[int, PropertyGraph]:
        with self._lock:
            return self.version, self.graph

    def commit(self, base: int, graph: PropertyGraph) -> int:
        with self._lock:
            if base != self.version:
                raise SerializationConflict("the graph has changed since the transaction began")
            self.version, self.graph = base + 1, graph
            return self.version


class Session:
    def __init__(self, store, max_document: int = MAX_DOCUMENT):
        self.store = GraphStore(store) if isinstance(store, PropertyGraph) else store
        self.max_document = document_limit(max_document)
        self._open: tuple[int, PropertyGraph, bool] | None = None

    @property
    def in_transaction(self) -> bool:
        return self._open is not None

    def set_isolation(self, level: str) -> None:
        if level.upper() != "SERIALIZABLE":
            raise InvalidParameter("transactions are serializable only")

    def execute(self, text: str, params: dict | None = None) -> Result:
        statement = parse(text)
        if isinstance(statement, Control):
            return self._control(statement)
        return self._within(statement, params) if self._open is not None else self._alone(statement, params)

    def _control(self, statement: Control) -> Result:
        if statement.action == "start":
            if self._open is not None:
                raise InvalidParameter("a transaction is open already")
            self._open = (*self.store.snapshot(), statement.read_only)
        elif statement.action == "commit":
            if self._open is None:
                raise InvalidParameter("no transaction is open")
            (base, graph, _), self._open = self._open, None
            if graph is not self.store.snapshot()[1]:
                self.store.commit(base, graph)
        else:
            self._open = None
        return Result()

    def _within(self, statement, params) -> Result:
        """Within a transaction nothing is tried again, and any error ends it."""
        base, graph, read_only = self._open
        try:
            result, after = run(graph, statement, params, self.max_document)
            if read_only and result.mutations:
                raise InvalidParameter("the transaction is read only")
        except Exception as e:
            self._open = None
            raise translate(e) from e
        self._open = (base, after, read_only)
        return result

    def _alone(self, statement, params) -> Result:
        for attempt in range(1, ATTEMPTS + 1):
            base, graph = self.store.snapshot()
            try:
                result, after = run(graph, statement, params, self.max_document)
                if after is not graph:
                    self.store.commit(base, after)
                return result
            except GraphError as e:
                if not e.retryable or attempt == ATTEMPTS:
                    raise
                time.sleep(BACKOFF * 2 ** (attempt - 1))
            except Exception as e:
                raise translate(e) from e
        raise AssertionError("unreachable")
