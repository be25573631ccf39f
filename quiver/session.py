"""The way in: named graphs, queries, transactions."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quiver.errors import AnalysisError, CatalogError, ConflictError
from quiver.lang import ast as A
from quiver.lang.parser import is_write, parse
from quiver.operators.mutations import Stats, Writer, check_types, check_unique
from quiver.plans.compiler import Compiler
from quiver.sources.graph import Graph, Index, graph_id
from quiver.sources.shared import cut_lineage
from quiver.sources.store import Store

#: Rows of a chunk of a streamed result.
CHUNK = 256


@dataclass
class _Entry:
    graph: Graph
    version: int = 0
    types: tuple[A.TypeDeclaration, ...] = ()


class Session:
    """Graphs by name, in memory or, with a root folder, in a store of versions."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.store = Store(spark, root) if root else None
        self.entries: dict[str, _Entry] = {}
        self.types: dict[str, tuple[A.TypeDeclaration, ...]] = {}
        self.commits: dict[str, list[tuple[int, list[DataFrame]]]] = {}
        self.stats = Stats()
        self._open: dict[str, tuple[_Entry, list[tuple[str, dict]], list[DataFrame]]] = {}
        for name in self.store.graphs() if self.store else ():
            self._load(name)

    def _load(self, name: str) -> None:
        graph, version = self.store.load(name)
        self.entries[name] = _Entry(graph, version, self.store.types(name, version))

    def _refresh(self, name: str) -> None:
        """Take up what other sessions have committed to the store."""
        if self.store and name not in self._open:
            known = self.store.versions(name)
            if known and (name not in self.entries or self.entries[name].version < known[-1]):
                self._load(name)

    def register(self, graph: Graph) -> Graph:
        """Make a graph known under its name; its tables stay where they are."""
        self.entries[graph.name] = _Entry(graph)
        return graph

    def graph(self, name: str) -> Graph:
        return self._entry(name).graph

    def _entry(self, name: str) -> _Entry:
        if name in self._open:
            return self._open[name][0]
        if name not in self.entries:
            raise CatalogError(f"graph '{name}' not found")
        return self.entries[name]

    # -- queries

    def query(self, text: str, graph: str = "default", parameters: dict[str, Any] | None = None) -> DataFrame:
        """Run a program; the result is that of its last statement. Nothing runs before the rows are asked for, except writes."""
        self.stats, out = Stats(), self._message("no statement")
        for statement in parse(text).statements:
            out = self.run(statement, text, graph, parameters or {})
        return out

    def stream(self, text: str, graph: str = "default", parameters: dict[str, Any] | None = None, chunk: int = CHUNK) -> Iterator[list]:
        """Rows of the result in chunks, without ever holding all of them."""
        part: list = []
        for row in self.query(text, graph, parameters).toLocalIterator():
            part.append(row)
            if len(part) == chunk:
                yield part
                part = []
        if part:
            yield part

    def run(self, statement: A.Node, text: str, graph: str, parameters: dict[str, Any]) -> DataFrame:
        if isinstance(statement, A.Query | A.SetOperation):
            if is_write(statement):
                return self._write(statement, text, graph, parameters)
            if graph not in self.entries and graph == "default" and not any(isinstance(x, A.Match | A.Procedure) for x in A.walk(statement)):
                return Compiler(Graph(self.spark, graph), parameters, graphs=self.graph).query(statement)
            return Compiler(self._entry(graph).graph, parameters, graphs=self.graph).query(statement)
        return getattr(self, f"_{type(statement).__name__.lower()}")(statement, graph)

    def _message(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(text,)], "result string")

    def _write(self, statement: A.Node, text: str, name: str, parameters: dict[str, Any]) -> DataFrame:
        self._refresh(name)
        if name not in self.entries and name not in self._open:
            self.entries[name] = _Entry(Graph(self.spark, name))
        entry = self._entry(name)
        writer = Writer(entry.graph, entry.version + 1)
        writer.ordinal = self._ordinal = getattr(self, "_ordinal", 0) + 1000 if name in self._open else 0
        rows = Compiler(writer.graph, parameters, writer, self.graph).query(statement)
        self.stats += writer.stats
        last = statement.clauses[-1]
        if not isinstance(last, A.Projection):
            what = {A.Insert: ("created", writer.stats.nodes_created + writer.stats.edges_created), A.Update: ("modified", writer.stats.properties_set), A.Delete: ("deleted", writer.stats.nodes_deleted + writer.stats.edges_deleted)}[type(last)]
            rows = self.spark.createDataFrame([(what[1],)], f"{what[0]} long")
        else:
            rows = cut_lineage(rows)
        if name in self._open:
            _, log, touched = self._open[name]
            fresh = self._settled(writer.graph, entry)
            self._open[name] = (replace(entry, graph=fresh), [*log, (statement, parameters)], [*touched, *writer.touched])
            return rows
        self._commit(name, entry, writer.graph, writer.touched)
        return rows

    def _settled(self, graph: Graph, entry: _Entry) -> Graph:
        """The graph with the rows of its changed tables at rest, after all constraints hold."""
        old = entry.graph
        known = {id(t.frame) for t in [*old.nodes.values(), *(t for ts in old.edges.values() for t in ts)]}
        rest = lambda t: t if id(t.frame) in known else replace(t, frame=cut_lineage(t.frame))
        graph = replace(graph, nodes={n: rest(t) for n, t in graph.nodes.items()}, edges={k: [rest(t) for t in v] for k, v in graph.edges.items()})
        check_unique(graph)
        check_types(graph, entry.types)
        return graph

    def _commit(self, name: str, entry: _Entry, graph: Graph, touched: list[DataFrame]) -> None:
        version = entry.version + 1
        if self.store:
            check_unique(graph), check_types(graph, entry.types)
            graph = self.store.commit(graph, version, entry.types, touched)
        else:
            graph = self._settled(graph, entry)
        self.entries[name] = _Entry(graph, version, entry.types)
        self.commits.setdefault(name, []).append((version, touched))

    # -- transactions

    def _transaction(self, t: A.Transaction, name: str) -> DataFrame:
        if t.action == "BEGIN":
            self.begin(name)
        elif t.action == "COMMIT":
            self.commit(name)
        else:
            self.rollback(name)
        return self._message(t.action)

    def begin(self, name: str = "default") -> None:
        """Further statements on the graph see this version and their own writes."""
        if name in self._open:
            raise AnalysisError("a transaction is open already")
        self._refresh(name)
        if name not in self.entries:
            self.entries[name] = _Entry(Graph(self.spark, name))
        self._open[name] = (self.entries[name], [], [])

    def commit(self, name: str = "default") -> None:
        """First committer wins: an entity that another commit since the begin also wrote makes this one fail. Else the statements are applied to the newest version."""
        if name not in self._open:
            raise AnalysisError("no transaction is open")
        entry, log, touched = self._open.pop(name)
        self._refresh(name)
        head = self.entries[name]
        if not log:
            return
        if head.version == entry.version:
            self._commit(name, entry, entry.graph, touched)
            return
        since = ((v, self.store.touched(name, v)) for v in self.store.versions(name)) if self.store else self.commits.get(name, [])
        for version, others in since:
            if version <= entry.version:
                continue
            for mine in touched:
                for other in others:
                    if not mine.join(other, "_id", "left_semi").limit(1).isEmpty():
                        raise ConflictError(f"another transaction has changed {name}")
        for statement, parameters in log:
            self._write(statement, "", name, parameters)

    def rollback(self, name: str = "default") -> None:
        if self._open.pop(name, None) is None:
            raise AnalysisError("no transaction is open")

    @contextmanager
    def transaction(self, name: str = "default"):
        self.begin(name)
        try:
            yield self
        except BaseException:
            self.rollback(name)
            raise
        self.commit(name)

    def at(self, name: str, version: int) -> Graph:
        """A snapshot of an earlier version, from the store."""
        if not self.store:
            raise CatalogError("versions are kept in a store only")
        return self.store.load(name, version)[0]

    # -- catalog

    def _creategraph(self, c: A.CreateGraph, _: str) -> DataFrame:
        if c.type_only:
            if c.name in self.types and not c.if_not_exists:
                raise CatalogError(f"graph type '{c.name}' already exists")
            self.types.setdefault(c.name, c.types)
            return self._message(f"Graph type '{c.name}' created")
        if c.name in self.entries:
            if not c.if_not_exists:
                raise CatalogError(f"graph '{c.name}' already exists")
            return self._message(f"Graph '{c.name}' already exists")
        self.entries[c.name] = _Entry(Graph(self.spark, c.name), 0, c.types)
        if self.store:
            self.entries[c.name].graph = self.store.commit(self.entries[c.name].graph, 0, c.types)
        return self._message(f"Graph '{c.name}' created")

    def _dropgraph(self, d: A.DropGraph, _: str) -> DataFrame:
        if d.name not in self.entries:
            if not d.if_exists:
                raise CatalogError(f"graph '{d.name}' not found")
            return self._message(f"Graph '{d.name}' does not exist")
        del self.entries[d.name]
        self.commits.pop(d.name, None)
        if self.store:
            self.store.drop(d.name)
        return self._message(f"Graph '{d.name}' dropped")

    def _listgraphs(self, _: A.ListGraphs, __: str) -> DataFrame:
        return self.spark.createDataFrame([(n, graph_id(n)) for n in sorted(self.entries)], "name string, id string")

    def _createindex(self, c: A.CreateIndex, name: str) -> DataFrame:
        self._refresh(name)
        if name not in self.entries:
            self.entries[name] = _Entry(Graph(self.spark, name))
        graph = self._entry(name).graph
        if c.name in graph.indexes:
            if not c.if_not_exists:
                raise CatalogError(f"index '{c.name}' already exists")
            return self._message(f"Index '{c.name}' already exists")
        self._redeclare(name, {**graph.indexes, c.name: Index(c.name, c.label, c.properties, c.unique)})
        return self._message(f"Index '{c.name}' created")

    def _dropindex(self, d: A.DropIndex, name: str) -> DataFrame:
        self._refresh(name)
        indexes = self._entry(name).graph.indexes
        if d.name in indexes:
            self._redeclare(name, {k: v for k, v in indexes.items() if k != d.name})
        return self._message(f"Index '{d.name}' dropped")

    def _redeclare(self, name: str, indexes: dict[str, Index]) -> None:
        """A version with other indexes; tables and files stay."""
        entry = self._entry(name)
        graph = replace(entry.graph, indexes=indexes)
        check_unique(graph)
        if name in self._open:
            entry.graph.indexes.clear()
            entry.graph.indexes.update(indexes)
            return
        if self.store:
            graph._files = getattr(entry.graph, "_files", {})
            self._commit(name, entry, graph, [])
        else:
            self.entries[name] = replace(entry, graph=graph)
