"""Versions of graphs on disk: immutable Parquet files and one manifest for each version."""

from __future__ import annotations

import datetime
import json
import uuid
from dataclasses import asdict, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from quiver.errors import CatalogError, ConflictError
from quiver.lang.ast import TypeDeclaration
from quiver.sources.graph import EdgeTable, Graph, Index, NodeTable


class Store:
    """Graphs under a folder of any file system that Spark writes. A version is committed by creating its manifest, which only one writer can."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, *parts: str) -> str:
        return "\n".join(r[0] for r in self.spark.read.option("wholetext", True).text("/".join([self.root, *parts])).collect())

    def _names(self, *parts: str) -> list[str]:
        fs, path = self._fs(), self._path(*parts)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def graphs(self) -> list[str]:
        return [n for n in self._names() if n != "backups" and self.versions(n)]

    def versions(self, name: str) -> list[int]:
        return sorted(int(f[1:-5]) for f in self._names(name, "manifests") if f.startswith("v") and f.endswith(".json"))

    def commit(self, graph: Graph, version: int, types: tuple[TypeDeclaration, ...] = (), touched: list[DataFrame] | None = None) -> Graph:
        """Write the tables that changed, the ids of the entities that did, and the manifest; a version that is there already means that another writer was first."""
        known: dict[int, str] = getattr(graph, "_files", {})
        files: dict[int, str] = {}

        def put(frame: DataFrame) -> tuple[str, DataFrame]:
            if id(frame) in known:
                files[id(frame)] = known[id(frame)]
                return known[id(frame)], frame
            path = f"{self.root}/{graph.name}/data/{uuid.uuid4().hex}"
            frame.write.parquet(path)
            back = self.spark.read.schema(frame.schema).parquet(path)
            files[id(back)] = path
            return path, back

        ids = f"{self.root}/{graph.name}/data/{uuid.uuid4().hex}" if touched else None
        if ids:
            reduce(DataFrame.union, (t.select("_id") for t in touched)).write.parquet(ids)
        manifest: dict = {"version": version, "touched": ids, "types": [asdict(t) for t in types], "integrity": graph.integrity, "nodes": [], "edges": [], "indexes": [[i.name, i.label, list(i.properties), i.unique] for i in graph.indexes.values()]}
        nodes, edges = {}, {}
        for name, t in graph.nodes.items():
            path, frame = put(t.frame)
            nodes[name] = replace(t, frame=frame)
            manifest["nodes"].append([list(t.labels), t.key, t.prefix, sorted(t.hidden), path])
        for label, tables in graph.edges.items():
            for t in tables:
                path, frame = put(t.frame)
                edges.setdefault(label, []).append(replace(t, frame=frame))
                manifest["edges"].append([label, t.key, t.source, t.target, t.source_table, t.target_table, t.prefix, sorted(t.hidden), path])
        try:
            out = self._fs().create(self._path(graph.name, "manifests", f"v{version}.json"), False)
        except Exception as problem:
            raise ConflictError(f"version {version} of {graph.name} is committed already") from problem
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        saved = replace(graph, nodes=nodes, edges=edges)
        saved._files = files
        return saved

    def load(self, name: str, version: int | None = None) -> tuple[Graph, int]:
        """A version of a graph, the last one by default: a snapshot that later commits don't change."""
        known = self.versions(name)
        if not known or version is not None and version not in known:
            raise CatalogError(f"graph {name} not found")
        version = known[-1] if version is None else version
        return self._graph(name, self._manifest(name, version)), version

    def _manifest(self, name: str, version: int) -> dict:
        return json.loads(self._read(name, "manifests", f"v{version}.json"))

    def types(self, name: str, version: int) -> tuple[TypeDeclaration, ...]:
        """Types of nodes and edges declared for the graph."""
        tuples = lambda x: tuple(tuples(y) for y in x) if isinstance(x, list) else x
        return tuple(TypeDeclaration(**{k: tuples(v) for k, v in t.items()}) for t in self._manifest(name, version).get("types", ()))

    def touched(self, name: str, version: int) -> list[DataFrame]:
        """Ids of the entities that a version changed."""
        path = self._manifest(name, version).get("touched")
        return [self.spark.read.schema("_id string").parquet(path)] if path else []

    def _graph(self, name: str, manifest: dict) -> Graph:
        graph = Graph(self.spark, name, integrity=manifest["integrity"], indexes={i[0]: Index(i[0], i[1], tuple(i[2]), i[3]) for i in manifest["indexes"]})
        files: dict[int, str] = {}
        for labels, key, prefix, hidden, path in manifest["nodes"]:
            frame = self.spark.read.parquet(path)
            files[id(frame)] = path
            graph.nodes["&".join(labels)] = NodeTable(tuple(labels), frame, key, prefix, frozenset(hidden))
        for label, key, source, target, source_table, target_table, prefix, hidden, path in manifest["edges"]:
            frame = self.spark.read.parquet(path)
            files[id(frame)] = path
            graph.edges.setdefault(label, []).append(EdgeTable(label, frame, key, source, target, source_table, target_table, prefix, frozenset(hidden)))
        graph._files = files
        return graph

    def drop(self, name: str) -> None:
        self._fs().delete(self._path(name), True)

    def vacuum(self, name: str, keep: int = 1) -> int:
        """Drop all but the last versions and the files that only they use; returns the number of versions dropped."""
        known = self.versions(name)
        gone, kept = known[:-keep], known[-keep:]
        used = {row[-1].rsplit("/", 1)[-1] for v in kept for kind in ("nodes", "edges") for row in self._manifest(name, v)[kind]}
        used |= {path.rsplit("/", 1)[-1] for v in kept if (path := self._manifest(name, v).get("touched"))}
        for backup in self.backups():
            used |= {row[-1].rsplit("/", 1)[-1] for kind in ("nodes", "edges") for row in json.loads(self._read("backups", backup))[kind]}
        for v in gone:
            self._fs().delete(self._path(name, "manifests", f"v{v}.json"), False)
        for f in self._names(name, "data"):
            if f not in used:
                self._fs().delete(self._path(name, "data", f), True)
        return len(gone)

    # -- backups: a copy of the manifest is enough, as files never change

    def backup(self, name: str, label: str = "backup") -> str:
        _, version = self.load(name)
        manifest = json.loads(self._read(name, "manifests", f"v{version}.json")) | {"graph": name}
        title = f"{datetime.datetime.now():%Y%m%d_%H%M%S}_{label}"
        out = self._fs().create(self._path("backups", title), False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        return title

    def backups(self) -> list[str]:
        """Newest first."""
        return [n for n in reversed(self._names("backups")) if not n.startswith(".")]

    def delete_backup(self, title: str) -> bool:
        return self._fs().delete(self._path("backups", title), False)

    def restore(self, title: str) -> Graph:
        manifest = json.loads(self._read("backups", title))
        return self._graph(manifest["graph"], manifest)
