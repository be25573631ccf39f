"""INSERT, SET, REMOVE and DELETE as new versions of the tables they touch."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.errors import AnalysisError, ConstraintError
from quiver.lang import ast as A
from quiver.plans.expressions import Expressions
from quiver.plans.scope import Binding, Frame, _common, ref
from quiver.sources.graph import EdgeTable, Graph, NodeTable
from quiver.sources.shared import cut_lineage


@dataclass
class Stats:
    nodes_created: int = 0
    edges_created: int = 0
    nodes_deleted: int = 0
    edges_deleted: int = 0
    properties_set: int = 0

    def __iadd__(self, other: Stats) -> Stats:
        for name in self.__dataclass_fields__:
            setattr(self, name, getattr(self, name) + getattr(other, name))
        return self


def stored_form(graph: Graph) -> Graph:
    """The graph with ids in place of native keys, so that any change fits any table."""
    if all(t.key == "_id" for t in graph.nodes.values()):
        return replace(graph, nodes=dict(graph.nodes), edges={k: list(v) for k, v in graph.edges.items()}, indexes=dict(graph.indexes))
    nodes = {n: NodeTable(t.labels, t.frame.select(t.id_of(ref(t.key)).alias("_id"), *(ref(p) for p in t.properties)), "_id", hidden=frozenset(["_id"])) for n, t in graph.nodes.items()}
    edges: dict[str, list[EdgeTable]] = {}
    for label, tables in graph.edges.items():
        for t in tables:
            source = graph.nodes[t.source_table].id_of(ref(t.source)) if t.source_table else ref(t.source)
            target = graph.nodes[t.target_table].id_of(ref(t.target)) if t.target_table else ref(t.target)
            rows = t.frame.select(F.concat(F.lit(t.prefix), ref(t.key).cast("string")).alias("_id"), source.alias("_src"), target.alias("_dst"), *(ref(p) for p in t.properties))
            edges.setdefault(label, []).append(EdgeTable(label, rows, "_id", "_src", "_dst", hidden=frozenset(["_id", "_src", "_dst"])))
    return Graph(graph.spark, graph.name, nodes, edges, False, dict(graph.indexes))


def _append(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Union by name; a property of two types takes their common one."""
    if old is None:
        return new
    have, more = ({f.name: f.dataType for f in d.schema.fields} for d in (old, new))
    of = {n: _common(have.get(n), more.get(n, have.get(n))) for n in {**have, **more}}
    cast = lambda d, names: d.select(*(ref(n).cast(of[n]).alias(n) for n in names))
    return cast(old, have).unionByName(cast(new, more), allowMissingColumns=True)


class Writer:
    """Applies writing clauses to a copy of the graph; the caller commits ``graph``."""

    def __init__(self, graph: Graph, version: int):
        self.graph, self.version, self.stats, self.touched = stored_form(graph), version, Stats(), []
        self.ordinal = 0

    def __call__(self, clause: A.Node, frame: Frame, compiler) -> Frame:
        if isinstance(clause, A.Insert):
            out = self.insert(clause, frame, compiler)
        elif isinstance(clause, A.Update):
            out = self.change(clause, frame, compiler)
        else:
            out = self.delete(clause, frame)
        # clauses that follow see the changed graph
        compiler.graph = compiler.matcher.graph = self.graph
        return out

    def new_id(self, element: int) -> Column:
        """A UUID from graph, version, element and row: replays give the same."""
        text = F.sha1(F.concat_ws("/", F.lit(self.graph.id), F.lit(str(self.version)), F.lit(str(element)), ref("_row").cast("string")).cast("binary"))
        return F.concat_ws("-", *(F.substring(text, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))

    def insert(self, clause: A.Insert, frame: Frame, compiler) -> Frame:
        rows = cut_lineage(frame.df.withColumn("_row", F.lit(0).cast("long") if frame.single else F.monotonically_increasing_id()))
        frame = Frame(rows, dict(frame.scope))
        compile_ = Expressions(frame.scope, compiler.parameters)
        columns: dict[str, Column] = {}
        added: dict[str, Binding] = {}
        new_nodes: list[tuple[str, tuple[str, ...], dict[str, Column]]] = []
        new_edges: list[tuple[str, str, str, str, dict[str, Column]]] = []
        n = rows.count()

        def values(properties) -> dict[str, Column]:
            out = {}
            for name, e in properties:
                value = compile_(e)
                out[name] = value.column.cast("string") if value.type == "null" else value.column
            return out

        for path in clause.paths:
            names = []
            for e in path.elements[0::2]:
                v = e.variable or compiler.matcher.hidden()
                names.append(v)
                if v in frame.scope or v in added:
                    continue
                self.ordinal += 1
                labels = tuple(sorted({x for group in e.labels for x in group}))
                properties = values(e.properties)
                columns[f"{v}$id"] = self.new_id(self.ordinal)
                added[v] = Binding("node", v, {}, ("&".join(labels),))
                new_nodes.append((v, labels, properties))
            for i, e in enumerate(path.elements[1::2]):
                if len(e.labels) != 1:
                    raise AnalysisError("a new edge needs one label")
                v = e.variable or compiler.matcher.hidden()
                self.ordinal += 1
                a, b = (names[i], names[i + 1]) if e.direction != "in" else (names[i + 1], names[i])
                columns[f"{v}$id"] = self.new_id(self.ordinal)
                added[v] = Binding("edge", v, {})
                new_edges.append((v, e.labels[0], a, b, values(e.properties)))
        for v, labels, properties in new_nodes:
            columns[f"{v}$labels"] = F.array(*map(F.lit, labels)) if labels else F.array().cast("array<string>")
            columns |= {f"{v}$p${k}": c for k, c in properties.items()}
        for v, label, _, _, properties in new_edges:
            columns[f"{v}$label"] = F.lit(label)
            columns |= {f"{v}$p${k}": c for k, c in properties.items()}
        df = rows.withColumns(columns) if columns else rows
        for v, _, a, b, _ in new_edges:
            df = df.withColumns({f"{v}$src": ref(f"{a}$id"), f"{v}$dst": ref(f"{b}$id")})
        df = cut_lineage(df)
        types = {f.name: f.dataType for f in df.schema.fields}
        for v, labels, properties in new_nodes:
            name = "&".join(labels)
            fresh = df.select(ref(f"{v}$id").alias("_id"), *(ref(f"{v}$p${k}").alias(k) for k in properties))
            old = self.graph.nodes.get(name)
            self.graph.nodes[name] = NodeTable(labels, _append(old.frame if old else None, fresh), "_id", hidden=frozenset(["_id"]))
            self.touched.append(fresh.select("_id"))
            added[v] = replace(added[v], properties={k: types[f"{v}$p${k}"] for k in properties})
            self.stats.nodes_created += n
        for v, label, _, _, properties in new_edges:
            fresh = df.select(ref(f"{v}$id").alias("_id"), ref(f"{v}$src").alias("_src"), ref(f"{v}$dst").alias("_dst"), *(ref(f"{v}$p${k}").alias(k) for k in properties))
            old = self.graph.edges.get(label)
            hidden = frozenset(["_id", "_src", "_dst"])
            merged = fresh
            for t in old or ():
                merged = _append(t.frame, merged)
            self.graph.edges[label] = [EdgeTable(label, merged, "_id", "_src", "_dst", hidden=hidden)]
            self.touched.append(fresh.select("_id"))
            added[v] = replace(added[v], properties={k: types[f"{v}$p${k}"] for k in properties})
            self.stats.edges_created += n
        return Frame(df.drop("_row"), {**frame.scope, **added})

    # -- SET, REMOVE

    def change(self, clause: A.Update, frame: Frame, compiler) -> Frame:
        compile_ = Expressions(frame.scope, compiler.parameters)
        by_variable: dict[str, dict[str, Column]] = {}
        whole: set[str] = set()
        labels: list[A.SetLabel] = []
        for item in clause.items:
            bound = compile_.binding(item.variable)
            if bound.kind not in ("node", "edge"):
                raise AnalysisError(f"{item.variable} is no node or edge")
            if isinstance(item, A.SetLabel):
                labels.append(item)
                continue
            changes = by_variable.setdefault(item.variable, {})
            if isinstance(item, A.SetProperty):
                value = compile_(item.value)
                changes[item.name] = value.column.cast("string") if value.type == "null" else value.column
            else:
                if not isinstance(item.value, A.MapOf):
                    raise AnalysisError("SET takes all properties from a map literal")
                whole.add(item.variable)
                changes |= {k: compile_(e).column for k, e in item.value.items}
        news = {f"_n{i}${k}": c for i, changes in enumerate(by_variable.values()) for k, c in changes.items()}
        df = cut_lineage(frame.df.withColumns(news)) if news else cut_lineage(frame.df)
        scope = dict(frame.scope)
        for i, (v, changes) in enumerate(by_variable.items()):
            bound = scope[v]
            # several rows for one entity: one of them wins, the same in every run
            delta = df.filter(bound.part("id").isNotNull()).groupBy(bound.part("id").alias("_id")).agg(F.max(F.struct(*(ref(f"_n{i}${k}").alias(k) for k in changes))).alias("_new"), F.count(F.lit(1)).alias("_rows")) if changes else df.filter(bound.part("id").isNotNull()).select(bound.part("id").alias("_id"), F.struct(F.lit(1)).alias("_new"), F.lit(1).alias("_rows")).dropDuplicates(["_id"])
            delta = cut_lineage(delta)
            self.touched.append(delta.select("_id"))
            self.stats.properties_set += len(changes) * df.filter(bound.part("id").isNotNull()).count()
            types = {f.name: f.dataType for f in delta.schema["_new"].dataType.fields} if changes else {}
            self._each(bound, lambda t, delta=delta, changes=changes, types=types, v=v: self._merged(t, delta, list(changes), types, v in whole))
            properties = dict(bound.properties) if v not in whole else {}
            for k in changes:
                of = df.schema[f"_n{i}${k}"].dataType
                df = df.withColumn(f"{bound.prefix}$p${k}", ref(f"_n{i}${k}"))
                properties[k] = of
            scope[v] = replace(bound, properties=properties)
        df = df.drop(*news)
        for item in labels:
            bound = scope[item.variable]
            ids = cut_lineage(df.filter(bound.part("id").isNotNull()).select(bound.part("id").alias("_id")).distinct())
            self.touched.append(ids)
            self._relabel(ids, item.label, clause.remove)
            now = F.array_remove(bound.part("labels"), item.label) if clause.remove else F.array_sort(F.array_union(bound.part("labels"), F.array(F.lit(item.label))))
            df = df.withColumn(f"{bound.prefix}$labels", now)
            scope[item.variable] = replace(bound, tables=())
        return Frame(df, scope)

    def _each(self, bound: Binding, change) -> None:
        if bound.kind == "node":
            for name, t in list(self.graph.nodes.items()):
                if not bound.tables or name in bound.tables:
                    self.graph.nodes[name] = replace(t, frame=change(t))
        else:
            for label, tables in list(self.graph.edges.items()):
                self.graph.edges[label] = [replace(t, frame=change(t)) for t in tables]

    def _merged(self, t: NodeTable | EdgeTable, delta: DataFrame, names: list[str], types: dict[str, T.DataType], whole: bool) -> DataFrame:
        """The table with the new values of the entities in the delta. A property new to the label appears if any row takes it."""
        joined = t.frame.join(delta, "_id", "left")
        hit = F.col("_rows").isNotNull()
        columns = []
        for f in t.frame.schema.fields:
            if f.name in names:
                of = _common(f.dataType, types[f.name]) if not isinstance(types[f.name], T.NullType) else f.dataType
                columns.append(F.when(hit, F.col("_new")[f.name].cast(of)).otherwise(ref(f.name).cast(of)).alias(f.name))
            else:
                columns.append(F.when(~hit, ref(f.name)).alias(f.name) if whole and f.name not in t.hidden else ref(f.name))
        columns += [F.col("_new")[n].alias(n) for n in names if n not in t.frame.columns]
        return joined.select(*columns)

    def _relabel(self, ids: DataFrame, label: str, remove: bool) -> None:
        moved: dict[tuple[str, ...], list[DataFrame]] = {}
        for name, t in list(self.graph.nodes.items()):
            if (label in t.labels) != remove:
                continue
            goal = tuple(x for x in t.labels if x != label) if remove else tuple(sorted({*t.labels, label}))
            moved.setdefault(goal, []).append(t.frame.join(ids, "_id", "left_semi"))
            self.graph.nodes[name] = replace(t, frame=t.frame.join(ids, "_id", "left_anti"))
        for goal, parts in moved.items():
            name = "&".join(goal)
            frame = self.graph.nodes[name].frame if name in self.graph.nodes else None
            for part in parts:
                frame = _append(frame, part)
            self.graph.nodes[name] = NodeTable(goal, frame, "_id", hidden=frozenset(["_id"]))

    # -- DELETE

    def delete(self, clause: A.Delete, frame: Frame) -> Frame:
        """Edges first, then nodes with all their edges."""
        df = cut_lineage(frame.df)
        nodes = edges = None
        for v in clause.variables:
            if v not in frame.scope:
                raise AnalysisError(f"unknown identifier {v}")
            bound = frame.scope[v]
            if bound.kind not in ("node", "edge"):
                raise AnalysisError(f"{v} is no node or edge")
            ids = df.filter(bound.part("id").isNotNull()).select(bound.part("id").alias("_id"))
            if bound.kind == "node":
                nodes = ids if nodes is None else nodes.union(ids)
            else:
                edges = ids if edges is None else edges.union(ids)
        if edges is not None:
            self._drop_edges(cut_lineage(edges.distinct()), ["_id"])
        if nodes is not None:
            ids = cut_lineage(nodes.distinct())
            self._drop_edges(ids, ["_src", "_dst"])
            for name, t in list(self.graph.nodes.items()):
                gone = t.frame.join(ids, "_id", "left_semi").count()
                if not gone:
                    continue
                self.stats.nodes_deleted += gone
                self.graph.nodes[name] = replace(t, frame=t.frame.join(ids, "_id", "left_anti"))
            self.touched.append(ids)
        return Frame(df, frame.scope)

    def _drop_edges(self, ids: DataFrame, ends: list[str]) -> None:
        for label, tables in list(self.graph.edges.items()):
            kept = []
            for t in tables:
                gone = ids.withColumnRenamed("_id", "_gone")
                if all(t.frame.join(gone, ref(end) == F.col("_gone"), "left_semi").isEmpty() for end in ends):
                    kept.append(t)  # rows and file stay
                    continue
                rest = t.frame
                for end in ends:
                    rest = rest.join(gone, ref(end) == F.col("_gone"), "left_anti")
                rest = cut_lineage(rest)
                self.stats.edges_deleted += t.frame.count() - rest.count()
                kept.append(replace(t, frame=rest))
            self.graph.edges[label] = kept
        if ends == ["_id"]:
            self.touched.append(ids)


def check_unique(graph: Graph) -> None:
    """No two nodes of a label agree on all properties of a unique index; a null agrees with nothing."""
    for index in graph.indexes.values():
        if not index.unique:
            continue
        rows = None
        for t in graph.node_tables(((index.label,),)):
            part = t.frame.select(*((ref(p).cast("string") if p in t.properties else F.lit(None).cast("string")).alias(p) for p in index.properties))
            rows = part if rows is None else rows.union(part)
        if rows is not None:
            some = rows.dropna().groupBy(*index.properties).count().filter("count > 1").limit(1)
            if not some.isEmpty():
                raise ConstraintError(f"unique index {index.name} has several nodes with one value")


def check_types(graph: Graph, types: tuple[A.TypeDeclaration, ...]) -> None:
    """Properties declared NOT NULL are there."""
    for declared in types:
        tables = [t for t in graph.nodes.values() if set(declared.labels) <= set(t.labels)] if declared.kind == "NODE" else [t for x in declared.labels for t in graph.edges.get(x, [])]
        for t in tables:
            for name, _, required in declared.properties:
                missing = t.frame.limit(1) if name not in t.properties else t.frame.filter(ref(name).isNull()).limit(1)
                if required and not missing.isEmpty():
                    raise ConstraintError(f"{':'.join(declared.labels)} needs {name}")
