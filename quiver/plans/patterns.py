"""Patterns to joins."""

from __future__ import annotations

from dataclasses import replace
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quiver.errors import AnalysisError
from quiver.lang import ast as A
from quiver.plans.expressions import Expressions
from quiver.plans.scope import Binding, Frame, _common, bind_nodes, ref
from quiver.sources.graph import EdgeTable, Graph, NodeTable
from quiver.sources.shared import cut_lineage

#: Levels between two cuts of the lineage while a path grows without a bound.
LEVELS_PER_CUT = 3


class Matcher:
    """Extends frames by patterns. ``wanted``: properties used per variable, None for all of them."""

    def __init__(self, graph: Graph, parameters: dict, wanted: dict[str, set[str] | None]):
        self.graph, self.parameters, self.wanted = graph, parameters, wanted
        self.fresh = count()

    def hidden(self) -> str:
        return f"_{next(self.fresh)}"

    def needs(self, name: str) -> set[str] | None:
        return self.wanted.get(name, set())

    def match(self, frame: Frame, paths: tuple[A.Path, ...], where: A.Node | None) -> Frame:
        """All paths; a path that shares a variable with what is there grows from it, others are crossed."""
        left = list(paths)
        while left:
            bound = [p for p in left if any(getattr(e, "variable", None) in frame.scope for e in p.elements)]
            path = bound[0] if bound else left[0]
            left.remove(path)
            frame = self.path(frame, path)
        return frame

    # -- one path

    def path(self, frame: Frame, path: A.Path) -> Frame:
        elements = [replace(e, variable=e.variable or self.hidden()) for e in path.elements]
        for e, given in zip(elements, path.elements, strict=True):
            if given.variable is None:
                self.wanted[e.variable] = {name for name, _ in e.properties}
        nodes, edges = elements[0::2], elements[1::2]
        if path.shortest:
            return self.shortest(frame, path, elements)
        start = next((i for i, n in enumerate(nodes) if n.variable in frame.scope), None)
        if start is None:
            start = 0
            frame = self.scan(frame, nodes[0])
        frame = self.check(frame, nodes[start])
        order = [(i, i + 1) for i in range(start, len(edges))] + [(i + 1, i) for i in range(start - 1, -1, -1)]
        for here, there in order:
            edge = edges[min(here, there)]
            flipped = edge if here < there else replace(edge, direction={"out": "in", "in": "out", "both": "both"}[edge.direction])
            frame = self.repeat(frame, nodes[here], flipped, nodes[there], path.mode, bool(path.variable)) if edge.quantifier else self.expand(frame, nodes[here], flipped, nodes[there])
        return self.name_path(frame, path, elements) if path.variable else frame

    def name_path(self, frame: Frame, path: A.Path, elements: list[A.Node]) -> Frame:
        nodes, edges = [], []
        for i, e in enumerate(elements):
            bound = frame.scope.get(e.variable)
            if isinstance(e, A.NodePattern):
                if i == 0 or not elements[i - 1].quantifier:
                    nodes.append(F.array(bound.part("id")))
            elif e.quantifier:
                # the repeated part holds the nodes behind its start, in the order walked
                nodes.append(ref(f"{e.variable}$walk")), edges.append(ref(e.variable))
            else:
                edges.append(F.array(bound.part("id")))
        empty = F.array().cast("array<string>")
        p = path.variable
        df = frame.df.withColumns({f"{p}$nodes": F.concat(*nodes), f"{p}$edges": F.concat(*edges) if edges else empty})
        return frame.with_df(df, **{p: Binding("path", p)})

    # -- nodes

    def conditions(self, frame: Frame, element: A.Node) -> Frame:
        """Inline properties and the inline condition."""
        compile_ = Expressions(frame.scope, self.parameters)
        for name, value in element.properties:
            frame = frame.with_df(frame.df.filter(compile_(A.Binary("=", A.Property(A.Variable(element.variable), name), value)).column))
        if element.where is not None:
            frame = frame.with_df(frame.df.filter(compile_.predicate(element.where)))
        return frame

    def scan(self, frame: Frame, node: A.NodePattern) -> Frame:
        rows, bound = bind_nodes(self.graph.node_tables(node.labels), node.variable, self.needs(node.variable), self.graph.spark)
        return Frame(rows if frame.single else frame.df.crossJoin(rows), {**frame.scope, node.variable: bound})

    def check(self, frame: Frame, node: A.NodePattern) -> Frame:
        """Labels and conditions of a node that is bound."""
        bound = frame.scope[node.variable]
        if bound.kind != "node":
            raise AnalysisError(f"{node.variable} is no node")
        good = {t.name for t in self.graph.node_tables(node.labels)}
        if not set(bound.tables) <= good:
            df = frame.df
            for group in node.labels:
                df = df.filter(F.arrays_overlap(bound.part("labels"), F.array(*map(F.lit, group))))
            frame = frame.with_df(df)
        return self.conditions(frame, node)

    # -- edges

    def ways(self, edge: A.EdgePattern, near: Binding, far: list[NodeTable] | None) -> list[tuple[EdgeTable, bool]]:
        """Edge tables that can connect the two sides, and whether they are walked from target to source."""
        names = None if far is None else {t.name for t in far}
        out = []
        for table in self.graph.edge_tables(edge.labels):
            for back in {"out": (False,), "in": (True,), "both": (False, True)}[edge.direction]:
                a, b = (table.target_table, table.source_table) if back else (table.source_table, table.target_table)
                if (a is None or not near.tables or a in near.tables) and (b is None or names is None or b in names):
                    out.append((table, back))
        return out

    def steps(self, ways: list[tuple[EdgeTable, bool]], prefix: str, both: bool, wanted: set[str] | None, native: tuple[bool, bool]) -> tuple[DataFrame | None, Binding]:
        """Rows of edges with ``near`` and ``far`` ends; a loop is walked once. ``native``: ends as keys of their tables."""
        properties: dict[str, T.DataType] = {}
        for t, _ in ways:
            for name, of in t.properties.items():
                if wanted is None or name in wanted:
                    properties[name] = _common(properties.get(name), of)
        out = None
        for t, back in ways:
            source, target = self._end(t, "source"), self._end(t, "target")
            near, far = (target, source) if back else (source, target)
            keys = (ref(t.target), ref(t.source)) if back else (ref(t.source), ref(t.target))
            rows = t.frame
            if both and back:
                rows = rows.filter(~source.eqNullSafe(target))
            part = rows.select(
                (keys[0] if native[0] else near).alias(f"{prefix}$near"), (keys[1] if native[1] else far).alias(f"{prefix}$far"),
                F.concat(F.lit(t.prefix), ref(t.key).cast("string")).alias(f"{prefix}$id"), source.alias(f"{prefix}$src"), target.alias(f"{prefix}$dst"), F.lit(t.label).alias(f"{prefix}$label"),
                *((ref(p).cast(of) if p in t.properties else F.lit(None).cast(of)).alias(f"{prefix}$p${p}") for p, of in properties.items()),
            )
            out = part if out is None else out.union(part)
        return out, Binding("edge", prefix, properties)

    def _end(self, t: EdgeTable, which: str) -> Column:
        column, table = (t.source, t.source_table) if which == "source" else (t.target, t.target_table)
        return self.graph.nodes[table].id_of(ref(column)) if table else ref(column).cast("string")

    def nothing(self, prefix: str) -> DataFrame:
        names = ["near", "far", "id", "src", "dst", "label"]
        return self.graph.spark.createDataFrame([], T.StructType([T.StructField(f"{prefix}${n}", T.StringType()) for n in names]))

    def expand(self, frame: Frame, near: A.NodePattern, edge: A.EdgePattern, far: A.NodePattern) -> Frame:
        """One hop. Ends join on the native keys of their tables where both sides have only one, else on ids."""
        here = frame.scope[near.variable]
        bound = frame.scope.get(far.variable)
        tables = self.graph.node_tables(far.labels)
        ways = self.ways(edge, here, [t for t in tables if bound is None or not bound.tables or t.name in bound.tables])
        ends = {(t.source_table, t.target_table)[::-1] if back else (t.source_table, t.target_table) for t, back in ways}
        single = len(ends) == 1
        near_table, far_table = next(iter(ends)) if single else (None, None)
        near_native = single and near_table is not None and here.keyed
        far_native = single and far_table is not None and (bound is None or bound.keyed)
        name = edge.variable
        rows, edge_binding = self.steps(ways, name, edge.direction == "both", self.needs(name), (near_native, far_native))
        rows = self.nothing(name) if rows is None else rows
        again = frame.scope.get(name)
        if again is not None:
            raise AnalysisError(f"edge {name} is bound already")
        condition = here.part("key" if near_native else "id") == ref(f"{name}$near")
        if bound is not None:
            condition = condition & (bound.part("key" if far_native else "id") == ref(f"{name}$far"))
        joined = Frame(frame.df.join(rows, condition), {**frame.scope, name: edge_binding})
        joined = self.conditions(joined, edge)
        if bound is not None:
            out = self.check(joined, far)
            return out.with_df(out.df.drop(f"{name}$near", f"{name}$far"))
        return self.arrive(joined, f"{name}$far", far, [t for t in tables if not single or far_table in (None, t.name)], far_native, far_table)

    def arrive(self, frame: Frame, far: str, node: A.NodePattern, tables: list[NodeTable], native: bool, table: str | None) -> Frame:
        """Bind the node at the far end; without any use of its properties an edge is proof enough that it is there."""
        wanted = self.needs(node.variable)
        v = node.variable
        if self.graph.integrity and native and wanted == set() and not node.properties and node.where is None and [t.name for t in tables] == [table]:
            t = tables[0]
            df = frame.df.withColumns({f"{v}$id": t.id_of(ref(far)), f"{v}$labels": F.array(*map(F.lit, t.labels)), f"{v}$key": ref(far)}).drop(far.replace("$far", "$near"), far)
            return frame.with_df(df, **{v: Binding("node", v, {}, (t.name,), True)})
        rows, bound = bind_nodes(tables, v, wanted, self.graph.spark)
        key = bound.part("key" if native and bound.keyed else "id")
        df = frame.df.join(rows, ref(far) == key).drop(far.replace("$far", "$near"), far)
        return self.conditions(frame.with_df(df, **{v: bound}), node)

    # -- repeated edges

    def repeat(self, frame: Frame, near: A.NodePattern, edge: A.EdgePattern, far: A.NodePattern, mode: str | None, walk: bool) -> Frame:
        """An edge m to n times. The variable holds the ids of the edges walked; a trail, the default, repeats none."""
        low, high = edge.quantifier
        mode = mode or "TRAIL"
        if high is None and mode == "WALK":
            raise AnalysisError("a WALK needs an upper bound")
        name, here = edge.variable, frame.scope[near.variable]
        bound = frame.scope.get(far.variable)
        if bound is not None:
            other = self.hidden()
            frame = self.repeat(frame, near, edge, replace(far, variable=other), mode, walk)
            return self.check(frame.with_df(frame.df.filter(ref(f"{other}$id") == bound.part("id"))), far)
        step_name = self.hidden()
        ways = [(t, back) for t in self.graph.edge_tables(edge.labels) for back in {"out": (False,), "in": (True,), "both": (False, True)}[edge.direction]]
        rows, _ = self.steps(ways, step_name, edge.direction == "both", {p for p, _ in edge.properties} | _owned(edge.where, edge.variable), (False, False))
        steps = rows if rows is not None else self.nothing(step_name)
        inline = replace(edge, variable=step_name, where=_rename(edge.where, edge.variable, step_name))
        step_frame = self.conditions(Frame(steps, {step_name: self.steps(ways, step_name, False, None, (False, False))[1]}), inline) if rows is not None else Frame(steps)
        steps = step_frame.df.select(f"`{step_name}$near`", f"`{step_name}$far`", f"`{step_name}$id`")
        empty = F.array().cast("array<string>")
        level = frame.df.withColumns({"_at": here.part("id"), name: empty, f"{name}$walk": empty})
        found = [level] if low == 0 else []
        depth = 0
        while high is None or depth < high:
            depth += 1
            joined = level.join(steps, ref("_at") == ref(f"{step_name}$near"))
            step, to = ref(f"{step_name}$id"), ref(f"{step_name}$far")
            if mode == "TRAIL":
                joined = joined.filter(~F.array_contains(ref(name), step))
            elif mode in ("ACYCLIC", "SIMPLE"):
                again = F.array_contains(ref(f"{name}$walk"), to)
                closed = F.exists(ref(f"{name}$walk"), lambda x: x == here.part("id"))
                # a simple path may end where it began, and goes no further then
                joined = joined.filter(~again & (~closed if mode == "SIMPLE" else (to != here.part("id"))))
            level = joined.withColumns({"_at": to, name: F.concat(ref(name), F.array(step)), f"{name}$walk": F.concat(ref(f"{name}$walk"), F.array(to))}).select(*level.columns)
            if high is None and depth % LEVELS_PER_CUT == 0:
                level = cut_lineage(level)
                if level.isEmpty():
                    break
            if depth >= low:
                found.append(level)
        out = found[0]
        for more in found[1:]:
            out = out.union(more)
        frame = frame.with_df(out.withColumnRenamed("_at", f"{name}$far"), **{name: Binding("value", name, type="list", element="str")})
        return self.arrive(frame, f"{name}$far", far, self.graph.node_tables(far.labels), False, None)

    # -- shortest paths

    def shortest(self, frame: Frame, path: A.Path, elements: list[A.Node]) -> Frame:
        """Breadth first, level by level: a pair of ends is kept at the first level that reaches it."""
        if len(elements) != 3:
            raise AnalysisError("a shortest path has one edge pattern between two nodes")
        first, edge, last = elements
        low, high = edge.quantifier or (1, 1)
        if first.variable not in frame.scope:
            frame = self.scan(frame, first)
        frame = self.check(frame, first)
        here, name = frame.scope[first.variable], edge.variable
        step_name = self.hidden()
        ways = [(t, back) for t in self.graph.edge_tables(edge.labels) for back in {"out": (False,), "in": (True,), "both": (False, True)}[edge.direction]]
        rows, binding = self.steps(ways, step_name, edge.direction == "both", None if edge.where is not None else {p for p, _ in edge.properties}, (False, False))
        if rows is None:
            rows = self.nothing(step_name)
        inline = replace(edge, variable=step_name, where=_rename(edge.where, edge.variable, step_name))
        steps = self.conditions(Frame(rows, {step_name: binding}), inline).df.select(ref(f"{step_name}$near").alias("_near"), ref(f"{step_name}$far").alias("_far"), ref(f"{step_name}$id").alias("_step"))
        empty = F.array().cast("array<string>")
        level = frame.df.select(here.part("id").alias("_from")).distinct().select("_from", F.col("_from").alias("_to"), empty.alias("_edges"), empty.alias("_walk"))
        seen = level.select("_from", "_to")
        kept = [level] if low == 0 else []
        depth = 0
        one = Window.partitionBy("_from", "_to").orderBy("_edges")
        while high is None or depth < high:
            depth += 1
            grown = level.join(steps, F.col("_to") == F.col("_near")).select("_from", F.col("_far").alias("_to"), F.concat("_edges", F.array("_step")).alias("_edges"), F.concat("_walk", F.array("_far")).alias("_walk"))
            grown = grown.join(seen, ["_from", "_to"], "left_anti")
            if path.shortest == "any":
                grown = grown.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n")
            level = cut_lineage(grown)
            if level.isEmpty():
                break
            kept.append(level)
            seen = seen.union(level.select("_from", "_to").distinct())
        paths = kept[0] if kept else level
        for more in kept[1:]:
            paths = paths.union(more)
        paths = paths.filter(F.size("_edges") >= low).select("_from", F.col("_to").alias(f"{name}$far"), F.col("_edges").alias(name), F.col("_walk").alias(f"{name}$walk"))
        joined = frame.df.join(paths, here.part("id") == F.col("_from")).drop("_from")
        frame = frame.with_df(joined, **{name: Binding("value", name, type="list", element="str")})
        if last.variable in frame.scope:
            bound = frame.scope[last.variable]
            frame = self.check(frame.with_df(frame.df.filter(ref(f"{name}$far") == bound.part("id"))), last)
        else:
            frame = self.arrive(frame, f"{name}$far", last, self.graph.node_tables(last.labels), False, None)
        return self.name_path(frame, path, [first, replace(edge, quantifier=(low, high)), last]) if path.variable else frame


def _owned(e: A.Node | None, variable: str) -> set[str]:
    return {x.name for x in A.walk(e) if isinstance(x, A.Property) and x.owner == A.Variable(variable)}


def _rename(e: A.Node | None, old: str, new: str) -> A.Node | None:
    from quiver.plans.expressions import substitute

    return None if e is None else substitute(e, {A.Variable(old): A.Variable(new)})
