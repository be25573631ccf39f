"""Queries to DataFrames: each clause turns the frame before it into the next."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.errors import AnalysisError
from quiver.functions.aggregates import aggregate
from quiver.functions.scalar import Typed
from quiver.lang import ast as A
from quiver.operators.procedures import call_procedure
from quiver.plans.expressions import Expressions, list_of, substitute
from quiver.plans.patterns import Matcher
from quiver.plans.scope import Binding, Frame, ref, type_name
from quiver.sources.graph import Graph

_IDENTITY_CALLS = {"id", "labels", "type"}


def wanted_properties(query: A.Node) -> dict[str, set[str] | None]:
    """Properties that the query uses of each variable; None if it uses the whole entity."""
    out: dict[str, set[str] | None] = {}

    def note(name: str, prop: str | None) -> None:
        if prop is None:
            out[name] = None
        elif out.get(name, set()) is not None:
            out.setdefault(name, set()).add(prop)

    def visit(node: Any, parent: Any = None) -> None:
        if isinstance(node, A.Property) and isinstance(node.owner, A.Variable):
            note(node.owner.name, node.name)
            return
        if isinstance(node, A.Variable):
            only_identity = (
                isinstance(parent, A.Call) and parent.name in _IDENTITY_CALLS
                or isinstance(parent, A.Aggregate) and parent.name == "COUNT"
                or isinstance(parent, A.Binary) and parent.op in ("=", "<>")
                or isinstance(parent, A.IsNull)
            )
            if not only_identity:
                note(node.name, None)
            return
        if isinstance(node, A.Projection):
            if node.final and not node.items:
                for x in A.walk(query):
                    if isinstance(x, A.NodePattern | A.EdgePattern) and x.variable:
                        note(x.variable, None)
            for item in node.items:
                passed = isinstance(item.expression, A.Variable) and not node.final
                if passed and item.alias in (None, item.expression.name):
                    continue
                visit(item.expression, node)
            visit((node.group_by, node.having, node.where, node.page), node)
            return
        if isinstance(node, A.NodePattern | A.EdgePattern) and node.variable:
            for name, _ in node.properties:
                note(node.variable, name)
        if isinstance(node, A.SetProperty | A.SetAll | A.SetLabel):
            note(node.variable, None)
        if isinstance(node, A.Delete):
            return
        if isinstance(node, A.Node):
            for name in node.__dataclass_fields__:
                visit(getattr(node, name), node)
        elif isinstance(node, tuple):
            for x in node:
                visit(x, parent)

    visit(query)
    return out


class Compiler:
    """Compiles queries on a graph. ``update`` carries out writing clauses: (clause, frame, compiler) -> frame."""

    def __init__(self, graph: Graph, parameters: dict[str, Any] | None = None, update: Callable | None = None, graphs: Callable[[str], Graph] | None = None):
        self.graph, self.parameters, self.update, self.graphs = graph, parameters or {}, update, graphs
        self.matcher: Matcher = Matcher(graph, self.parameters, {})

    # -- whole queries

    def query(self, node: A.Node) -> DataFrame:
        if isinstance(node, A.SetOperation):
            left, right = self.query(node.left), self.query(node.right)
            if len(left.columns) != len(right.columns):
                raise AnalysisError(f"{node.op} of {len(left.columns)} and {len(right.columns)} columns")
            right = right.toDF(*left.columns)
            methods = {("UNION", True): left.union, ("INTERSECT", True): left.intersectAll, ("INTERSECT", False): left.intersect, ("EXCEPT", True): left.exceptAll, ("EXCEPT", False): left.subtract}
            return left.union(right).distinct() if (node.op, node.all) == ("UNION", False) else methods[node.op, node.all](right)
        self.matcher = Matcher(self.graph, self.parameters, wanted_properties(node))
        frame = self.clauses(self.begin(), node.clauses)
        last = node.clauses[-1]
        if isinstance(last, A.Projection) and last.final or isinstance(last, A.Procedure):
            return frame.df
        if isinstance(last, A.Insert | A.Update | A.Delete):
            return frame.df
        raise AnalysisError("a query ends with RETURN or a write")

    def begin(self) -> Frame:
        return Frame(self.graph.spark.range(1).select(), single=True)

    def clauses(self, frame: Frame, clauses: tuple[A.Node, ...]) -> Frame:
        for clause in clauses:
            if isinstance(clause, A.Insert | A.Update | A.Delete):
                if self.update is None:
                    raise AnalysisError("this graph can't be changed")
                frame = self.update(clause, frame, self)
            else:
                frame = getattr(self, f"_{type(clause).__name__.lower()}")(frame, clause)
        return frame

    def expressions(self, frame: Frame) -> Expressions:
        return Expressions(frame.scope, self.parameters)

    # -- clauses

    def _match(self, frame: Frame, m: A.Match) -> Frame:
        if m.graph:
            if self.graphs is None:
                raise AnalysisError("no other graphs here")
            other = self.graphs(m.graph)
            kept, self.matcher = self.matcher, Matcher(other, self.parameters, self.matcher.wanted)
            try:
                return self._match(frame, replace(m, graph=None))
            finally:
                self.matcher = kept
        if m.optional:
            return self._optional(frame, m)
        frame = self.matcher.match(frame, m.paths, m.where)
        if m.where is not None:
            frame = self.filter(frame, m.where)
        return self.page(frame, m.page)

    def _optional(self, frame: Frame, m: A.Match) -> Frame:
        """The whole pattern with its condition, left-joined on the variables that it shares with the rows so far."""
        names = {x.name for x in A.walk(m) if isinstance(x, A.Variable)} | {x.variable for x in A.walk(m.paths) if getattr(x, "variable", None)}
        shared = [v for v in frame.scope if v in names]
        if frame.single:
            inner = self._match(self.begin(), replace(m, optional=False))
            return inner.with_df(self.graph.spark.range(1).select().join(inner.df, F.lit(True), "left"))
        columns = [c for v in shared for c in frame.scope[v].columns]
        start = Frame(frame.df.select(*map(ref, columns)).distinct() if shared else self.begin().df, {v: frame.scope[v] for v in shared}, single=not shared)
        inner = self._match(start, replace(m, optional=False))
        keys = [k for v in shared for k in frame.scope[v].identity]
        new = {v: b for v, b in inner.scope.items() if v not in shared}
        marks = [ref(k).alias(f"_o{i}") for i, k in enumerate(keys)]
        right = inner.df.select(*marks, *(ref(c) for b in new.values() for c in b.columns))
        condition = F.lit(True)
        for i, k in enumerate(keys):
            condition = condition & ref(k).eqNullSafe(ref(f"_o{i}"))
        return frame.with_df(frame.df.join(right, condition, "left").drop(*(f"_o{i}" for i in range(len(keys)))), **new)

    def filter(self, frame: Frame, condition: A.Node) -> Frame:
        """Conjuncts that are EXISTS become semi-joins and anti-joins, the others stay conditions."""
        if isinstance(condition, A.Binary) and condition.op == "AND":
            return self.filter(self.filter(frame, condition.left), condition.right)
        negated = isinstance(condition, A.Unary) and condition.op == "NOT" and isinstance(condition.operand, A.Exists)
        if isinstance(condition, A.Exists) or negated:
            query = condition.operand.query if negated else condition.query
            keys, found = self.correlated(frame, query)
            if keys:
                match = F.lit(True)
                for i, k in enumerate(keys):
                    match = match & (ref(k).eqNullSafe(ref(f"_e{i}")) if not k.endswith("$id") else ref(k) == ref(f"_e{i}"))
                return frame.with_df(frame.df.join(found, match, "left_anti" if negated else "left_semi"))
        frame, condition = self.lift(frame, condition)
        return frame.with_df(frame.df.filter(self.expressions(frame).predicate(condition)))

    def correlated(self, frame: Frame, query: A.Node) -> tuple[list[str], DataFrame]:
        """The rows of the query that begins with the variables it shares: identity columns outside, and what is found as _e0, _e1, ..."""
        if not isinstance(query, A.Query):
            raise AnalysisError("set operations can't stand in EXISTS")
        names = {x.name for x in A.walk(query) if isinstance(x, A.Variable)} | {x.variable for x in A.walk(query) if getattr(x, "variable", None)}
        shared = [v for v in frame.scope if v in names]
        clauses = query.clauses[:-1] if isinstance(query.clauses[-1], A.Projection) else query.clauses
        columns = [c for v in shared for c in frame.scope[v].columns]
        start = Frame(frame.df.select(*map(ref, columns)).distinct(), {v: frame.scope[v] for v in shared}) if shared else self.begin()
        inner = self.clauses(start, clauses)
        keys = [k for v in shared for k in frame.scope[v].identity]
        return keys, inner.df.select(*(ref(k).alias(f"_e{i}") for i, k in enumerate(keys))).distinct() if keys else inner.df.select(F.lit(1).alias("_e")).limit(1)

    def lift(self, frame: Frame, expression: A.Node) -> tuple[Frame, A.Node]:
        """Replace EXISTS and VALUE inside an expression by columns joined to the rows."""
        known: dict[A.Node, A.Node] = {}
        for node in A.walk(expression):
            if isinstance(node, A.Exists) and node not in known:
                keys, found = self.correlated(frame, node.query)
                name = self.matcher.hidden()
                condition = F.lit(True)
                for i, k in enumerate(keys):
                    condition = condition & ref(k).eqNullSafe(ref(f"_e{i}"))
                joined = frame.df.join(found.withColumn(name, F.lit(True)), condition, "left").drop(*(f"_e{i}" for i in range(len(keys))), "_e")
                frame = frame.with_df(joined.withColumn(name, F.coalesce(ref(name), F.lit(False))), **{name: Binding("value", name, type="bool")})
                known[node] = A.Variable(name)
            elif isinstance(node, A.ValueOf) and node not in known:
                names = {x.variable for x in A.walk(node.query) if getattr(x, "variable", None)}
                if names & set(frame.scope):
                    raise AnalysisError("VALUE can't use variables from outside")
                kept = self.matcher
                rows = self.query(node.query)
                self.matcher = kept
                if len(rows.columns) != 1:
                    raise AnalysisError("VALUE needs one column")
                name = self.matcher.hidden()
                kind, element = type_name(rows.schema.fields[0].dataType)
                frame = frame.with_df(frame.df.join(rows.toDF(name).limit(1), F.lit(True), "left"), **{name: Binding("value", name, type=kind, element=element)})
                known[node] = A.Variable(name)
        return frame, substitute(expression, known) if known else expression

    def _let(self, frame: Frame, let: A.Let) -> Frame:
        for name, e in let.items:
            frame, e = self.lift(frame, e)
            value = self.expressions(frame)(e)
            frame = frame.with_df(frame.df.withColumn(name, value.column), **{name: Binding("value", name, type=value.type, element=value.element)})
        return Frame(frame.df, frame.scope)

    def _for(self, frame: Frame, f: A.For) -> Frame:
        values = self.expressions(frame)(f.source)
        if values.type != "list":
            raise AnalysisError("FOR takes a list")
        return Frame(frame.df.withColumn(f.variable, F.explode(values.column)), {**frame.scope, f.variable: Binding("value", f.variable, type=values.element or "str")})

    def _filter(self, frame: Frame, f: A.Filter) -> Frame:
        return self.filter(frame, f.condition)

    def _procedure(self, frame: Frame, p: A.Procedure) -> Frame:
        rows = call_procedure(self.graph, p.name)
        if p.yields is not None:
            have = {c.lower(): c for c in rows.columns}
            rows = rows.select(*((F.col(have[y.expression.name.lower()]) if y.expression.name.lower() in have else F.lit(None).cast("string")).alias(y.alias or y.expression.name) for y in p.yields))
        kinds = {f.name: type_name(f.dataType) for f in rows.schema.fields}
        return Frame(rows, {n: Binding("value", n, type=k, element=e) for n, (k, e) in kinds.items()})

    # -- projections

    def page(self, frame: Frame, page: A.Page) -> Frame:
        df = frame.df
        if page.order:
            compile_ = self.expressions(frame)
            df = df.orderBy(*(c.desc() if s.descending else c.asc() for s in page.order for c in [compile_.column(s.expression)]))
        return frame.with_df(self.cut(df, page))

    def number(self, e: A.Node) -> int:
        value = self.parameters.get(e.name) if isinstance(e, A.Parameter) else e.value if isinstance(e, A.Literal) else None
        if not isinstance(value, int) or isinstance(value, bool) or value < 0:
            raise AnalysisError("LIMIT and OFFSET take a whole number")
        return value

    def cut(self, df: DataFrame, page: A.Page) -> DataFrame:
        if page.offset is not None:
            df = df.offset(self.number(page.offset))
        return df if page.limit is None else df.limit(self.number(page.limit))

    @staticmethod
    def title(item: A.Item, at: int) -> str:
        e = item.expression
        if item.alias:
            return item.alias
        if isinstance(e, A.Variable):
            return e.name
        if isinstance(e, A.Property) and isinstance(e.owner, A.Variable):
            return f"{e.owner.name}.{e.name}"
        return f"col_{at}"

    def _projection(self, frame: Frame, p: A.Projection) -> Frame:
        items = p.items or tuple(A.Item(A.Variable(v)) for v in frame.scope if not v.startswith("_"))
        if not items:
            raise AnalysisError("* stands for no variable")
        titles = [self.title(item, i) for i, item in enumerate(items)]
        exprs: list[A.Node] = []
        for item in items:
            frame, e = self.lift(frame, item.expression)
            exprs.append(e)
        aliases = {A.Variable(t): e for t, e, item in zip(titles, exprs, items, strict=True) if item.alias and t not in frame.scope}
        # a sort key is a column of the result if it is one by name or form, else it is carried along and dropped
        order = [(s, substitute(s.expression, aliases)) for s in p.page.order] if p.final else [(s, s.expression) for s in p.page.order]
        having = None if p.having is None else substitute(p.having, aliases)
        grouped = bool(p.group_by) or any(A.has_aggregate(e) for e in exprs) or (having is not None and A.has_aggregate(having))
        extra = [e for _, e in order if e not in exprs] if p.final and (not p.distinct or grouped) else []
        names = titles + [f"_s{i}" for i in range(len(extra))]
        group = tuple(substitute(g, aliases) for g in p.group_by)
        out = self.group(frame, exprs + extra, names, group, having) if grouped else self.select(frame, exprs + extra, names, p.final)
        if p.distinct:
            out = out.with_df(out.df.select(*(ref(c) for t in titles for c in out.scope[t].columns)).dropDuplicates() if not extra else out.df.dropDuplicates([c for t in titles for c in out.scope[t].identity]))
        if p.where is not None:
            out = self.filter(out, p.where)
        df = out.df
        if order:
            keys = []
            for s, e in order:
                if e in exprs or e in extra:
                    at = exprs.index(e) if e in exprs else len(titles) + extra.index(e)
                    bound = out.scope[names[at]]
                    column = ref(bound.identity[0])
                else:
                    column = self.expressions(out).column(s.expression)
                keys.append(column.desc() if s.descending else column.asc())
            df = df.orderBy(*keys)
        df = self.cut(df, p.page)
        if p.final:
            df = df.select(*(out.scope[t].whole().column.alias(t) if out.scope[t].kind != "value" else ref(t) for t in titles))
            return Frame(df, {})
        return Frame(df.select(*(ref(c) for t in dict.fromkeys(titles) for c in out.scope[t].columns)), {t: out.scope[t] for t in titles})

    def select(self, frame: Frame, exprs: list[A.Node], names: list[str], final: bool) -> Frame:
        columns, scope = [], {}
        compile_ = self.expressions(frame)
        for e, name in zip(exprs, names, strict=True):
            if isinstance(e, A.Variable) and compile_.binding(e.name).kind != "value":
                scope[name], renamed = frame.scope[e.name].renamed(name)
                columns += renamed
                continue
            value = compile_(e)
            columns.append(value.column.alias(name))
            scope[name] = Binding("value", name, type=value.type, element=value.element)
        return Frame(frame.df.select(*columns), scope)

    def group(self, frame: Frame, exprs: list[A.Node], names: list[str], group_by: tuple[A.Node, ...], having: A.Node | None) -> Frame:
        """Items without an aggregate are the keys, unless GROUP BY names them; aggregates inside an item are computed first, the item from them."""
        compile_ = self.expressions(frame)
        keys = list(dict.fromkeys([*group_by, *(e for e in exprs if not A.has_aggregate(e))] if not group_by else group_by))
        if group_by and (loose := [e for e in exprs if not A.has_aggregate(e) and e not in keys and not isinstance(e, A.Literal)]):
            raise AnalysisError(f"{loose[0]} is neither grouped by nor aggregated")
        columns, scope, known = [], {}, {}
        for i, e in enumerate(keys):
            name = f"_k{i}"
            if isinstance(e, A.Variable) and compile_.binding(e.name).kind != "value":
                scope[name], renamed = frame.scope[e.name].renamed(name)
                columns += renamed
            else:
                value = compile_(e)
                columns.append(value.column.alias(name))
                scope[name] = Binding("value", name, type=value.type, element=value.element)
            known[e] = A.Variable(name)
        aggregates = list(dict.fromkeys(x for e in [*exprs, having] for x in A.walk(e) if isinstance(x, A.Aggregate)))
        built = []
        for i, a in enumerate(aggregates):
            arg = None if a.arg is None else self.counted(compile_, a)
            value = aggregate(a.name, arg, a.distinct, None if a.extra is None else compile_(a.extra))
            name = f"_a{i}"
            built.append(value.column.alias(name))
            scope[name] = Binding("value", name, type=value.type, element=value.element)
            known[a] = A.Variable(name)
        # COLLECT and the like look at columns of the rows before grouping
        pre = frame.df.select(*columns, *(ref(c) for b in frame.scope.values() for c in b.columns if c not in {k for k in scope})) if columns else frame.df
        key_names = [c for n in scope if n.startswith("_k") for c in scope[n].columns]
        df = pre.groupBy(*map(ref, key_names)).agg(*built) if built else pre.select(*map(ref, key_names)).distinct()
        grouped = Frame(df, scope)
        if having is not None:
            grouped = grouped.with_df(df.filter(self.expressions(grouped).predicate(substitute(having, known))))
        return self.select(grouped, [substitute(e, known) for e in exprs], names, False)

    @staticmethod
    def counted(compile_: Expressions, a: A.Aggregate) -> Typed:
        if a.name == "COUNT" and isinstance(a.arg, A.Variable):
            bound = compile_.binding(a.arg.name)
            if bound.kind in ("node", "edge"):
                return Typed(bound.part("id"), "str")
        return compile_(a.arg)


__all__ = ["Compiler", "list_of", "wanted_properties"]
