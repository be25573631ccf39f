"""Expressions to columns."""

from __future__ import annotations

from dataclasses import fields, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from quiver.errors import AnalysisError
from quiver.functions.scalar import Typed, function, to_datetime
from quiver.lang import ast as A
from quiver.plans.scope import Binding, ref

_CASTS = {"INTEGER": ("bigint", "int"), "INT": ("bigint", "int"), "BIGINT": ("bigint", "int"), "FLOAT": ("double", "float"), "DOUBLE": ("double", "float"), "STRING": ("string", "str"), "VARCHAR": ("string", "str"), "BOOLEAN": ("boolean", "bool"), "BOOL": ("boolean", "bool"), "DATE": ("date", "date"), "TIMESTAMP": ("timestamp_ntz", "datetime"), "DATETIME": ("timestamp_ntz", "datetime")}
_NUMBERS = ("int", "float")


def substitute(node: Any, known: dict[A.Node, A.Node]) -> Any:
    """The tree with every subtree among the keys replaced."""
    if isinstance(node, A.Node):
        if node in known:
            return known[node]
        changed = {f.name: new for f in fields(node) if (new := substitute(getattr(node, f.name), known)) is not getattr(node, f.name)}
        return replace(node, **changed) if changed else node
    if isinstance(node, tuple):
        new = tuple(substitute(x, known) for x in node)
        return new if any(a is not b for a, b in zip(new, node, strict=True)) else node
    return node


def literal(value: Any) -> Typed:
    import datetime

    names = {bool: "bool", int: "int", float: "float", str: "str", datetime.date: "date", datetime.datetime: "datetime", bytes: "bytes"}
    if value is None:
        return Typed(F.lit(None), "null")
    if isinstance(value, list | tuple):
        parts = [literal(x) for x in value]
        return list_of(parts)
    if isinstance(value, dict):
        return Typed(F.struct(*(literal(v).column.alias(k) for k, v in sorted(value.items()))), "map")
    if type(value) not in names:
        raise AnalysisError(f"a parameter can't be a {type(value).__name__}")
    if isinstance(value, int) and not isinstance(value, bool):
        return Typed(F.lit(value).cast("bigint"), "int")
    if isinstance(value, datetime.datetime):
        return Typed(F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz"), "datetime")
    return Typed(F.lit(value), names[type(value)])


def list_of(parts: list[Typed]) -> Typed:
    kinds = {p.type for p in parts} - {"null"}
    if not parts or not kinds:
        return Typed(F.array(*(p.column.cast("string") for p in parts)).cast("array<string>"), "list", "null")
    if kinds <= set(_NUMBERS):
        kind = "float" if "float" in kinds else "int"
        return Typed(F.array(*(p.column.cast("double" if kind == "float" else "bigint") for p in parts)), "list", kind)
    if len(kinds) > 1:
        raise AnalysisError(f"a list can't mix {', '.join(sorted(kinds))}")
    return Typed(F.array(*(p.column for p in parts)), "list", kinds.pop())


class Expressions:
    """Compiles expressions over a scope; aggregates only where a column is given for them."""

    def __init__(self, scope: dict[str, Binding], parameters: dict[str, Any]):
        self.scope, self.parameters = scope, parameters

    def column(self, e: A.Node) -> Column:
        return self(e).column

    def predicate(self, e: A.Node, plain: bool = True) -> Column:
        """A condition; ``plain``: only true counts, so forms that push down may give null for false."""
        if plain and isinstance(e, A.Binary) and e.op == "AND":
            return self.predicate(e.left) & self.predicate(e.right)
        if plain and isinstance(e, A.Binary) and e.op == "IN" and isinstance(e.right, A.ListOf) and all(isinstance(x, A.Literal) and x.value is not None for x in e.right.items) and e.right.items:
            return self.column(e.left).isin(*(x.value for x in e.right.items))
        out = self(e)
        return out.column if out.type == "bool" else F.lit(None).cast("boolean")

    def __call__(self, e: A.Node) -> Typed:
        method = getattr(self, f"_{type(e).__name__.lower()}", None)
        if method is None:
            raise AnalysisError(f"{type(e).__name__} can't stand here")
        return method(e)

    def _literal(self, e: A.Literal) -> Typed:
        return literal(e.value)

    def _parameter(self, e: A.Parameter) -> Typed:
        if e.name not in self.parameters:
            raise AnalysisError(f"no value for ${e.name}")
        return literal(self.parameters[e.name])

    def binding(self, name: str) -> Binding:
        if name not in self.scope:
            raise AnalysisError(f"unknown identifier {name}")
        return self.scope[name]

    def _variable(self, e: A.Variable) -> Typed:
        return self.binding(e.name).whole()

    def _property(self, e: A.Property) -> Typed:
        if isinstance(e.owner, A.Variable):
            bound = self.binding(e.owner.name)
            if bound.kind in ("node", "edge"):
                return bound.property(e.name)
        owner = self(e.owner)
        if owner.type == "null":
            return owner
        if owner.type in ("map", "node", "edge", "duration"):
            if isinstance(e.owner, A.MapOf):
                found = [v for k, v in e.owner.items if k == e.name]
                return self(found[-1]) if found else Typed(F.lit(None), "null")
            inside = owner.column if owner.type in ("map", "duration") else owner.column["properties"]
            return Typed(F.get_json_object(F.to_json(inside), f"$.{e.name}"), "str") if owner.element is None and owner.type == "map" else Typed(inside[e.name], "int" if owner.type == "duration" else "str")
        raise AnalysisError(f"{owner.type} has no properties")

    def _unary(self, e: A.Unary) -> Typed:
        x = self(e.operand)
        if e.op == "NOT":
            if x.type not in ("bool", "null"):
                raise AnalysisError(f"NOT does not take {x.type}")
            return Typed(~x.column.cast("boolean"), "bool")
        if x.type not in (*_NUMBERS, "null"):
            raise AnalysisError(f"{e.op} does not take {x.type}")
        return Typed(-x.column, x.type) if e.op == "-" else x

    def _identity(self, e: A.Node) -> Typed | None:
        """The id, for a variable that is a node or an edge: entities are equal if their ids are."""
        if isinstance(e, A.Variable) and self.binding(e.name).kind in ("node", "edge"):
            return Typed(self.binding(e.name).part("id"), "id")
        return None

    def _binary(self, e: A.Binary) -> Typed:
        op = e.op
        if op in ("=", "<>"):
            a, b = self._identity(e.left) or self(e.left), self._identity(e.right) or self(e.right)
            if "null" not in (a.type, b.type) and a.type != b.type and not {a.type, b.type} <= set(_NUMBERS) and not {a.type, b.type} <= {"str", "time"}:
                same = a.column.isNull() & b.column.isNull()
            else:
                same = a.column.eqNullSafe(b.column)
            return Typed(same if op == "=" else ~same, "bool")
        a, b = self(e.left), self(e.right)
        if op in ("AND", "OR", "XOR"):
            x, y = (v.column if v.type == "bool" else F.lit(None).cast("boolean") for v in (a, b))
            return Typed(x & y if op == "AND" else x | y if op == "OR" else x != y, "bool")
        if op in ("<", ">", "<=", ">="):
            if "null" in (a.type, b.type):
                return Typed(F.lit(None).cast("boolean"), "bool")
            if a.type != b.type and not {a.type, b.type} <= set(_NUMBERS) and not {a.type, b.type} <= {"str", "time"}:
                raise AnalysisError(f"{a.type} and {b.type} don't compare")
            x, y = a.column, b.column
            out = {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
            if "float" in (a.type, b.type):
                odd = [F.isnan(v.column) for v in (a, b) if v.type == "float" and not isinstance(e.left if v is a else e.right, A.Literal)]
                # a comparison with NaN is null; Spark would put NaN above all numbers
                if odd and op in (">", ">="):
                    nan = odd[0] if len(odd) == 1 else odd[0] | odd[1]
                    out = out & F.when(nan, F.lit(None).cast("boolean")).otherwise(True)
            return Typed(out, "bool")
        if op == "IN":
            if b.type == "null":
                return Typed(F.lit(False), "bool")
            if b.type != "list":
                raise AnalysisError("IN takes a list")
            mine = a.column
            return Typed(F.coalesce(F.exists(b.column, lambda x: x.eqNullSafe(mine)), F.lit(False)), "bool")
        if op == "LIKE":
            if isinstance(e.right, A.Literal) and isinstance(e.right.value, str):
                return Typed(a.column.like(e.right.value), "bool")
            return Typed(F.like(a.column, b.column), "bool")
        if op == "||":
            if {a.type, b.type} <= {"str", "time", "null"}:
                return Typed(F.concat(a.column.cast("string"), b.column.cast("string")), "str")
            if {a.type, b.type} <= {"list", "null"}:
                return Typed(F.concat(a.column, b.column), "list", a.element if a.element != "null" else b.element)
            raise AnalysisError(f"|| does not take {a.type} and {b.type}")
        return self._arithmetic(op, a, b)

    def _arithmetic(self, op: str, a: Typed, b: Typed) -> Typed:
        for x in (a, b):
            if x.type not in (*_NUMBERS, "null"):
                raise AnalysisError(f"{op} does not take {x.type}")
        kind = "float" if "float" in (a.type, b.type) else "int"
        of = "double" if kind == "float" else "bigint"
        x, y = a.column.cast(of) if a.type != kind else a.column, b.column.cast(of) if b.type != kind else b.column
        if op == "/":
            # whole numbers divide to whole numbers, towards zero
            return Typed(F.call_function("div", x, y) if kind == "int" else x / y, kind)
        return Typed({"+": x + y, "-": x - y, "*": x * y, "%": x % y}[op], kind)

    def _isnull(self, e: A.IsNull) -> Typed:
        x = self._identity(e.operand) or self(e.operand)
        return Typed(x.column.isNotNull() if e.negated else x.column.isNull(), "bool")

    def _case(self, e: A.Case) -> Typed:
        subject = None if e.subject is None else self(e.subject)
        out, kinds = None, []
        for condition, value in e.branches:
            test = self.predicate(condition, plain=False) if subject is None else subject.column.eqNullSafe(self(condition).column)
            result = self(value)
            kinds.append(result)
            out = F.when(test, result.column) if out is None else out.when(test, result.column)
        if e.default is not None:
            kinds.append(self(e.default))
            out = out.otherwise(kinds[-1].column)
        known = {k.type for k in kinds} - {"null"}
        kind = "float" if known == set(_NUMBERS) else known.pop() if len(known) == 1 else "null" if not known else "str"
        return Typed(out, kind, next((k.element for k in kinds if k.element), None))

    def _listof(self, e: A.ListOf) -> Typed:
        return list_of([self(x) for x in e.items])

    def _mapof(self, e: A.MapOf) -> Typed:
        if not e.items:
            return Typed(F.create_map().cast("map<string,string>"), "map")
        return Typed(F.struct(*(self(v).column.alias(k) for k, v in sorted(dict(e.items).items()))), "map")

    def _cast(self, e: A.Cast) -> Typed:
        if e.type not in _CASTS:
            raise AnalysisError(f"no type {e.type}")
        x, (of, kind) = self(e.operand), _CASTS[e.type]
        if x.type == "str" and kind == "datetime":
            return to_datetime(x)
        return function("toString")(x) if kind == "str" else Typed(x.column.cast(of), kind)

    def _aggregate(self, e: A.Aggregate) -> Typed:
        raise AnalysisError(f"{e.name} can't stand here")

    def _call(self, e: A.Call) -> Typed:
        special = getattr(self, f"_fn_{e.name}", None)
        if special is not None:
            return special(e)
        if e.name == "path_length":
            return self._fn_length(e)
        args = [self(x) for x in e.args]
        try:
            return function(e.name)(*args)
        except TypeError as problem:
            raise AnalysisError(f"{e.name}: {problem}") from problem

    def _entity(self, e: A.Call) -> Binding | None:
        if len(e.args) != 1:
            raise AnalysisError(f"{e.name} takes one argument")
        if isinstance(e.args[0], A.Variable) and self.binding(e.args[0].name).kind != "value":
            return self.binding(e.args[0].name)
        return None

    def _fn_id(self, e: A.Call) -> Typed:
        bound = self._entity(e)
        if bound is not None and bound.kind in ("node", "edge"):
            return Typed(bound.part("id"), "str")
        x = self(e.args[0])
        if x.type in ("node", "edge"):
            return Typed(x.column["id"], "str")
        if x.type in ("str", "null"):
            return x
        raise AnalysisError(f"id does not take {x.type}")

    def _fn_labels(self, e: A.Call) -> Typed:
        bound = self._entity(e)
        if bound is not None:
            return Typed(bound.part("labels"), "list", "str") if bound.kind == "node" else Typed(F.array().cast("array<string>"), "list", "str")
        x = self(e.args[0])
        if x.type in ("list", "null"):
            return x
        return Typed(x.column["labels"] if x.type == "node" else F.when(x.column.isNotNull(), F.array().cast("array<string>")), "list", "str")

    def _fn_type(self, e: A.Call) -> Typed:
        bound = self._entity(e)
        if bound is not None:
            return Typed(bound.part("label") if bound.kind == "edge" else F.lit(bound.kind.upper()), "str")
        x = self(e.args[0])
        names = {"int": "INTEGER", "float": "FLOAT", "str": "STRING", "bool": "BOOLEAN", "datetime": "TIMESTAMP"}
        if x.type == "edge":
            return Typed(x.column["label"], "str")
        return Typed(F.when(x.column.isNull(), F.lit("NULL")).otherwise(F.lit(names.get(x.type, x.type.upper()))), "str")

    def _fn_keys(self, e: A.Call) -> Typed:
        bound = self._entity(e)
        if bound is not None and bound.kind in ("node", "edge"):
            named = [F.when(ref(f"{bound.prefix}$p${p}").isNotNull(), F.lit(p)) for p in sorted(bound.properties)]
            keys = F.array_compact(F.array(*named)) if named else F.array().cast("array<string>")
            return Typed(F.when(bound.part("id").isNotNull(), keys), "list", "str")
        if isinstance(e.args[0], A.MapOf):
            return list_of([literal(k) for k in sorted(dict(e.args[0].items))])
        x = self(e.args[0])
        if x.type == "null":
            return Typed(F.lit(None).cast("array<string>"), "list", "str")
        if x.type == "map":
            return Typed(F.array_sort(F.json_object_keys(F.to_json(x.column))), "list", "str")
        raise AnalysisError(f"keys does not take {x.type}")

    def _fn_size(self, e: A.Call) -> Typed:
        if len(e.args) == 1 and isinstance(e.args[0], A.MapOf):
            return literal(len(dict(e.args[0].items)))
        return function("size")(*(self(x) for x in e.args))

    def _path(self, e: A.Call, part: str) -> Binding:
        bound = self._entity(e)
        if bound is None or bound.kind != "path":
            raise AnalysisError(f"{e.name} takes a path")
        return bound

    def _fn_nodes(self, e: A.Call) -> Typed:
        return Typed(self._path(e, "nodes").part("nodes"), "list", "str")

    def _fn_edges(self, e: A.Call) -> Typed:
        return Typed(self._path(e, "edges").part("edges"), "list", "str")

    _fn_relationships = _fn_edges

    def _fn_length(self, e: A.Call) -> Typed:
        bound = self._entity(e)
        if bound is not None and bound.kind == "path":
            return Typed(F.size(bound.part("edges")).cast("bigint"), "int")
        return function("size")(*(self(x) for x in e.args))
