"""What the variables of a query stand for: sets of flat columns, so that Catalyst prunes and pushes through them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.functions.scalar import Typed
from quiver.sources.graph import NodeTable


def type_name(of: T.DataType) -> tuple[str, str | None]:
    """Type in the language of a Spark type, and of its elements."""
    if isinstance(of, T.ArrayType):
        return "list", type_name(of.elementType)[0]
    if isinstance(of, T.StructType):
        return ("duration", None) if of.fieldNames() == ["months", "days", "nanos"] else ("map", None)
    names = {T.BooleanType: "bool", T.LongType: "int", T.IntegerType: "int", T.ShortType: "int", T.ByteType: "int", T.DoubleType: "float", T.FloatType: "float", T.StringType: "str", T.DateType: "date", T.TimestampNTZType: "datetime", T.TimestampType: "datetime", T.BinaryType: "bytes", T.NullType: "null"}
    return names.get(type(of), "float" if isinstance(of, T.DecimalType) else "str"), None


def ref(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class Binding:
    """kind: node, edge, path or value. Columns are named by the prefix, ``$`` and the part; a value has one column."""

    kind: str
    prefix: str
    properties: dict[str, T.DataType] = field(default_factory=dict)
    tables: tuple[str, ...] = ()  # node tables it can come from
    keyed: bool = False  # prefix$key holds the key of its only table
    type: str = "null"
    element: str | None = None

    def part(self, name: str) -> Column:
        return ref(f"{self.prefix}${name}")

    @property
    def columns(self) -> list[str]:
        fixed = {"node": ["id", "labels"] + ["key"] * self.keyed, "edge": ["id", "src", "dst", "label"], "path": ["nodes", "edges"]}
        if self.kind == "value":
            return [self.prefix]
        return [f"{self.prefix}${x}" for x in fixed[self.kind]] + [f"{self.prefix}$p${p}" for p in self.properties]

    @property
    def identity(self) -> list[str]:
        return {"value": [self.prefix], "path": [f"{self.prefix}$nodes", f"{self.prefix}$edges"]}.get(self.kind, [f"{self.prefix}$id"])

    def property(self, name: str) -> Typed:
        if name not in self.properties:
            return Typed(F.lit(None), "null")
        return Typed(ref(f"{self.prefix}$p${name}"), *type_name(self.properties[name]))

    def whole(self) -> Typed:
        """The entity as one value."""
        if self.kind == "value":
            return Typed(ref(self.prefix), self.type, self.element)
        if self.kind == "path":
            return Typed(F.struct(self.part("nodes").alias("nodes"), self.part("edges").alias("edges")), "path")
        inside = F.struct(*(ref(f"{self.prefix}$p${p}").alias(p) for p in sorted(self.properties))) if self.properties else F.create_map().cast("map<string,string>")
        if self.kind == "node":
            value = F.struct(self.part("id").alias("id"), self.part("labels").alias("labels"), inside.alias("properties"))
        else:
            value = F.struct(self.part("id").alias("id"), self.part("label").alias("label"), self.part("src").alias("source_id"), self.part("dst").alias("target_id"), inside.alias("properties"))
        return Typed(F.when(self.part("id").isNotNull(), value), self.kind)

    def renamed(self, prefix: str) -> tuple[Binding, list[Column]]:
        """The same under another prefix, and the columns that make it so."""
        other = replace(self, prefix=prefix)
        return other, [ref(old).alias(new) for old, new in zip(self.columns, other.columns, strict=True)]


@dataclass
class Frame:
    """Rows and the variables in them. ``single``: the one row without columns that a query begins with."""

    df: DataFrame
    scope: dict[str, Binding] = field(default_factory=dict)
    single: bool = False

    def with_df(self, df: DataFrame, **more: Binding) -> Frame:
        return Frame(df, {**self.scope, **more})


def bind_nodes(tables: list[NodeTable], prefix: str, wanted: set[str] | None, spark) -> tuple[DataFrame, Binding]:
    """Scan of node tables with the properties wanted (None: all)."""
    properties: dict[str, T.DataType] = {}
    for t in tables:
        for name, of in t.properties.items():
            if wanted is None or name in wanted:
                properties[name] = _common(properties.get(name), of)
    keyed = len(tables) == 1
    binding = Binding("node", prefix, properties, tuple(t.name for t in tables), keyed)
    out = None
    for t in tables:
        key = ref(t.key)
        columns = [t.id_of(key).alias(f"{prefix}$id"), F.array(*map(F.lit, t.labels)).alias(f"{prefix}$labels")]
        columns += [key.alias(f"{prefix}$key")] * keyed
        columns += [(ref(p).cast(of) if p in t.properties else F.lit(None).cast(of)).alias(f"{prefix}$p${p}") for p, of in properties.items()]
        part = t.frame.select(*columns)
        out = part if out is None else out.union(part)
    if out is None:
        fields = [T.StructField(f"{prefix}$id", T.StringType()), T.StructField(f"{prefix}$labels", T.ArrayType(T.StringType()))]
        out = spark.createDataFrame([], T.StructType(fields))
    return out, binding


def _common(a: T.DataType | None, b: T.DataType) -> T.DataType:
    """One type for a property that tables store differently: numbers meet in double, all else in string."""
    if a is None or a == b:
        return b
    numbers = (T.LongType, T.DoubleType)
    return T.DoubleType() if isinstance(a, numbers) and isinstance(b, numbers) else T.StringType()
