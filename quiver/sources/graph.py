"""Property graphs as tables: one table of nodes for each set of labels, one table of edges for each label."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.errors import AnalysisError


def graph_id(name: str) -> str:
    """The same name always gives the same id."""
    return str(uuid.uuid5(uuid.NAMESPACE_DNS, name))


def widen(frame: DataFrame) -> DataFrame:
    """Whole numbers become bigint, single floats double and zoned timestamps local ones: the value types of the language."""
    casts = {T.ByteType: "bigint", T.ShortType: "bigint", T.IntegerType: "bigint", T.FloatType: "double", T.DecimalType: "double", T.TimestampType: "timestamp_ntz"}
    return frame.select(*(F.col(f"`{f.name}`").cast(casts[type(f.dataType)]).alias(f.name) if type(f.dataType) in casts else F.col(f"`{f.name}`") for f in frame.schema.fields))


class _Loaded:
    """Attribute that holds rows, or a function that gives them: it is called when they are first asked for."""

    def __get__(self, table: object, _: type | None = None) -> DataFrame:
        if table is None:
            raise AttributeError  # so that the field has no default
        rows = table.__dict__["frame"]
        if not isinstance(rows, DataFrame):
            rows = table.__dict__["frame"] = rows()
        return rows

    def __set__(self, table: object, rows: DataFrame | Callable[[], DataFrame]) -> None:
        table.__dict__["frame"] = rows


def _rows(frame: DataFrame | Callable[[], DataFrame]) -> DataFrame:
    return widen(frame if isinstance(frame, DataFrame) else frame())


@dataclass
class NodeTable:
    """Nodes of one set of labels. ``key`` identifies a node within the table; its id is the prefix and the key."""

    labels: tuple[str, ...]
    frame: DataFrame = _Loaded()
    key: str
    prefix: str = ""
    #: Columns that are not properties.
    hidden: frozenset[str] = frozenset()

    @property
    def name(self) -> str:
        return "&".join(self.labels)

    @property
    def properties(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.frame.schema.fields if f.name not in self.hidden}

    def id_of(self, key: Column) -> Column:
        return F.concat(F.lit(self.prefix), key.cast("string")) if self.prefix else key.cast("string")


@dataclass
class EdgeTable:
    """Edges of one label. ``source`` and ``target`` hold keys of the node tables named, or ids where none is named."""

    label: str
    frame: DataFrame = _Loaded()
    key: str
    source: str
    target: str
    source_table: str | None = None
    target_table: str | None = None
    prefix: str = ""
    hidden: frozenset[str] = frozenset()

    @property
    def properties(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.frame.schema.fields if f.name not in self.hidden}


@dataclass
class Index:
    name: str
    label: str
    properties: tuple[str, ...]
    unique: bool = False


@dataclass
class Graph:
    """Tables by name. ``integrity``: the endpoints of every edge exist, so a node that is only passed through needs no join."""

    spark: SparkSession
    name: str
    nodes: dict[str, NodeTable] = field(default_factory=dict)
    edges: dict[str, list[EdgeTable]] = field(default_factory=dict)
    integrity: bool = False
    indexes: dict[str, Index] = field(default_factory=dict)

    @property
    def id(self) -> str:
        return graph_id(self.name)

    def add_nodes(self, label: str, frame: DataFrame | Callable[[], DataFrame], key: str) -> Graph:
        """A table of nodes of one label; every column is a property. A function that gives the rows is called on first use."""
        self.nodes[label] = NodeTable((label,), lambda: _rows(frame), key, f"{label.lower()}:")
        return self

    def add_edges(self, label: str, frame: DataFrame | Callable[[], DataFrame], source: tuple[str, str], target: tuple[str, str], key: str | None = None, properties: Iterable[str] = ()) -> Graph:
        """A table of edges; ``source`` and ``target`` are (node table, column of its keys). Without a key column the endpoints name the edge."""
        columns = list(dict.fromkeys(properties))

        def named() -> DataFrame:
            return _rows(frame).select(
                F.col(key).cast("string").alias("_id") if key else F.concat_ws(">", F.col(source[1]).cast("string"), F.col(target[1]).cast("string")).alias("_id"),
                F.col(source[1]).alias("_src"), F.col(target[1]).alias("_dst"), *columns,
            )

        self.edges.setdefault(label, []).append(EdgeTable(label, named, "_id", "_src", "_dst", source[0], target[0], f"{label.lower()}:", frozenset(["_id", "_src", "_dst"])))
        return self

    def node_tables(self, labels: tuple[tuple[str, ...], ...]) -> list[NodeTable]:
        """Tables whose nodes have one label of each group."""
        return [t for t in self.nodes.values() if all(any(x in t.labels for x in group) for group in labels)]

    def edge_tables(self, labels: tuple[str, ...]) -> list[EdgeTable]:
        return [t for label, tables in self.edges.items() if not labels or label in labels for t in tables]

    # -- what db.* procedures tell

    def labels(self) -> list[str]:
        return sorted({x for t in self.nodes.values() for x in t.labels})

    def relationship_types(self) -> list[str]:
        return sorted(self.edges)

    def property_keys(self) -> list[str]:
        return sorted({p for t in self.nodes.values() for p in t.properties} | {p for ts in self.edges.values() for t in ts for p in t.properties})

    def node_ids(self) -> DataFrame | None:
        parts = [t.frame.select(t.id_of(F.col(f"`{t.key}`")).alias("id")) for t in self.nodes.values()]
        return _union(parts)

    def edge_rows(self) -> DataFrame | None:
        return _union([t.frame.select(F.lit(t.label).alias("label"), F.col(f"`{t.key}`").cast("string").alias("id")) for ts in self.edges.values() for t in ts])

    def label_counts(self) -> DataFrame:
        """Nodes by label."""
        parts = [t.frame.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(*map(F.lit, t.labels))).alias("label"), "n") for t in self.nodes.values()]
        whole = _union(parts)
        if whole is None:
            return self.spark.createDataFrame([], "label string, count long")
        return whole.groupBy("label").agg(F.sum("n").alias("count"))

    def schema_info(self) -> DataFrame:
        """Label, property names and count of nodes and edges of each label."""
        counts = self.label_counts()
        keys = {x: sorted({p for t in self.nodes.values() if x in t.labels for p in t.properties}) for x in self.labels()}
        known = self.spark.createDataFrame([(k, v) for k, v in keys.items()], "label string, properties array<string>")
        return known.join(counts, "label")

    def scan_nodes(self, limit: int | None = None) -> DataFrame:
        frame = self.node_ids()
        if frame is None:
            frame = self.spark.createDataFrame([], "id string")
        return frame if limit is None else frame.limit(limit)

    def scan_edges(self, limit: int | None = None) -> DataFrame:
        """Label and id of edges; ``get_edge`` takes the id."""
        frame = _union([t.frame.select(F.lit(t.label).alias("label"), F.concat(F.lit(t.prefix), F.col(f"`{t.key}`").cast("string")).alias("id")) for ts in self.edges.values() for t in ts])
        if frame is None:
            frame = self.spark.createDataFrame([], "label string, id string")
        return frame if limit is None else frame.limit(limit)

    def get_node(self, id: str) -> DataFrame:
        """The node of an id, all its properties; no rows if there is none."""
        return self._get(list(self.nodes.values()), id)

    def get_edge(self, id: str) -> DataFrame:
        """The edge of an id; no rows if there is none."""
        return self._get([t for ts in self.edges.values() for t in ts], id)

    def _get(self, tables: list[NodeTable] | list[EdgeTable], id: str) -> DataFrame:
        parts = []
        for t in tables:
            if id.startswith(t.prefix):
                key, text = F.col(f"`{t.key}`"), id[len(t.prefix) :]
                # the first comparison, with the key's own type, reaches the scan; the second tells 7 from 007
                native = F.lit(text).try_cast(t.frame.schema[t.key].dataType)
                parts.append(t.frame.filter((key == native) & (key.cast("string") == text)))
        found = _union(parts, by_name=True)
        return self.spark.createDataFrame([], "id string") if found is None else found

    def range_scan(self, index: str, low=None, high=None) -> DataFrame:
        """Nodes whose leading property of the index lies in [low, high)."""
        if index not in self.indexes:
            raise AnalysisError(f"no index {index}")
        found = self.indexes[index]
        column = F.col(f"`{found.properties[0]}`")
        parts = []
        for t in self.node_tables(((found.label,),)):
            rows = t.frame
            rows = rows.filter(column >= F.lit(low)) if low is not None else rows
            parts.append(rows.filter(column < F.lit(high)) if high is not None else rows)
        return _union(parts, by_name=True)


def _union(parts: list[DataFrame], by_name: bool = False) -> DataFrame | None:
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part, allowMissingColumns=True) if by_name else out.union(part)
    return out
