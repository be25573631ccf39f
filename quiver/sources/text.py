"""Graphs as text: statements that build a graph again, written and read in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quiver.functions.scalar import duration_text
from quiver.operators.mutations import stored_form
from quiver.plans.scope import ref
from quiver.sources.graph import Graph


def _value(column: Column, of: T.DataType) -> Column:
    """A literal that the parser reads back as the same value; null where there is none."""
    if isinstance(of, T.StringType):
        return F.concat(F.lit("'"), F.replace(column, F.lit("'"), F.lit("''")), F.lit("'"))
    if isinstance(of, T.BooleanType):
        return F.when(column, "TRUE").when(~column, "FALSE")
    if isinstance(of, T.DateType):
        return F.concat(F.lit("DATE('"), column.cast("string"), F.lit("')"))
    if isinstance(of, T.TimestampNTZType):
        return F.concat(F.lit("DATETIME('"), F.replace(column.cast("string"), F.lit(" "), F.lit("T")), F.lit("')"))
    if isinstance(of, T.StructType):
        return F.concat(F.lit("DURATION('"), duration_text(column), F.lit("')"))
    if isinstance(of, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(column, lambda x: F.coalesce(_value(x, of.elementType), F.lit("NULL"))), ", "), F.lit("]"))
    return column.cast("string")


def _map(properties: dict[str, T.DataType], first: Column | None = None) -> Column:
    parts = [F.concat(F.lit(f"`{p}`: "), _value(ref(p), of)) for p, of in properties.items()]
    inside = F.concat_ws(", ", *([first] if first is not None else []), *parts)
    return F.when(inside == "", "").otherwise(F.concat(F.lit(" {"), inside, F.lit("}")))


def export_statements(graph: Graph) -> DataFrame:
    """One INSERT for each node and edge, in two parts (0: nodes, 1: edges): part, line. Nodes carry their id as ``_id``."""
    graph = stored_form(graph)
    out = None
    text = lambda c: _value(c, T.StringType())
    for t in graph.nodes.values():
        labels = "".join(f":`{x}`" for x in t.labels)
        rows = t.frame.select(F.lit(0).alias("part"), F.concat(F.lit(f"INSERT ({labels}"), _map(t.properties, F.concat(F.lit("_id: "), text(ref("_id")))), F.lit(");")).alias("line"))
        out = rows if out is None else out.union(rows)
    for label, tables in graph.edges.items():
        for t in tables:
            line = F.concat(F.lit("MATCH (a {_id: "), text(ref("_src")), F.lit("}), (b {_id: "), text(ref("_dst")), F.lit(f"}}) INSERT (a)-[:`{label}`"), _map(t.properties), F.lit("]->(b);"))
            rows = t.frame.select(F.lit(1).alias("part"), line.alias("line"))
            out = rows if out is None else out.union(rows)
    return out if out is not None else graph.spark.createDataFrame([], "part int, line string")


#: What would end a line, and the mark itself, as they stand in a file.
_MARKS = (("\\", "\\s"), ("\n", "\\n"), ("\r", "\\r"))


def _one_line(text: Column) -> Column:
    for plain, mark in _MARKS:
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def _many_lines(text: Column) -> Column:
    for plain, mark in reversed(_MARKS):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def export_graph(graph: Graph, path: str) -> int:
    """Write the statements as text under the path, one a line; returns how many. Line breaks and backslashes are written as \\n, \\r and \\s."""
    lines = export_statements(graph).withColumn("line", _one_line(F.col("line")))
    for part, name in ((0, "nodes"), (1, "edges")):
        lines.filter(F.col("part") == part).select("line").write.mode("overwrite").text(f"{path}/{name}")
    return graph.spark.read.text([f"{path}/nodes", f"{path}/edges"]).count()


def import_lines(session, lines: list[str], graph: str = "default") -> int:
    """Run statements line by line in one transaction; blank lines and comments are skipped, the first error stops it and names its line."""
    done = 0
    with session.transaction(graph):
        for number, line in enumerate(lines, 1):
            line = line.strip()
            if not line or line.startswith(("//", "--")):
                continue
            try:
                session.query(line, graph)
            except Exception as problem:
                raise type(problem)(f"statement {number}: {problem}") if len(getattr(problem, "args", ())) == 1 else problem
            done += 1
    return done


_STRING = r"'((?:[^']++|'')*+)'"
_EDGE = rf"(?s)^MATCH \(a \{{_id: {_STRING}\}}\), \(b \{{_id: {_STRING}\}}\) INSERT \(a\)-\[:`([^`]+)`(?: (\{{.*\}}))?\]->\(b\);$"


def _text(inside: Column) -> Column:
    """The string that stands between quotes in a file."""
    return _many_lines(F.replace(inside, F.lit("''"), F.lit("'")))


def import_graph(session, path: str, graph: str) -> int:
    """Read an export as tables: statements are parsed on the executors' side by pattern, so size does not matter; ``_id`` goes again."""
    from quiver.sources.graph import EdgeTable, NodeTable

    spark = session.spark
    nodes = spark.read.text(f"{path}/nodes").select(F.regexp_extract("value", r"^INSERT \(((?::`[^`]+`)*)", 1).alias("labels"), F.regexp_extract("value", r"(?s)^INSERT \([^{]*(\{.*\})\);$", 1).alias("map"))
    of_edge = lambda i: F.regexp_extract("value", _EDGE, i)
    edges = spark.read.text(f"{path}/edges").select(_text(of_edge(1)).alias("_src"), _text(of_edge(2)).alias("_dst"), of_edge(3).alias("label"), of_edge(4).alias("map"))
    from quiver.sources.graph import Graph as _Graph

    target = _Graph(spark, graph)
    for row in nodes.select("labels").distinct().collect():  # as many as there are sets of labels
        labels = tuple(sorted(x for x in row["labels"].replace(":", "").split("`") if x))
        rows, properties = _columns(nodes.filter(F.col("labels") == row["labels"]), [])
        frame = rows.withColumnRenamed("p__id", "_id").select("_id", *(F.col(f"`p_{p}`").alias(p) for p in properties if p != "_id"))
        target.nodes["&".join(labels)] = NodeTable(labels, frame, "_id", hidden=frozenset(["_id"]))
    for row in edges.select("label").distinct().collect():
        rows, properties = _columns(edges.filter(F.col("label") == row["label"]), ["_src", "_dst", "map"])
        # edges that are equal in all stay several: they are told apart by their number
        again = F.row_number().over(Window.partitionBy("_src", "_dst", "map").orderBy(F.lit(1))).cast("string")
        named = rows.select(F.md5(F.concat_ws(">", "_src", F.lit(row["label"]), "_dst", "map", again)).alias("_id"), "_src", "_dst", *(F.col(f"`p_{p}`").alias(p) for p in properties))
        target.edges[row["label"]] = [EdgeTable(row["label"], named, "_id", "_src", "_dst", hidden=frozenset(["_id", "_src", "_dst"]))]
    session.register(target)
    return nodes.count() + edges.count()


_PAIR = r"(`[^`]+`|_id): ('(?:[^']++|'')*+'|\[[^\]]*\]|[A-Z]+\('[^']*'\)|[^,}]+)"


def _columns(rows: DataFrame, kept: list[str]) -> tuple[DataFrame, list[str]]:
    """Properties of a map literal as columns, typed by how their values are written."""
    pairs = F.transform(F.regexp_extract_all("map", F.lit(_PAIR), F.lit(0)), lambda p: F.struct(F.regexp_replace(F.regexp_extract(p, _PAIR, 1), "`", "").alias("k"), F.regexp_extract(p, _PAIR, 2).alias("v")))
    parsed = rows.select(*kept, F.map_from_entries(pairs).alias("m"))
    kind = F.when(F.col("v").rlike("^'"), "string").when(F.col("v").rlike("^(TRUE|FALSE)$"), "boolean").when(F.col("v").rlike(r"^-?\d+$"), "bigint").when(F.col("v").rlike(r"^DATE\("), "date").when(F.col("v").rlike("^DATETIME"), "timestamp_ntz").when(F.col("v").rlike(r"^\[|^DURATION"), "text").otherwise("double")
    known = parsed.select(F.explode("m").alias("k", "v")).select("k", kind.alias("kind")).distinct().groupBy("k").agg(F.collect_set("kind").alias("kinds")).collect()
    types = {r["k"]: r["kinds"][0] if len(r["kinds"]) == 1 else "double" if set(r["kinds"]) == {"bigint", "double"} else "text" for r in known}

    def read(name: str, of: str) -> Column:
        raw = F.col("m")[name]
        if of == "string":
            return _text(F.substr(raw, F.lit(2), F.length(raw) - 2))
        if of in ("date", "timestamp_ntz"):
            return F.regexp_extract(raw, r"'([^']*)'", 1).cast(of)
        return raw.cast("string" if of == "text" else of)

    return parsed.select(*kept, *(read(k, of).alias(f"p_{k}") for k, of in sorted(types.items()))), sorted(types)
