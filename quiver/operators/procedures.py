"""CALL db.*: what a graph says about itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.errors import AnalysisError
from quiver.sources.graph import Graph


def call_procedure(graph: Graph, name: str) -> DataFrame:
    """Rows of a procedure; arguments have no effect."""
    spark = graph.spark

    def names(column: str, values: list[str]) -> DataFrame:
        return spark.createDataFrame([(v,) for v in values], f"{column} string")

    def counted(rows: DataFrame | None) -> DataFrame:
        if rows is None:
            return spark.createDataFrame([(0,)], "count long")
        return rows.agg(F.count(F.lit(1)).alias("count"))

    known = {
        "db.labels": lambda: names("label", graph.labels()),
        "db.relationshiptypes": lambda: names("relationshipType", graph.relationship_types()),
        "db.edgetypes": lambda: names("relationshipType", graph.relationship_types()),
        "db.propertykeys": lambda: names("propertyKey", graph.property_keys()),
        "db.schema": lambda: spark.createDataFrame([(graph.labels(), graph.relationship_types(), graph.property_keys())], "labels array<string>, relationshipTypes array<string>, propertyKeys array<string>"),
        "db.nodecount": lambda: counted(graph.node_ids()),
        "db.edgecount": lambda: counted(graph.edge_rows()),
    }
    if name.lower() not in known:
        raise AnalysisError(f"no procedure {name}")
    return known[name.lower()]()
