"""A stream of events as edges of a graph: each micro-batch is appended to the edge table's files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quiver.sources.graph import Graph


def ingest_edges(stream: DataFrame, path: str, checkpoint: str, source: str, target: str, key: str) -> StreamingQuery:
    """Append edges (key, source, target and the rest as properties) to Parquet files, exactly once by the checkpoint."""
    rows = stream.select(F.col(key).cast("string").alias("_id"), F.col(source).alias("_src"), F.col(target).alias("_dst"), *(c for c in stream.columns if c not in (key, source, target)))
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def degree_counts(stream: DataFrame, time: str, source: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Edges by source and window of time; rows later than ``late`` are left out."""
    counted = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window), F.col(source))
    return counted.agg(F.count(F.lit(1)).alias("edges")).select(F.col("window.start").alias("start"), source, "edges")


def attach(graph: Graph, label: str, path: str, source_table: str, target_table: str) -> Graph:
    """Make ingested files an edge table of the graph."""
    rows = graph.spark.read.parquet(path)
    return graph.add_edges(label, rows, (source_table, "_src"), (target_table, "_dst"), key="_id", properties=[c for c in rows.columns if not c.startswith("_")])
