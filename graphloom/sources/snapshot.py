"""A graph snapshot as Parquet: nodes and edges, split by type so that a query over few types reads those only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Replace the snapshot at ``path``; it must not be what ``nodes`` or ``edges`` are read from."""
    nodes.write.mode("overwrite").partitionBy("type").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str, edge_types: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the snapshot; with ``edge_types`` only the folders of those are listed and read."""
    edges = spark.read.parquet(f"{path}/edges")
    return spark.read.parquet(f"{path}/nodes"), edges.filter(edges["type"].isin(*edge_types)) if edge_types else edges
