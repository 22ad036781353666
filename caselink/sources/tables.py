"""Readers and writers of tables and graphs, and probes of a session."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .domain import SCHEMAS


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A case table with its fixed schema; columns that a file lacks are null."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root.rstrip('/')}/{name}.parquet")


def write_table(df: DataFrame, root: str, name: str) -> None:
    """Writes the columns of the fixed schema, cast to its types."""
    df.select(*[df[f.name].cast(f.dataType) for f in SCHEMAS[name].fields]).write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}.parquet")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, parts: int = 32, **options: str) -> DataFrame:
    """A relational table, read in parallel over ranges of a numeric key."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts), **options).load()


def write_graph(nodes: DataFrame, edges: DataFrame, root: str) -> None:
    """Nodes by label and edges by type, so that a query of one type reads only its folder."""
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{root.rstrip('/')}/nodes")
    edges.write.mode("overwrite").partitionBy("rel_type").parquet(f"{root.rstrip('/')}/edges")


def read_graph(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = spark.read.parquet(f"{root.rstrip('/')}/nodes"), spark.read.parquet(f"{root.rstrip('/')}/edges")
    return nodes.select("node_id", "label", "station_id", "props"), edges.select("edge_id", "src", "dst", "rel_type", "weight")


def probe(spark: SparkSession) -> str:
    """UP if the session runs a job, else DOWN."""
    try:
        return "UP" if spark.range(1).count() == 1 else "DEGRADED"
    except Exception:
        return "DOWN"


def scrub(message: str, secrets: tuple[str, ...] = ()) -> str:
    """An error text without known secrets and key patterns."""
    for s in secrets:
        if s:
            message = message.replace(s, "***")
    return re.sub(r"(gsk_|csk-|sk-)[A-Za-z0-9_-]{8,}|(?i:bearer)\s+[A-Za-z0-9._-]+", "***", message)
