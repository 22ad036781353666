"""Table loading and helpers of the corpus operators, on top of the engine's shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..store import components, cut, drop_shared, new_path, ranked, shared_dir, shuffled

__all__ = ["components", "cut", "drop_shared", "free_names", "load", "new_path", "ranked", "shared_dir", "shuffled"]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that df does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
