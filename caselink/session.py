"""Session factory with the settings the engine is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "caselink", master: str | None = None, **conf: str) -> SparkSession:
    """AQE, skew-join splitting and UTC; `conf` keys use `_` for `.`."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
