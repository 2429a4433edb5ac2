"""The session the engine is meant for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "strataweave", **conf: str) -> SparkSession:
    """A session with adaptive execution (coalescing and skewed joins) and UTC; the master and sizes come from the environment."""
    builder = SparkSession.builder.appName(name)
    for key, value in {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
