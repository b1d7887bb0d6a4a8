"""Spark sessions with the settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "strandline", **conf: str) -> SparkSession:
    """UTC, adaptive execution and Arrow; anything else by conf (keys with _ for .)."""
    build = SparkSession.builder.appName(app)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in (base | {k.replace("_", "."): v for k, v in conf.items()}).items():
        build = build.config(key, value)
    return build.getOrCreate()
