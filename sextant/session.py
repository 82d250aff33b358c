"""Session construction with the settings the engine is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "sextant", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and a fixed UTC time zone; anything set in ``conf`` wins."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
