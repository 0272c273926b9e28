"""A session with the settings that the engine's results rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "runlens", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution, and what the caller adds; an existing session is reused."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
