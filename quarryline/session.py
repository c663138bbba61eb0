"""A session with the settings the library is tested under."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "quarryline", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; everything else is the cluster's to say."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true"}
    return builder.config(map=settings | conf).getOrCreate()
