"""A session with the settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.scheduler.mode": "FAIR",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "plumbline", master: str | None = None, **more: str) -> SparkSession:
    """The active session or a new one; a master is named for local use only, a cluster brings its own."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | more).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
