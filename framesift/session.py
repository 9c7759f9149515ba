"""The Spark session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "framesift", master: str | None = None, **settings: str) -> SparkSession:
    """A session with adaptive execution and UTC; on a cluster everything else is the cluster's own."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
