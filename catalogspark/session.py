"""Session settings shared by the entry points, the tests and the benchmark."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "catalogspark", master: str | None = None, **conf: str) -> SparkSession:
    """The active session, or a new one with UTC and adaptive execution on.

    A cluster's own settings win: only what is unset is filled in.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
