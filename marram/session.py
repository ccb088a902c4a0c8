"""The session that the library's queries expect: UTC, adaptive execution, Arrow."""

from __future__ import annotations

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "marram", **conf: str) -> SparkSession:
    """The running session, or a new one; ``conf`` has dots written as double underscores."""
    builder = SparkSession.builder.appName(app)
    for key, value in (CONF | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
