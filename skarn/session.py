"""Session defaults: adaptive execution, UTC, Arrow."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "skarn", **conf: str) -> SparkSession:
    """The active session, or a new one with the defaults; a master must come from the environment or ``conf``."""
    builder = SparkSession.builder.appName(name)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
