"""Sessions with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(name: str = "episodica", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; other settings are left to the cluster."""
    builder = SparkSession.builder.appName(name)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
