"""The session that the engine's plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(app: str = "brindle", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in {**CONF, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
