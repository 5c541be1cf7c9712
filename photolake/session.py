"""Session settings that the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "photolake", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC times and bounded Arrow batches; ``conf`` overrides."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.ui.enabled": "false",
    } | {k: str(v) for k, v in conf.items()}
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()
