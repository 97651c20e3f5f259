"""Sessions with the settings that results depend on."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def get_session(master: str | None = None, **options: str) -> SparkSession:
    """A session in UTC with adaptive execution; options are Spark settings with ``_`` for ``.``."""
    builder = SparkSession.builder.appName("tracewell")
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (settings | {re.sub("_(?=[a-z])", ".", k): v for k, v in options.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
