"""The session that the queries and tests use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "sleuthgrid", **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution; on a cluster its master and sizes come from outside."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if "SPARK_MASTER" in os.environ:
        builder = builder.master(os.environ["SPARK_MASTER"])
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
