"""A session with the settings that the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "concordia", **settings: str) -> SparkSession:
    """A session with AQE, Arrow and UTC; further settings by name with '_' for '.'.

    On a cluster leave ``master`` out and size spark.sql.shuffle.partitions so that a
    partition holds 100 to 200 MB; AQE coalesces what turns out smaller.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**fixed, **{k.replace("_", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
