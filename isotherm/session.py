"""The Spark session that tests, the benchmark and scripts share."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "isotherm", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC, ANSI and adaptive execution on. Settings of a running session are kept."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    b = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()
