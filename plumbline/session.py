"""A session with the settings that the operators expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_or_create(app: str = "plumbline", cores: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """ANSI mode and adaptive execution on, UTC; local unless a master is configured outside."""
    n = cores or os.cpu_count() or 4
    b = SparkSession.builder.appName(app)
    if "SPARK_MASTER" not in os.environ:
        b = b.master(f"local[{n}]").config("spark.driver.memory", os.environ.get("PLUMBLINE_MEMORY", "8g"))
    return (
        b.config("spark.sql.shuffle.partitions", str(shuffle_partitions or n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
