"""Session defaults for local runs; a cluster brings its own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local(cores: int | str = "*", app: str = "narrata", **more: str) -> SparkSession:
    """A local session: UTC, adaptive execution, few shuffle partitions."""
    n = os.cpu_count() if cores == "*" else int(cores)
    conf = {
        "spark.master": f"local[{cores}]",
        "spark.app.name": app,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(n),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | more
    return SparkSession.builder.config(map=conf).getOrCreate()
