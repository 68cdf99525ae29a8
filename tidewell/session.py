"""Session settings for runs outside a managed cluster."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "tidewell", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with UTC time, adaptive execution and as many shuffle partitions as cores. On a cluster, use the session that it gives."""
    n = os.cpu_count() if cores == "*" else int(cores)
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("TIDEWELL_DRIVER_MEMORY", "8g"),
    }.items():
        builder = builder.config(k, conf.pop(k, v))
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
