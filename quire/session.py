"""Session defaults for stand-alone use; a caller's own session is never changed."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "quire", cpus: int | None = None, memory: str = "4g", **conf: str) -> SparkSession:
    """A local session in UTC with adaptive planning. On a cluster, submit with the cluster's own settings."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
