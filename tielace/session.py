"""Session defaults: UTC, adaptive execution, Arrow."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "tielace", cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster use the one that is there."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("TIELACE_DRIVER_MEMORY", "8g"),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    session = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
