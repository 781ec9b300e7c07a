"""Session construction and the settings the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that are safe at any size; a cluster's own settings win over them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    cores = cores or os.cpu_count() or 4
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tidemill").config(map=DEFAULTS)
    builder = builder.config("spark.driver.memory", os.environ.get("TIDEMILL_DRIVER_MEMORY", "8g"))
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
